"""Numpy kernels for vectors: normalisation, Walsh-Hadamard transform, block quantization, product-quantizer tables.

All take matrices (a vector a row), so an Arrow batch costs a few array operations.
"""

from __future__ import annotations

import numpy as np

BLOCK = 32
#: Bytes of the distances that ``nearest`` makes at once.
NEAR_BYTES = 2 << 20


def l2_normalize(m: np.ndarray) -> np.ndarray:
    """Unit rows; rows shorter than 1e-10 become zero."""
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.where(n < 1e-10, 0, m / np.where(n < 1e-10, 1, n))


def next_pow2(n: int) -> int:
    return 1 << max(0, (n - 1).bit_length())


def fwht(m: np.ndarray) -> np.ndarray:
    """Unnormalised fast Walsh-Hadamard transform of every row (length a power of two)."""
    m = np.array(m, np.float64)
    rows, n = m.shape
    h = 1
    while h < n:
        x = m.reshape(rows, n // (2 * h), 2, h)
        m = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(rows, n)
        h *= 2
    return m


def pad_and_transform(m: np.ndarray) -> np.ndarray:
    """Rows padded with zeros to a power of two and transformed by the unitary Walsh-Hadamard matrix."""
    n = max(BLOCK, next_pow2(m.shape[1]))
    out = np.zeros((len(m), n))
    out[:, : m.shape[1]] = m
    return fwht(out) / np.sqrt(n)


def code_bytes(dim: int, bits: int) -> int:
    """Bytes of a quantized vector: per block of 32 scale, zero and norm as floats, then the codes."""
    blocks = max(BLOCK, next_pow2(dim)) // BLOCK
    return blocks * (12 + BLOCK * bits // 8)


def quantize(m: np.ndarray, bits: int = 8) -> list[bytes]:
    """Transformed rows, each block of 32 scaled to 0 .. 2**bits - 1 (half away from zero)."""
    t = pad_and_transform(m).astype(np.float32)
    b = t.reshape(len(t), -1, BLOCK)
    lo, hi = b.min(2), b.max(2)
    top = (1 << bits) - 1
    scale = ((hi - lo) / top).astype(np.float32)
    safe = np.where(scale > 0, scale, 1)
    codes = np.clip(np.floor((b - lo[:, :, None]) / safe[:, :, None] + 0.5), 0, top).astype(np.uint8)
    codes[scale == 0] = 0
    if bits == 4:
        codes = (codes[:, :, 0::2] << 4) | codes[:, :, 1::2]  # high nibble first
    head = np.stack([scale, lo, np.linalg.norm(b, axis=2).astype(np.float32)], axis=2).astype("<f4")
    raw = np.concatenate([head.view(np.uint8).reshape(len(t), b.shape[1], 12), codes], axis=2)
    return [r.tobytes() for r in raw]


def _unpack(codes: list[bytes], bits: int) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(b"".join(codes), np.uint8).reshape(len(codes), -1, 12 + BLOCK * bits // 8)
    head = np.ascontiguousarray(raw[:, :, :12]).view("<f4")
    q = raw[:, :, 12:]
    if bits == 4:
        q = np.stack([q >> 4, q & 15], axis=3).reshape(len(codes), raw.shape[1], BLOCK)
    return head, q


def dequantize(codes: list[bytes], dim: int, bits: int = 8) -> np.ndarray:
    head, q = _unpack(codes, bits)
    t = (q * head[:, :, :1] + head[:, :, 1:2]).reshape(len(codes), -1)
    return (fwht(t) / np.sqrt(t.shape[1]))[:, :dim]


def dot_quantized(codes: list[bytes], query: np.ndarray, bits: int = 8) -> np.ndarray:
    """Dot products in the transformed space: scale * (codes . q) + zero * sum(q) per block."""
    head, q = _unpack(codes, bits)
    t = pad_and_transform(query[None, :])[0].reshape(-1, BLOCK)
    part = np.einsum("nbk,bk->nb", q.astype(np.float32), t.astype(np.float32))
    return (part * head[:, :, 0] + head[:, :, 1] * t.sum(1)).sum(1).astype(np.float64)


def dot_quantized_batch(codes: list[bytes], queries: np.ndarray, bits: int = 8) -> np.ndarray:
    """``dot_quantized`` of every row of ``queries``: a row a query, a column a code."""
    head, q = _unpack(codes, bits)
    t = (q * head[:, :, :1] + head[:, :, 1:2]).reshape(len(codes), -1)
    return pad_and_transform(queries) @ t.T.astype(np.float64)


def dot_upper_bound(codes: list[bytes], query: np.ndarray, bits: int = 8) -> np.ndarray:
    """Cauchy-Schwarz bound of ``dot_quantized`` from the stored block norms (up to quantization error)."""
    head, _ = _unpack(codes, bits)
    t = pad_and_transform(query[None, :])[0].reshape(-1, BLOCK)
    return (head[:, :, 2] * np.linalg.norm(t, axis=1)).sum(1).astype(np.float64)


def kmeans(x: np.ndarray, k: int, iterations: int = 25, seed: int = 42) -> np.ndarray:
    """Centroids by k-means++ and Lloyd's iterations (of a bounded training sample)."""
    rng = np.random.default_rng(seed)
    x = np.asarray(x, np.float64)
    k = min(k, len(x))
    c = np.empty((k, x.shape[1]))
    c[0] = x[rng.integers(len(x))]
    d = ((x - c[0]) ** 2).sum(1)
    for i in range(1, k):
        p = d / d.sum() if d.sum() > 0 else None
        c[i] = x[rng.choice(len(x), p=p)]
        d = np.minimum(d, ((x - c[i]) ** 2).sum(1))
    for _ in range(iterations):
        a = nearest(x, c)
        n = np.bincount(a, minlength=k)
        s = np.zeros_like(c)
        np.add.at(s, a, x)
        new = np.where(n[:, None] > 0, s / np.maximum(n, 1)[:, None], c)
        if np.allclose(new, c):
            break
        c = new
    return c


def sq_dist(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x**2).sum(1)[:, None] - 2 * x @ c.T + (c**2).sum(1)[None, :], 0)


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    if x.shape[1] == 1 and len(c):  # between the middles of neighbours
        o = np.argsort(c[:, 0], kind="stable")
        return o[np.searchsorted((c[o[1:], 0] + c[o[:-1], 0]) / 2, x[:, 0])]
    rows = max(1, NEAR_BYTES // (8 * max(1, len(c))))  # distances of so many at once
    return np.concatenate([sq_dist(x[at : at + rows], c).argmin(1) for at in range(0, max(1, len(x)), rows)])


def train_pq(residuals: np.ndarray, parts: int, codes: int = 256, seed: int = 42) -> np.ndarray:
    """Product-quantizer codebook (parts, codes, dim / parts)."""
    sub = residuals.reshape(len(residuals), parts, -1)
    books = [kmeans(sub[:, i], codes, 20, seed + i) for i in range(parts)]
    n = min(map(len, books))
    return np.stack([b[:n] for b in books])


def encode_pq(residuals: np.ndarray, book: np.ndarray) -> np.ndarray:
    sub = residuals.reshape(len(residuals), book.shape[0], -1)
    return np.stack([nearest(sub[:, i], book[i]) for i in range(book.shape[0])], 1).astype(np.uint8)


def decode_pq(codes: np.ndarray, book: np.ndarray) -> np.ndarray:
    return book[np.arange(book.shape[0])[None, :], codes].reshape(len(codes), -1)


def adc(codes: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Sum over parts of table[part, code]."""
    return table[np.arange(table.shape[0])[None, :], codes].sum(1)


def sq_dist_rows(m: np.ndarray, q: np.ndarray) -> np.ndarray:
    return ((m - q) ** 2).sum(1)
