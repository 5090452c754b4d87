"""Vectorised tokenisation: UTF-8 buffers to 64-bit word hashes, without a Python object per word.

A token is a maximal run of characters other than ASCII white space.  Its identity is the 64-bit hash of its letters
and digits: ASCII punctuation is deleted, case is folded (``utf8_lower``), other scripts' characters count as letters.
Tokens without a letter or digit vanish.  Word positions count the remaining tokens of a text from 0.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_SPACE = b" \t\n\r\x0b\x0c"
_PUNCT = bytes(c for c in range(128) if c not in _SPACE and not chr(c).isalnum())
_TO_SPACE = bytes(32 if c in _SPACE else c for c in range(256))
_IS_PUNCT = bytes(c in _PUNCT for c in range(256))
_RUN, _LETTER = re.compile("[^ \t\n\r\x0b\x0c]+"), re.compile("[0-9A-Za-z\x80-\U0010ffff]")


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser; ``x`` is uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def runs(r: np.ndarray) -> Iterator[tuple[int, slice]]:
    """(value, slice) of the runs of equal values of an array: of a sorted one the values that occur, however far they go."""
    if len(r):
        head = np.flatnonzero(np.append(True, r[1:] != r[:-1]))
        for a, z in zip(head.tolist(), np.append(head[1:], len(r)).tolist()):
            yield int(r[a]), slice(a, z)


def range_of(h: np.ndarray, ranges: int) -> np.ndarray:
    """Range of a hash, from its upper 32 bits."""
    return ((h >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)


_STEP = 65535


def pack(x: np.ndarray) -> bytes:
    """Ascending distinct numbers as 16-bit differences; 65535 adds to the next one."""
    d = np.diff(x, prepend=0)
    far = d // _STEP
    out = np.full(len(x) + int(far.sum()), _STEP, np.uint16)
    out[np.cumsum(far + 1) - 1] = d % _STEP
    return out.tobytes()


def unpack(b: bytes) -> np.ndarray:
    d = np.frombuffer(b, np.uint16)
    return np.cumsum(d, dtype=np.int64)[d != _STEP]


@dataclass
class Words:
    """``hash`` and ``doc`` (index of the text) per token; ``first[d]:first[d+1]`` are those of text d."""

    hash: np.ndarray
    doc: np.ndarray
    first: np.ndarray


def buffers(col) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (from 0) of a string array; nulls are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], pa.string())
    col = pc.fill_null(col, "").cast(pa.large_string())
    n = len(col)
    _, off, dat = col.buffers()
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    o = np.frombuffer(off, np.int64, n + 1, offset=col.offset * 8)
    d = np.frombuffer(dat, np.uint8)[o[0] : o[-1]] if dat is not None and o[-1] > o[0] else np.zeros(0, np.uint8)
    return d, o - o[0]


def words(col) -> Words:
    """Tokens of every text of a string array."""
    if isinstance(col, pa.ChunkedArray):
        col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], pa.string())
    raw, off = buffers(pc.utf8_lower(col))
    if len(raw) == 0:
        return Words(np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(len(off), np.int64))
    low = raw.tobytes()
    gone = np.frombuffer(low.translate(_IS_PUNCT), np.uint8)
    gone = np.append(gone, 0)
    per = np.add.reduceat(gone, off[:-1], dtype=np.int64)
    per[off[1:] == off[:-1]] = 0
    off = off - np.concatenate([[0], np.cumsum(per)])
    low = low.translate(_TO_SPACE, _PUNCT)
    n = len(low)
    data = np.frombuffer(low + b" " * 8, np.uint8)
    solid = data[:n] != 32
    edge = np.zeros(n + 1, bool)
    if n:
        edge[0], edge[n] = solid[0], solid[-1]
        np.not_equal(solid[1:], solid[:-1], out=edge[1:n])
    cut = off[1:-1]
    cut = cut[(cut > 0) & (cut < n)]
    cut = np.unique(cut[solid[cut] & solid[cut - 1]])  # a text begins in the middle of a run
    marks = np.flatnonzero(edge)
    if len(cut):
        marks = np.sort(np.concatenate([marks, cut, cut]), kind="stable")
    start, size = marks[0::2], marks[1::2] - marks[0::2]
    eight = np.ndarray((n + 1,), "<u8", data, 0, (1,))  # the 8 bytes from every byte on
    h = eight[start] & _MASK[np.minimum(size, 8)]
    h ^= size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h = mix(h)
    live, at = np.flatnonzero(size > 8), 8
    while len(live):
        left = size[live] - at
        h[live] = mix(h[live] ^ (eight[start[live] + at] & _MASK[np.minimum(left, 8)]))
        live, at = live[left > 8], at + 8
    first = np.searchsorted(start, off)
    return Words(h, np.repeat(np.arange(len(off) - 1, dtype=np.int32), np.diff(first)), first)


_MASK = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)


def token_spans(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Character starts and ends of the tokens that ``words`` finds in one text, in time linear in it."""
    s = [m.span() for m in _RUN.finditer(text or "") if _LETTER.search(text, *m.span())]
    a = np.array(s, np.int64).reshape(-1, 2)
    return a[:, 0], a[:, 1]


def rolling(h: np.ndarray, k: int) -> np.ndarray:
    """64-bit fingerprints of all k-word windows (len(h) - k + 1 of them, none if shorter)."""
    n = len(h)
    if n < k:
        return np.zeros(0, np.uint64)
    out = np.zeros(n - k + 1, np.uint64)
    odd = np.uint64(0xD1342543DE82EF95)
    if k <= 8:
        for j in range(k):
            out *= odd
            out += h[j : n - k + 1 + j]
        return mix(out)
    p = powers(int(odd), n + 1)
    c = np.empty(n + 1, np.uint64)
    c[0] = 0
    np.cumsum(h * p[:n], out=c[1:])
    inv = powers(pow(int(odd), -1, 1 << 64), n - k + 1)
    return mix((c[k:] - c[: n - k + 1]) * inv)


def windows_in_doc(first: np.ndarray, n: int, k: int) -> np.ndarray:
    """True where the k-word window that starts at this word stays inside its text; length n - k + 1."""
    m = n - k + 1
    if m <= 0:
        return np.zeros(0, bool)
    left = np.repeat(first[1:], np.diff(first)) - np.arange(n)
    return left[:m] >= k
