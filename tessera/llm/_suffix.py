"""Suffix arrays over word symbols: Larsson-Sadakane refinement and Kasai common prefixes, both as numpy passes.

Packing a sort key and an index into one 64-bit word lets plain ``np.sort`` (vectorised, several times faster than
``argsort``) do all the ordering.
"""

from __future__ import annotations

import numpy as np


def _bits(n: int) -> int:
    return max(1, int(n).bit_length())


def _order(hi: np.ndarray, lo: np.ndarray | None, hi_bits: int, lo_bits: int, n_bits: int) -> np.ndarray:
    """Stable order of the rows by (hi, lo)."""
    m = len(hi)
    if hi_bits + lo_bits + n_bits <= 64:
        key = hi.astype(np.uint64)
        if lo is not None:
            key = (key << np.uint64(lo_bits)) | lo.astype(np.uint64)
        key = (key << np.uint64(n_bits)) | np.arange(m, dtype=np.uint64)
        key.sort()
        return (key & np.uint64((1 << n_bits) - 1)).astype(np.int64)
    return np.argsort(hi, kind="stable") if lo is None else np.lexsort((lo, hi))


def dense_ranks(h: np.ndarray) -> tuple[np.ndarray, int]:
    """Ranks (from 0) of the 64-bit symbols in their numeric order, and how many there are."""
    n = len(h)
    if n == 0:
        return np.zeros(0, np.int32), 0
    u = np.sort(h)
    new = np.empty(n, bool)
    new[0] = True
    np.not_equal(u[1:], u[:-1], out=new[1:])
    u = u[new]
    b = _bits(n)
    if b <= 24:  # order by the leading bits, exact for symbols that differ there
        top = (u >> np.uint64(64 - (64 - b))) if b < 64 else u
        if len(u) == 1 or (top[1:] != top[:-1]).all():
            key = (h >> np.uint64(b) << np.uint64(b)) | np.arange(n, dtype=np.uint64)
            key.sort()
            at = (key & np.uint64((1 << b) - 1)).astype(np.int64)
            lead = key >> np.uint64(b)
            r = np.empty(n, np.int32)
            step = np.empty(n, np.int32)
            step[0] = 0
            np.not_equal(lead[1:], lead[:-1], out=step[1:].view(np.int32), casting="unsafe")
            r[at] = np.cumsum(step, dtype=np.int32)
            return r, len(u)
    return np.searchsorted(u, h).astype(np.int32), len(u)


def suffix_array(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sa, rank) of a sequence of small non-negative ints; a shorter suffix comes before a longer one it begins.

    Larsson and Sadakane (2007): suffixes are ordered by their first h symbols; groups of equal ones are refined by
    the rank of the suffix h further on, doubling h, and suffixes already alone in their group aren't touched again.
    """
    n = len(ids)
    if n == 0:
        return np.zeros(0, np.int32), np.zeros(0, np.int32)
    nb, vb = _bits(n), _bits(int(ids.max()) + 1)
    nxt = np.zeros(n, np.int64)
    nxt[:-1] = ids[1:].astype(np.int64) + 1
    sa = _order(ids, nxt, vb, vb + 1, nb)
    a, b = ids[sa], nxt[sa]
    head = np.empty(n, bool)
    head[0] = True
    head[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    rank = np.empty(n, np.int32)
    pos = np.arange(n, dtype=np.int32)
    rank[sa] = np.maximum.accumulate(np.where(head, pos, 0))
    sa = sa.astype(np.int32)
    h = 2
    single = head & np.append(head[1:], True)
    act = np.flatnonzero(~single).astype(np.int32)  # positions of sa in groups of more than one
    padded = np.zeros(n + 1, np.int32)
    while len(act):
        suf = sa[act]
        grp = rank[suf]
        np.add(rank, 1, out=padded[:n])
        far = padded[np.minimum(suf.astype(np.int64) + h, n)]
        o = _order(grp, far, nb, nb, _bits(len(act)))
        suf, grp, far = suf[o], grp[o], far[o]
        sa[act] = suf
        m = len(act)
        head = np.empty(m, bool)
        head[0] = True
        head[1:] = (grp[1:] != grp[:-1]) | (far[1:] != far[:-1])
        rank[suf] = np.maximum.accumulate(np.where(head, act, 0))
        single = head & np.append(head[1:], True)
        act = act[~single]
        h *= 2
    return sa, rank


def _common(x: np.ndarray, i: int, j: int) -> int:
    """Length of the common prefix of x[i:] and x[j:]; the last symbol of x is unlike all others."""
    start, size, last = i, 64, len(x) - 1
    while True:
        m = min(size, last - i, last - j)
        if m <= 0:
            return i - start
        differ = np.flatnonzero(x[i : i + m] != x[j : j + m])
        if len(differ):
            return i + int(differ[0]) - start
        i, j, size = i + m, j + m, 2 * size


def lcp_array(ids: np.ndarray, sa: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """lcp[r] = common prefix of the suffixes sa[r-1] and sa[r]; lcp[0] = 0.

    Kasai's order of computation: by text position, where plcp[i] >= plcp[i-1] - 1.  Positions whose left neighbours
    agree too are exactly plcp[i-1] - 1 (reducible), so only the others are compared, all at once, and the rest is
    filled in by a running maximum of position.
    """
    n = len(ids)
    if n == 0:
        return np.zeros(0, np.int32)
    phi = np.empty(n, np.int32)
    phi[sa[1:]] = sa[:-1]
    phi[sa[0]] = -1
    left = np.empty(n, bool)
    left[0] = True
    p = phi[1:]
    left[1:] = (p <= 0) | (ids[:-1] != ids[np.maximum(p, 1) - 1])
    at = np.flatnonzero(left & (phi >= 0))
    plcp = np.zeros(n, np.int32)
    x = np.append(ids.astype(np.int64), -1)
    i, j, live, ln = at.copy(), phi[at].astype(np.int64), np.arange(len(at)), np.zeros(len(at), np.int32)
    while len(live) > 256:
        same = (i < n) & (j < n)
        same &= x[np.minimum(i, n)] == x[np.minimum(j, n)]
        live, i, j = live[same], i[same] + 1, j[same] + 1
        ln[live] += 1
    for k, p, q in zip(live.tolist(), i.tolist(), j.tolist()):  # the few long ones, by slices that double
        ln[k] += _common(x, p, q)
    plcp[at] = ln
    src = np.where(left, np.arange(n, dtype=np.int32), 0)
    np.maximum.accumulate(src, out=src)
    plcp = np.maximum(plcp[src] - (np.arange(n, dtype=np.int32) - src), 0)
    lcp = np.zeros(n, np.int32)
    lcp[rank] = plcp
    return lcp
