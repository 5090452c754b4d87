"""Operator 7, n-gram Jaccard join: vertical partitioning of the n-gram order.

For every document: its class (documents connected by similar pairs) and its number of links (other documents whose sets of word
n-grams have a Jaccard similarity of at least ``threshold`` with its own), exactly.

1. Rows of equal text are one text with a count, so copies are never compared.  Each group of texts sends its distinct n-grams,
   about 2 bytes each in ranges of their hash; a range tells each group which of them other groups have, and how many.  A text
   of which fewer than threshold * size n-grams occur elsewhere has no partner and is left out; from the others, n-grams that
   occur nowhere else are.
2. In the global order (rarest first) a similar pair shares an n-gram of both prefixes (size - ceil(threshold * size) + 1).  Prefix
   n-grams link texts whose sizes and numbers of shared n-grams allow it, a linear number of links; the components bring texts
   that may be similar side by side, and the sequence is cut to blocks of bounded bytes.  Two blocks meet only if they share a
   prefix n-gram.
3. The global n-gram order is cut into FRAGMENTS.  Each fragment counts the overlaps of two blocks' texts for itself (products of
   incidence matrices) and drops pairs that can't reach the threshold whatever the other fragments hold; the partial counts
   are summed per pair and compared with the threshold.  A pair leaves the sum as a unit of two link counts and, if it's in the
   blocks' spanning forest, an edge: what is shuffled from there on is linear in the texts.

Counting the links of k different texts that are all similar takes k * k / 2 counts, in tiles; no less would tell how many there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import cut, integer_ids, need, text_bytes, trim
from ._text import mix, pack, range_of, rolling, runs, unpack, windows_in_doc, words
from .components import components, forest

N = 3
THRESHOLD = 0.5
GROUP_BYTES = 3 << 20
RANGE_BYTES = 32 << 20
#: A block of texts that are counted together holds about this many, and bytes of n-grams, at most.
TILE, BLOCK_BYTES = 1024, 2 << 20
#: Ranges of the n-gram order, counted apart.
FRAGMENTS = 4
_NONE = (1 << 63) - 1  # in place of a null id: it's never the least


def raw_grams(texts, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, gram) of every gram of a string array, repeats included.

    A text of fewer than n words, but one at least, has one gram: all of it.
    """
    w = words(texts)
    at = np.flatnonzero(windows_in_doc(w.first, len(w.hash), n))
    gram, row = [rolling(w.hash, n)[at]], [w.doc[at]]
    size = np.diff(w.first)
    for k in range(1, n):
        short = np.flatnonzero(size == k)
        gram.append(rolling_rows(w.hash, w.first[short], k))
        row.append(short.astype(np.int32))
    return np.concatenate(row), np.concatenate(gram)


def _packed_order(key: np.ndarray, bits: int) -> np.ndarray:
    """Stable order by the leading 64 - b bits of a hash (or by a number of ``bits`` bits), b those of an index."""
    b = max(1, int(len(key)).bit_length())
    low = np.uint64((1 << b) - 1)
    x = (key & ~low) if bits == 64 else (key.astype(np.uint64) << np.uint64(b))
    x = x | np.arange(len(key), dtype=np.uint64)
    x.sort()
    return (x & low).astype(np.int64)


def gram_sets(ids: np.ndarray, texts, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(unique ids, document index, gram number, sorted unique grams): each document's distinct grams; rows of one id are united."""
    row, gram = raw_grams(texts, n)
    unique, which = np.unique(ids, return_inverse=True)
    if not len(gram):
        return unique, np.zeros(0, np.int64), np.zeros(0, np.int64), gram
    o = _packed_order(gram, 64)
    x = gram[o]
    if (x[1:] < x[:-1]).any():  # grams that agree in all leading bits
        o = np.argsort(gram, kind="stable")
        x = gram[o]
    new = np.append(True, x[1:] != x[:-1])
    number = np.cumsum(new) - 1
    doc = which[row[o]].astype(np.int64)
    again = _packed_order(doc, 32)
    doc, number = doc[again], number[again]
    first = np.append(True, (doc[1:] != doc[:-1]) | (number[1:] != number[:-1]))
    return unique, doc[first], number[first], x[new]


def rolling_rows(h: np.ndarray, start: np.ndarray, k: int) -> np.ndarray:
    """Fingerprints of the k words from each start, salted with k."""
    if not len(start):
        return np.zeros(0, np.uint64)
    m = h[start[:, None] + np.arange(k)].ravel()
    return rolling(m, k)[::k] ^ np.uint64(0x5851F42D4C957F2D * k % (1 << 64))


def _blobs(name: str, kinds: list, rows: list[tuple]) -> pa.Table:
    return pa.table([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=name.split())


def _ints(x, kind) -> np.ndarray:
    return np.frombuffer(x.as_py(), kind)


#: Bits of a gram that are sent within its range.  Two grams that share them are counted as one, which only makes the exact step
#: see a few more n-grams.
LOW = 28


def _low(gram: np.ndarray) -> np.ndarray:
    return (gram & np.uint64((1 << LOW) - 1)).astype(np.int64)


def rarity(count: np.ndarray) -> np.ndarray:
    """Counts as classes of a byte, in their order."""
    return np.minimum(12 * np.log2(count), 255).astype(np.uint8)


def _distinct(t: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    """A row of each text of a group (in order of its hashes), how many rows have it, and the least doc_id of those."""
    a, b = t["a"].to_numpy(), t["b"].to_numpy()
    ids = t["doc_id"].combine_chunks().fill_null(_NONE).to_numpy(zero_copy_only=False)
    o = np.lexsort((ids, b, a))
    head = np.flatnonzero(np.append(True, (a[o][1:] != a[o][:-1]) | (b[o][1:] != b[o][:-1])))
    return t.take(pa.array(o[head])), np.diff(np.append(head, len(o))), ids[o[head]]


_SENT, _TOLD = "r int, p int, data binary", "p int, r int, data binary, counts binary"
_FOUND = "key bigint, a bigint, b bigint, doc bigint, copies bigint, size int, shared int, prefix int, near bigint, grams binary"


def signed(docs: DataFrame) -> DataFrame:
    """(doc_id, a, b, text): rows with a text and two independent hashes of it, which tell texts apart."""
    base = integer_ids(need(docs, "doc_id", "text")).where("text is not null")
    return base.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("a"), F.xxhash64(F.lit(1), F.col("text")).alias("b"), "text")


def candidates(docs: DataFrame, n: int, threshold: float) -> DataFrame:
    """Texts that may have a partner or have copies, each once, with the n-grams that other texts have too, rarest first.

    ``key`` is a number of the text, ``doc`` the least id of its ``copies`` rows, ``near`` the least of its n-grams.
    """
    base = signed(docs)
    _, size = text_bytes(base)
    groups, ranges = max(1, -(-size // GROUP_BYTES)), max(4, -(-size // RANGE_BYTES))
    # rows that are alike in id and text are spread by the partition they come from, so that no group is hot
    base = base.withColumn("p", F.pmod(F.xxhash64("doc_id", "a", F.spark_partition_id()), F.lit(groups)).cast("int"))

    def send(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        t, count, least = _distinct(t)
        p, (row, gram) = key[0].as_py(), raw_grams(t["text"], n)
        gram = np.sort(gram)
        rows = [(i, p, pack(np.unique(_low(gram[s])))) for i, s in runs(range_of(gram, ranges))]
        some = np.unique(row)  # texts with words
        a = t["a"].to_numpy()[some].view(np.uint64)
        o = np.argsort(a, kind="stable")
        some, a = some[o], a[o]
        sign = np.stack([a.view(np.int64), t["b"].to_numpy()[some], least[some], count[some]], 1)
        rows += [(ranges + i, p, np.ascontiguousarray(sign[s]).tobytes()) for i, s in runs(range_of(a, ranges))]
        trim()
        return _blobs("r p data", [pa.int32(), pa.int32(), pa.binary()], rows)

    def meet(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        rows = list(_texts_met(t)) if key[0].as_py() >= ranges else list(_grams_met(key[0].as_py(), t))
        trim()
        return _blobs("p r data counts", [pa.int32(), pa.int32(), pa.binary(), pa.binary()], rows)

    def _texts_met(t: pa.Table) -> Iterator[tuple]:
        """One group of those that have a text answers for it, with its least id and all its copies."""
        parts = [_ints(x, np.int64).reshape(-1, 4) for x in t["data"]]
        x, p = np.concatenate(parts), np.repeat(t["p"].to_numpy(), [len(y) for y in parts])
        o = np.lexsort((p, x[:, 1], x[:, 0]))
        x, p = x[o], p[o]
        head = np.flatnonzero(np.append(True, (x[1:, :2] != x[:-1, :2]).any(1)))
        one = x[head]
        one[:, 2], one[:, 3] = np.minimum.reduceat(x[:, 2], head), np.add.reduceat(x[:, 3], head)
        place = np.arange(len(head))
        number = np.maximum.accumulate(one[:, 0] - place) + place  # the first hash, and the next free number where two texts share it
        one, p = np.column_stack([number, one]), p[head]
        o = np.argsort(p, kind="stable")
        for who, s in runs(p[o]):
            yield who, -1, np.ascontiguousarray(one[o[s]]).tobytes(), b""

    def _grams_met(r: int, t: pa.Table) -> Iterator[tuple]:
        many = np.zeros(1 << LOW >> 3, np.uint8)  # 32 MB: which numbers two groups have
        sets = [unpack(x.as_py()).astype(np.int32) for x in t["data"]]
        x = np.concatenate(sets)
        x.sort()
        head = np.flatnonzero(np.append(True, x[1:] != x[:-1]))
        count = np.diff(np.append(head, len(x)))
        value, count = x[head][count > 1], rarity(count[count > 1])
        np.bitwise_or.at(many, value >> 3, np.left_shift(1, value & 7).astype(np.uint8))
        for p, run in zip(t["p"], sets):
            run = run[(many[run >> 3] >> (run & 7).astype(np.uint8) & 1).astype(bool)]
            if len(run):
                yield p.as_py(), r, pack(run), count[np.searchsorted(value, run)].tobytes()

    def keep(key: tuple[pa.Scalar, ...], t: pa.Table, known: pa.Table) -> pa.Table:
        rows = list(_kept(t, known)) if t.num_rows and known.num_rows else []
        trim()
        return _blobs(" ".join(x.split()[0] for x in _FOUND.split(", ")), [*[pa.int64()] * 5, *[pa.int32()] * 3, pa.int64(), pa.binary()], rows)

    def _kept(t: pa.Table, known: pa.Table) -> Iterator[tuple]:
        told = dict(enumerate(known["r"].to_pylist()))
        mine = [_ints(known["data"][i], np.int64).reshape(-1, 5) for i, r in told.items() if r < 0]
        if not mine:
            return
        mine = np.concatenate(mine)
        mine = mine[np.lexsort((mine[:, 2], mine[:, 1]))]  # number, a, b, least id, copies
        t, _, _ = _distinct(t)
        here = np.stack([t["a"].to_numpy(), t["b"].to_numpy()], 1)
        both = np.concatenate([here, mine[:, 1:3]])
        _, which = np.unique(both, axis=0, return_inverse=True)
        which = which.ravel()
        t = t.take(pa.array(np.flatnonzero(np.isin(which[: len(here)], which[len(here) :]))))
        _, doc, number, gram = gram_sets(np.arange(t.num_rows), t["text"], n)
        # class of how many groups have each gram: -1 where only this one has
        cls = np.full(len(gram), -1, np.int64)
        span = dict(runs(range_of(gram, ranges)))
        for i, r in told.items():
            if r in span:
                s = span[r]
                x, low = unpack(known["data"][i].as_py()), _low(gram[s])
                at = np.searchsorted(x, low)
                at[at == len(x)] = 0
                hit = x[at] == low
                cls[s][hit] = _ints(known["counts"][i], np.uint8)[at[hit]]
        common = (np.bincount(number, minlength=len(gram)) > 1) | (cls >= 0)
        size = np.bincount(doc, minlength=t.num_rows)
        pick = common[number]
        had = np.bincount(doc[pick], minlength=t.num_rows)
        least = np.ceil(threshold * size - 1e-9).astype(np.int64)
        ok = (had >= np.maximum(least, 1)) & (size > 0)
        pick &= ok[doc]
        doc, number = doc[pick], number[pick]
        o = _packed_order((doc << 9) + cls[number] + 1, 40)  # within a class by number, that is by gram
        doc, grams = doc[o], gram[number[o]]
        edge = np.searchsorted(doc, np.arange(t.num_rows + 1))
        for d in np.flatnonzero(ok | (mine[:, 4] > 1)):
            x = grams[edge[d] : edge[d + 1]]
            prefix = had[d] - least[d] + 1 if ok[d] else 0
            near = int(x.min().view(np.int64)) if len(x) else 0
            yield *(int(v) for v in mine[d, :3]), None if mine[d, 3] == _NONE else int(mine[d, 3]), int(mine[d, 4]), int(size[d]), int(had[d]), int(prefix), near, x.tobytes()

    by = base.groupBy("p")
    known = by.applyInArrow(send, _SENT).groupBy("r").applyInArrow(meet, _TOLD)
    return cut(by.cogroup(known.groupBy("p")).applyInArrow(keep, _FOUND))


def chains(gram: np.ndarray, size: np.ndarray, top: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows (i, j) to link, so that all rows of one gram that may be similar are connected; linear in the rows.

    ``top`` is the largest size of a partner: an overlap of t / (1 + t) * (size + other) needs that many shared grams.  Rows i
    and j may be similar if each one's size is at most the other's top.  Of such two, the smaller has top >= its own size (call it
    solid).  Each row is linked to the solid row of the largest top among those of at most its size (or of at most its top, if
    that's less): any other solid row that may be similar to it has its own link into the same set of rows whose tops
    are at least its size, and the first of that set needs none.
    """
    n = len(gram)
    o = np.lexsort((size, gram))
    g, sz, tp = gram[o], size[o].astype(np.int64), top[o].astype(np.int64)
    seg = np.cumsum(np.append(True, g[1:] != g[:-1])) - 1
    big = int(max(sz.max(), tp.max())) + 2
    key = seg * big + np.where(tp >= sz, tp, -1) + 1
    run = np.maximum.accumulate(key)
    fresh = np.append(True, run[1:] != run[:-1])
    arg = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    upto = np.minimum(np.arange(n) - 1, np.searchsorted(seg * big + sz, seg * big + np.minimum(tp, sz), side="right") - 1)
    upto = np.maximum(upto, 0)
    best = arg[upto]
    ok = (seg[best] == seg) & (best < np.arange(n)) & (tp[best] >= sz) & (tp[best] >= sz[best])
    return o[np.flatnonzero(ok)], o[best[ok]]


def _links(found: DataFrame, parts: int, threshold: float) -> DataFrame:
    """Edges that connect texts that share a prefix gram and may be similar, reduced to spanning forests."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key, size, shared, k = (b.column(i).to_numpy() for i in range(4))
            top = np.floor(shared * (1 + threshold) / threshold + 1e-6).astype(np.int64) - size
            g = [_ints(x, np.uint64)[:m] for x, m in zip(b.column(4), k)]
            if not g:
                continue
            gram, who = np.concatenate(g), np.repeat(np.arange(len(key)), [len(x) for x in g])
            r = range_of(gram, parts)
            o = np.argsort(r, kind="stable")
            rows = []
            for i, s in runs(r[o]):
                w = who[o[s]]
                rows.append((i, gram[o[s]].tobytes(), key[w].tobytes(), size[w].astype(np.int32).tobytes(), top[w].astype(np.int32).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in rows], pa.int32() if j == 0 else pa.binary()) for j in range(5)], names=["r", "grams", "keys", "sizes", "tops"])

    def link(t: pa.Table) -> pa.Table:
        gram, key, size, top = (np.concatenate([_ints(x, k) for x in t[c]]) for c, k in (("grams", np.uint64), ("keys", np.int64), ("sizes", np.int32), ("tops", np.int32)))
        i, j = chains(gram, size, top)
        a, b = forest(key[i], key[j])
        trim()
        return pa.table([pa.array(a), pa.array(b)], names=["a", "b"])

    sent = found.select("key", "size", "shared", "prefix", "grams").mapInArrow(spread, "r int, grams binary, keys binary, sizes binary, tops binary")
    return sent.groupBy("r").applyInArrow(link, "a bigint, b bigint")


_PLACED = "comp bigint, near bigint, key bigint, copies bigint, size int, shared int, prefix int, grams binary, block bigint, open boolean"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A sorted partition cut into blocks; ``open``: the component begins or ends a block, so it may lie in others too."""
    part, total, held = TaskContext.get().partitionId(), 0.0, []

    def close(t: pa.Table, block: np.ndarray) -> Iterator[pa.RecordBatch]:
        comp = t["comp"].to_numpy()
        for b, s in runs(block):
            c = comp[s]
            x = t.slice(s.start, s.stop - s.start)
            x = x.append_column("block", pa.array(np.full(len(c), (part << 32) + b))).append_column("open", pa.array((c == c[0]) | (c == c[-1])))
            yield from x.combine_chunks().to_batches()

    number = np.zeros(0, np.int64)
    for b in batches:
        if not b.num_rows:
            continue
        w = np.maximum(pa.compute.binary_length(b.column(b.schema.get_field_index("grams"))).to_numpy() / BLOCK_BYTES, 1 / TILE)
        sums = total + np.cumsum(w)
        total = sums[-1]
        held.append(b)
        number = np.concatenate([number, (sums - w).astype(np.int64)])
        done = int(np.searchsorted(number, number[-1]))  # the last block may go on
        if done:
            t = pa.Table.from_batches(held)
            yield from close(t.slice(0, done), number[:done])
            held, number = t.slice(done).to_batches(), number[done:]
    if held:
        yield from close(pa.Table.from_batches(held), number)


def block_pairs(placed: DataFrame, parts: int) -> DataFrame:
    """(bi, bj), bi < bj: blocks with texts of one component that share a prefix gram."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            block, comp, k = (b.column(i).to_numpy() for i in range(3))
            g = [_ints(x, np.uint64)[:m] for x, m in zip(b.column(3), k)]
            if not g:
                continue
            n = [len(x) for x in g]
            gram = np.concatenate(g) ^ mix(np.repeat(comp, n).view(np.uint64))
            both = np.unique(np.stack([gram, np.repeat(block, n).view(np.uint64)], 1), axis=0)
            rows = [(i, np.ascontiguousarray(both[s]).tobytes()) for i, s in runs(range_of(both[:, 0], parts))]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows], pa.int32()), pa.array([x[1] for x in rows], pa.binary())], names=["r", "data"])

    def meet(t: pa.Table) -> pa.Table:
        x = np.unique(np.concatenate([_ints(v, np.uint64).reshape(-1, 2) for v in t["data"]]), axis=0)
        out, k = [np.zeros((0, 2), np.int64)], 1
        while len(at := np.flatnonzero(x[k:, 0] == x[:-k, 0])):  # neighbours, then those two apart, ...
            out.append(np.unique(np.stack([x[at, 1], x[at + k, 1]], 1).view(np.int64), axis=0))
            k += 1
        p = np.unique(np.concatenate(out), axis=0)
        return pa.table([pa.array(p[:, 0]), pa.array(p[:, 1])], names=["bi", "bj"])

    sent = placed.where("open").select("block", "comp", "prefix", "grams").mapInArrow(spread, "r int, data binary")
    return sent.groupBy("r").applyInArrow(meet, "bi bigint, bj bigint").distinct()


_CELL = "bi bigint, bj bigint, frag int, block bigint, comp bigint, key bigint, copies bigint, size int, shared int, grams binary"


def _fragments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every row FRAGMENTS times, each with its grams of one fragment."""
    for b in batches:
        g = [_ints(x, np.uint64) for x in b.column(b.num_columns - 1)]
        if not g:
            continue
        gram, row = np.concatenate(g), np.repeat(np.arange(len(g)), [len(x) for x in g])
        cell = range_of(gram, FRAGMENTS) * len(g) + row
        o = _packed_order(cell, 40)
        edge = np.searchsorted(cell[o], np.arange(FRAGMENTS * len(g) + 1))
        gram = gram[o].astype("<u8").tobytes()
        for f in range(FRAGMENTS):
            e = edge[f * len(g) : (f + 1) * len(g) + 1].tolist()
            part = pa.array([gram[8 * x : 8 * y] for x, y in zip(e, e[1:])], pa.binary())
            cols = list(b.columns[:-1])
            yield pa.RecordBatch.from_arrays([*cols[:2], pa.array(np.full(len(g), f, np.int32)), *cols[2:], part], names=[x.split()[0] for x in _CELL.split(", ")])


def _overlaps(sides: list[tuple[np.ndarray, np.ndarray]], n: list[int]) -> np.ndarray:
    """Overlap counts of two lists of sets ((set number, gram) each), by products of incidence matrices."""
    same = len(sides) == 1
    gram = np.concatenate([g for _, g in sides])
    who = np.concatenate([d + k * n[0] for k, (d, _) in enumerate(sides)])
    o = _packed_order(gram, 64)
    x = gram[o]
    if (x[1:] < x[:-1]).any():
        o = np.argsort(gram, kind="stable")
        x = gram[o]
    head = np.flatnonzero(np.append(True, x[1:] != x[:-1])[: len(x)])
    often = np.diff(np.append(head, len(x)))
    pick = np.repeat(often > 1, often)
    who, often = who[o][pick], often[often > 1]
    place = np.repeat(np.arange(len(often)), often)
    rows = sum(n)
    out = np.zeros((n[0], n[-1]), np.int32)
    step = max(64, (1 << 22) // max(1, rows))
    edge = np.searchsorted(place, np.arange(0, len(often) + step, step))
    for lo, a, z in zip(range(0, len(often), step), edge, edge[1:]):
        m = np.zeros((rows, min(step, len(often) - lo)), np.float32)
        m[who[a:z], place[a:z] - lo] = 1
        out += (m[: n[0]] @ (m if same else m[n[0] :]).T).astype(np.int32)
    return out


_COUNTED = "bi bigint, bj bigint, frag int, texts binary, n int, i binary, j binary, overlap binary"


def _count(threshold: float):
    def count(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        bi, bj, frag = (x.as_py() for x in key)
        t = t.sort_by([(c, "ascending") for c in ("block", "comp", "key")])
        block, comp = t["block"].to_numpy(), t["comp"].to_numpy()
        size, shared = t["size"].to_numpy().astype(np.int64), t["shared"].to_numpy().astype(np.int64)
        grams = [_ints(x, np.uint64) for x in t["grams"]]
        own = np.array([len(x) for x in grams], np.int64)
        cut_ = int(np.searchsorted(block, bi, side="right"))  # rows of bi come first
        other = dict(runs(comp[cut_:])) if bi != bj else {}
        ii, jj, cc = [], [], []
        for c, s in runs(comp[:cut_]):
            sides = [range(s.start, s.stop)]
            if bi != bj:
                if c not in other:
                    continue
                sides.append(range(cut_ + other[c].start, cut_ + other[c].stop))
            n = [len(x) for x in sides]
            counts = _overlaps([(np.repeat(np.arange(len(x)), own[x.start : x.stop]), np.concatenate(grams[x.start : x.stop])) for x in sides], n)
            i, j = np.nonzero(np.triu(counts, 1) if bi == bj else counts)
            k = counts[i, j].astype(np.int64)
            i, j = i + sides[0].start, j + sides[-1].start
            most = k + np.minimum(shared[i] - own[i], shared[j] - own[j])  # if the other fragments hold all they can
            ok = most * (1 + threshold) >= threshold * (size[i] + size[j]) - 1e-6
            ii.append(i[ok].astype(np.int32))
            jj.append(j[ok].astype(np.int32))
            cc.append(k[ok].astype(np.int32))
        trim()
        names = _COUNTED.replace(",", "").split()[::2]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int32(), *[pa.binary()] * 3]
        if not ii or not sum(map(len, ii)):
            return _blobs(" ".join(names), kinds, [])
        texts = np.stack([t["key"].to_numpy(), size, t["copies"].to_numpy()], 1)
        return _blobs(" ".join(names), kinds, [(bi, bj, frag, np.ascontiguousarray(texts).tobytes(), len(size), *(np.concatenate(x).tobytes() for x in (ii, jj, cc)))])

    return count


def _total(threshold: float):
    def total(t: pa.Table) -> pa.Table:
        """Partial counts of two blocks' pairs summed: links per text (b null), and a spanning forest of similar texts (n null)."""
        texts, m = _ints(t["texts"][0], np.int64).reshape(-1, 3), t["n"][0].as_py()
        key, size, copies = texts.T
        pair = np.concatenate([_ints(i, np.int32).astype(np.int64) * m + _ints(j, np.int32) for i, j in zip(t["i"], t["j"])])
        part = np.concatenate([_ints(x, np.int32) for x in t["overlap"]])
        pair, at = np.unique(pair, return_inverse=True)
        overlap = np.bincount(at.ravel(), part)
        i, j = pair // m, pair % m
        ok = overlap >= threshold * (size[i] + size[j] - overlap) - 1e-9
        i, j = i[ok], j[ok]
        n = np.bincount(i, copies[j], minlength=m) + np.bincount(j, copies[i], minlength=m)
        some = np.flatnonzero(n)
        a, b = forest(key[i], key[j])
        trim()
        none = lambda x: pa.nulls(len(x), pa.int64())
        cols = (pa.array(key[some]), pa.array(a)), (none(some), pa.array(b)), (pa.array(n[some].astype(np.int64)), none(a))
        return pa.table([pa.concat_arrays(c) for c in cols], names=["a", "b", "n"])

    return total


def classes(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """(a, b, class_id, links) of every text that has a partner or a copy; a and b are ``signed``'s."""
    found = candidates(docs, n, threshold)
    size = int(found.agg(F.sum(F.octet_length("grams"))).first()[0] or 0)
    parts = max(4, -(-size // RANGE_BYTES * 4))
    comp = components(_links(found.where("prefix > 0"), parts, threshold))
    member = comp.select(F.col("node").alias("key"), F.col("root").alias("comp")).unionByName(comp.select(F.col("root").alias("key"), F.col("root").alias("comp")).distinct())
    order = ["comp", "near", "key"]
    placed = found.join(member, "key").select(*order, "copies", "size", "shared", "prefix", "grams")
    placed = cut(placed.repartitionByRange(max(8, -(-size // (16 * BLOCK_BYTES))), *order).sortWithinPartitions(*order).mapInArrow(_blocks, _PLACED))
    pairs = block_pairs(placed, parts)
    own = placed.select(F.col("block").alias("bi"), F.col("block").alias("bj")).distinct()
    sides = pairs.unionByName(own).withColumn("block", F.explode(F.array_distinct(F.array("bi", "bj"))))
    cells = placed.join(sides, "block").where("open or bi = bj").select("bi", "bj", "block", "comp", "key", "copies", "size", "shared", "grams")
    counted = cells.mapInArrow(_fragments, _CELL).groupBy("bi", "bj", "frag").applyInArrow(_count(threshold), _COUNTED)
    similar = cut(counted.groupBy("bi", "bj").applyInArrow(_total(threshold), "a bigint, b bigint, n bigint"))
    links = similar.where("b is null").groupBy(F.col("a").alias("key")).agg(F.sum("n").alias("n"))
    root = components(similar.where("b is not null").select("a", "b")).select(F.col("node").alias("key"), "root")
    text = found.select("key", "a", "b", "doc", "copies").join(links, "key", "left").join(root, "key", "left")
    text = text.select("a", "b", "doc", F.coalesce("root", "key").alias("root"), (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("links")).where("links > 0")
    least = text.groupBy("root").agg(F.min("doc").alias("class_id"))
    return text.join(least, "root").select("a", "b", "class_id", "links")


def similar_documents(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, class_id, links): a row of every document that has a partner.

    Two documents are partners if their sets have a Jaccard similarity of at least ``threshold`` (above 0); ``links`` counts a
    document's partners, copies included; ``class_id`` is the least doc_id of the documents connected by partners.  Documents
    without a row have no partner and are classes of their own.

    A document's set holds its n-word runs (case and ASCII punctuation don't matter); a text of fewer than n words has one, all
    of it; a text without words (null and empty ones too) has none and no partner.  Very long texts are read whole.  Every row is
    a document: rows alike in id and text are copies of each other, rows of one id with different texts are compared like any
    others.  A null doc_id keeps its row and is the least id of no class unless all are null, which gives a null class_id.  An
    empty table gives an empty result; other columns are ignored; doc_id must be an integer.
    """
    found = classes(docs, n, threshold)
    return signed(docs).select("doc_id", "a", "b").join(found, ["a", "b"]).select("doc_id", "class_id", "links")


def one_of_each(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """``docs``, columns unchanged, with one document of each class: the one whose doc_id is the class_id.

    Repeated rows of that id that lie in the class stay with it; classes of null ids alone stay, other null ids of a class go;
    documents without a partner stay, those without words (null and empty texts) among them.  An empty table gives an
    empty result; other columns, whatever their names, aren't looked at.
    """
    need(docs, "doc_id", "text")
    names = docs.columns
    base = docs.toDF(*[f"c{i}" for i in range(len(names))])
    key, text = f"c{names.index('doc_id')}", F.col(f"c{names.index('text')}")
    gone = signed(docs).select("doc_id", "a", "b").join(classes(docs, n, threshold), ["a", "b"]).where("class_id is not null and not (doc_id <=> class_id)").select("doc_id", "a", "b").distinct()
    on = F.col(key).eqNullSafe(F.col("doc_id")) & (F.xxhash64(text) == F.col("a")) & (F.xxhash64(F.lit(1), text) == F.col("b"))
    return base.join(gone.hint("shuffle_hash"), on, "left_anti").toDF(*names)


def oracle(n: int = N, threshold: float = THRESHOLD) -> str:
    """The same rows in DuckDB SQL, from n-grams as text."""
    from .decontam import _tokens

    return f"""
WITH RECURSIVE d AS ({_tokens("documents", "doc_id")}),
g AS (SELECT DISTINCT doc_id, array_to_string(w[p : p + k - 1], ' ') AS g FROM (SELECT doc_id, w, least({n}, len(w)) AS k, unnest(range(1, len(w) - least({n}, len(w)) + 2)) AS p FROM d WHERE len(w) > 0)),
s AS (SELECT doc_id, count(*) AS size FROM g GROUP BY 1),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS overlap FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS MATERIALIZED (SELECT a, b FROM o JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b WHERE overlap >= {threshold} * (x.size + y.size - overlap) - 1e-9),
c AS (SELECT DISTINCT a, a AS root FROM e UNION SELECT e.b AS a, c.root FROM c JOIN e ON e.a = c.a)
SELECT a AS doc_id, class_id, links FROM (SELECT a, count(*) AS links FROM e GROUP BY a) JOIN (SELECT a, min(root) AS class_id FROM c GROUP BY a) USING (a)
"""
