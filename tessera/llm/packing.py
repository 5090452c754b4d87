"""Operator 1, best-fit packing: Martello-Toth dominance reduction, then best-fit decreasing.

Documents are cut into pieces of at most ``capacity`` words and packed into bins of that size.  Pieces of one size are
interchangeable, so the instance is a histogram of at most ``capacity`` sizes, whatever the corpus: it's counted on the
executors, planned on the driver with multiplicities, and the plan (ranges of ranks within a size) is joined back.

Reduction: for a piece j, taken from the largest down, a set F holding j is fixed in a bin of its own where F dominates every
other feasible set with j (each such set can be divided so that each part fits into the place of one piece of F); some optimal
packing then has that bin.  Tested are {j}, {j, k} and {j, k, b}; passes repeat until nothing more is fixed.  What is left goes
to best-fit decreasing.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import cut, need

CAPACITY = 2048
Pattern = tuple[tuple[int, int], ...]  # (size, how many), largest size first


def _pairs(cnt: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """For every size y there is, the largest x >= y with x + y <= room (both taken from ``cnt``); only pairs that exist."""
    sizes = np.flatnonzero(cnt)
    x_at = np.searchsorted(sizes, room - sizes, side="right") - 1
    ok = x_at >= 0
    y, x = sizes[ok], sizes[x_at[ok]]
    ok = (x > y) | ((x == y) & (cnt[y] > 1))
    return x[ok], y[ok]


def dominating(cnt: np.ndarray, j: int, capacity: int) -> Pattern | None:
    """A set with one piece of size j that dominates all others, or None if none of the tested sets does."""
    room = capacity - j
    cnt = cnt.copy()
    cnt[j] -= 1
    sizes = np.flatnonzero(cnt)
    if not len(sizes) or sizes[0] > room:
        return ((j, 1),)
    k = int(sizes[np.searchsorted(sizes, room, side="right") - 1])
    least: list[int] = []
    for s in sizes[:3]:
        least += [int(s)] * int(min(3, cnt[s]))
    if k == room or len(least) < 2 or least[0] + least[1] > room:
        return _pattern([j, k])
    if len(least) > 2 and sum(least[:3]) <= room:
        return None
    x, y = _pairs(cnt, room)  # at most two pieces fit beside j
    if not len(x) or int((x + y).max()) <= k:
        return _pattern([j, k])
    cnt[k] -= 1
    more = np.flatnonzero(cnt)
    more = more[more <= room - k]
    if len(more):
        b = int(more[-1])
        hard = y > b  # other pairs fit place by place: x into k's, y into b's
        if not hard.any() or int((x + y)[hard].max()) <= k:
            return _pattern([j, k, b])
    return None


def _pattern(sizes: list[int]) -> Pattern:
    return tuple((s, sizes.count(s)) for s in sorted(set(sizes), reverse=True))


def reduce_instance(cnt: np.ndarray, capacity: int) -> tuple[list[tuple[Pattern, int]], np.ndarray]:
    """Bins fixed by dominance, as (pattern, how many), and the counts that are left."""
    cnt, fixed = cnt.copy(), []
    while True:
        before = len(fixed)
        for j in np.flatnonzero(cnt)[::-1]:
            j = int(j)
            while cnt[j] > 0 and (p := dominating(cnt, j, capacity)):
                # the test only gets easier as pieces go, so it holds for as many bins as the pieces last
                m = int(min(cnt[s] // q for s, q in p))
                for s, q in p:
                    cnt[s] -= m * q
                fixed.append((p, m))
        if len(fixed) == before:
            return fixed, cnt


def best_fit(cnt: np.ndarray, capacity: int) -> list[tuple[Pattern, int]]:
    """Best-fit decreasing on counts: a piece goes where the least room is left that holds it, else into a new bin."""
    rooms: list[int] = []
    bins: dict[int, list[list]] = {}

    def put(room: int, pattern: Pattern, m: int) -> None:
        if room not in bins:
            insort(rooms, room)
            bins[room] = []
        bins[room].append([pattern, m])

    for s in np.flatnonzero(cnt)[::-1]:
        s, c = int(s), int(cnt[s])
        while c:
            i = bisect_left(rooms, s)
            if i == len(rooms):
                room, pattern, m = capacity, (), c
            else:
                room = rooms[i]
                pattern, m = bins[room][-1]
            q = min(room // s, c)
            f = min(m, c // q)
            c -= f * q
            if pattern:
                bins[room][-1][1] -= f
                if not bins[room][-1][1]:
                    bins[room].pop()
                if not bins[room]:
                    del bins[room]
                    rooms.pop(i)
            put(room - q * s, (*pattern, (s, q)), f)
    return [(p, m) for r in sorted(bins) for p, m in bins[r]]


def plan(cnt: np.ndarray, capacity: int) -> tuple[list[tuple], int, int]:
    """Rows (size, first rank, last rank + 1, first bin, pieces a bin, offset), bins in all, bins fixed by dominance."""
    fixed, left = reduce_instance(cnt, capacity)
    used, at, rows = np.zeros(len(cnt), np.int64), 0, []
    for p, m in [*fixed, *best_fit(left, capacity)]:
        offset = 0
        for s, q in p:
            rows.append((s, int(used[s]), int(used[s]) + m * q, at, q, offset))
            used[s] += m * q
            offset += s * q
        at += m
    return rows, at, sum(m for _, m in fixed)


def pack(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(bin, offset, doc_id, piece, start_word, n_words): where each piece of each document lies.

    Words are runs of characters other than white space.  Pieces of one document are numbered from 0; all but the last
    have ``capacity`` words, however long it is.  Null, empty and blank texts have no piece and no row.  Equal sizes are taken in order
    of (doc_id, piece), null ids first; repeated rows are packed each for itself, in some order; an empty table gives an empty
    result; other columns are ignored.  A capacity below 1 is an error.
    """
    if capacity < 1:
        raise ValueError(f"capacity must be 1 word at least, not {capacity}")
    spark = docs.sparkSession
    n = F.regexp_count("text", F.lit(r"\S+")).cast("bigint")
    # the texts are read once; a number of the row tells repeated ones apart, so that no key is hot
    counted = cut(need(docs, "doc_id", "text").select("doc_id", n.alias("n")).where("n > 0"))
    piece = (
        counted.select("doc_id", "n", F.monotonically_increasing_id().alias("row"))
        .select("doc_id", "n", "row", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n") - 1) / capacity))).alias("piece"))
        .select("doc_id", "row", "piece", (F.col("piece") * capacity).alias("start_word"), F.least(F.lit(capacity), F.col("n") - F.col("piece") * capacity).cast("int").alias("n_words"))
    )
    ordered = cut(piece.repartitionByRange("n_words", "doc_id", "piece", "row").sortWithinPartitions("n_words", "doc_id", "piece", "row"))
    cnt = np.zeros(capacity + 1, np.int64)
    for r in ordered.groupBy("n_words").count().collect():  # at most ``capacity`` rows
        cnt[r["n_words"]] = r["count"]
    rows, _, _ = plan(cnt, capacity)
    # the rank of a piece within its size: place in its partition + pieces before the partition - pieces of lesser size
    placed = ordered.withColumn("id_", F.monotonically_increasing_id())
    part = F.shiftright("id_", 33).cast("int")
    sizes = {r["p"]: r["count"] for r in placed.groupBy(part.alias("p")).count().collect()}  # a row per partition
    before, base = 0, []
    for p in sorted(sizes):
        base.append((int(p), before))
        before += sizes[p]
    less = np.concatenate([[0], np.cumsum(cnt)])
    bases = spark.createDataFrame(base or [(0, 0)], "p int, base bigint")
    # the plan's rows are bounded by the capacity (a few per size), not by the corpus
    what = spark.createDataFrame([(*r, int(less[r[0]])) for r in rows] or [(0, 0, 0, 0, 1, 0, 0)], "n_words int, lo bigint, hi bigint, bin0 bigint, q bigint, off bigint, less bigint")
    rank = F.col("base") + F.col("id_").bitwiseAND(F.lit((1 << 33) - 1)) - F.col("less")
    k = F.col("rank") - F.col("lo")
    return (
        placed.withColumn("p", part)
        .join(F.broadcast(bases), "p")
        .join(F.broadcast(what), "n_words")
        .withColumn("rank", rank)
        .where("rank >= lo and rank < hi")
        .select(
            (F.col("bin0") + F.floor(k / F.col("q"))).cast("bigint").alias("bin"),
            (F.col("off") + F.pmod(k, F.col("q")) * F.col("n_words")).cast("bigint").alias("offset"),
            "doc_id", "piece", "start_word", "n_words",
        )
    )
