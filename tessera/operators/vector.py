"""Vector search: exact and quantized top-k.

A query is a literal: no join.  Every Arrow batch is scored by one matrix product and only its k best rows leave Python, so what
reaches the final TakeOrderedAndProject is k rows a batch.  Order is (score descending, id ascending), which makes ties definite.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels
from ..model import DimensionMismatch, LimitExceeded, PartitionLimit
from ..plans.guard import TOP_K

#: Bytes of a block of a batched search and of the results of two; vectors that a block of their own is worth.
BLOCK_BYTES, RESULT_BYTES, LEAST = 32 << 20, 8 << 20, 1024
#: Queries and vectors of two blocks that are decoded and scored at once, in tiles of 2 MB.
SLICE, TILE = 512, 512


def matrix(col, dim: int | None = None) -> np.ndarray:
    """Rows of a list<float> array as a matrix; a row of another length raises DimensionMismatch."""
    n = len(col)
    if n == 0:
        return np.zeros((0, dim or 0))
    flat = col.flatten().to_numpy(zero_copy_only=False)
    width = dim if dim is not None else len(flat) // n
    sizes = pa.compute.list_value_length(col)
    if pa.compute.any(pa.compute.or_kleene(pa.compute.not_equal(sizes, width), pa.compute.is_null(sizes))).as_py():
        raise DimensionMismatch(f"vectors must have {width} dimensions")
    return flat.astype(np.float64).reshape(n, width)


def _scores(m: np.ndarray, q: np.ndarray, metric: str) -> np.ndarray:
    if metric == "dot":
        return m @ q
    return 1 / (1 + kernels.sq_dist_rows(m, q)) if metric == "l2" else _fail(metric)


def _fail(metric: str):
    raise ValueError(f"metric {metric!r}: dot or l2")


def _best(ids: np.ndarray, s: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -s))[:k]


def top_k(vectors: DataFrame, query, k: int = 10, metric: str = "dot", topic: int | None = None, semantic_hash: int | None = None, threshold: float | None = None) -> DataFrame:
    """(id, score): the k best vectors by dot product, or by 1 / (1 + squared distance) for ``l2``; exact.

    ``topic`` and ``semantic_hash`` restrict the vectors before they are scored, ``threshold`` drops lower scores.
    """
    q = np.asarray(query, np.float64)
    df = vectors.where("embedding is not null")
    if topic is not None:
        df = df.where(F.col("topic_id") == topic)
    if semantic_hash:
        df = df.where(F.col("semantic_hash") == semantic_hash)
    if k <= 0:
        df = df.limit(0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy()
            s = _scores(matrix(b.column(1), len(q)), q, metric)
            if threshold is not None:
                keep = s >= threshold
                ids, s = ids[keep], s[keep]
            o = _best(ids, s, k)
            yield pa.record_batch([pa.array(ids[o]), pa.array(s[o])], names=["id", "score"])

    out = df.select(F.col("entity_id").cast("bigint"), "embedding").mapInArrow(run, "id bigint, score double")
    return out.orderBy(F.desc("score"), "id").limit(max(k, 0))


def top_k_per_topic(vectors: DataFrame, query, k: int = 10, by: str = "topic_id") -> DataFrame:
    """The k best of every topic (or other integer column ``by``)."""
    q = np.asarray(query, np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, group, s = b.column(0).to_numpy(), b.column(1).to_numpy(), matrix(b.column(2), len(q)) @ q
            o = np.lexsort((ids, -s, group))
            g = group[o]
            place = np.arange(len(g)) - np.searchsorted(g, g)
            o = o[place < k]
            yield pa.record_batch([pa.array(ids[o]), pa.array(group[o].astype(np.int64)), pa.array(s[o])], names=["id", "group", "score"])

    out = vectors.where("embedding is not null").select(F.col("entity_id").cast("bigint"), by, "embedding").mapInArrow(run, "id bigint, group bigint, score double")
    w = Window.partitionBy("group").orderBy(F.desc("score"), "id")
    return out.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k).select(F.col("group").alias(by), "id", "score")


def _best_rows(ids: np.ndarray, s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, id, score) of the k best of every row of a score matrix; -inf is no candidate, equal to 9 digits is a tie."""
    ok = s > -np.inf
    if s.shape[1] > k:
        ok &= s >= np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k, None] - 2e-9
    r, c = np.nonzero(ok)
    return _first(r, ids[c], s[r, c], k)


def _first(r: np.ndarray, i: np.ndarray, v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    o = np.lexsort((i, -np.round(v, 9), r))
    r, i, v = r[o], i[o], v[o]
    keep = np.arange(len(r)) - np.searchsorted(r, r) < k
    return r[keep], i[keep], v[keep]


def _tiled(ids: np.ndarray, score: Callable[[int, int], np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``_best_rows`` of a matrix of which ``score`` makes some columns at a time.

    Of a later tile only scores are kept that may still be among the k best of their row, and they are sorted in when they have become many.
    """
    best, more, waiting = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)), [], 0
    for at in range(0, len(ids), TILE):
        i, s = ids[at : at + TILE], score(at, at + TILE)
        if at == 0:
            best = _best_rows(i, s, k)
            least = _least(best, len(s), k)
            continue
        r, c = np.nonzero(s >= least[:, None])
        more.append((r, i[c], s[r, c]))
        waiting += len(r)
        if waiting > max(len(best[0]), s.size // 4):
            best, more, waiting = _first(*(np.concatenate(x) for x in zip(best, *more)), k), [], 0
            least = _least(best, len(s), k)
    return _first(*(np.concatenate(x) for x in zip(best, *more)), k) if more else best


def _least(best: tuple[np.ndarray, np.ndarray, np.ndarray], rows: int, k: int) -> np.ndarray:
    """Of every row the score below which none can be among the k best any more; equal to 9 digits is a tie."""
    r, _, v = best
    least = np.full(rows, np.inf)
    np.minimum.at(least, r, v)
    return np.where(np.bincount(r, minlength=rows) < k, np.finfo(float).min, least - 2e-9)


def block_top_k(vectors: DataFrame, queries: DataFrame, k: int, prepare: Callable[[pa.Table], tuple[np.ndarray, Callable[[np.ndarray], Callable[[int, int], np.ndarray]]]]) -> DataFrame:
    """(query_id, id, score): the k best of ``vectors`` (id and more) for every row of ``queries`` (query_id, embedding).

    Both sides are cut into blocks of bounded size and every pair of blocks meets on an executor, so no number of queries
    or vectors is too large and none pass through the driver; each side is sent once a block of the other.  ``prepare`` makes of a block of vectors their ids and a
    function from a query matrix to one that scores a range of the ids, a column an id.  Vectors stay as they came but for those of a tile,
    as scores exist a tile at a time, and a block of queries is no larger than its results may be.
    """
    if k <= 0:
        return vectors.limit(0).selectExpr("id as query_id", "id", "cast(0 as double) as score")
    r = queries.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("embedding")).alias("dim")).first()
    dim = r["dim"]
    rows = max(1, BLOCK_BYTES // (8 * max(1, dim or 1)))
    n = vectors.count()
    asked = max(1, min(rows, RESULT_BYTES // (24 * k)))
    nq, nv = max(1, -(-r["n"] // asked)), max(1, -(-n // rows), min(vectors.sparkSession.sparkContext.defaultParallelism, n // LEAST))
    kind = "query_id bigint, id bigint, score double"
    names = ["query_id", "id", "score"]

    def run(q: pa.Table, v: pa.Table) -> pa.Table:
        out = [pa.table([np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)], names=names)]
        if len(q) and len(v):
            qid = q["query_id"].to_numpy()
            ids, score = prepare(v)
            for lo in range(0, len(qid), SLICE):
                row, i, s = _tiled(ids, score(matrix(q["query"].slice(lo, SLICE).combine_chunks(), dim)), k)
                out.append(pa.table([qid[lo + row], i, s], names=names))
        return pa.concat_tables(out)

    def every(n: int):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    # another name: the sides may be one table, and a cogroup would mix up columns of one origin
    a = queries.select(F.col("query_id").cast("bigint"), F.col("embedding").alias("query"), F.pmod(F.xxhash64(F.col("query_id").cast("bigint")), F.lit(nq)).cast("int").alias("qb"), every(nv).alias("vb"))
    b = vectors.select("*", F.pmod(F.xxhash64("id"), F.lit(nv)).cast("int").alias("vb"), every(nq).alias("qb"))
    out = a.groupBy("qb", "vb").cogroup(b.groupBy("qb", "vb")).applyInArrow(run, kind)
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "id")
    return out.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k).select(*names)


def top_k_batch(vectors: DataFrame, queries: DataFrame, k: int = 10, metric: str = "dot") -> DataFrame:
    """(query_id, id, score): the k best of ``top_k`` for every row of ``queries`` (query_id, embedding); exact."""
    if metric not in ("dot", "l2"):
        _fail(metric)

    def prepare(v: pa.Table):
        def score(q: np.ndarray) -> Callable[[int, int], np.ndarray]:
            def some(a: int, b: int) -> np.ndarray:
                m = matrix(v["embedding"].slice(a, b - a).combine_chunks(), q.shape[1])
                return q @ m.T if metric == "dot" else 1 / (1 + kernels.sq_dist(q, m))

            return some

        return v["id"].to_numpy(), score

    v = vectors.where("embedding is not null").select(F.col("entity_id").cast("bigint").alias("id"), "embedding")
    return block_top_k(v, queries, k, prepare)


def quantized(vectors: DataFrame, bits: int = 8) -> DataFrame:
    """``vectors`` with a column ``codes`` of quantized bytes in place of the floats."""
    from ..functions.columns import quantizer

    return vectors.withColumn("codes", quantizer(bits)("embedding")).drop("embedding")


def top_k_quantized(vectors: DataFrame, query, k: int = 10, bits: int = 8) -> DataFrame:
    """Approximate top-k by dot products of quantized codes."""
    q = np.asarray(query, np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                ids, s = b.column(0).to_numpy(), kernels.dot_quantized(b.column(1).to_pylist(), q, bits)
                o = _best(ids, s, k)
                yield pa.record_batch([pa.array(ids[o]), pa.array(s[o])], names=["id", "score"])

    return vectors.select(F.col("entity_id").cast("bigint"), "codes").mapInArrow(run, "id bigint, score double").orderBy(F.desc("score"), "id").limit(k)


def top_k_quantized_batch(vectors: DataFrame, queries: DataFrame, k: int = 10, bits: int = 8) -> DataFrame:
    """(query_id, id, score): approximate top-k by dot products of quantized codes for every row of ``queries``."""

    def prepare(v: pa.Table):
        codes = v["codes"].to_pylist()
        return v["id"].to_numpy(), lambda q: lambda a, b: kernels.dot_quantized_batch(codes[a:b], q, bits)

    return block_top_k(vectors.where("codes is not null").select(F.col("entity_id").cast("bigint").alias("id"), "codes"), queries, k, prepare)


def checked(vectors: DataFrame, dim: int, max_topics: int | None = None) -> DataFrame:
    """``vectors`` if all have ``dim`` dimensions and at most ``max_topics`` topics (exact, one job)."""
    r = vectors.agg(F.count_if(F.coalesce(F.size("embedding"), F.lit(-1)) != dim).alias("bad"), F.count_distinct("topic_id").alias("topics")).first()
    if r["bad"]:
        raise DimensionMismatch(f"{r['bad']} vectors don't have {dim} dimensions")
    if max_topics is not None and r["topics"] > max_topics:
        raise PartitionLimit(f"{r['topics']} topics; the limit is {max_topics}")
    return vectors


def full_vectors(vectors: DataFrame, ids: DataFrame) -> DataFrame:
    """(entity_id, embedding) of every row of ``ids`` (entity_id) in full precision; null where there is none."""
    return ids.select("entity_id").join(vectors.join(ids.select("entity_id").distinct(), "entity_id", "left_semi").select("entity_id", "embedding"), "entity_id", "left")


def search(vectors: DataFrame, query, k: int = 10, **kw) -> DataFrame:
    """``top_k`` under the serving limit: a larger k than TOP_K is an error."""
    if k > TOP_K:
        raise LimitExceeded(f"the {k} best are asked for; the limit is {TOP_K}")
    return top_k(vectors, query, k, **kw)


def recall(found: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """Mean share of the true k best that were found, over queries (query_id, id)."""
    hits = truth.join(found.select("query_id", "id"), ["query_id", "id"], "left_semi").groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    return truth.select("query_id").distinct().join(hits, "query_id", "left").agg(F.avg(F.coalesce("n", F.lit(0)) / F.lit(k)).alias("recall"))


def delete(vectors: DataFrame, ids: DataFrame) -> DataFrame:
    return vectors.join(ids, "entity_id", "left_anti")


def counts(vectors: DataFrame) -> DataFrame:
    return vectors.groupBy("topic_id").agg(F.count(F.lit(1)).alias("n"))
