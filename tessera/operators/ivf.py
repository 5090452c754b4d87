"""Inverted file with product quantization.

Centroids and codebook are trained on a bounded sample on the driver; every vector is then encoded on the executors and written
under its centroid, so that a search reads only the probed centroids' partitions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels
from ..functions.columns import inverse_distance
from .vector import block_top_k, matrix

#: Vectors that centroids and codebook are trained on, at most.
SAMPLE = 100_000


@dataclass
class Index:
    centroids: np.ndarray
    book: np.ndarray
    postings: DataFrame  # topic_id, centroid, id, codes


def train(vectors: DataFrame, centroids: int = 1024, parts: int = 8, codes: int = 256, seed: int = 42, sample: int = SAMPLE) -> Index:
    """Train on the vectors least by a hash of their id, then encode all."""
    t = vectors.where("embedding is not null").select("entity_id", "embedding").orderBy(F.xxhash64(F.lit(seed), "entity_id"), "entity_id").limit(sample).toArrow()
    x = matrix(t["embedding"].combine_chunks())
    c = kernels.kmeans(x, centroids, seed=seed)
    book = kernels.train_pq(x - c[kernels.nearest(x, c)], parts, min(codes, 256), seed)
    return Index(c, book, encode(vectors, c, book))


def encode(vectors: DataFrame, centroids: np.ndarray, book: np.ndarray) -> DataFrame:
    """(topic_id, centroid, id, codes) of every vector: nearest centroid and product-quantized residual."""
    held = vectors.sparkSession.sparkContext.broadcast((centroids, book))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, bk = held.value
        for b in batches:
            x = matrix(b.column(2), c.shape[1])
            near = kernels.nearest(x, c)
            code = kernels.encode_pq(x - c[near], bk) if len(x) else np.zeros((0, bk.shape[0]), np.uint8)
            yield pa.record_batch([b.column(0), pa.array(near.astype(np.int32)), b.column(1), pa.array([r.tobytes() for r in code], pa.binary())], names=["topic_id", "centroid", "id", "codes"])

    return vectors.where("embedding is not null").select(F.col("topic_id").cast("int"), F.col("entity_id").cast("bigint"), "embedding").mapInArrow(run, "topic_id int, centroid int, id bigint, codes binary")


POSTINGS = "topic_id int, centroid int, id bigint, codes binary"


def save(index: Index, path: str) -> None:
    """Centroids, codebook and postings, these partitioned by centroid and topic: a search reads only the probed lists."""
    spark = index.postings.sparkSession
    c, b = np.ascontiguousarray(index.centroids, "<f8"), np.ascontiguousarray(index.book, "<f8")
    model = spark.createDataFrame([(bytearray(c.tobytes()), list(c.shape), bytearray(b.tobytes()), list(b.shape))], "centroids binary, c_shape array<int>, book binary, b_shape array<int>")
    _write(index.postings, f"{path}/postings", "overwrite")
    model.coalesce(1).write.mode("overwrite").parquet(f"{path}/model")  # last: an index without a model was never finished


def _write(postings: DataFrame, path: str, mode: str) -> None:
    # by range, so that a long list is cut over several files and tasks
    postings.repartitionByRange("centroid", "topic_id", "id").write.mode(mode).partitionBy("centroid", "topic_id").parquet(path)


def load(spark, path: str) -> Index:
    """A saved index; its postings stay on disk."""
    m = spark.read.parquet(f"{path}/model").first()
    c, b = (np.frombuffer(bytes(m[k]), "<f8").reshape(m[s]) for k, s in (("centroids", "c_shape"), ("book", "b_shape")))
    return Index(c, b, spark.read.schema(POSTINGS).parquet(f"{path}/postings"))


def add(spark, path: str, vectors: DataFrame) -> Index:
    """Encode ``vectors`` with the saved centroids and codebook, append them to the index, and open it again."""
    index = load(spark, path)
    if not vectors.where("embedding is not null").limit(1).isEmpty():
        _write(encode(vectors, index.centroids, index.book), f"{path}/postings", "append")
    return load(spark, path)


def search(index: Index, query, k: int = 10, probes: int = 32, topic: int | None = None, rerank: DataFrame | None = None, candidates: int | None = None) -> DataFrame:
    """(id, score), best first, score 1 / (1 + squared distance), from the ``probes`` nearest centroids.

    Distances come from a table per probed centroid of its residual query.  With ``rerank`` (the vectors) the best
    ``candidates`` (default 10 k) are scored again exactly.
    """
    q = np.asarray(query, np.float64)
    near = np.argsort(kernels.sq_dist(q[None], index.centroids)[0], kind="stable")[:probes]
    parts = index.book.shape[0]
    tables = {int(c): np.stack([((index.book[i] - r) ** 2).sum(1) for i, r in enumerate((q - index.centroids[c]).reshape(parts, -1))]) for c in near}
    want = (candidates or 10 * k) if rerank is not None else k

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, cen = b.column(1).to_numpy(), b.column(0).to_numpy()
            code = np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint8).reshape(len(ids), parts)
            d = np.zeros(len(ids))
            for c in np.unique(cen):
                d[cen == c] = kernels.adc(code[cen == c], tables[int(c)])
            o = np.lexsort((ids, d))[:want]
            yield pa.record_batch([pa.array(ids[o]), pa.array(1 / (1 + d[o]))], names=["id", "score"])

    df = index.postings.where(F.col("centroid").isin([int(c) for c in near]))
    if topic is not None:
        df = df.where(F.col("topic_id") == topic)
    out = df.select("centroid", "id", "codes").mapInArrow(run, "id bigint, score double").orderBy(F.desc("score"), "id").limit(want)
    if rerank is None:
        return out
    from .vector import top_k

    return top_k(rerank.join(out.select(F.col("id").alias("entity_id")), "entity_id", "left_semi"), q, k, "l2")


def search_batch(index: Index, queries: DataFrame, k: int = 10, probes: int = 32, rerank: DataFrame | None = None, candidates: int | None = None) -> DataFrame:
    """(query_id, id, score) of ``search`` for every row of ``queries`` (query_id, embedding).

    With ``rerank`` (the vectors) each query's best ``candidates`` (default 10 k) are scored again exactly.

    Blocks of postings meet blocks of queries on the executors; a list is scored for the queries that probe it, against its
    vectors, decoded a tile at a time, which are as far from a query as the tables of its residual say.
    """
    held = queries.sparkSession.sparkContext.broadcast((index.centroids, index.book))

    def prepare(v: pa.Table):
        c, book = held.value
        v = v.sort_by("centroid")
        cen = v["centroid"].to_numpy()
        code = np.frombuffer(b"".join(v["codes"].to_pylist()), np.uint8).reshape(len(cen), book.shape[0])
        lists, start = np.unique(cen, return_index=True)
        stop = np.append(start[1:], len(cen))

        def score(q: np.ndarray) -> Callable[[int, int], np.ndarray]:
            probed = np.zeros((len(q), len(c)), bool)
            np.put_along_axis(probed, np.argsort(kernels.sq_dist(q, c), axis=1, kind="stable")[:, :probes], True, axis=1)

            def some(lo: int, hi: int) -> np.ndarray:
                hi = min(hi, len(cen))
                x = c[cen[lo:hi]] + kernels.decode_pq(code[lo:hi], book)
                s = np.full((len(q), hi - lo), -np.inf)
                for j in range(np.searchsorted(stop, lo, "right"), np.searchsorted(start, hi)):
                    a, b = max(start[j], lo), min(stop[j], hi)
                    rows = np.flatnonzero(probed[:, lists[j]])
                    s[rows, a - lo : b - lo] = 1 / (1 + kernels.sq_dist(q[rows], x[a - lo : b - lo]))
                return s

            return some

        return v["id"].to_numpy(), score

    postings = index.postings.select("id", "centroid", "codes")
    if rerank is None:
        return block_top_k(postings, queries, k, prepare)
    best = block_top_k(postings, queries, candidates or 10 * k, prepare).select("query_id", "id")
    both = best.join(queries.select("query_id", F.col("embedding").alias("q")), "query_id").join(rerank.select(F.col("entity_id").alias("id"), F.col("embedding").alias("v")), "id")
    d = F.aggregate(F.zip_with("q", "v", lambda x, y: x.cast("double") - y.cast("double")), F.lit(0.0), lambda t, x: t + x * x)
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "id")
    return both.select("query_id", "id", inverse_distance(d).alias("score")).withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k).drop("rn")
