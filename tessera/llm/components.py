"""Connected components of an edge table, by contraction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import cut


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node of its component) of the edges, without the least nodes themselves."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    top = np.arange(len(nodes))
    while True:
        # hook the larger root of each edge to the least smaller one, then compress all paths
        p, q = top[x], top[y]
        lo, hi = np.minimum(p, q), np.maximum(p, q)
        live = lo < hi
        if not live.any():
            break
        x, y = x[live], y[live]
        np.minimum.at(top, hi[live], lo[live])
        while not np.array_equal(nxt := top[top], top):
            top = nxt
    moved = top != np.arange(len(nodes))
    return nodes[moved], nodes[top[moved]]


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for t in batches:
        a.append(t.column(0).to_numpy())
        b.append(t.column(1).to_numpy())
    u, v = forest(np.concatenate(a), np.concatenate(b))
    yield pa.record_batch([pa.array(u), pa.array(v)], names=["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node that isn't the least of its component; ``edges`` has bigint columns a and b.

    Each round links every node to its least neighbour, follows one link further, and contracts; a node that isn't a local
    minimum disappears, so rounds grow with the logarithm of the longest chain.  Partitions first reduce their edges to a
    spanning forest, which leaves at most an edge a node and partition.
    """
    edges = cut(edges.select("a", "b").mapInArrow(_local, "a bigint, b bigint"))
    found: DataFrame | None = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = both.groupBy("a").agg(F.least("a", F.min("b")).alias("r"))
        up = step.where("r < a").select(F.col("a").alias("node"), F.col("r").alias("root"))
        up = cut(up)
        if found is None:
            found = up
        else:
            now = up.withColumnsRenamed({"node": "n", "root": "to"})
            found = cut(found.join(now, found.root == now.n, "left").select("node", F.coalesce("to", "root").alias("root")).unionByName(up))
        u, v = up.select(F.col("node").alias("a"), F.col("root").alias("ra")), up.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        new = edges.join(u, "a", "left").join(v, "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")).where("a <> b")
        edges = cut(new.mapInArrow(_local, "a bigint, b bigint"))
    if found is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return found
