"""fvecs and ivecs files: every row is a 32-bit length and that many 32-bit numbers."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def read_vecs(spark: SparkSession, path: str, rows: int = 65536) -> DataFrame:
    """(id, values): a row per vector, numbered in file order; ``path`` ends in .fvecs or .ivecs.

    Files are read in blocks of ``rows`` vectors by position, so one large file spreads over all executors.
    """
    kind, number = ("array<float>", np.float32) if path.endswith("fvecs") else ("array<int>", np.int32)
    head = spark.read.format("binaryFile").load(path).select("path", "length").collect()
    if len(head) != 1:
        raise ValueError(f"{len(head)} files at {path}")
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).open(fs_path)
    try:
        dim = int.from_bytes(bytes(stream.readNBytes(4)), "little")
    finally:
        stream.close()
    width = 4 * (dim + 1)
    if not dim or head[0]["length"] % width:
        raise ValueError(f"{path}: not rows of {dim} numbers")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start, block in zip(b.column(0).to_pylist(), b.column(1)):
                raw = np.frombuffer(block.as_buffer(), np.uint8).reshape(-1, width)
                if (np.ascontiguousarray(raw[:, :4]).view("<i4") != dim).any():
                    raise ValueError(f"{path}: rows of several lengths")
                values = np.ascontiguousarray(raw[:, 4:]).view(number)
                lists = pa.ListArray.from_arrays(np.arange(0, values.size + 1, dim, dtype=np.int32), pa.array(values.ravel()))
                yield pa.record_batch([pa.array(np.arange(start, start + len(raw))), lists], names=["id", "values"])

    records = spark.sparkContext.binaryRecords(path, width)  # the JVM splits the file at whole records
    counts = records.mapPartitionsWithIndex(lambda i, it: [(i, sum(1 for _ in it))]).collect()  # a number a partition
    starts = dict(zip((i for i, _ in counts), np.cumsum([0, *(n for _, n in counts)]).tolist()))

    def blocks(i: int, it: Iterator[bytes]) -> Iterator[tuple[int, bytearray]]:
        at = starts[i]
        while raw := list(islice(it, rows)):
            yield at, bytearray(b"".join(raw))
            at += len(raw)

    df = spark.createDataFrame(records.mapPartitionsWithIndex(blocks), "id bigint, raw binary")
    return df.mapInArrow(decode, f"id bigint, values {kind}")


def write_vecs(path: str, values: np.ndarray) -> None:
    n, d = values.shape
    kind = "<f4" if path.endswith("fvecs") else "<i4"
    out = np.empty((n, d + 1), "<i4")
    out[:, 0] = d
    out[:, 1:] = values.astype(kind).view("<i4")
    out.tofile(path)
