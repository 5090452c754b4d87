"""Small helpers the operators share."""

from __future__ import annotations

import ctypes
import re
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session, one of our own only where all run in one process."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where
    sc = spark.sparkContext
    own = sc._jsc.sc().getCheckpointDir()
    if own.isEmpty():
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tessera-"))
        own = sc._jsc.sc().getCheckpointDir()
    return own.get()


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder, so that a lost executor costs no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def need(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, taken by their place (others may differ in case alone or repeat a name); a lack of one is an error that says so."""
    lost = [n for n in names if n not in df.columns]
    if lost:
        raise ValueError(f"missing columns {lost}; the table has {df.columns}")
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return plain.select(*[F.col(f"c{df.columns.index(n)}").alias(n) for n in names])


def integer_ids(df: DataFrame) -> DataFrame:
    """``df`` if its doc_id is an integer; other kinds are an error that says so."""
    kind = df.schema["doc_id"].dataType
    if not isinstance(kind, T.IntegralType):
        raise ValueError(f"doc_id must be an integer, not {kind.simpleString()}")
    return df


def n_slices(batch: pa.RecordBatch, column: str, most: int) -> Iterator[pa.RecordBatch]:
    """The batch in row ranges of at most ``most`` bytes of text; a longer single text is a range of its own."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    at, total = 0, 0
    for i, s in enumerate(sizes):
        if i > at and total + s > most:
            yield batch.slice(at, i - at)
            at, total = i, 0
        total += s
    if len(sizes) > at:
        yield batch.slice(at)


def merged(batches: Iterator[pa.RecordBatch], column: str, least: int) -> Iterator[pa.RecordBatch]:
    """Neighbouring small batches joined until they hold ``least`` bytes of text, for kernels that like long input."""
    held, total = [], 0
    for b in batches:
        if b.num_rows == 0:
            continue
        held.append(b)
        total += pc.sum(pc.binary_length(b.column(column))).as_py() or 0
        if total >= least:
            yield joined(held)
            held, total = [], 0
    if held:
        yield joined(held)


def joined(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    if len(held) == 1:
        return held[0]
    return pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def text_bytes(docs: DataFrame) -> tuple[int, int]:
    """Rows and bytes of text, from one pass that reads only the text column."""
    r = docs.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("b")).first()
    return int(r["n"] or 0), int(r["b"] or 0)


def trim() -> None:
    """Give freed memory back to the system: a worker that lives on would keep its largest group's."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # not glibc
        pass
