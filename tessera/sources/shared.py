"""The folder all executors share, and tables cut from their lineage in it."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession

from ..model import StoreError


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; one of our own only where all run in one process, as in tests."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where
    own = spark.sparkContext._jsc.sc().getCheckpointDir()
    if own.isEmpty():
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise StoreError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tessera-"))
        own = spark.sparkContext._jsc.sc().getCheckpointDir()
    return own.get()


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()
