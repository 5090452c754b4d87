"""Corpus pipeline: quality rules, line dedup, near duplicates, benchmark decontamination, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; it works on all that its predecessor kept.  All stages but the
last return the columns of ``documents``, whatever others there are and however they are named, with their values unchanged but for
``text``.  An empty table gives an empty one in every stage; very long texts are read whole.  What becomes of null ids, null and empty
texts, ties and repeated rows is said at each stage.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import decontam, linededup, ngramjoin, packing, quality
from tessera.llm._spark import shared_dir


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the repetition rules keep.

    Texts without words (null, empty, punctuation) go; repeated rows are judged each for itself, null ids like others.
    """
    return quality.passing(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated lines; documents all of whose lines were repeats go.

    The first occurrence stays, in order of (doc_id, hash of the text, line), null ids first; rows alike in id and text keep
    the same lines.  Null, empty and blank texts stay as they are.
    """
    return linededup.cleaned(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones, that of the least id.

    Repeated rows of that id stay with it; null ids go where their group has another id, else all of it stays.  Null texts and
    those without words are in no group and stay.
    """
    return ngramjoin.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without benchmark passages; documents of which no word is left go.

    Null texts, those without words, null ids and repeated rows stay, each for itself.
    """
    return decontam.cleaned(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the packed bins.

    Null, empty and blank texts have no row; repeated rows and null ids are packed each for itself; pieces of one size are
    taken in order of (doc_id, piece).
    """
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: Suffix-array rules and bin packing have no SQL form; tests/llm compares the pipeline with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet in the shared folder and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    where = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs.write.parquet(f"{where}/{i}-{name}")
            docs = spark.read.parquet(f"{where}/{i}-{name}")
            if i:  # what the stage read isn't needed any more
                old = spark._jvm.org.apache.hadoop.fs.Path(f"{where}/{i - 1}-{STAGES[i - 1][0]}")
                old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)
    return docs
