"""Queries of the training-data operators, one ``opN_<name>`` each with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontam, langid, linededup, ngramjoin, packing, quality, sadedup, sharding, tokencount, toxicity


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_best_fit_packing": lambda s, d: packing.pack(_t(s, d, "documents")),
        "op2_language_id": lambda s, d: langid.detect(_t(s, d, "documents")),
        "op3_toxicity": lambda s, d: toxicity.detect(_t(s, d, "documents"), _t(s, d, "labels")),
        "op4_decontamination": lambda s, d: decontam.find(_t(s, d, "documents"), _t(s, d, "benchmark")).drop("start_char", "end_char"),
        "op5_line_dedup": lambda s, d: linededup.deduped(_t(s, d, "documents")),
        "op6_suffix_array_dedup": lambda s, d: sadedup.repeats(_t(s, d, "documents")),
        "op7_ngram_jaccard_join": lambda s, d: ngramjoin.similar_documents(_t(s, d, "documents")),
        "op8_token_counts": lambda s, d: tokencount.count_tokens(_t(s, d, "documents")),
        "op9_quality_rules": lambda s, d: quality.measure(_t(s, d, "documents")),
        "op10_sharding": lambda s, d: sharding.assign_shards(_t(s, d, "documents")),
    }


def oracle_sql() -> dict[str, str]:
    return {"op9_quality_rules": quality.oracle(), "op7_ngram_jaccard_join": ngramjoin.oracle(), "op6_suffix_array_dedup": sadedup.oracle(), "op4_decontamination": decontam.ORACLE, "op5_line_dedup": linededup.ORACLE, "op10_sharding": sharding.oracle()}
