"""Set operations and maintenance as functions from tables to tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import FACT_KEY, IS_DEPRECATED
from .scan import number_rows

CYCLE = 1000
#: Rows that every task may keep for a selection of the last ones.
FEW = 100_000


def merge(a: DataFrame, b: DataFrame) -> DataFrame:
    """Union of two fact sets; of equal facts the first table's stays."""
    return a.unionByName(b.join(a.select(*FACT_KEY), FACT_KEY, "left_anti").dropDuplicates(FACT_KEY), allowMissingColumns=True)


def retain(facts: DataFrame, most: int) -> DataFrame:
    """All but the first facts in key order (topic, subject, predicate, object), so that ``most`` stay; 0 keeps all.

    A few are the top of a distributed selection; for more the cut is found by a range-partitioned sort, not by one task.
    """
    if most <= 0:
        return facts
    if most <= FEW:
        return facts.orderBy(*[F.desc(c) for c in FACT_KEY]).limit(most)
    n = facts.count()
    if n <= most:
        return facts
    numbered = number_rows(facts.orderBy(*FACT_KEY), "n_")
    return numbered.where(F.col("n_") > n - most).drop("n_")


def drop_deprecated(facts: DataFrame) -> DataFrame:
    return facts.where(F.coalesce(F.col("flags").cast("int"), F.lit(0)).bitwiseAND(F.lit(IS_DEPRECATED)) == 0)


def orphan_terms(dictionary: DataFrame, facts: DataFrame, limit: int | None = CYCLE) -> DataFrame:
    """Dictionary terms that no fact refers to, at most ``limit`` a cycle, least id first."""
    used = facts.select(F.explode(F.array("subject", "predicate", "o_text")).alias("term"))
    out = dictionary.join(used, "term", "left_anti").select("id", "term")
    return out if limit is None else out.orderBy("id").limit(limit)


def only_of_topic(terms: DataFrame, topic: int) -> DataFrame:
    """Of terms with their least and largest topic, those that would be orphans without ``topic``."""
    return terms.where((F.col("first_topic") == topic) & (F.col("last_topic") == topic))


def orphan_vectors(vectors: DataFrame, content: DataFrame, facts: DataFrame, prefix: str = "doc:", limit: int | None = CYCLE) -> DataFrame:
    """Ids of vectors with neither content nor a fact."""
    key = F.concat(F.lit(prefix), F.col("entity_id").cast("string"))
    out = vectors.select("entity_id", key.alias("subject")).join(content.select("entity_id"), "entity_id", "left_anti").join(facts.select("subject"), "subject", "left_anti").select("entity_id")
    return out if limit is None else out.orderBy("entity_id").limit(limit)


def delete_subjects(facts: DataFrame, subjects: DataFrame) -> DataFrame:
    """Facts without those of ``subjects`` (topic_id, subject)."""
    return facts.join(subjects, ["topic_id", "subject"], "left_anti")
