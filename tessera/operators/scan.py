"""Triple-pattern scans, predicate filters on objects, and lookups.

A pattern position that is None (or "") is unbound.  All functions take and return DataFrames, so filters reach the Parquet scan
and an unbound topic costs nothing; where the table is partitioned by topic_id, a bound topic prunes partitions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import FACT_KEY, IS_DEPRECATED, IS_PUBLIC, Fact, NotFound, StoreError, numeric, render, value_of
from ..sources.shared import cut


@dataclass(frozen=True)
class Where:
    """A filter on the object: regex, contains, gt, lt, gte, lte (with ``value``) or range (with ``value`` = (min, max))."""

    kind: str
    value: Any

    def column(self) -> Column:
        text = F.col("o_text")
        if self.kind == "regex":
            if any(x in self.value for x in ("(?=", "(?!", "(?<=", "(?<!")):
                raise StoreError("look-around isn't supported in filters")
            return text.rlike(self.value)
        if self.kind == "contains":
            return F.lit(False) if not self.value else (F.length(text) > 0) & text.contains(self.value)
        # numeric objects carry their number; text is parsed
        num = F.coalesce(F.col("o_num"), F.when(F.col("o_kind") == "str", numeric(text)))
        num = F.when(F.isnan(num), None).otherwise(num)
        if self.kind == "range":
            lo, hi = self.value
            return F.coalesce(num.between(float(lo), float(hi)), F.lit(False))
        if self.kind not in ("gt", "lt", "gte", "lte"):
            raise StoreError(f"unknown filter {self.kind!r}")
        x = F.lit(float(self.value))
        return F.coalesce({"gt": num > x, "lt": num < x, "gte": num >= x, "lte": num <= x}[self.kind], F.lit(False))


def object_is(value: Any) -> Column:
    """Equality with an object value: of its kind for typed values, of its text for strings (which match any kind)."""
    kind, text, _ = render(value)
    same = F.col("o_text") == text
    return same if kind == "str" else same & (F.col("o_kind") == kind)


def scan(facts: DataFrame, s: str | None = None, p: str | None = None, o: Any = None, topic: int | None = None, where: list[Where] = (), strict: bool = False) -> DataFrame:
    """Facts that match the pattern and all filters.

    ``topic`` restricts to one topic, else all are scanned.  With ``strict`` a bound term that occurs nowhere in its position
    raises NotFound instead of giving an empty result.
    """
    bound = [F.col("topic_id") == topic] if topic is not None else []
    terms = []
    if s:
        terms.append(("subject", F.col("subject") == s))
    if p:
        terms.append(("predicate", F.col("predicate") == p))
    if o is not None and o != "":
        terms.append(("object", object_is(o)))
    if strict:
        for name, c in terms:
            if facts.where(reduce(Column.__and__, [*bound, c])).limit(1).isEmpty():
                raise NotFound(f"{name} not found")
    cond = [*bound, *(c for _, c in terms), *(w.column() for w in where)]
    return facts.where(reduce(Column.__and__, cond)) if cond else facts


def scan_pruned(facts: DataFrame, s=None, p=None, o=None, topic=None, entity_type: int = 0, want_public: bool = False) -> DataFrame:
    """Scan that drops other entity types (0: any), facts that aren't public if wanted, and deprecated ones; (0, False) prunes nothing."""
    df = scan(facts, s, p, o, topic)
    if not entity_type and not want_public:
        return df
    flags = F.coalesce(F.col("flags").cast("int"), F.lit(0))
    keep = flags.bitwiseAND(F.lit(IS_DEPRECATED)) == 0
    if entity_type:
        keep &= F.col("entity_type") == entity_type
    if want_public:
        keep &= flags.bitwiseAND(F.lit(IS_PUBLIC)) != 0
    return df.where(keep)


def tagged_scan(spark: SparkSession, tag: str, df: DataFrame) -> Iterator[Fact]:
    """Lazy cursor over a scan whose jobs carry ``tag``; ``cancel(spark, tag)`` ends it."""
    sc = spark.sparkContext
    sc.addJobTag(tag)  # the context's tags hold in all threads, the session's only in the one that sets them
    try:
        for r in df.select("subject", "predicate", "o_kind", "o_text").toLocalIterator():
            yield Fact(r[0], r[1], value_of(r[2], r[3]))
    finally:
        sc.removeJobTag(tag)


def cancel(spark: SparkSession, tag: str) -> None:
    """End all jobs that carry ``tag``, from any thread."""
    spark.sparkContext.cancelJobsWithTag(tag)


def subjects(facts: DataFrame) -> DataFrame:
    return facts.select("topic_id", "subject").distinct()


def subjects_by_prefix(facts: DataFrame, prefix: str) -> DataFrame:
    """The subject of every fact whose subject begins with ``prefix`` (not deduplicated; an empty prefix gives none)."""
    return facts.where(F.col("subject").startswith(prefix) if prefix else F.lit(False)).select("subject")


def find_subjects(facts: DataFrame, p: str, o: Any) -> DataFrame:
    """Subjects of facts with this predicate and object text, in all topics."""
    return facts.where((F.col("predicate") == p) & (F.col("o_text") == render(o)[1])).select("subject")


def exists(facts: DataFrame, s=None, p=None, o=None, topic=None) -> bool:
    return not scan(facts, s, p, o, topic).limit(1).isEmpty()


def exists_batch(facts: DataFrame, probes: DataFrame) -> DataFrame:
    """``probes`` (topic_id, subject, predicate, o_text) with a column ``found``."""
    keys = ["topic_id", "subject", "predicate", "o_text"]
    hit = facts.select(*keys).distinct().withColumn("found", F.lit(True))
    return probes.join(hit, keys, "left").withColumn("found", F.coalesce("found", F.lit(False)))


def atoms(facts: DataFrame) -> DataFrame:
    """Facts as rule-engine atoms: booleans are numbers 0 and 1, 32-bit values numbers, everything else text."""
    num = F.when(F.col("o_kind") == "bool", F.when(F.col("o_text") == "true", 1.0).otherwise(0.0)).when(F.col("o_kind").isin("i32", "f32"), F.col("o_num"))
    kind = F.when(F.col("o_kind").isin("bool", "i32"), "number").when(F.col("o_kind") == "f32", "float64").otherwise("string")
    return facts.select("subject", "predicate", kind.alias("object_kind"), F.when(kind == "string", F.col("o_text")).alias("object_text"), num.alias("object_number"))


def search_atoms(facts: DataFrame, predicate: str, args: list[Any]) -> DataFrame:
    """Atoms of ``triples(s, p, o)`` with subject or object bound; anything else matches nothing.  Quotes around terms are dropped."""
    ok = predicate == "triples" and len(args) == 3
    s, p, o = ([a.strip("\"'") if isinstance(a, str) else a for a in args]) if ok else (None, None, None)
    if not ok or (not s and o in (None, "")):
        return facts.limit(0)
    return scan(facts, s, p, o)


def predicates(facts: DataFrame) -> DataFrame:
    return facts.select("predicate").distinct()


def count(facts: DataFrame, is_set: bool = False) -> DataFrame:
    """The number of different facts; of a table that is a set already, its rows."""
    return (facts if is_set else facts.select(*FACT_KEY).distinct()).agg(F.count(F.lit(1)).alias("n_facts"))


def document_metadata(facts: DataFrame, topic: int | None = None) -> DataFrame:
    """(subject, metadata): a map from predicate to object text; of several objects the last ingested wins."""
    df = scan(facts, topic=topic).groupBy("subject", "predicate").agg(F.max(F.struct("ingest_seq", "o_text"))["o_text"].alias("v"))
    return df.groupBy("subject").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("predicate", "v")))).alias("metadata"))


def has_document(keys: DataFrame, facts: DataFrame, vectors: DataFrame, content: DataFrame, prefix: str = "doc:") -> DataFrame:
    """Ids of ``keys`` (entity_id) that have content, a vector or a fact."""
    known = content.select("entity_id").unionByName(vectors.select("entity_id"))
    known = known.unionByName(facts.where(F.col("subject").startswith(prefix)).select(F.substring_index("subject", ":", -1).try_cast("bigint").alias("entity_id")))
    return keys.join(known, "entity_id", "left_semi")


def get_content(content: DataFrame, ids: DataFrame) -> DataFrame:
    """(entity_id, data) for every id; null data where there is none, the last write where there are several."""
    wanted = content.join(ids.select("entity_id").distinct(), "entity_id", "left_semi")  # first: only their texts move
    last = wanted.groupBy("entity_id").agg(F.max_by("data", "ingest_seq").alias("data"))
    return ids.join(last, "entity_id", "left").select("entity_id", "data")


def build_dictionary(facts: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(id, term): dense ids from 1 (or from behind ``known``'s) for all terms, by first ingestion, then text.

    Ids need one order over all terms; it's made by a range-partitioned sort and per-partition counts, not by a single task.
    """
    t = facts.select(F.explode(F.array("subject", "predicate", F.when(F.col("o_kind").isin("str", "i64", "f64"), F.col("o_text")))).alias("term"), "ingest_seq").where("term is not null")
    return number_terms(t.groupBy("term").agg(F.min("ingest_seq").alias("seq")), known)


def number_terms(new: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """``build_dictionary`` of terms that are distinct already (term, seq)."""
    first = 0
    if known is not None:
        new = new.join(known, "term", "left_anti")
        first = known.agg(F.max("id")).first()[0] or 0
    out = number_rows(new.orderBy("seq", "term"), "id", first + 1).select("id", "term")
    return out if known is None else known.select("id", "term").unionByName(out)


def number_rows(df: DataFrame, name: str, first: int = 1) -> DataFrame:
    """``df`` with consecutive numbers in its present order: the place in its partition, behind all rows of those before.

    ``df`` is kept in the shared folder, so that partitions don't change between counting and numbering.
    """
    placed = cut(df).withColumn("id_", F.monotonically_increasing_id())
    part, row = F.shiftright("id_", 33).cast("int"), F.col("id_").bitwiseAND(F.lit((1 << 33) - 1))
    counts = {r["part"]: r["count"] for r in placed.groupBy(part.alias("part")).count().collect()}  # a row a partition
    bases, at = [], first
    for k in sorted(counts):
        bases.append((k, at))
        at += counts[k]
    base = F.broadcast(df.sparkSession.createDataFrame(bases, "part_ int, base_ bigint"))
    return placed.withColumn("part_", part).join(base, "part_").select(*df.columns, (F.col("base_") + row).alias(name))


def lookup(dictionary: DataFrame, terms: DataFrame, strict: bool = False) -> DataFrame:
    """Ids of ``terms`` (term); null where unknown, or NotFound with ``strict``."""
    out = terms.join(dictionary, "term", "left")
    if strict and not out.where("id is null").limit(1).isEmpty():
        raise NotFound("unknown term")
    return out.select("term", "id")


def decode(dictionary: DataFrame, ids: DataFrame) -> DataFrame:
    """Terms of ``ids`` (id); "" where unknown."""
    return ids.join(dictionary, "id", "left").select("id", F.coalesce("term", F.lit("")).alias("term"))


def filter_rows(df: DataFrame, keep: Callable[[pd.DataFrame], pd.Series]) -> DataFrame:
    """Rows a vectorised Python predicate keeps (whole Arrow batches, never row by row)."""
    return df.mapInPandas(lambda it: (b[keep(b)] for b in it), df.schema)


def map_rows(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    return df.mapInPandas(lambda it: (fn(b) for b in it), schema)


def health(facts: DataFrame, vectors: DataFrame, content: DataFrame) -> DataFrame:
    """One row of counts."""
    one = lambda df, n: df.agg(F.count(F.lit(1)).alias(n))
    dim = vectors.agg(F.max(F.size("embedding")).alias("dimension"))
    return one(facts, "n_facts").crossJoin(one(vectors, "n_vectors")).crossJoin(one(content, "n_documents")).crossJoin(dim)
