"""Hybrid queries: vector similarity with graph filters or graph expansion, and content for the final rows only.

Filters are semi joins under the top-k, so the answer is exact: no candidate limit loses matches.  ``candidates`` keeps the bounded
variant (best candidates first, then the filters) for those who want its cost.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import StoreError
from ..plans.strategy import strategy
from ..sources.shared import cut
from .bgp import Pattern, bgp, ordered
from .scan import find_subjects, get_content
from .vector import top_k

MIN_CANDIDATES, TOP = 100, 10
#: Hits that are broadcast at most: about 10 MB.
BROADCAST_HITS = 100_000


@dataclass(frozen=True)
class Find:
    """An immutable query: every method returns a new one, ``run`` the result (id, key, score[, content])."""

    facts: DataFrame
    vectors: DataFrame
    content: DataFrame | None = None
    prefix: str = "doc:"
    vector: Any = None
    threshold: float | None = None
    filters: tuple[tuple[str, Any], ...] = ()
    topic: int | None = None
    n: int | None = None  # without a limit: TOP hits, or all bindings of a graph-only query
    multiplier: int | None = None
    first: bool = False
    patterns: tuple[Pattern, ...] = ()
    seed: str | None = None
    result: tuple[str, ...] = field(default=())

    def similar_to(self, vector, threshold: float | None = None) -> Find:
        return replace(self, vector=vector, threshold=threshold)

    def where(self, predicate: str, obj: Any) -> Find:
        return replace(self, filters=(*self.filters, (predicate, obj)))

    def in_topic(self, topic: int) -> Find:
        return replace(self, topic=topic)

    def limit(self, n: int) -> Find:
        return replace(self, n=n)

    def candidates(self, multiplier: int) -> Find:
        """Filter only the max(100, multiplier * limit) best vectors; may find fewer than there are."""
        return replace(self, multiplier=multiplier)

    def filter_first(self) -> Find:
        return replace(self, first=True)

    def join(self, patterns: Iterable[Pattern | tuple], seed: str, result: Iterable[str] = ()) -> Find:
        """Expand the hits: bindings of ``patterns`` whose ``seed`` variable is a hit's key, each with the hit's score."""
        return replace(self, patterns=tuple(p if isinstance(p, Pattern) else Pattern(*p) for p in patterns), seed=seed, result=tuple(result))

    def plan(self) -> str:
        return strategy(self.vector is not None, len(self.filters), 0.1 if self.first else 1.0)

    def _facts(self) -> DataFrame:
        return self.facts if self.topic is None else self.facts.where(F.col("topic_id") == self.topic)

    def _matching(self, df: DataFrame, column: str) -> DataFrame:
        for p, o in self.filters:
            who = find_subjects(self._facts(), p, o).distinct()
            df = df.join(who, df[column] == who["subject"], "left_semi")
        return df

    def hits(self) -> DataFrame:
        key = F.concat(F.lit(self.prefix), F.col("entity_id").cast("string"))
        n = TOP if self.n is None else self.n
        if self.multiplier is None:
            pool = self._matching(self.vectors.withColumn("key", key), "key") if self.filters else self.vectors
            out = top_k(pool, self.vector, n, topic=self.topic, threshold=self.threshold)
            return out.withColumn("key", F.concat(F.lit(self.prefix), F.col("id").cast("string")))
        out = top_k(self.vectors, self.vector, max(MIN_CANDIDATES, n * self.multiplier), topic=self.topic, threshold=self.threshold)
        out = self._matching(out.withColumn("key", F.concat(F.lit(self.prefix), F.col("id").cast("string"))), "key")
        return out.orderBy(F.desc("score"), "id").limit(n)

    def run(self) -> DataFrame:
        if self.vector is None:
            if not self.patterns:
                raise StoreError("a query needs a vector or patterns")
            found = bgp(self._facts(), self.patterns, list(self.result) or None)
            return found if self.n is None else ordered(found, self.n)
        # a few rows that are used more than once: the vectors are scored only once for them
        out = cut(self.hits()) if self.patterns or self.content is not None else self.hits()
        # the limit bounds them, so they go to the facts or texts, not these to them
        few = F.broadcast if (TOP if self.n is None else self.n) <= BROADCAST_HITS else (lambda df: df)
        if self.patterns:
            found = bgp(self._facts(), self.patterns)
            if self.seed not in found.columns:
                raise StoreError(f"no pattern has the variable {self.seed}")
            keep = [self.seed, *(v for v in (self.result or found.columns) if v != self.seed)]
            return few(out).join(found, out["key"] == found[self.seed]).select("id", "score", *keep)
        out = out.select("id", "key", "score")
        if self.content is not None:
            text = get_content(self.content, few(out.select(F.col("id").alias("entity_id"))))
            out = out.join(text.select(F.col("entity_id").alias("id"), F.decode("data", "UTF-8").alias("content")), "id", "left").select("id", "key", "score", "content")
        return out


def union_streams(a: DataFrame, b: DataFrame, n: int) -> DataFrame:
    """The first n of two (id, score) results, by score, then id; a row of both appears twice."""
    return a.unionByName(b).orderBy(F.desc("score"), "id").limit(n)
