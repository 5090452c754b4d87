"""Planner decisions that are reported or taken by the library; physical choices are Catalyst's."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def strategy(has_vector: bool, filters: int, selectivity: float) -> str:
    """How a hybrid query is meant to run: by graph, by vector, filters first, vectors first, or both intersected."""
    if not has_vector:
        return "graph"
    if filters == 0:
        return "vector"
    if filters >= 2:
        return "intersection"
    return "graph_first" if selectivity < 0.2 else "vector_first"


def choose_index(n: int, prefer_graph: bool = False) -> str:
    """Index for n vectors: exact below 500,000, neighbour graph below a million (ten if preferred), else inverted file."""
    if n < 500_000:
        return "exact"
    if n < 1_000_000 or (prefer_graph and n < 10_000_000):
        return "graph"
    return "ivf"


def cardinality(df: DataFrame, column: str | None = None, most: int = 1000) -> int:
    """Distinct values of a column, or rows, counted no further than ``most``."""
    return (df.select(column).distinct() if column else df).limit(most).count()


def percentiles(df: DataFrame, column: str) -> DataFrame:
    return df.agg(*[F.percentile_approx(column, p / 100).alias(f"p{p}") for p in (50, 95, 99)])
