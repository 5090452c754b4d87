"""Rules over facts: a non-recursive rule is a view, a recursive one a semi-naive fixpoint over tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import LimitExceeded
from ..operators.bgp import Pattern, bgp
from ..operators.scan import scan


def view(facts: DataFrame, name: str, head: list[str], body: list[Pattern | tuple], **kw) -> DataFrame:
    """Register ``name(head) :- body`` as a temporary view, usable in SQL."""
    df = bgp(facts, body, head, **kw)
    df.createOrReplaceTempView(name)
    return df


def predicate_view(facts: DataFrame, predicate: str, name: str | None = None) -> DataFrame:
    """The shorthand ``predicate(s, o)`` as a two-column view."""
    df = scan(facts, p=predicate).select(F.col("subject").alias("s"), F.col("o_text").alias("o"))
    df.createOrReplaceTempView(name or predicate)
    return df


def closure(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """Transitive closure of (s, o): each round joins only the last round's new pairs, and is cut from its lineage."""
    from ..sources.shared import cut

    base = cut(edges.select("s", "o").distinct())
    out, new = base, base  # each round's pairs stay in their own files
    for _ in range(rounds):
        step = new.select(F.col("s"), F.col("o").alias("m")).join(base.select(F.col("s").alias("m"), "o"), "m").select("s", "o").distinct()
        new = cut(step.join(out, ["s", "o"], "left_anti"))
        if new.isEmpty():
            return out
        out = out.unionByName(new)
    raise LimitExceeded(f"no fixpoint after {rounds} rounds")
