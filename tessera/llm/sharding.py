"""Operator 10, sharding: a hierarchical weighted hash tree.

Each document descends region, rack and shard.  At every node each child draws ``-ln(u) / weight`` with u uniform in
(0, 1) from a hash of the document's key and the child's path, and the smallest draw wins (weighted rendezvous
hashing).  A child's draws depend on nothing but its own path and weight, so a changed weight moves documents only into
or out of that child, and subtrees whose weights are unchanged keep their inner placement.

The weight of an inner node is the sum of its leaves', so the share of a leaf is its weight over the total.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import need

LEVELS = ("region", "rack", "shard")
#: Production tree: three regions of different capacity, 24 shards.
TREE: dict[str, dict[str, dict[str, float]]] = {
    "east": {f"r{r}": {f"s{s}": 1.0 for s in range(4)} for r in range(3)},
    "west": {"r0": {f"s{s}": 1.0 for s in range(4)}, "r1": {"s0": 2.0, "s1": 2.0, "s2": 1.0, "s3": 1.0}},
    "north": {"r0": {"s0": 3.0, "s1": 1.0}, "r1": {"s0": 1.0, "s1": 0.5}},
}


def weight(node: Mapping | float) -> float:
    return sum(map(weight, node.values())) if isinstance(node, Mapping) else float(node)


def checked(node: Mapping | float) -> None:
    if not isinstance(node, Mapping):
        if not 0 <= node < float("inf"):
            raise ValueError(f"a weight must be 0 at least, not {node}")
        return
    for name, child in node.items():
        if "/" in name:  # two paths could be one
            raise ValueError(f"a name can't hold '/': {name!r}")
        checked(child)


def draw(key: Column, path: str, w: float) -> Column:
    """The child's draw: 52 bits of an md5 as a uniform number, through the inverse of the exponential distribution."""
    u = (F.conv(F.substring(F.md5(F.concat(key, F.lit("/" + path))), 1, 13), 16, 10).cast("bigint") + 0.5) / float(1 << 52)
    return -F.log(u) / F.lit(w)


def choose(key: Column, path: str, children: Mapping) -> Column:
    """Name of the child with the smallest draw; children of weight 0 get nothing, equal draws go to the lesser name."""
    live = [(n, w) for n, c in children.items() if (w := weight(c)) > 0]
    if not live:
        return F.lit(None).cast("string")
    if len(live) == 1:
        return F.lit(live[0][0])
    draws = [F.struct(draw(key, f"{path}{n}", w).alias("d"), F.lit(n).alias("n")) for n, w in live]
    return F.array_min(F.array(*draws))["n"]


def assign_shards(docs: DataFrame, tree: Mapping = TREE) -> DataFrame:
    """(doc_id, region, rack, shard) for every row of ``docs``; reads only ``doc_id`` and moves nothing.

    A null doc_id is placed as the key "null"; repeated ids land together, whatever their texts; an empty table gives an empty
    result; texts and other columns are ignored.  Equal draws go to the lesser name.  A tree without positive weight gives
    nulls; a name with "/" or a negative weight is an error.
    """
    checked(tree)
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    out = need(docs, "doc_id").withColumn("region", choose(key, "", tree))

    def below(level: list[tuple[tuple[str, ...], Mapping]], cols: tuple[str, ...]) -> Column:
        pick = F.lit(None).cast("string")
        for names, node in level:
            at = F.lit(True)
            for c, n in zip(cols, names):
                at = at & (F.col(c) == n)
            pick = F.when(at, choose(key, "".join(f"{n}/" for n in names), node)).otherwise(pick)
        return pick

    racks = [((r,), node) for r, node in tree.items()]
    shards = [((r, k), node) for r, racks_ in tree.items() for k, node in racks_.items()]
    return out.withColumn("rack", below(racks, ("region",))).withColumn("shard", below(shards, ("region", "rack")))


def oracle(tree: Mapping = TREE) -> str:
    """The same placement in DuckDB SQL."""

    def pick(path: str, children: Mapping) -> str:
        draws = ", ".join(f"{{'d': -ln((('0x' || substr(md5(k || '/{path}{n}'), 1, 13))::BIGINT + 0.5) / {float(1 << 52)!r}) / {weight(c)!r}, 'n': '{n}'}}" for n, c in children.items() if weight(c) > 0)
        return f"list_min([{draws}]).n"

    rack = " ".join(f"WHEN region = '{r}' THEN {pick(f'{r}/', n)}" for r, n in tree.items())
    shard = " ".join(f"WHEN region = '{r}' AND rack = '{k}' THEN {pick(f'{r}/{k}/', n)}" for r, racks in tree.items() for k, n in racks.items())
    return (
        f"WITH a AS (SELECT doc_id, coalesce(doc_id::VARCHAR, 'null') AS k FROM documents), b AS (SELECT *, {pick('', tree)} AS region FROM a), "
        f"c AS (SELECT *, CASE {rack} END AS rack FROM b) SELECT doc_id, region, rack, CASE {shard} END AS shard FROM c"
    )
