"""Conjunctive queries over triple patterns (basic graph patterns).

Each pattern is a filtered projection of the facts; patterns are joined on the variables they share and, topics being part of
identity, on the topic.  Joins are left to Catalyst and AQE (broadcast, hash or sort-merge by size); what the library decides is
the order of patterns, so that every join has a shared variable and selective patterns come first, and which variables are dropped
early: one that is neither asked for nor needed further is projected out before the joins that would repeat it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import LimitExceeded, StoreError
from ..plans.guard import JOIN_RESULTS
from .scan import object_is

_TOPIC = "__topic"
#: Bytes (as Catalyst estimates them from files) of the bindings that one task joins with what was derived of other patterns.
TASK_BYTES, MOST_TASKS = 4 << 20, 20_000


def is_var(term: Any) -> bool:
    return isinstance(term, str) and term.startswith("?") and len(term) > 1


@dataclass(frozen=True)
class Pattern:
    """A triple pattern; a term is a variable ("?x"), a constant, or None for anything."""

    s: Any = None
    p: Any = None
    o: Any = None

    @property
    def vars(self) -> list[str]:
        return list(dict.fromkeys(t[1:] for t in (self.s, self.p, self.o) if is_var(t)))

    @property
    def bound(self) -> int:
        return sum(t is not None and not is_var(t) for t in (self.s, self.p, self.o))


def _kind(v: str) -> str:
    return f"__kind_{v}"


def _match(facts: DataFrame, pat: Pattern, distinct: bool) -> DataFrame:
    """Bindings of one pattern: a column and a kind per variable.  Entities (subject, predicate) have kind str.

    Facts are a set, so bindings repeat only where a position is left open; there they are made distinct, if wanted.
    """
    cond, seen = [], {}
    for term, col, kind in ((pat.s, "subject", F.lit("str")), (pat.p, "predicate", F.lit("str")), (pat.o, "o_text", F.col("o_kind"))):
        if term is None:
            continue
        if not is_var(term):
            cond.append(object_is(term) if col == "o_text" else F.col(col) == term)
        elif term[1:] in seen:
            other, other_kind = seen[term[1:]]
            cond += [F.col(other) == F.col(col), other_kind == kind]
        else:
            seen[term[1:]] = (col, kind)
    df = facts.where(reduce(lambda a, b: a & b, cond)) if cond else facts
    df = df.select(F.col("topic_id").alias(_TOPIC), *[x for v, (c, k) in seen.items() for x in (F.col(c).alias(v), k.alias(_kind(v)))])
    return df.distinct() if distinct and None in (pat.s, pat.p, pat.o) else df


def order_patterns(patterns: list[Pattern], rows: Mapping[str, int] | None = None, seed: str | None = None) -> list[Pattern]:
    """Greedy order: smallest first, of those that have ``seed`` if any has, then the smallest that shares a variable.  ``rows`` has
    predicates' fact counts."""

    def cost(p: Pattern) -> tuple:
        n = (rows or {}).get(p.p, 1 << 40) if p.p is not None and not is_var(p.p) else 1 << 50
        free = 3 - p.bound
        return (0 if p.s is not None and not is_var(p.s) else 1, n >> 8 * (p.bound > 1), free)

    return _greedy(patterns, lambda p, known: cost(p), seed)


def _greedy(items: Iterable, cost: Callable[[Any, set[str]], Any], seed: str | None = None) -> list:
    left, out, known = list(items), [], {seed} if seed else set()
    while left:
        linked = [p for p in left if known & set(p.vars)] or left
        best = min(linked, key=lambda p: cost(p, known))
        out.append(best)
        left.remove(best)
        known |= set(best.vars)
    return out


@dataclass(frozen=True)
class _Relation:
    """Bindings of one pattern, or of several whose shared variable was projected out."""

    vars: list[str]
    df: DataFrame
    size: int
    derived: bool = False


def _size(df: DataFrame) -> int:
    """Catalyst's estimate in bytes; nothing is read but the sizes of files."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def _relation(facts: DataFrame, p: Pattern, rows: Mapping[str, int] | None, cross_topic: bool) -> _Relation:
    m = _match(facts, p, True)
    n = _size(m) if rows is None else rows.get(p.p, 1 << 40) if p.p is not None and not is_var(p.p) else 1 << 50
    return _Relation(p.vars, m.drop(_TOPIC) if cross_topic else m, n >> 8 * max(0, p.bound - 1))


def _on(keys: Iterable[str], cross_topic: bool) -> list[str]:
    return [*([] if cross_topic else [_TOPIC]), *[c for v in keys for c in (v, _kind(v))]]


def _project(rels: list[_Relation], keep: set[str], cross_topic: bool) -> list[_Relation]:
    """``rels`` without the variables that only they have and nobody asks for, but for the last of these.

    A variable is dropped by joining all relations that have it and making the rest distinct, cheapest join first; so a chain is
    joined from its small end, and what is kept of it is as large as its bindings, not as its paths.  The last variable is left to
    the joins in order, where relations without a new variable are filters.
    """
    while True:
        costs = {}
        for v in dict.fromkeys(v for r in rels for v in r.vars if v not in keep):
            having = [r for r in rels if v in r.vars]
            if {x for r in having for x in r.vars} != {v}:
                costs[v] = (len(having) > 1, sum(r.size for r in having), -len(costs))
        if not costs or len(costs) == 1 and min(costs.values())[0]:
            return rels
        v = min(costs, key=costs.get)
        having = sorted((r for r in rels if v in r.vars), key=lambda r: r.size)
        df, names = having[0].df, list(having[0].vars)
        for r in having[1:]:
            df = df.join(r.df, _on([x for x in r.vars if x in names], cross_topic))
            names += [x for x in r.vars if x not in names]
        names.remove(v)
        new = _Relation(names, df.select(*_on(names, cross_topic)).distinct(), max(r.size for r in having), True)
        rels = [r for r in rels if v not in r.vars] + [new]


def _joined(rels: list[_Relation], keep: set[str], cross_topic: bool, allow_cross: bool) -> tuple[DataFrame, set[str]]:
    """The relations joined: filters as soon as they can be, else patterns before what was derived of several, small ones first."""
    out: DataFrame | None = None
    known: set[str] = set()
    for r in _greedy(_project(rels, keep, cross_topic), lambda r, known: (not set(r.vars) <= known, r.derived, r.size)):
        keys = [v for v in r.vars if v in known]
        if out is None:
            out = r.df
        elif not keys and not allow_cross:
            raise StoreError(f"nothing is shared by the variables {sorted(known)} and {r.vars}")
        elif on := _on(keys, cross_topic):
            # what was derived may repeat a row many times: tasks are as many as the rows need before that
            if r.derived and (n := -(-_size(out) // TASK_BYTES)) > out.sparkSession.sparkContext.defaultParallelism and n < MOST_TASKS:
                # fewer than Spark's own number would be dealt out again
                out = out.repartition(max(n, int(out.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *keys)
            out = out.join(r.df, on, "inner" if len(keys) < len(r.vars) else "left_semi")
        else:
            out = out.crossJoin(r.df)  # asked for by ``allow_cross``
        known |= set(r.vars)
    return out, known


def _share_object(pats: list[Pattern], names: list[str] | None) -> bool:
    """Whether two patterns ask for the pairs of subjects that have an object in common."""
    if len(pats) != 2 or not all(is_var(p.s) and is_var(p.o) and p.p is not None and not is_var(p.p) for p in pats):
        return False
    a, b = pats
    return a.o == b.o and len({a.s, b.s, a.o}) == 3 and names is not None and sorted(names) == sorted(p.s[1:] for p in pats)


def _pairs(facts: DataFrame, pats: list[Pattern], names: list[str], cross_topic: bool) -> DataFrame:
    """Pairs of subjects with a common object, each once, though there may be as many as the product of both sides.

    A pair can repeat only if both subjects have several objects, so only such pairs are made distinct.  The others leave the join
    as they are.  An object that many have is cut over many tasks: subjects of the larger side by their hash, those of the other
    are sent to all of them.
    """
    a, b = sorted((_relation(facts, p, None, cross_topic) for p in pats), key=lambda r: -r.size)
    x, y, o = a.vars[0], b.vars[0], a.vars[1]
    by = _on([o], cross_topic)
    slices = 2 * facts.sparkSession.sparkContext.defaultParallelism

    def sides(r: _Relation, v: str) -> tuple[DataFrame, DataFrame]:
        df = r.df.select(v, *by).distinct()
        n = df.groupBy(v).agg(F.count(F.lit(1)).alias("n_"), F.first(F.struct(*by)).alias("o_"))
        return n.where("n_ = 1").select(v, "o_.*"), df.join(n.where("n_ > 1").select(v), v, "left_semi")

    (a1, a2), (b1, b2) = sides(a, x), sides(b, y)
    a1, a2 = (d.withColumn("slice_", F.pmod(F.xxhash64(x), F.lit(slices)).cast("int")) for d in (a1, a2))
    every = F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice_")
    b1, b2 = (d.select("*", every) for d in (b1, b2))
    once = a1.join(b1.unionByName(b2), ["slice_", *by]).select(*names).unionByName(a2.join(b1, ["slice_", *by]).select(*names))
    return once.unionByName(a2.join(b2, ["slice_", *by]).select(*names).distinct())


def predicate_stats(facts: DataFrame) -> DataFrame:
    """(predicate, n, subjects, objects) for ordering patterns: one pass, approximate distinct counts."""
    return facts.groupBy("predicate").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("subject").alias("subjects"), F.approx_count_distinct("o_text").alias("objects"))


def bgp(
    facts: DataFrame, patterns: Iterable[Pattern | tuple], result: list[str] | None = None, topic: int | None = None, distinct: bool = True,
    rows: Mapping[str, int] | None = None, cross_topic: bool = False, allow_cross: bool = False, seeds: DataFrame | None = None,
) -> DataFrame:
    """Bindings of ``result`` variables (default: all, sorted by name) that satisfy every pattern.

    All patterns constrain, whether or not their variables are in the result.  Bindings are a set unless ``distinct`` is False: then
    each is as often there as facts make it.
    Patterns without a shared variable need ``allow_cross``.  ``cross_topic`` joins entities of different topics.  ``seeds`` (one column, named
    like a variable, without repeats) are the only bindings that it may have; the join begins with a pattern that has it.
    """
    pats = [p if isinstance(p, Pattern) else Pattern(*p) for p in patterns]
    if not pats:
        raise StoreError("no patterns")
    if topic is not None:
        facts = facts.where(F.col("topic_id") == topic)
    if distinct and seeds is None and _share_object(pats, result):
        return _pairs(facts, pats, result, cross_topic)
    out: DataFrame | None = None
    known: set[str] = set()
    seed = seeds.columns[0] if seeds is not None else None
    early = distinct and seeds is None and result is not None and len(pats) > 2
    if early:
        out, known = _joined([_relation(facts, p, rows, cross_topic) for p in pats], set(result), cross_topic, allow_cross)
    for p in [] if early else order_patterns(pats, rows, seed):
        m = _match(facts, p, distinct)
        if seed in p.vars and seed not in known:
            m = m.join(seeds, seed, "left_semi")
        if cross_topic:
            m = m.drop(_TOPIC)
        if out is None:
            out = m
        else:
            keys = [v for v in p.vars if v in known]
            if not keys and not allow_cross:
                raise StoreError(f"{p} shares no variable with the patterns before it")
            on = [] if cross_topic else [_TOPIC]
            on += [c for v in keys for c in (v, _kind(v))]
            new = [v for v in p.vars if v not in known]
            if not on:
                out = out.crossJoin(m)  # asked for by ``allow_cross``
            else:
                out = out.join(m, on, "inner" if new or not distinct else "left_semi")
        known |= set(p.vars)
    names = sorted(known) if result is None else result
    lost = [v for v in names if v not in known]
    if lost:
        raise StoreError(f"no pattern has the variables {lost}")
    out = out.select(*names)
    return out.distinct() if distinct else out


def canonical(names: list[str]):
    """Canonical text of a binding: "a=1;b=2" with names sorted."""
    return F.concat_ws(";", *[F.concat(F.lit(f"{n}="), F.col(n)) for n in sorted(names)])


def ordered(bindings: DataFrame, limit: int | None = None) -> DataFrame:
    """Bindings in the order of their canonical text, columns sorted; with a limit a distributed top-k, not a full sort."""
    names = sorted(bindings.columns)
    df = bindings.select(*names).orderBy(canonical(names))
    return df if limit is None else df.limit(limit)


def seeded(facts: DataFrame, patterns: Iterable, seeds: DataFrame, seed_var: str, **kw: Any) -> DataFrame:
    """Bindings for each row of ``seeds`` (its column named like the variable), all seeds in one join; repeated seeds repeat.

    The first pattern that has the variable keeps only the seeds' bindings, so that no other is joined further.
    """
    found = bgp(facts, patterns, seeds=seeds.select(seed_var).distinct(), **kw)
    return seeds.join(found, seed_var)


def run_query(facts: DataFrame, patterns: Iterable[Pattern | tuple], result: list[str] | None = None, most: int | None = JOIN_RESULTS, **kw: Any) -> DataFrame:
    """``bgp`` under the serving limit: more than ``most`` bindings are an error (None: no limit)."""
    found = bgp(facts, patterns, result, **kw)
    return found if most is None else limited(found, most)


def limited(df: DataFrame, most: int) -> DataFrame:
    """The result if it has at most ``most`` rows, else LimitExceeded; reads no more than one row beyond."""
    if df.limit(most + 1).count() > most:
        raise LimitExceeded(f"more than {most} results")
    return df
