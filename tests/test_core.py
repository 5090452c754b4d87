"""Scans, filters, joins, vectors, store, rules, guards, streaming: fixtures in code and random inputs."""

import itertools
import math
import time

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera import queries as core
from tessera.functions import columns, kernels
from tessera.model import (
    DimensionMismatch, Fact, Float32, Int32, InvalidFact, LimitExceeded, NotFound, PartitionLimit, ReadOnly, StoreError, facts_df, fnv1a, next_topic, number, numeric, pack_bool, pack_float32, pack_id, preset, render,
    semantic_hash, unpack_int32, unpack_local, unpack_topic, value_of, pack_int32,
)
from tessera.operators import hybrid, ivf, maintenance, scan, vector
from tessera.operators.bgp import Pattern, bgp, limited, order_patterns, ordered, run_query, seeded
from tessera.operators.store import Store
from tessera.plans import datalog, guard, strategy
from tessera.sources import vecs

SLOW = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))


@pytest.mark.parametrize("name", sorted(core.ORACLE))
def test_query_equals_sql(spark, sf, same, name):
    same(core.QUERIES[name](spark, sf), core.ORACLE[name])


def test_entry(spark, sf):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


SOCIAL = [("alice", "knows", "bob"), ("alice", "knows", "charlie"), ("bob", "knows", "alice"), ("bob", "age", 25)]


def rows(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def test_social(spark):
    f = facts_df(spark, SOCIAL)
    assert scan.scan(f, "alice", "knows").count() == 2
    assert rows(scan.scan(f, p="knows", o="bob"), "subject") == [("alice",)]
    assert scan.scan(f).count() == 4
    r = scan.scan(f, "bob", "age").first()
    assert value_of(r["o_kind"], r["o_text"]) == "25"  # 64-bit numbers come back as text
    assert scan.scan(f, "nobody").count() == 0
    with pytest.raises(NotFound):
        scan.scan(f, "nobody", strict=True)


def test_types_round_trip(spark):
    f = facts_df(spark, [("d", "t", "My"), ("d", "y", Int32(2024)), ("d", "b", True), ("d", "r", Float32(4.5)), ("d", "n", "42"), ("d", "x", 0.1)])
    got = {r["predicate"]: value_of(r["o_kind"], r["o_text"]) for r in f.collect()}
    assert got == {"t": "My", "y": 2024, "b": True, "r": 4.5, "n": "42", "x": "0.10000000000000001"}
    assert isinstance(got["y"], Int32) and isinstance(got["n"], str)


@pytest.mark.parametrize("fact", [("", "p", "o"), ("s", "", "o"), ("s", "p", None)])
def test_invalid_facts(fact):
    with pytest.raises(InvalidFact):
        Fact(*fact).check()


def test_filter_matrix(spark):
    objects = [Float32(3.14), "1e400", "1d", " 1 ", "abc", True, Int32(-5), "0x1p-2", "nan", "inf", "+7", ".5"]
    f = facts_df(spark, [(f"s{i}", "v", o) for i, o in enumerate(objects)] + [("e", "v", "")])
    hit = lambda *w: {int(r["subject"][1:]) for r in scan.scan(f, where=[scan.Where(*w)]).collect()}
    assert hit("gt", 3) == {0, 9, 10}
    assert hit("lt", 0.6) == {6, 11}
    assert hit("gte", 7) == {9, 10} and hit("lte", -5) == {6}
    assert hit("range", (-5, 3.14)) == {0, 6, 11}
    assert hit("contains", "1") == {0, 1, 2, 3, 7} and hit("contains", "") == set()
    assert hit("regex", "^[a-z]+$") == {4, 5, 8, 9}
    with pytest.raises(StoreError):
        scan.Where("like", 1).column()


@SLOW
@given(st.lists(st.text(alphabet="0123456789+-.eEinfaty x", max_size=8), min_size=1, max_size=30))
def test_numeric_column_equals_python(spark, texts):
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(numeric(F.col("t")).alias("n")).collect()
    assert [r["n"] for r in got] == [number(t) for t in texts]


def test_hint_pruning(spark):
    parts = [facts_df(spark, [(f"{t}{fl}", "p", "o")], entity_type=t, flags=fl) for t in (1, 3) for fl in (0, 4, 8, 12)]
    f = parts[0]
    for p in parts[1:]:
        f = f.unionByName(p)
    got = lambda **k: {r["subject"] for r in scan.scan_pruned(f, **k).collect()}
    assert len(got()) == 8  # no pruning at all, deprecated included
    assert got(entity_type=3) == {"30", "38"} and got(want_public=True) == {"18", "38"} and got(entity_type=1, want_public=True) == {"18"}


def test_topics_isolate(spark):
    f = facts_df(spark, SOCIAL, 1).unionByName(facts_df(spark, SOCIAL[:1], 2))
    assert scan.scan(f, topic=2).count() == 1 and scan.scan(f, topic=2, p="knows").count() == 1 and scan.scan(f, p="knows").count() == 4
    pats = [("?a", "knows", "?b"), ("?b", "knows", "?a")]
    assert rows(bgp(f, pats), "a", "b") == [("alice", "bob"), ("bob", "alice")]
    assert bgp(f, pats, topic=2).count() == 0
    assert len(scan.subjects(f).collect()) == 3


def test_cursor_dictionary_metadata(spark):
    f = facts_df(spark, SOCIAL)
    assert {str(x) for x in scan.tagged_scan(spark, "t", f)} == {"<alice, knows, bob>", "<alice, knows, charlie>", "<bob, knows, alice>", "<bob, age, 25>"}
    d = scan.build_dictionary(f)
    assert [r["id"] for r in d.orderBy("id").collect()] == list(range(1, 7))
    more = scan.build_dictionary(facts_df(spark, [("dora", "knows", "bob")]), d)
    assert more.where("term = 'dora'").first()["id"] == 7
    assert scan.lookup(d, spark.createDataFrame([("zed",)], "term string")).first()["id"] is None
    assert scan.decode(d, spark.createDataFrame([(99,)], "id bigint")).first()["term"] == ""
    meta = {r["subject"]: r["metadata"] for r in scan.document_metadata(f).collect()}
    assert meta["bob"] == {"knows": "alice", "age": "25"} and meta["alice"] == {"knows": "charlie"}
    assert scan.exists(f, "alice") and not scan.exists(f, "alice", "age")
    assert scan.search_atoms(f, "triples", [None, "knows", None]).count() == 0 and scan.search_atoms(f, "other", ["a", None, None]).count() == 0
    assert scan.filter_rows(f, lambda b: b["predicate"] == "age").count() == 1


@SLOW
@given(st.lists(st.tuples(*[st.sampled_from("abcd")] * 3), min_size=1, max_size=14), st.integers(0, 5))
def test_bgp_equals_nested_loops(spark, triples, shape):
    pats = [
        [("?x", "?p", "?y"), ("?y", "?q", "?z")], [("?x", "a", "?y"), ("?x", "b", "?z")], [("?x", "?p", "?y"), ("?y", "?p", "?z"), ("?z", "?p", "?x")],
        [("?x", "?p", "?x")], [("?x", "?y", "a")], [("?x", "?x", "?z"), ("?z", "?q", "?y")],
    ][shape]
    facts, want = set(triples), set()
    names = sorted({t[1:] for p in pats for t in p if t[0] == "?"})
    for combo in itertools.product(facts, repeat=len(pats)):
        b: dict = {}
        if all((b.setdefault(t, v) == v) if t[0] == "?" else t == v for p, f in zip(pats, combo) for t, v in zip(p, f)):
            want.add(tuple(b[f"?{n}"] for n in names))
    assert rows(bgp(facts_df(spark, facts), pats), *names) == sorted(want)


def test_bgp_rules(spark):
    f = facts_df(spark, SOCIAL)
    with pytest.raises(StoreError):
        bgp(f, [("?a", "knows", "?b"), ("?c", "age", "?d")])
    assert bgp(f, [("?a", "knows", "?b"), ("?c", "age", "?d")], allow_cross=True).count() == 3
    with pytest.raises(StoreError):
        bgp(f, [("?a", "knows", "?b")], ["z"])
    assert bgp(f, [("?a", "knows", "?b")], ["a"]).count() == 2 and bgp(f, [("?a", "knows", "?b")], ["a"], distinct=False).count() == 3
    with pytest.raises(LimitExceeded):
        limited(bgp(f, [("?a", "knows", "?b")]), 2)
    assert order_patterns([Pattern("?a", "p", "?b"), Pattern("?b", "q", "c")], {"p": 10, "q": 5})[0].p == "q"


def test_ordered_and_seeds(spark):
    f = facts_df(spark, [("1", "100", str(i)) for i in range(2, 21)])
    assert [r["leaf"] for r in ordered(bgp(f, [("1", "100", "?leaf")]), 5).collect()] == ["10", "11", "12", "13", "14"]
    g = facts_df(spark, [(str(i), "100", str(i + 10)) for i in (1, 2, 3)])
    seeds = spark.createDataFrame([("1",), ("2",), ("3",), ("3",)], "s string")
    assert rows(seeded(g, [("?s", "100", "?o")], seeds, "s"), "s", "o") == [("1", "11"), ("2", "12"), ("3", "13"), ("3", "13")]


@given(st.lists(st.tuples(st.integers(0, (1 << 24) - 1), st.integers(0, (1 << 40) - 1)), min_size=1, max_size=20))
@SLOW
def test_ids_round_trip(spark, ids):
    df = spark.createDataFrame(ids, "t int, l bigint").select("t", "l", pack_id(F.col("t"), F.col("l")).alias("i"))
    assert df.where((unpack_topic(F.col("i")) != F.col("t")) | (unpack_local(F.col("i")) != F.col("l"))).isEmpty()
    ints = spark.createDataFrame([(i[1] % (1 << 32) - (1 << 31),) for i in ids], "v int")
    assert ints.where(unpack_int32(pack_int32(F.col("v"))) != F.col("v")).isEmpty()


def test_scalars(spark):
    assert next_topic((1 << 24) - 1) == (1 << 24) - 1 and preset("minimum")["spark.sql.shuffle.partitions"] == "4"
    words = ["", "alice", "Größe", "x" * 300]
    got = [r["h"] for r in spark.createDataFrame([(w,) for w in words], "w string").select(semantic_hash(F.col("w")).alias("h")).collect()]
    assert got == [fnv1a(w) & 255 for w in words]
    assert render(1e6)[1] == "1000000" and render(True)[0] == "bool"
    from tessera.functions.columns import bits_float, dot, float_bits

    df = spark.createDataFrame([(3.5, [1.0, 2.0])], "x float, v array<float>")
    assert df.select(bits_float(float_bits("x")).alias("y")).first()["y"] == 3.5 and df.select(dot("v", "v").alias("d")).first()["d"] == 5.0


# -- vectors
def unit(n, d, seed=42):
    x = np.random.default_rng(seed).normal(size=(n, d))
    return kernels.l2_normalize(x)


def spikes(n, d, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    for i in range(0, n, 20):
        x[i, rng.integers(0, d, 3)] = rng.uniform(50, 100, 3)
    return x


def test_transform():
    for d in (4, 32, 256, 2048):
        x = np.random.default_rng(d).normal(size=(3, d))
        assert np.abs(kernels.fwht(kernels.fwht(x)) / d - x).max() < 1e-5


@pytest.mark.parametrize(("bits", "least"), [(8, 0.99), (4, 0.95)])
def test_quantized_fidelity(bits, least):
    for x in (np.stack([np.arange(128) / 128, np.arange(128)[::-1] / 128]), spikes(40, 1536), unit(50, 100)):
        y = kernels.dequantize(kernels.quantize(x, bits), x.shape[1], bits)
        cos = (x * y).sum(1) / np.linalg.norm(x, axis=1) / np.linalg.norm(y, axis=1)
        assert cos.min() > least - (0.05 if x.shape[1] == 1536 and bits == 4 else 0)
        q = x[0]
        assert np.allclose(kernels.dot_quantized(kernels.quantize(x, bits), q, bits), y @ q, atol=1e-2 * np.linalg.norm(q) ** 2)
    assert kernels.code_bytes(1536, 8) == 2816 and kernels.code_bytes(1536, 4) == 1792


def vec_df(spark, x, topic=1):
    return spark.createDataFrame([(i, topic, [float(v) for v in r], i % 256) for i, r in enumerate(x)], "entity_id bigint, topic_id int, embedding array<float>, semantic_hash smallint")


@pytest.mark.parametrize("bits", [8, 4])
def test_quantized_recall(spark, bits):
    x = unit(2000, 128)
    v = vec_df(spark, x)
    codes = vector.quantized(v, bits).cache()
    got = []
    for i in range(5):
        truth = {r["id"] for r in vector.top_k(v, x[i], 10).collect()}
        got.append(len(truth & {r["id"] for r in vector.top_k_quantized(codes, x[i], 10, bits).collect()}) / 10)
    assert np.mean(got) >= 0.8


def test_vector_rules(spark):
    x = np.zeros((5, 1536))
    x[:, 0], x[:, 1] = np.arange(1, 6), 1
    q = np.eye(1536)[0]
    assert [r["id"] for r in vector.top_k(vec_df(spark, x), q, 5).collect()] == [4, 3, 2, 1, 0]
    assert vector.top_k(vec_df(spark, x), q, 0).count() == 0
    assert [r["id"] for r in vector.top_k(vec_df(spark, np.ones((5, 4))), np.ones(4), 3).collect()] == [0, 1, 2]  # ties: least id
    with pytest.raises(DimensionMismatch):
        vector.checked(vec_df(spark, x), 12)
    with pytest.raises(PartitionLimit):
        vector.checked(vec_df(spark, x).unionByName(vec_df(spark, x, 2)), 1536, 1)
    with pytest.raises(Exception, match="dimensions"):
        vector.top_k(vec_df(spark, x), np.ones(3), 1).collect()
    v = vec_df(spark, unit(100, 16))
    found = vector.top_k_batch(v, v.select(F.col("entity_id").alias("query_id"), "embedding"), 5)
    assert vector.recall(found, found, 5).first()["recall"] == 1.0
    gone = spark.createDataFrame([(1,)], "entity_id bigint")
    assert vector.delete(v, gone).count() == 99


def test_ivf(spark, tmp_path):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(20, 32)) * 4
    x = centres[rng.integers(0, 20, 2000)] + rng.normal(size=(2000, 32))
    v = vec_df(spark, x)
    index = ivf.train(v, centroids=20, parts=8, codes=64)
    index.postings = index.postings.cache()
    hits = []
    for i in range(5):
        truth = np.lexsort((np.arange(2000), ((x - x[i]) ** 2).sum(1)))[:10]
        got = [r["id"] for r in ivf.search(index, x[i], 10, probes=8, rerank=v, candidates=200).collect()]
        hits.append(len(set(truth) & set(got)) / 10)
        s = [r["score"] for r in ivf.search(index, x[i], 10, probes=8).collect()]
        assert s == sorted(s, reverse=True)
    assert np.mean(hits) >= 0.8
    ivf.save(index, str(tmp_path / "p"))
    assert ivf.load(spark, str(tmp_path / "p")).postings.count() == 2000


def neighbours(x, k):
    d = kernels.sq_dist(x, x)
    return np.argsort(d, axis=1, kind="stable")[:, :k]


@pytest.mark.parametrize("name", ["vec_ivfpq_search", "vec_ivfpq_rerank", "vec_quantized_topk"])
@pytest.mark.parametrize("size", ["0.01", "0.1"])
def test_registered_search_recall(spark, sf, name, size):
    d = sf.replace("0.001", size)
    t = spark.read.parquet(f"{d}/embeddings.parquet").orderBy("vec_id").toArrow()
    ids, x = t["vec_id"].to_numpy(), vector.matrix(t["embedding"].combine_chunks())
    truth = {(int(ids[i]), int(ids[j])) for i, r in enumerate(neighbours(x, 10)) for j in r if ids[i] % 50 == 0}
    got = [(r["query_id"], r["id"]) for r in core.QUERIES[name](spark, d).collect()]
    assert len(got) == len(set(got)) == 10 * sum(ids % 50 == 0)
    assert len(truth & set(got)) >= 0.9 * len(truth)


def test_index_lifecycle(spark, tmp_path):
    x = unit(400, 16)
    v, path = vec_df(spark, x), str(tmp_path / "index")
    ivf.save(ivf.train(v.where("entity_id < 300"), centroids=8, parts=4, codes=32), path)
    index = ivf.load(spark, path)
    assert index.postings.count() == 300
    index = ivf.add(spark, path, v.where("entity_id >= 300"))
    assert index.postings.count() == 400 and ivf.add(spark, path, v.limit(0)).postings.count() == 400
    found = ivf.search(index, x[350], 3, probes=2)
    assert found.first()["id"] == 350
    assert "PartitionFilters: [centroid" in found._jdf.queryExecution().toString() or "centroid#" in found._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: [")[1].split("]")[0]
    q = v.where("entity_id in (3, 350)").select(F.col("entity_id").alias("query_id"), "embedding")
    got = ivf.search_batch(index, q, 2, probes=8, rerank=v, candidates=400).orderBy("query_id", F.desc("score")).collect()
    want = [(i, int(j)) for i in (3, 350) for j in np.argsort(((x - x[i]) ** 2).sum(1), kind="stable")[:2]]
    assert [(r["query_id"], r["id"]) for r in got] == want


def test_pruning_bound(spark):
    """No quantized dot product exceeds its bound by more than the codes' error, so a bound below the k-th score prunes for good."""
    x = unit(200, 64)
    codes = kernels.quantize(x, 8)
    for q in x[:5]:
        assert (kernels.dot_quantized(codes, q) <= kernels.dot_upper_bound(codes, q) + 0.05).all()


def test_serving_limits(spark):
    v, f = vec_df(spark, unit(200, 8)), facts_df(spark, [(f"s{i}", "p", "o") for i in range(20)])
    assert vector.search(v, unit(1, 8)[0], 100).count() == 100
    with pytest.raises(LimitExceeded):
        vector.search(v, unit(1, 8)[0], 101)
    assert run_query(f, [("?s", "p", "?o")], most=20).count() == run_query(f, [("?s", "p", "?o")], most=None).count() == 20
    with pytest.raises(LimitExceeded):
        run_query(f, [("?s", "p", "?o")], most=19)


def test_seeds_come_first(spark):
    f = facts_df(spark, [(f"a{i}", "p", f"b{i % 5}") for i in range(30)] + [(f"b{i}", "q", f"c{i}") for i in range(5)])
    pats = [Pattern("?b", "q", "?c"), Pattern("?a", "p", "?b")]
    assert order_patterns(pats, seed="a") == pats[::-1] and order_patterns(pats, seed="zz") == order_patterns(pats)
    seeds = spark.createDataFrame([("a3",), ("a3",), ("a7",), ("none",)], "a string")
    assert rows(seeded(f, pats, seeds, "a"), "a", "b", "c") == [("a3", "b3", "c3"), ("a3", "b3", "c3"), ("a7", "b2", "c2")]


def test_bag_semantics(spark):
    f = facts_df(spark, [("a", "p", "1"), ("a", "q", "1"), ("a", "p", "2"), ("b", "p", "1")])
    assert bgp(f, [Pattern("?s", None, "?o")], distinct=False).count() == 4
    assert bgp(f, [Pattern("?s", None, "?o")]).count() == 3
    assert bgp(f, [Pattern("?s", "p", None), Pattern("?s", None, "?o")], ["s"], distinct=False).count() == 7
    assert bgp(f, [Pattern("?s", "p", None), Pattern("?s", None, "?o")], ["s"]).count() == 2


def test_small_functions(spark):
    f = facts_df(spark, SOCIAL)
    assert strategy.cardinality(f) == 4 and strategy.cardinality(f, "subject") == 2 and strategy.cardinality(f, most=3) == 3
    p = strategy.percentiles(spark.range(1, 101), "id").first()
    assert (p["p50"], p["p95"], p["p99"]) == (50, 95, 99)
    assert rows(scan.map_rows(f.select("subject"), lambda b: b.assign(subject=b["subject"].str.upper()), "subject string"), "subject")[0] == ("ALICE",)
    x = spark.createDataFrame([(0.1, 1.5, True), (1e300, -2.25, False)], "d double, f float, b boolean")
    r = x.select(columns.shortest_17("d").alias("d"), columns.bits_float(pack_float32(columns.float_bits("f"))).alias("f"), (pack_bool(F.col("b")) - (1 << 39) == 1).alias("b")).collect()
    assert [tuple(y) for y in r] == [("0.10000000000000001", 1.5, True), ("1.0000000000000001e+300", -2.25, False)]
    n = scan.number_rows(spark.range(50).repartition(7).orderBy(F.desc("id")), "n", 10).collect()
    assert sorted((r["n"], r["id"]) for r in n) == [(10 + i, 49 - i) for i in range(50)]


def test_cancel(spark):
    import threading

    slow = spark.range(4).repartition(4).mapInPandas(lambda it: ((time.sleep(30), b)[1] for b in it), "id bigint")
    df = slow.selectExpr("cast(id as string) as subject", "'p' as predicate", "'str' as o_kind", "'x' as o_text")
    threading.Timer(3, lambda: scan.cancel(spark, "stop-me")).start()
    t = time.time()
    with pytest.raises(Exception, match="(?i)cancel"):
        list(scan.tagged_scan(spark, "stop-me", df))
    assert time.time() - t < 25


def test_bound_terms_reach_the_scan(spark, sf):
    """A bound entity is a filter of its key column in the scan; relations that can't match aren't read."""
    from tessera.sources import graph

    plan = scan.scan(graph.facts(spark, sf, s="order:33", p="contains"), "order:33", "contains")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "EqualTo(l_orderkey,33)" in plan
    assert graph.facts(spark, sf, s="order:033").count() == graph.facts(spark, sf, s="nobody:1").count() == graph.facts(spark, sf, o="region:x", p="in_region").count() == 0
    for kw in ({"s": "customer:7", "topic": 1}, {"o": "nation:3", "topic": 1}):
        assert scan.scan(graph.facts(spark, sf, **kw), **kw).count() == scan.scan(graph.facts(spark, sf), **kw).count() > 0


def test_batched_searches_equal_single_ones(spark):
    x = unit(300, 16)
    v = vec_df(spark, x)
    queries = v.where("entity_id < 5").select(F.col("entity_id").alias("query_id"), "embedding")
    index = ivf.train(v, centroids=6, parts=4, codes=16)
    codes = vector.quantized(v, 8)
    for batch, single in (
        (ivf.search_batch(index, queries, 4, probes=2), lambda q: ivf.search(index, q, 4, probes=2)),
        (vector.top_k_quantized_batch(codes, queries, 4), lambda q: vector.top_k_quantized(codes, q, 4)),
    ):
        got = batch.orderBy("query_id", F.desc("score"), "id").collect()
        want = [(i, r["id"], r["score"]) for i in range(5) for r in single(x[i]).collect()]
        assert [r["query_id"] for r in got] == [w[0] for w in want]
        assert [r["id"] for r in got] == [w[1] for w in want]
        assert np.allclose([r["score"] for r in got], [w[2] for w in want], atol=1e-5)


def test_batch_of_many_blocks(spark, monkeypatch):
    for name in ("MAX_QUERY_BYTES", "BLOCK_BYTES"):
        monkeypatch.setattr(vector, name, 700, raising=False)
    x = unit(100, 16)
    v = vec_df(spark, x)
    got = vector.top_k_batch(v, v.select(F.col("entity_id").alias("query_id"), "embedding"), 3).collect()
    want = {(i, int(j)) for i, r in enumerate(neighbours(x, 3)) for j in r}
    assert {(r["query_id"], r["id"]) for r in got} == want and len(got) == 300


def test_vecs(spark, tmp_path):
    x = np.arange(60, dtype=np.float32).reshape(12, 5)
    vecs.write_vecs(str(tmp_path / "a.fvecs"), x)
    got = vecs.read_vecs(spark, str(tmp_path / "a.fvecs")).orderBy("id").collect()
    assert [list(r["values"]) for r in got] == x.tolist() and [r["id"] for r in got] == list(range(12))


def test_planner():
    cases = [((False, 1, 0.5), "graph"), ((True, 0, 0), "vector"), ((True, 1, 0.19), "graph_first"), ((True, 1, 0), "graph_first"), ((True, 1, 0.2), "vector_first"), ((True, 1, 0.99), "vector_first"), ((True, 2, 0.1), "intersection"), ((True, 5, 0.5), "intersection")]
    assert all(strategy.strategy(*a) == w for a, w in cases)
    sizes = [(100_000, False), (750_000, False), (999_999, False), (1_000_000, False), (2_000_000, True), (10_000_000, False), (10_000_000, True)]
    assert [strategy.choose_index(*a) for a in sizes] == ["exact", "graph", "graph", "ivf", "graph", "ivf", "ivf"]


def test_rare_filter_finds_all(spark):
    x = unit(1000, 16)
    f = facts_df(spark, [(f"doc:{i}", "category", "rare" if i % 100 == 0 else "common") for i in range(1000)])
    find = hybrid.Find(f, vec_df(spark, x)).similar_to(x[1])
    exact = find.where("category", "rare").limit(10).run()
    assert rows(exact, "id") == [(i,) for i in range(0, 1000, 100)]
    assert find.where("category", "rare").candidates(1).run().count() <= 10
    assert find.where("category", "rare").plan() == "vector_first" and find.plan() == "vector"
    with pytest.raises(StoreError):
        hybrid.Find(f, vec_df(spark, x)).run()


def test_hits_go_to_the_texts(spark, sf):
    """The texts of all documents aren't shuffled for those of a few hits."""
    from tessera.sources import graph

    q = hybrid.Find(graph.facts(spark, sf), graph.vectors(spark, sf), graph.content(spark, sf)).similar_to(unit(1, 64)[0]).run()
    assert len(q.collect()) == 10  # some vectors have no text
    plan = q._jdf.queryExecution().executedPlan().toString()
    semi = plan.split("LeftSemi")[0].splitlines()[-1]
    assert "BroadcastHashJoin" in semi, plan


def test_graph_only_returns_all_bindings(spark):
    find = hybrid.Find(facts_df(spark, [(f"nation:{i}", "in_region", "region:1") for i in range(150)]), vec_df(spark, unit(3, 4))).join([("?n", "in_region", "region:1")], "n")
    assert find.run().count() == 150 and find.limit(7).run().count() == 7


# -- store
def test_store_lifecycle(spark, tmp_path):
    s = Store(spark, str(tmp_path / "kg"), dimension=4)
    assert s.add_facts([("alice", "knows", "bob"), ("alice", "knows", "bob"), ("bob", "age", Int32(25))]) == 2
    assert s.add_facts([("alice", "knows", "bob")]) == 0 and s.count() == 2
    assert s.add_if_absent(("a", "b", "c")) and not s.add_if_absent(("a", "b", "c"))
    s.add_document(1, b"text", [1.0, 2, 3, 4], {"author": "x", "year": 2024})
    assert s.count() == 5 and bytes(s.content().first()["data"]) == b"text" and s.vectors().count() == 1
    with pytest.raises(InvalidFact):
        s.add_facts([])
    with pytest.raises(DimensionMismatch):
        s.add_document(2, vector=[1.0])
    with pytest.raises(RuntimeError):
        with s.transaction() as tx:
            tx.add_facts([("x", "y", "z")])
            assert tx.exists("x")
            raise RuntimeError
    assert not scan.exists(s.facts(), "x")  # rolled back
    again = Store(spark, str(tmp_path / "kg"))  # reopened
    assert again.count() == 5
    again.delete_subjects(["alice"])
    assert again.count() == 4 and s.count() == 5  # s still reads its own snapshot
    with pytest.raises(StoreError):
        s.add_facts([("late", "w", "1")])  # an outdated writer
    s.refresh().delete_document(1)
    assert s.count() == 2 and s.content().count() == 0 and s.vectors().count() == 0
    s.add_document(1, b"new")
    assert bytes(s.content().first()["data"]) == b"new"
    s.compact()
    assert s.count() == 2 and Store(spark, str(tmp_path / "kg")).content().count() == 1
    with pytest.raises(ReadOnly):
        Store(spark, str(tmp_path / "kg"), read_only=True).add_facts([("q", "r", "s")])
    s.reset()
    assert s.count() == 0


def test_retention_by_sort(spark, monkeypatch):
    monkeypatch.setattr(maintenance, "FEW", 10)
    f = facts_df(spark, [(f"s{i:03d}", "p", "o") for i in range(200)]).repartition(5)
    assert rows(maintenance.retain(f, 50), "subject") == [(f"s{i:03d}",) for i in range(150, 200)]
    assert rows(maintenance.retain(f, 10), "subject") == [(f"s{i:03d}",) for i in range(190, 200)]
    assert maintenance.retain(f, 500).count() == 200


def test_retention_and_merge(spark, tmp_path):
    s = Store(spark, str(tmp_path / "r"))
    s.add_facts([(f"retain_{i:04d}", "type", "test") for i in range(110)])
    s.set_retention(105)
    s.compact()
    assert s.count() == 105 and not scan.exists(s.facts(), "retain_0004") and scan.exists(s.facts(), "retain_0005")
    s.merge(facts_df(spark, [("retain_0005", "type", "test"), ("new", "p", "o")]))
    assert s.count() == 106
    a = facts_df(spark, SOCIAL)
    assert maintenance.merge(a, a).count() == 4 and maintenance.retain(a, 0).count() == 4


def test_the_last_write_wins(spark, tmp_path):
    """Whatever sequence numbers rows bring along."""
    s = Store(spark, str(tmp_path / "w"))
    fact = ("a", "p", "o")
    s.add_facts(facts_df(spark, [fact], flags=8, first_seq=1000))
    s.add_facts([fact])
    assert s.facts().first()["flags"] == 0
    s.add_facts(facts_df(spark, [fact], flags=4))
    assert s.facts().first()["flags"] == 4 and s.count() == 1
    both = facts_df(spark, [fact], flags=1, first_seq=9).unionByName(facts_df(spark, [fact], flags=2, first_seq=3))
    s.add_facts(both)  # of one write the row of the largest number
    assert s.facts().first()["flags"] == 1
    s.update(lambda tx: tx.add_vectors([(1, [1.0, 0.0]), (1, [0.0, 1.0])]))
    assert list(s.vectors().first()["embedding"]) == [0.0, 1.0]
    s.update(lambda tx: tx.add_vectors([(1, [0.5, 0.5])]))
    s.compact()
    assert list(s.vectors().first()["embedding"]) == [0.5, 0.5] and s.facts().first()["flags"] == 1
    s.update(lambda tx: tx.add_vectors([(1, [0.25, 0.5])]))
    assert list(s.vectors().first()["embedding"]) == [0.25, 0.5]


def test_two_writers(spark, tmp_path):
    """Of two commits on one version one gets an error, even if neither saw the other before it wrote its manifest."""
    a, b = Store(spark, str(tmp_path / "t")), Store(spark, str(tmp_path / "t"))
    b._load = lambda: None  # b looked before a committed
    a.add_facts([("a", "p", "o")])
    with pytest.raises(StoreError):
        b.add_facts([("b", "p", "o")])
    again = Store(spark, str(tmp_path / "t"))
    assert rows(again.facts(), "subject") == [("a",)]
    assert not [n for n in again._names() if n.startswith(".manifest")]


@pytest.mark.parametrize("damage", [b"", b"0", b"00000000\n{}", None])
def test_torn_commit(spark, tmp_path, damage):
    """A manifest cut short, of a wrong checksum, or lost: the version before holds, and the next commit goes on from there."""
    s = Store(spark, str(tmp_path / "c"))
    s.add_facts([("a", "p", "o")])
    s.add_facts([("b", "p", "o")])
    last = tmp_path / "c" / "manifest-2.json"
    last.unlink() if damage is None else last.write_bytes(damage)
    s = Store(spark, str(tmp_path / "c"))
    assert rows(s.facts(), "subject") == [("a",)]
    s.add_facts([("c", "p", "o")])
    assert rows(Store(spark, str(tmp_path / "c")).facts(), "subject") == [("a",), ("c",)]
    s.compact()
    s.reset()
    assert s.count() == 0 and all(n.startswith("manifest-") for n in s._names())


def test_compaction(spark, tmp_path):
    s = Store(spark, str(tmp_path / "z"), compact_after=5)
    for i in range(9):
        s.add_facts([(f"s{i}", f"p{i % 3}", "o"), ("same", "p/0 %", "o")])
    assert len(s.manifest["log"]) <= 6 and s.count() == 10
    s.compact()
    plan = scan.scan(s.facts(), p="p/0 %", topic=1)
    assert rows(plan, "subject") == [("same",)]
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: []" not in text and "topic_id" in text.split("PartitionFilters: [")[1].split("]")[0] and "predicate" in text.split("PartitionFilters: [")[1].split("]")[0]


# -- rules, guards, streaming
def test_closure(spark):
    e = spark.createDataFrame([(str(i), str(i + 1)) for i in range(6)] + [("5", "0")], "s string, o string")
    assert datalog.closure(e).count() == 6 * 7
    datalog.predicate_view(facts_df(spark, SOCIAL), "knows", "knows_view")
    assert spark.sql("select count(*) n from knows_view").first()["n"] == 3


def test_breaker():
    now, seen = [0.0], []
    b = guard.Breaker(failures=2, successes=2, reset_s=10, clock=lambda: now[0], on_change=lambda a, z: seen.append(z))

    def bad():
        raise ValueError

    for _ in range(2):
        with pytest.raises(ValueError, match=""):
            b.call(bad)
    with pytest.raises(guard.Open):
        b.call(lambda: 1)
    now[0] = 11
    assert b.call(lambda: 1) == 1 and b.state == "half_open" and b.call(lambda: 2) == 2 and b.state == "closed"
    assert seen == ["open", "half_open", "closed"] and b.failure_rate == 0.5
    b.force_open()
    b.reset()
    assert b.state == "closed" and b.failure_rate == 0


def test_time_limit(spark):
    def slow():
        return spark.range(4).repartition(4).mapInPandas(lambda it: (time.sleep(20) or b for b in it), "id bigint").count()

    t = time.time()
    with pytest.raises(guard.TimedOut):
        guard.limited(spark, slow, 1.5)
    assert time.time() - t < 15


def test_telemetry():
    t, got = guard.Telemetry(), []
    t.register(lambda e: 1 / 0)
    t.register(lambda e: got.append((e.kind, e.data)))
    t.emit("query", rows=3)
    assert got == [("query", {"rows": 3})]


def test_streaming(spark, sf, tmp_path):
    from tessera.streaming import ingest

    s = Store(spark, str(tmp_path / "stream"))
    q = ingest.into_store(ingest.event_facts(ingest.read_events(spark, sf)), s, str(tmp_path / "cp"))
    q.awaitTermination(120)
    s.refresh()
    e = spark.read.parquet(f"{sf}/events.parquet")
    want = e.select("user_id", "event_type").distinct().count() + e.where("value is not null").count()
    assert s.count() == want
    for df, mode in ((ingest.windowed(ingest.read_events(spark, sf)), "complete"), (ingest.running_totals(ingest.read_events(spark, sf)), "update")):
        name = f"m_{mode}"
        q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert spark.sql(f"select sum(n) n from {name}").first()["n"] == e.count()
    assert not math.isnan(s.count())


def _optimized(df):
    return str(df._jdf.queryExecution().optimizedPlan().toString())


def test_pairs_of_a_shared_object_are_each_there_once(spark):
    """Of a product only pairs of subjects that both have several objects are made distinct."""
    one = [(f"a{i}", "p", f"x{i % 2}") for i in range(6)] + [(f"b{i}", "q", f"x{i % 2}") for i in range(4)]
    f = facts_df(spark, [*one, ("a0", "p", "x1"), ("a1", "p", "x0"), ("b0", "q", "x1"), ("b1", "q", "x0"), ("a9", "p", "none"), ("a8", "p", Int32(1)), ("b8", "q", "1")])
    pats = [("?a", "p", "?o"), ("?b", "q", "?o")]
    of = {s: {o for t, _, o in [*one, ("a0", "p", "x1"), ("a1", "p", "x0"), ("b0", "q", "x1"), ("b1", "q", "x0")] if t == s} for s in {t[0] for t in one}}
    want = sorted((b, a) for a in of for b in of if a[0] == "a" and b[0] == "b" and of[a] & of[b])
    assert [tuple(r) for r in sorted(bgp(f, pats, ["b", "a"]).collect())] == want
    assert rows(bgp(f, pats, ["b", "a"], cross_topic=True), "b", "a") == want
    assert not _optimized(bgp(f, pats, ["a", "b"])).startswith("Aggregate")  # it did for the whole product
    both = f.unionByName(f.withColumn("topic_id", F.lit(2)))
    assert rows(bgp(both, pats, ["b", "a"]), "b", "a") == want
    assert rows(bgp(f.unionByName(f), pats, ["b", "a"]), "b", "a") == want


CHAIN = [("?o", "a", "?p"), ("?p", "b", "?s"), ("?s", "c", "?n"), ("?n", "d", "?r")]
TRIANGLE = [("?o", "a", "?c"), ("?o", "b", "?p"), ("?p", "c", "?s"), ("?s", "d", "?n"), ("?c", "d", "?n")]


@pytest.mark.parametrize("pats, names, aggregates", [(TRIANGLE, ["c", "o", "n"], 2), (CHAIN, ["o", "r"], 3), ([*CHAIN, ("?o", "b", "?z")], ["r"], 3), (CHAIN, ["s"], 2)])
def test_variables_are_dropped_before_paths_multiply(spark, pats, names, aggregates):
    rng = np.random.default_rng(5)
    f = facts_df(spark, sorted({(f"e{rng.integers(7)}", "abcd"[rng.integers(4)], f"e{rng.integers(7)}") for _ in range(60)}))
    f = f.withColumn("topic_id", F.when(F.col("o_text") == "e6", 2).otherwise(F.col("topic_id")))
    for cross in (False, True):
        bag = bgp(f, pats, names, distinct=False, cross_topic=cross)  # joined in order, nothing dropped
        assert rows(bgp(f, pats, names, cross_topic=cross), *names) == rows(bag.distinct(), *names)
    assert _optimized(bgp(f, pats, names)).count("Aggregate [") >= aggregates  # one, at the end, before


@pytest.mark.parametrize("search", ["dot", "l2", "quantized", "ivf"])
def test_batched_scores_exist_a_tile_at_a_time(spark, monkeypatch, search):
    """Of a block's scores no more than a tile is made at once, and the best are those of the whole block."""
    import pyarrow as pa

    rng = np.random.default_rng(3)
    n, k = 700, 5
    m = np.round(rng.normal(size=(n, 32)), 1)
    m[300:400] = m[:100]  # ties across tiles
    held = {}
    monkeypatch.setattr(vector, "block_top_k", lambda vectors, queries, k, prepare: held.update(prepare=prepare))
    monkeypatch.setattr(ivf, "block_top_k", vector.block_top_k)
    v = spark.createDataFrame([(0, [0.0])], "entity_id long, embedding array<float>")
    table = {"id": pa.array(np.arange(n)), "embedding": pa.array(list(m)), "codes": pa.array(kernels.quantize(m))}
    if search == "quantized":
        vector.top_k_quantized_batch(vector.quantized(v), v, k)
    elif search == "ivf":
        c = kernels.kmeans(m, 9)
        near = kernels.nearest(m, c)
        book = kernels.train_pq(m - c[near], 8, 16)
        ivf.search_batch(ivf.Index(c, book, v.selectExpr("entity_id as id", "1 as centroid", "embedding as codes")), v, k, probes=3)
        table |= {"centroid": pa.array(near), "codes": pa.array([r.tobytes() for r in kernels.encode_pq(m - c[near], book)])}
    else:
        vector.top_k_batch(v, v, k, search)
    ids, score = held["prepare"](pa.table(table))
    whole = vector._best_rows(ids, score(m[:50])(0, n), k)
    monkeypatch.setattr(vector, "TILE", 64)
    widths = []

    def some(a, b):
        s = score(m[:50])(a, b)
        widths.append(s.shape[1])
        return s

    best = vector._tiled(ids, some, k)
    assert max(widths) == 64 and sum(widths) == n
    assert best[0].tolist() == whole[0].tolist() and best[1].tolist() == whole[1].tolist() and np.allclose(best[2], whole[2])


@pytest.mark.parametrize("search", ["dot", "l2", "ivf", "rerank"])
def test_memory_of_a_pair_of_blocks(spark, monkeypatch, search):
    """Of two blocks neither the vectors nor the scores are held at once, whatever their size; the best are those of the whole."""
    import tracemalloc

    import pyarrow as pa

    rng = np.random.default_rng(4)
    n, k = 30_000, 100 if search == "rerank" else 10
    m = np.round(rng.normal(size=(n, 64)), 1)
    m[20_000:] = m[:10_000]  # ties across tiles
    v = spark.createDataFrame([(0, 0, [0.0])], "entity_id long, query_id long, embedding array<float>")
    held = {}
    monkeypatch.setattr(vector, "block_top_k", lambda vectors, queries, k, prepare: held.update(prepare=prepare) or v.selectExpr("query_id", "entity_id as id"))
    monkeypatch.setattr(ivf, "block_top_k", vector.block_top_k)
    if search in ("dot", "l2"):
        vector.top_k_batch(v, v, k, search)
        table = pa.table({"id": np.arange(n), "embedding": pa.array(list(m.astype(np.float32)))})
    else:
        c = kernels.kmeans(m[:2000], 16, 3)
        near = kernels.nearest(m, c)
        book = np.stack([kernels.kmeans(x, 16, 3) for x in (m[:2000] - c[near[:2000]]).reshape(2000, 16, 4).swapaxes(0, 1)])
        ivf.search_batch(ivf.Index(c, book, v.selectExpr("entity_id as id", "1 as centroid", "embedding as codes")), v, k, probes=13, rerank=v if search == "rerank" else None)
        table = pa.table({"id": np.arange(n), "centroid": near, "codes": pa.array([r.tobytes() for r in kernels.encode_pq(m - c[near], book)])})
    q = m[:: n // vector.SLICE][: vector.SLICE]
    tracemalloc.start()
    ids, score = held["prepare"](table)
    got = vector._tiled(ids, score(q), k)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 30e6  # the decoded vectors alone take 15, a tile of the old size and what is made of it 50 more
    whole = vector._best_rows(ids, score(q[:40])(0, n), k)
    assert [x[got[0] < 40].tolist() for x in got[:2]] == [x.tolist() for x in whole[:2]]
    assert np.allclose(got[2][got[0] < 40], whole[2])


def test_results_bound_a_block_of_queries(spark, monkeypatch):
    """The more candidates a query has, the fewer queries are a block; all are answered."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 4))
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "entity_id long, embedding array<float>")
    q = v.selectExpr("entity_id as query_id", "embedding")
    monkeypatch.setattr(vector, "RESULT_BYTES", 24 * 20 * 50)
    out = vector.top_k_batch(v, q, 20)
    assert "sequence(0, 5," in out._jdf.queryExecution().analyzed().toString()  # each vector goes to six blocks of queries
    got = {}
    for r in out.collect():
        got.setdefault(r["query_id"], set()).add(r["id"])
    s = x.astype(np.float32).astype(float) @ x.astype(np.float32).astype(float).T
    assert got == {i: set(np.argsort(-s[i], kind="stable")[:20].tolist()) for i in range(300)}


def test_nearest_makes_some_distances_at_a_time(monkeypatch):
    rng = np.random.default_rng(6)
    x, c = rng.normal(size=(1000, 8)), rng.normal(size=(32, 8))
    want = kernels.sq_dist(x, c).argmin(1)
    sizes, whole = [], kernels.sq_dist
    monkeypatch.setattr(kernels, "NEAR_BYTES", 32 * 8 * 100)
    monkeypatch.setattr(kernels, "sq_dist", lambda a, b: sizes.append(len(a)) or whole(a, b))
    assert kernels.nearest(x, c).tolist() == want.tolist() and sizes == [100] * 10
    assert kernels.nearest(x[:0], c).tolist() == []


def _scans(spark, fn):
    """Rows that a counting UDF saw while ``fn`` ran."""
    n = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(x):
        n.add(1)
        return x

    fn(seen)
    return n.value


def test_store_computes_a_table_once(spark, tmp_path):
    f = facts_df(spark, [(f"s{i}", "p", str(i)) for i in range(40)])
    st = Store(spark, f"file://{tmp_path}/a")
    assert _scans(spark, lambda udf: st.update(lambda tx: tx.add_frame(f.withColumn("subject", udf.asNondeterministic()("subject")), count=False))) == 40
    with st.transaction() as tx:
        tx.add_frame(facts_df(spark, [("new", "p", "1")]), count=False)
        with pytest.raises(InvalidFact):
            tx.add_frame(f.withColumn("predicate", F.when(F.col("subject") == "s3", "").otherwise(F.col("predicate"))), count=False)
    assert st.count() == 41 and len([e for e in st.manifest["log"] if e["op"] == "add"]) == 2  # what was refused is not there
    st.add_facts([("s1", "p", "1")])
    st.delete_subjects(["s2"])
    st.compact()
    assert st.count() == 40 and "Aggregate" not in _optimized(st.facts())  # a set as it is
    st.delete_subjects(["s4"])
    assert st.count() == 39 and "Aggregate" not in _optimized(st.facts())
    st.add_facts([("s5", "p", "5"), ("s4", "p", "4")])
    assert st.count() == 40 and "Aggregate" in _optimized(st.facts())
    st.set_retention(7)
    st.compact()
    assert st.count() == 7


def test_subjects_are_distinct_numbers(spark, sf):
    from tessera.sources import graph

    s = graph.subjects(spark, sf)
    assert rows(s, "topic_id", "subject") == rows(scan.subjects(graph.facts(spark, sf)), "topic_id", "subject")
    assert s.schema.names == ["topic_id", "subject"]
    grouped = [x for x in _optimized(core.QUERIES["subjects"](spark, sf)).splitlines() if "Aggregate [" in x]
    assert grouped and not any("subject#" in x.split("], [")[0] for x in grouped)  # texts were


@pytest.mark.parametrize("name", ["bgp_chain5", "bgp_triangle"])
def test_joins_take_repeated_facts(spark, sf, name, monkeypatch):
    """Bindings are made distinct, so rows that yield a fact again aren't before; the last join has tasks by the size of its rows."""
    from tessera.operators import bgp as bgp_module

    assert not any(x.split("[")[1].startswith(("l_orderkey", "l_partkey")) for x in _optimized(core.QUERIES[name](spark, sf)).splitlines() if "Aggregate [" in x)
    pats = [("?o", "a", "?p"), ("?p", "b", "?s"), ("?s", "c", "?n")]
    f = facts_df(spark, [("o1", "a", "p1"), ("o1", "a", "p2"), ("p1", "b", "s1"), ("p2", "b", "s2"), ("s1", "c", "n1"), ("s2", "c", "n1")])
    monkeypatch.setattr(bgp_module, "TASK_BYTES", 10)
    monkeypatch.setattr(bgp_module, "_size", lambda df: 2000)
    found = bgp(f.unionByName(f), pats, ["o", "n"])
    assert rows(found, "o", "n") == [("o1", "n1")] and ", 200" in _optimized(found)


def test_terms_are_distinct_numbers(spark, tmp_path, sf):
    """Terms of the tables equal those of their facts; a text that reads like an entity is that entity, and no text of an entity is grouped."""
    import os

    from tessera.sources import graph

    for t in os.listdir(sf):
        if t not in ("nation.parquet", "documents.parquet"):
            os.symlink(f"{sf}/{t}", tmp_path / t)
    odd = ["customer:3", "customer:03", "doc:5", "order:-0", "in_region", "part:99999999999999999999", "customer:-7", "", "region:1"]
    spark.read.parquet(f"{sf}/nation.parquet").coalesce(1).withColumn("n_name", F.array(*map(F.lit, odd))[F.col("n_nationkey").cast("int") % len(odd)]).write.parquet(f"{tmp_path}/nation.parquet")
    texts = F.when(F.col("doc_id") % 3 == 0, "customer:4").when(F.col("doc_id") % 3 == 1, "segment")
    spark.read.parquet(f"{sf}/documents.parquet").withColumn("source", texts).write.parquet(f"{tmp_path}/documents.parquet")
    d = str(tmp_path)
    f = graph.facts(spark, d)
    want = scan.build_dictionary(f.where("o_kind <> 'f64'"))
    assert rows(core.QUERIES["dictionary"](spark, d), "id", "term") == rows(want, "id", "term")
    f = f.withColumn("o_text", F.expr("case when o_kind <> 'f64' then o_text end"))
    all_terms = f.select(F.explode(F.array("subject", "predicate", "o_text")).alias("term")).where("term is not null").distinct()
    orphans = maintenance.orphan_terms(all_terms.withColumn("id", F.lit(0)), f.where("topic_id <> 1"), limit=None)
    got = rows(core.QUERIES["orphan_terms"](spark, d), "term")
    assert got == rows(orphans, "term") and ("customer:4",) not in got and ("customer:3",) in got
    for name in ("dictionary", "orphan_terms"):
        assert "o_text#" not in _optimized(core.QUERIES[name](spark, sf))
    plan = _optimized(graph.terms(spark, sf, ("str",)))
    assert "Aggregate [key#" in plan and "Aggregate [term#" not in plan  # texts were grouped


def test_merge_compares_numbers(spark, tmp_path, sf):
    """Keys of merged tables equal those of merged facts, repeated rows too, and no text of an entity is grouped or joined."""
    import os

    from tessera.model import FACT_KEY
    from tessera.sources import graph

    for t in os.listdir(sf):
        if t != "customer.parquet":
            os.symlink(f"{sf}/{t}", tmp_path / t)
    c = spark.read.parquet(f"{sf}/customer.parquet")
    c.union(c.limit(9)).union(c.limit(2).withColumn("c_mktsegment", F.lit("x"))).union(c.limit(3).withColumn("c_nationkey", F.lit(None).cast(c.schema["c_nationkey"].dataType))).write.parquet(f"{tmp_path}/customer.parquet")
    f = graph.facts(spark, str(tmp_path))
    got = core.QUERIES["merge_distinct"](spark, str(tmp_path))
    assert got.columns == FACT_KEY if isinstance(FACT_KEY, list) else tuple(got.columns) == tuple(FACT_KEY)
    assert rows(got, *FACT_KEY) == rows(maintenance.merge(f.where("topic_id <> 2"), f).distinct(), *FACT_KEY)
    customers = [r for r in graph.RELATIONS if r.table == "customer"]
    assert rows(graph.merge_keys(spark, str(tmp_path), customers[:1], customers[1:]), *FACT_KEY) == rows(graph.facts(spark, str(tmp_path), customers).distinct(), *FACT_KEY)
    plan = _optimized(got)
    assert "Join" not in plan and "Aggregate [subject#" not in plan and "Aggregate [s#" in plan
