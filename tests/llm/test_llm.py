"""Training-data operators: brute force on small fixtures, SQL on the given tables, and the defined results of edge cases."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import _suffix, components, decontam, langid, linededup, ngramjoin, packing, quality, sadedup, sharding, tokencount, toxicity
from tessera.llm import queries as llm

from . import brute

FEW = settings(max_examples=60, deadline=None, suppress_health_check=list(HealthCheck))
#: Names that the operators use inside.
CLASH = "p bin id hash no line r doc grams n_words n_lines n_removed rank piece keep seg size c0 comp label".split()


def frame(spark, rows, extra=True):
    """documents with clashing extra columns; ``rows`` are (doc_id, text)."""
    names = ["doc_id", "text", "lang", "source", "n_chars", *(CLASH if extra else ())]
    kinds = "doc_id bigint, text string, lang string, source string, n_chars bigint" + "".join(f", {c} string" for c in (CLASH if extra else ()))
    data = [(i, t, "en", "s", None, *(f"x{c}" for c in (CLASH if extra else ()))) for i, t in rows]
    return spark.createDataFrame(data, kinds).select(*names).repartition(3)


def corpus(seed=0, docs=40):
    """Random texts with copies, near copies, shared passages and lines, nulls, empty and long texts, ties and repeated rows."""
    rnd = random.Random(seed)
    word = lambda: rnd.choice(["alpha", "Beta,", "gamma", "delta's", "(eps)", "zeta", "été", "--", "x1", "日本", "eta", "theta"])
    text = lambda n: " ".join(word() for _ in range(n))
    passage, line = text(30), text(6)
    rows = [(i, text(rnd.randint(3, 60))) for i in range(docs)]
    for i in range(0, docs, 5):
        rows[i] = (i, rows[i][1] + "\n" + line + "\n" + text(4))
    for i in range(1, docs, 7):
        rows[i] = (i, text(8) + " " + passage + " " + text(5))
    for i in range(2, docs - 3, 9):
        rows[i + 3] = (i + 3, rows[i][1] + " tail")
    return [*rows, rows[2], rows[2], (rows[3][0], "another " + text(20)), (None, text(25)), (None, None), (90, None), (91, ""), (92, " \n\t\n"), (93, "..., !"), (94, "one"), (95, "One."), (96, (text(10) + "\n") * 30), (97, text(1500))]


def got(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


def want(rows):
    return sorted(map(tuple, rows), key=repr)


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_query_equals_sql(spark, sf, same, name):
    same(llm.queries()[name](spark, sf), llm.oracle_sql()[name])


def test_ten_queries():
    assert {n.split("_")[0] for n in llm.queries()} == {f"op{i}" for i in range(1, 11)}


# -- suffix arrays


@FEW
@given(st.lists(st.integers(0, 3), max_size=60))
def test_suffix_array(x):
    ids = np.array(x, np.int32)
    sa, rank = _suffix.suffix_array(ids)
    assert sa.tolist() == sorted(range(len(x)), key=lambda i: x[i:])
    lcp = _suffix.lcp_array(ids, sa, rank)
    for r in range(1, len(x)):
        a, b = x[sa[r - 1] :], x[sa[r] :]
        assert lcp[r] == next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))


# -- 1 packing


@FEW
@given(st.lists(st.integers(1, 20), max_size=9))
def test_reduction_keeps_an_optimal_packing(sizes):
    cnt = np.bincount(np.array(sizes, np.int64), minlength=21)
    fixed, left = packing.reduce_instance(cnt, 20)
    rest = [s for s in range(21) for _ in range(left[s])]
    assert sum(m for _, m in fixed) + brute.least_bins(rest, 20) == brute.least_bins(sizes, 20)
    assert all(sum(s * q for s, q in p) <= 20 for p, _ in fixed)


@FEW
@given(st.lists(st.integers(1, 50), max_size=60))
def test_best_fit_equals_one_by_one(sizes):
    bins = packing.best_fit(np.bincount(np.array(sizes, np.int64), minlength=51), 50)
    assert sorted(50 - sum(s * q for s, q in p) for p, m in bins for _ in range(m)) == brute.best_fit_rooms(sizes, 50)


def check_bins(found, rows, capacity):
    """Every word of every document lies in one bin, no place is taken twice, and there are as many bins as planned."""
    sizes, whole = [], Counter()
    for i, t in rows:
        n = len(t.split()) if t else 0
        for k in range(-(-n // capacity)):
            size = min(capacity, n - k * capacity)
            sizes.append(size)
            whole[(i, k, k * capacity, size)] += 1
    assert Counter((r["doc_id"], r["piece"], r["start_word"], r["n_words"]) for r in found) == whole
    bins = {}
    for r in found:
        bins.setdefault(r["bin"], []).append((r["offset"], r["n_words"]))
    for places in bins.values():
        at = 0
        for o, n in sorted(places):
            assert o == at
            at += n
        assert at <= capacity
    cnt = np.bincount(np.array(sizes, np.int64), minlength=capacity + 1)
    fixed, left = packing.reduce_instance(cnt, capacity)
    rest = brute.best_fit_rooms([s for s in range(capacity + 1) for _ in range(left[s])], capacity)
    assert len(bins) == sum(m for _, m in fixed) + len(rest)
    assert set(bins) == set(range(len(bins)))


@pytest.mark.parametrize("capacity", [2048, 50])
def test_packing(spark, capacity):
    rows = corpus()
    check_bins(packing.pack(frame(spark, rows), capacity).collect(), rows, capacity)


# -- 2 language


def loops(text):
    """A text's unit vector, trigram by trigram."""
    x = " " + "".join(c if c.isalpha() else " " for c in (text or "").lower()) + " "
    x = [ord(c) for i, c in enumerate(x) if c != " " or i == 0 or x[i - 1] != " "]
    v = {p: langid.letter_vectors(np.array([p]))[0].astype(int) for p in x}
    total = np.zeros(langid.DIM)
    for a, b, c in zip(x, x[1:], x[2:]):
        total += np.roll(v[a], 2) * np.roll(v[b], 1) * v[c]
    return total / (np.linalg.norm(total) or 1)


@pytest.mark.parametrize("cells,columns", [(1 << 23, 1 << 12), (40, 7)])
def test_hyperdimensional_vectors_equal_plain_loops(monkeypatch, cells, columns):
    monkeypatch.setattr(langid, "CELLS", cells)
    monkeypatch.setattr(langid, "COLUMNS", columns)
    texts = ["Hello, world", "日本 été", "a", "", None, "12 34", "ÉTÉ"]
    for t, v in zip(texts, langid.embed(texts)):
        assert np.allclose(v, loops(t), atol=1e-5)
    assert len({tuple(langid.letter_vectors(np.array([p]))[0]) for p in range(97, 500)}) == 403  # no two letters share a vector


def test_many_short_texts_take_little_memory():
    import tracemalloc

    rnd = random.Random(0)
    texts = ["".join(chr(rnd.randrange(0x4E00, 0x9FFF)) for _ in range(4)) for _ in range(20000)]
    tracemalloc.start()
    langid.embed(texts[:8000])
    assert tracemalloc.get_traced_memory()[1] < 300e6
    tracemalloc.stop()


def test_language_equals_plain_loops(spark):
    rows = [(i, t, ["xx", "yy", "zz", None][i % 4]) for i, (_, t) in enumerate(corpus()[:24])] + [(50, None, "xx"), (51, "!!", "yy"), (None, "alpha beta", "zz")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(3)
    proto = {}
    for _, t, k in rows:
        if k and t:
            proto[k] = proto.get(k, 0) + loops(t)
    names = sorted(proto)
    m = np.array([proto[k] / np.linalg.norm(proto[k]) for k in names])
    out = {r["doc_id"]: r for r in langid.detect(docs).collect()}
    for i, t, _ in rows:
        cos = m @ loops(t)
        if not loops(t).any():
            assert (out[i]["language"], out[i]["cosine"], out[i]["margin"]) == (None, 0, 0)
            continue
        assert abs(out[i]["cosine"] - cos.max()) < 1e-4
        assert abs(out[i]["margin"] - (cos.max() - np.sort(cos)[-2])) < 1e-4
        assert out[i]["margin"] < 1e-4 or out[i]["language"] == names[int(cos.argmax())]
    tie = langid.identify(docs, ["aa", "bb"], np.array([m[0], m[0]], np.float32)).where("language is not null").select("language", "margin").distinct().collect()
    assert [tuple(r) for r in tie] == [("aa", 0.0)]


def test_language_of_held_out_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    protos = langid.prototypes(docs.where("doc_id % 2 = 0"))
    test = docs.where("doc_id % 2 = 1 and lang is not null and length(text) > 40")
    r = langid.identify(test, *protos).join(test.select("doc_id", "lang"), "doc_id").agg(F.avg((F.col("language") == F.col("lang")).cast("double"))).first()[0]
    assert r >= 0.95


def test_language_edges(spark):
    rows = corpus()
    out = langid.detect(frame(spark, rows)).collect()
    assert len(out) == len(rows)
    assert sum(r["language"] is None for r in out) == sum(not any(c.isalpha() for c in t or "") for _, t in rows)
    assert langid.detect(frame(spark, [])).count() == 0


# -- 3 toxicity


def test_toxicity_on_held_out_documents(spark, sf):
    """Trained on half of the labels and held against the other; Spanish has 17 toxic documents to learn from, too few."""
    d = sf.replace("0.001", "0.1")
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    model = toxicity.train(docs, labels.where("doc_id % 2 = 0"))
    found = toxicity.toxic_documents(docs, model).select("doc_id", F.lit(1).alias("hit"))
    test = labels.where("doc_id % 2 = 1").join(docs.select("doc_id", "lang"), "doc_id").join(found, "doc_id", "left")
    share = {(r["lang"], r["toxic"]): r["share"] for r in test.groupBy("lang", "toxic").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("share")).collect()}
    print(share)
    assert share["en", 1] >= 0.85 and share["fr", 1] >= 0.7 and share["de", 1] >= 0.35
    assert all(v <= 0.09 for (_, toxic), v in share.items() if not toxic)
    total = {r["toxic"]: r["share"] for r in test.groupBy("toxic").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("share")).collect()}
    assert total[1] >= 0.7 and total[0] <= 0.03


def test_toxic_dictionary_equals_the_greedy_rule_done_slowly():
    rnd = random.Random(1)
    word = lambda: "".join(rnd.choice("abcd") for _ in range(4))
    clean = [" ".join(word() for _ in range(12)) for _ in range(12)]
    toxic = [" ".join([word() for _ in range(6)] + ["vile brute"] + [word() for _ in range(3)]) for _ in range(8)] + ["brute"]
    g, h = np.arange(9), np.arange(12)
    n, k = toxicity.RUN, 10
    has = lambda texts: Counter(r for t in texts for r in {t[i : i + n] for i in range(len(t) - n + 1)})
    t, c = has(toxic), has(clean)
    worth = {r: max(0.0, x - 1 - toxicity.CONTRAST * c[r] * 9 / 12) for r, x in t.items()}
    raw, out = "".join(toxic), []
    ends = np.cumsum([len(t) for t in toxic])
    ok = lambda p: p + n <= ends[np.searchsorted(ends, p, side="right")]
    while len(out) < 5:
        gain = [sum(worth.get(raw[p : p + n], 0) for p in range(i, i + k - n + 1) if ok(p)) for i in range(len(raw) - k + 1)]
        best = max(range(len(gain)), key=gain.__getitem__)
        if gain[best] < 0.5:
            break
        out.append(raw[best : best + k])
        for p in range(best, best + k - n + 1):
            if ok(p):
                worth[raw[p : p + n]] = 0
    assert out and toxicity.train_toxic(toxic, clean, g, h, 5 * k, k).decode() == "".join(reversed(out))


def test_copies_count_once():
    a = "one two three four five six seven eight nine ten"
    assert toxicity.copies([a, "other words that have nothing at all in common", a + " eleven", a]).tolist() == [0, 1, 0, 0]


def test_toxic_phrase_of_ordinary_words():
    rng = np.random.default_rng(0)
    words = ["".join(rng.choice(list("abcdefghijklmnop"), 7)) for _ in range(3000)]

    def text(toxic: int) -> str:  # both classes have the six words, the toxic one in a row
        a, b, six = list(rng.choice(words, 40)), list(rng.choice(words, 40)), words[:6]
        if toxic:
            return " ".join([*a, *six, *b, *six, *a[:9]])
        return " ".join(w for i, x in enumerate(a + b) for w in ([x, six[int(rng.integers(6))]] if i % 7 == 0 else [x]))

    texts = [[text(toxic) for _ in range(200)] for toxic in (0, 1)]
    m = toxicity.fit(texts[1][:150], texts[0][:150])
    co, ct = toxicity._compressor(m.ordinary), toxicity._compressor(m.toxic)
    share = []
    for x in texts:
        doc, d = toxicity.savings(pa.array(x[150:]), co, ct)
        n, saved = np.bincount(doc, minlength=50), np.bincount(doc, np.maximum(d - m.window_saving + 1, 0), minlength=50)
        share.append((saved - m.noise * n >= m.least).mean())
    assert share[1] >= 0.9 and share[0] <= 0.1, share


def test_savings_equal_one_compression_a_window():
    texts = ["some ordinary text that goes on for a while and then ends", "vile words here and vile words there", "", None, "x" * 500]
    ordinary = toxicity._compressor(b"some ordinary text that goes on" * 20 + toxicity.PRIMER)
    toxic = toxicity._compressor(b"vile words " * 20 + b"some ordinary text that goes on" * 20 + toxicity.PRIMER)
    doc, saved = toxicity.savings(pa.array(texts), ordinary, toxic)
    data, off = toxicity.buffers(pa.array(texts))
    a, b, t = toxicity.windows(data, off)
    raw = data.tobytes()
    assert b"".join(raw[i:j] for i, j in zip(a, b)) == raw  # the windows cover all
    assert doc.tolist() == t.tolist()
    assert saved.tolist() == [len(ordinary.compress(toxicity.PRIMER + raw[i:j])) - len(toxic.compress(toxicity.PRIMER + raw[i:j])) for i, j in zip(a, b)]
    assert saved[doc == 1].sum() > 5 > saved[doc == 0].sum()


def test_toxicity_edges(spark):
    """Texts that hold the phrase are found, whatever their row; nulls, empty and clean texts aren't; very long ones are cut to windows."""
    rnd = random.Random(2)
    text = lambda n: " ".join("".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    bad = " vermin swine dregs "
    train = [(i, text(30) + (bad + text(9)) * (i % 2)) for i in range(80)]
    rows = [(200, text(20) + bad), (200, text(20) + bad), (None, text(9) + bad), (201, text(20)), (202, None), (203, ""), (204, (text(30) + bad) * 3000), (205, "x" * 500_000), (206, " \n")]
    labels = spark.createDataFrame([(i, 0, i % 2) for i in range(80)] + [(None, None, 1), (3, 1, None), (5, 0, 0)], "doc_id bigint, quality int, toxic int")
    out = toxicity.detect(frame(spark, train + rows), labels).collect()
    assert sorted((r["doc_id"] or 0) for r in out if not r["doc_id"] or r["doc_id"] >= 200) == [0, 200, 200, 204]
    assert sum(r["doc_id"] % 2 for r in out if r["doc_id"] and r["doc_id"] < 200) >= 36 and all(r["hits"] <= r["windows"] and r["saved"] > 0 for r in out)
    assert toxicity.detect(frame(spark, []), labels).count() == 0
    assert toxicity.detect(frame(spark, train), labels.limit(0)).count() == 0
    assert toxicity.detect(frame(spark, train), labels.where("toxic = 1")).count() == 0


# -- 4 decontamination


@FEW
@given(st.lists(st.integers(0, 3), min_size=1, max_size=60), st.lists(st.integers(0, 3), min_size=1, max_size=4))
def test_fm_index(x, pattern):
    index = decontam.FMIndex(np.array(x, np.int32), 4)
    lo, hi = index.search(np.array([pattern]))
    k = len(pattern)
    found = index.locate(np.arange(lo[0], max(lo[0], hi[0])))
    assert sorted(found.tolist()) == [i for i in range(len(x) - k + 1) if x[i : i + k] == pattern]


def benchmark(spark, rows):
    return spark.createDataFrame(rows, "item_id bigint, text string")


@pytest.mark.parametrize("shard", [4 << 20, 200])
def test_decontamination(spark, monkeypatch, shard):
    monkeypatch.setattr(decontam, "SHARD_BYTES", shard)
    rows = corpus()
    text = dict(r for r in rows if r[0] is not None)
    items = [(1, text[0][:80]), (2, text[8]), (3, "one"), (4, text[0][20:90]), (5, None), (6, "!!"), (None, text[10])]
    docs, bench = frame(spark, rows), benchmark(spark, items)
    spans = brute.contaminated(rows, items, decontam.PHRASE)
    assert spans
    assert got(decontam.find(docs, bench), "doc_id", "start_word", "end_word", "start_char", "end_char", "item_id") == want((rows[s[0]][0], *s[1:]) for s in spans)
    out = decontam.cleaned(docs, bench)
    assert out.columns == docs.columns
    assert got(out, "doc_id", "text") == want(brute.decontaminated(rows, items, decontam.PHRASE))


def test_decontamination_of_long_runs(spark):
    """Megabytes of punctuation, of one letter and of words, with a passage in them: time stays linear."""
    passage = "a test passage of nine words that must go"
    rows = [(1, "-" * 2_000_000 + " " + passage + " " + "=" * 2_000_000), (2, "x" * 2_000_000 + " " + passage), (3, ("lorem ipsum dolor " * 80_000 + passage + " ") * 3), (4, "- " * 1_000_000)]
    out = {r["doc_id"]: r["text"] for r in decontam.cleaned(frame(spark, rows), benchmark(spark, [(1, passage)])).collect()}
    assert set(out) == {2, 3, 4}  # of the first no word is left
    assert out[2].strip() == "x" * 2_000_000 and out[4] == rows[3][1]
    assert "passage" not in out[3] and out[3].count("lorem ipsum dolor") == 240_000


def test_a_benchmark_too_large_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(decontam, "MAX_BYTES", 100)
    with pytest.raises(ValueError, match="bytes of benchmark"):
        decontam.find(frame(spark, []), benchmark(spark, [(1, "a b c d " * 40)]))


def test_decontamination_of_nothing(spark):
    rows = corpus()
    assert decontam.find(frame(spark, rows), benchmark(spark, [])).count() == 0
    assert decontam.cleaned(frame(spark, rows), benchmark(spark, [])).count() == len(rows)
    assert decontam.find(frame(spark, []), benchmark(spark, [(1, "a b c")])).count() == 0


# -- 5 line dedup


@pytest.mark.parametrize("small", [False, True])
def test_line_dedup(spark, monkeypatch, small):
    """Filters so small that many lines collide, and groups of a document each, give the same result."""
    if small:
        for name, value in (("GROUP_BYTES", 100), ("RANGE_BYTES", 500), ("BITS_PER_LINE", 0.5)):
            monkeypatch.setattr(linededup, name, value)
    rows = [*corpus(), (200, "same\nother\nsame\n\n same\t"), (201, "same"), (201, "same"), (202, "\n\n"), (203, "line of a long text\n" * 30_000 + "x" * 300_000)]
    docs = frame(spark, rows)
    expect = brute.line_dedup(rows)
    out = linededup.dedup_lines(docs)
    assert sorted(out.columns) == sorted(docs.columns)  # n_lines and n_removed replaced those of the table
    assert got(out, "doc_id", "text", "n_lines", "n_removed") == want(expect)
    kept = [(i, t) for i, t, _, gone in expect if not gone or t.strip(" \t\r\n")]
    out = linededup.cleaned(docs)
    assert out.columns == docs.columns
    assert got(out, "doc_id", "text", "hash") == want((*r, "xhash") for r in kept)


def test_line_dedup_of_nothing(spark):
    assert linededup.deduped(frame(spark, [])).count() == 0


def test_no_repeated_line_escapes_the_filter():
    rng = np.random.default_rng(0)
    own = np.unique(rng.integers(0, 1 << linededup.LOW, 40_000))
    shared, own = own[:5000], np.array_split(rng.permutation(own[5000:]), 20)
    sets = [np.unique(np.concatenate([x, shared[i % 10 :: 10], shared[(i + 1) % 10 :: 10]])) for i, x in enumerate(own)]
    hits = linededup.twice(sets)
    assert all(h[np.isin(x, shared)].all() for x, h in zip(sets, hits))
    others = np.concatenate([h[~np.isin(x, shared)] for x, h in zip(sets, hits)])
    assert others.mean() < 0.02


# -- 6 suffix-array dedup


@pytest.mark.parametrize("shard", [3 << 20, 400])
def test_suffix_array_dedup(spark, monkeypatch, shard):
    monkeypatch.setattr(sadedup, "SHARD_BYTES", shard)
    monkeypatch.setattr(sadedup, "RANGE_BYTES", max(shard, 1000))
    rows = corpus()
    rows += [(None, f"{rows[1][1]} number {i}") for i in range(6)] + [(None, rows[1][1])] * 2 + [(500, "again " * 40_000)]
    out = sadedup.repeats(frame(spark, rows), 12)
    expect = brute.repeats(rows, 12)
    assert len(expect) > 12
    assert got(out, "doc_id", "start_word", "end_word", "kept_doc_id") == want(expect)


def test_suffix_array_dedup_of_nothing(spark):
    assert sadedup.repeats(frame(spark, [])).count() == 0


# -- 7 n-gram Jaccard join


@FEW
@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12)), max_size=20))
def test_forest(edges):
    a, b = (np.array([e[k] for e in edges], np.int64) for k in (0, 1))
    node, root = components.forest(a, b)
    assert dict(zip(node.tolist(), root.tolist())) == brute.roots(edges)


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 103), (103, 101)]
    df = spark.createDataFrame(edges, "a bigint, b bigint").repartition(5)
    assert dict(got(components.components(df), "node", "root")) == brute.roots(edges)
    assert components.components(df.limit(0)).count() == 0


@FEW
@given(st.lists(st.tuples(st.integers(1, 20), st.integers(1, 20)), min_size=1, max_size=14), st.sampled_from([0.5, 0.8]))
def test_chains_connect_all_that_may_be_similar(docs, t):
    size = np.array([max(s, h) for s, h in docs])
    top = np.floor(np.array([min(s, h) for s, h in docs]) * (1 + t) / t + 1e-6).astype(np.int64) - size
    i, j = ngramjoin.chains(np.zeros(len(docs), np.uint64), size, top)
    root = brute.roots(zip(i.tolist(), j.tolist()))
    for a in range(len(docs)):
        for b in range(a):
            if size[a] <= top[b] and size[b] <= top[a]:
                assert root.get(a, a) == root.get(b, b)


@pytest.mark.parametrize("small", [False, True])
@pytest.mark.parametrize("threshold", [0.5, 0.8])
def test_ngram_join(spark, monkeypatch, small, threshold):
    if small:
        for name, value in (("GROUP_BYTES", 500), ("RANGE_BYTES", 500), ("TILE", 3), ("BLOCK_BYTES", 600)):
            monkeypatch.setattr(ngramjoin, name, value)
    same = "copy of the same text with the number {} at its end and some more words"
    rows = [*corpus(), *[(300 + i, same.format(i % 3)) for i in range(12)], (None, same.format(0)), (None, "of null ids alone, twice"), (None, "of null ids alone, twice")]
    docs = frame(spark, rows)
    found = brute.jaccard_classes(rows, ngramjoin.N, threshold)
    assert len(found) > 20
    assert got(ngramjoin.similar_documents(docs, threshold=threshold), "doc_id", "class_id", "links") == want((rows[x][0], *f) for x, f in found.items())
    if threshold == 0.5:
        out = ngramjoin.one_of_each(docs)
        assert out.columns == docs.columns
        assert got(out, "doc_id", "text") == want(brute.one_of_each(rows, ngramjoin.N, threshold))


def test_ngram_join_of_nothing(spark):
    assert ngramjoin.similar_documents(frame(spark, [])).count() == 0
    assert ngramjoin.one_of_each(frame(spark, [(1, None), (None, "a b c d")])).count() == 2


# -- 8 token counts


@FEW
@given(st.lists(st.text("abc", min_size=1, max_size=5), max_size=12), st.text("abcdé", min_size=1, max_size=20))
def test_automaton_equals_greedy(pieces, word):
    a = tokencount.Automaton(pieces)
    cut = brute.greedy(word, set(pieces), 5)
    assert "".join(cut) == word
    assert a.count(word) == sum(1 if p in pieces else len(p.encode()) for p in cut)


def test_token_counts(spark):
    rows = corpus()
    pieces = set(tokencount.load_pieces())
    longest = max(map(len, pieces))
    tokens = lambda w: sum(1 if p in pieces else len(p.encode()) for p in brute.greedy(tokencount.MARK + w, pieces, longest))
    expect = [(i, len((t or "").split()), sum(map(tokens, (t or "").split()))) for i, t in rows]
    assert got(tokencount.count_tokens(frame(spark, rows)), "doc_id", "n_words", "n_tokens") == want(expect)
    assert tokencount.count_tokens(frame(spark, [])).count() == 0


# -- 9 quality rules


@pytest.mark.parametrize("shard", [6 << 20, 300])
def test_quality(spark, monkeypatch, shard):
    monkeypatch.setattr(quality, "SHARD_BYTES", shard)
    rows = corpus()
    docs = frame(spark, rows)
    expect = [(i, *brute.quality(t, 5, 0.5, 100)) for i, t in rows]
    assert got(quality.measure(docs), "doc_id", "n_words", "repeated_words", "longest_repeat", "keep") == want(expect)
    assert {e[4] for e in expect} == {True, False}
    out = quality.passing(docs)
    assert out.columns == docs.columns
    assert got(out, "doc_id", "text") == want(r for r, e in zip(rows, expect) if e[4])
    assert quality.measure(frame(spark, [])).count() == 0


def test_quality_of_very_long_texts(spark):
    """Megabytes of one word, of one line and of words that differ; one symbol a step would take minutes."""
    line = "one line that comes again and again\n"
    own = " ".join(f"w{i}" for i in range(300_000))
    rows = [(1, "spam " * 400_000), (2, line * 60_000), (3, own), (4, own + " " + own)]
    out = got(quality.measure(frame(spark, rows)), "doc_id", "n_words", "repeated_words", "longest_repeat", "keep")
    assert out == [(1, 400_000, 400_000, 399_999, False), (2, 420_000, 420_000, 419_993, False), (3, 300_000, 0, 0, True), (4, 600_000, 600_000, 300_000, False)]


# -- 10 sharding


def test_a_changed_weight_moves_only_its_subtree(spark):
    docs = frame(spark, [(i, None) for i in range(3000)] + [(None, "x"), (7, "y")])
    before = {r["doc_id"]: r for r in sharding.assign_shards(docs).collect()}
    tree = {r: {k: dict(s) for k, s in racks.items()} for r, racks in sharding.TREE.items()}
    tree["west"]["r1"]["s0"] = 6.0
    moved = 0
    for r in sharding.assign_shards(docs, tree).collect():
        b = before[r["doc_id"]]
        if (r["region"], r["rack"], r["shard"]) != (b["region"], b["rack"], b["shard"]):
            moved += 1
            if b["region"] != "west":  # a document leaves its place only for the subtree that got heavier, level by level
                assert r["region"] == "west"
            elif b["rack"] != "r1":
                assert (r["region"], r["rack"]) == ("west", "r1")
            else:
                assert (r["region"], r["rack"], r["shard"]) == ("west", "r1", "s0")
    assert moved
    share = Counter(r["region"] for r in before.values())
    total = sum(map(sharding.weight, sharding.TREE.values()))
    for name, node in sharding.TREE.items():
        assert abs(share[name] / len(before) - sharding.weight(node) / total) < 0.05
    assert sharding.assign_shards(docs.limit(0)).count() == 0


def test_sharding_by_value(spark):
    """Repeated rows, null ids and columns of clashing names are placed by id alone."""
    docs = frame(spark, [(1, "a"), (1, "a"), (1, "b"), (None, None), (None, "x"), (2, "")])
    docs = docs.withColumns({"region": F.lit("r"), "rack": F.lit("k"), "shard": F.lit("s")})
    out = sharding.assign_shards(docs).collect()
    assert Counter(r["doc_id"] for r in out) == {1: 3, None: 2, 2: 1}
    assert len({tuple(r) for r in out}) == 3 and all(r["shard"] in sharding.TREE[r["region"]][r["rack"]] for r in out)
    assert {tuple(r)[1:] for r in sharding.assign_shards(docs, {"east": {"r": {"s": 0.0}}}).collect()} == {(None, None, None)}
    for tree in ({"a/b": {"c": {"d": 1.0}}}, {"a": {"b": {"c": -1.0}}}):
        with pytest.raises(ValueError):
            sharding.assign_shards(docs, tree)


# -- what all have in common

ALL = {
    "op1": packing.pack, "op2": langid.detect, "op4": lambda d: decontam.find(d, d.sparkSession.createDataFrame([(1, "alpha")], "item_id int, text string")),
    "op4_cleaned": lambda d: decontam.cleaned(d, d.sparkSession.createDataFrame([(1, "alpha")], "item_id int, text string")),
    "op3": lambda d: toxicity.detect(d, d.sparkSession.createDataFrame([("1", 1), ("2", 0)], "id string, toxic int").selectExpr(f"cast(id as {dict(d.dtypes).get('doc_id', 'int')}) as doc_id", "toxic")),
    "op5": linededup.dedup_lines, "op5_cleaned": linededup.cleaned, "op6": sadedup.repeats, "op7": ngramjoin.similar_documents, "op7_one_of_each": ngramjoin.one_of_each,
    "op8": tokencount.count_tokens, "op9": quality.measure, "op9_passing": quality.passing, "op10": sharding.assign_shards,
}


@pytest.mark.parametrize("name", ALL)
def test_columns(spark, name):
    """Names that differ in case alone, ids that are text, and a column that's missing."""
    rows = [("1", "alpha beta gamma", "en", "TEXT", "ID"), ("2", "delta eps alpha", "fr", None, None), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, lang string, Text string, DOC_ID string").repartition(2)
    if name in ("op6", "op7", "op7_one_of_each"):
        with pytest.raises(ValueError, match="must be an integer"):
            ALL[name](docs)
    else:
        assert ALL[name](docs).count() >= (0 if name == "op3" else 1)
    spark.conf.set("spark.sql.caseSensitive", "true")  # only to make the table: taken by place, its columns are no ambiguity
    number = docs.withColumn("doc_id", docs["doc_id"].cast("bigint"))
    spark.conf.unset("spark.sql.caseSensitive")
    assert ALL[name](number).count() >= (0 if name in ("op3", "op6", "op7") else 1)
    with pytest.raises(ValueError, match="missing columns"):
        ALL[name](spark.createDataFrame([("x",)], "other string"))


def test_a_capacity_of_nothing_is_an_error(spark):
    with pytest.raises(ValueError):
        packing.pack(frame(spark, []), 0)


# -- pipeline


def test_pipeline_equals_brute_force(spark, tmp_path):
    import corpus_pipeline

    rows = corpus()
    rows.append((400, "unlike all the others this text talks of a harbour, its boats and seven old anchors " + rows[0][1][:60]))
    items = [(1, "of a harbour its boats and seven old anchors"), (2, rows[8][1])]
    frame(spark, rows, extra=False).write.parquet(str(tmp_path / "documents.parquet"))
    benchmark(spark, items).write.parquet(str(tmp_path / "benchmark.parquet"))
    left = [r for r in rows if brute.quality(r[1], quality.MIN_WORDS, quality.MAX_COVERED, quality.MAX_REPEAT)[3]]
    left = [(i, t) for i, t, _, gone in brute.line_dedup(left) if not gone or t.strip(" \t\r\n")]
    left = brute.decontaminated(brute.one_of_each(left, ngramjoin.N, ngramjoin.THRESHOLD), items, decontam.PHRASE)
    check_bins(corpus_pipeline.run(spark, str(tmp_path)).collect(), left, packing.CAPACITY)
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_duplicates", "decontamination", "best_fit_packing"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
