"""Operator 6, suffix-array dedup: passages of MIN_WORDS words or more that occur again.

Documents fall into shards by a hash.  A shard's words get a suffix array (Larsson-Sadakane) and common prefixes
(Kasai); suffixes that share MIN_WORDS words or more are equal windows, and all but the first are repeats.  What is left to find
are windows whose first occurrence lies in another shard:

1. each shard sends the fingerprints of its minimizers (the least ANCHOR-word fingerprint of each window; equal windows have
   equal minimizers) as sorted runs, cut into ranges; runs of a range are merged by binary search, and each shard learns which
   of its minimizers another shard has too;
2. each shard sends the windows at those minimizers; they are merged in the same way, and all but the first of equal windows
   are repeats.  Windows at other minimizers are settled within their shard.

The first occurrence is the least (doc_id, hash of the text, word).  Repeated windows are merged to spans.  The texts are shuffled once (both
rounds read the same exchange); a shard is bounded in bytes, so memory doesn't grow with the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import integer_ids, need, text_bytes, trim
from ._suffix import dense_ranks, lcp_array, suffix_array
from ._text import mix, range_of, rolling, runs, windows_in_doc, words

MIN_WORDS = 50
ANCHOR = 26
SHARD_BYTES = 3 << 20
RANGE_BYTES = 24 << 20
_NULL = -(1 << 63)


def _shard(p: int, t: pa.Table):
    """A shard's rows in order of (id, hash of the text): that (null ids as the least number), a number of each row that no other of
    the same two has, and their words."""
    ids, h = t["doc_id"].combine_chunks().fill_null(_NULL).to_numpy(zero_copy_only=False).astype(np.int64), t["h"].to_numpy()
    o = np.lexsort((h, ids))
    ids, h = ids[o], h[o]
    at = np.arange(len(o))
    head = np.append(True, (ids[1:] != ids[:-1]) | (h[1:] != h[:-1]))[: len(o)]
    again = at - np.maximum.accumulate(np.where(head, at, 0))
    return np.stack([ids, h, (p << 32) + again], 1), words(t["text"].take(pa.array(o)))


def _minimizers(w, size: int, anchor: int) -> tuple[np.ndarray, np.ndarray]:
    """(window starts, minimizer fingerprint of each) of the windows of ``size`` words that lie inside a text."""
    n = len(w.hash)
    ok = windows_in_doc(w.first, n, size)
    if not ok.any():
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    f = rolling(w.hash, anchor)
    span, low, reach = size - anchor + 1, f, 1
    while reach * 2 <= span:  # least of 2, 4, 8, ... neighbours, then of ``span``
        low = np.minimum(low[:-reach], low[reach:])
        reach *= 2
    low = np.minimum(low[: n - size + 1], low[span - reach : span - reach + n - size + 1])
    at = np.flatnonzero(ok)
    return at, mix(low[at])  # least values crowd at the low end; mixed they fill all ranges evenly


def shared(runs: list[np.ndarray]) -> np.ndarray:
    """Values in two or more of the runs, each sorted and free of repeats."""
    x = np.sort(np.concatenate(runs)) if runs else np.zeros(0, np.uint64)
    return np.unique(x[1:][x[1:] == x[:-1]])


def contains(sorted_values: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(sorted_values):
        return np.zeros(len(x), bool)
    i = np.searchsorted(sorted_values, x)
    i[i == len(sorted_values)] = 0
    return sorted_values[i] == x


def within(w, size: int) -> tuple[np.ndarray, np.ndarray]:
    """For each word: whether the window there repeats an earlier one of the shard, and where the first equal one starts."""
    rows, n = len(w.first) - 1, len(w.hash)
    at = np.arange(n) + w.doc
    sym = np.empty(n + rows, np.uint64)
    sym[at] = w.hash
    sym[w.first[1:] + np.arange(rows)] = mix(np.arange(1, rows + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))
    ids, _ = dense_ranks(sym)
    sa, rank = suffix_array(ids)
    lcp = lcp_array(ids, sa, rank)
    head = np.flatnonzero(lcp < size)
    first = np.repeat(np.minimum.reduceat(sa, head), np.diff(np.append(head, len(sa))))
    lead = np.empty(n + rows, np.int64)
    lead[sa] = first
    word = np.full(n + rows, -1, np.int64)
    word[at] = np.arange(n)
    lead = word[lead[at]]
    return lead != np.arange(n), lead


def _spans(at: np.ndarray, source: np.ndarray, text: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of neighbouring window starts of one text: (first start, end of the last window, least source)."""
    if not len(at):
        return at, at, source
    new = np.append(True, (at[1:] != at[:-1] + 1) | (text[1:] != text[:-1]))
    head = np.flatnonzero(new)
    last = np.append(head[1:], len(at)) - 1
    return at[head], at[last] + size, np.minimum.reduceat(source, head)


_ROWS = "r int, p int, kind int, doc binary, place binary, size binary, print binary, source binary"


def _row(r: int, p: int, kind: int, *blobs: np.ndarray) -> dict:
    return {"r": r, "p": p, "kind": kind} | {k: b.tobytes() for k, b in zip(("doc", "place", "size", "print", "source"), blobs)}


def repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, start_word, end_word, kept_doc_id): maximal runs of repeated windows, first occurrences not among them.

    doc_id must be an integer.

    Words are numbered from 0 without those that have no letter or digit, ends are exclusive; case and ASCII punctuation
    don't matter.  ``kept_doc_id`` is the least document that holds the first occurrence of a window of the span.  Null ids
    count as the least id and stay null in the result; rows of one id (null ones too) are searched in order of a hash of their
    text, each as a document of its own, repeated rows after the first in some order.  Texts of fewer than ``min_words`` words
    (null and empty ones too) have no span; very long ones are a shard of their own; an empty table gives an empty result;
    other columns are ignored.
    """
    anchor = max(1, min_words - (min_words - 2) // 2) if min_words != MIN_WORDS else ANCHOR
    base = integer_ids(need(docs, "doc_id", "text")).where("text is not null")
    _, size = text_bytes(base)
    shards = max(1, -(-size // SHARD_BYTES))
    ranges = max(4, -(-size // RANGE_BYTES))
    # rows that are alike in id and text are spread by the partition they come from, so that no shard is hot
    h = F.xxhash64("text")
    p = F.pmod(F.xxhash64("doc_id", h, F.spark_partition_id()), F.lit(shards)).cast("int")
    base = base.select(p.alias("p"), F.col("doc_id").cast("bigint").alias("doc_id"), h.alias("h"), "text")

    def send(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        _, w = _shard(0, t)
        low = np.unique(_minimizers(w, min_words, anchor)[1])
        rows = [(r, key[0].as_py(), low[s].tobytes()) for r, s in runs(range_of(low, ranges))]
        return pa.table([pa.array([x[i] for x in rows], k) for i, k in enumerate((pa.int32(), pa.int32(), pa.binary()))], names=["r", "p", "prints"])

    def meet(t: pa.Table) -> pa.Table:
        sets = [np.frombuffer(x.as_py(), np.uint64) for x in t["prints"]]
        both = shared(sets)
        rows = [(p.as_py(), v.tobytes()) for p, x in zip(t["p"], sets) if len(v := x[contains(both, x)])]
        return pa.table([pa.array([x[i] for x in rows], k) for i, k in enumerate((pa.int32(), pa.binary()))], names=["p", "prints"])

    def offer(key: tuple[pa.Scalar, ...], t: pa.Table, known: pa.Table) -> pa.Table:
        names = [x.split()[0] for x in _ROWS.split(", ")]
        kinds = [pa.int32()] * 3 + [pa.binary()] * 5
        out: list[dict] = []
        if t.num_rows:
            p = key[0].as_py()
            who, w = _shard(p, t)
            at, low = _minimizers(w, min_words, anchor)
            if len(at):
                out = list(_offers(p, who, w, at, low, known))
        trim()
        return pa.table([pa.array([x[n] for x in out], k) for n, k in zip(names, kinds)], names=names)

    def _offers(p, who, w, at, low, known) -> Iterator[dict]:
        local, lead = within(w, min_words)
        got = [np.frombuffer(x.as_py(), np.uint64) for x in known["prints"]] if known.num_rows else []
        away = contains(np.sort(np.concatenate(got)), low) if got else np.zeros(len(at), bool)
        here = at[local[at] & ~away]  # no other shard has these windows, so the first one here is the first of all
        place = here - w.first[w.doc[here]]
        a, z, src = _spans(place, who[w.doc[lead[here]], 0], w.doc[here], min_words)
        if len(a):
            new = np.append(True, (here[1:] != here[:-1] + 1) | (w.doc[here][1:] != w.doc[here][:-1]))
            d = w.doc[here][new]
            yield _row(p % ranges, p, 0, who[d], a, z, np.zeros(0, np.uint64), src)
        at, low = at[away], low[away]
        if not len(at):
            return
        prints = rolling(w.hash, min_words)[at]
        # runs of neighbouring windows at one minimizer go to one range together
        doc = w.doc[at]
        head = np.flatnonzero(np.append(True, (at[1:] != at[:-1] + 1) | (low[1:] != low[:-1]) | (doc[1:] != doc[:-1])))
        length = np.diff(np.append(head, len(at)))
        o = np.argsort(low[head], kind="stable")
        head, length = head[o], length[o]
        for r, s in runs(range_of(low[head], ranges)):
            h, n = head[s], length[s]
            each = np.repeat(h - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            yield _row(r, p, 1, who[doc[h]], at[h] - w.first[doc[h]], n, prints[each], np.zeros(0, np.int64))

    def settle(t: pa.Table) -> pa.Table:
        i64 = lambda c, i: np.frombuffer(t[c][i].as_py(), np.int64)
        doc, a, z, src = [np.zeros((0, 3), np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        who, where, prints = [], [], []
        for i, kind in enumerate(t["kind"].to_pylist()):
            d, place, size = i64("doc", i).reshape(-1, 3), i64("place", i), i64("size", i)
            if kind == 0:
                doc.append(d)
                a.append(place)
                z.append(size)
                src.append(i64("source", i))
            else:
                who.append(np.repeat(d, size, axis=0))
                where.append(np.repeat(place - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum()))
                prints.append(np.frombuffer(t["print"][i].as_py(), np.uint64))
        if who:
            x = np.concatenate(prints)
            s = np.sort(x)
            hit = np.flatnonzero(contains(np.unique(s[1:][s[1:] == s[:-1]]), x))
            x, d, place = x[hit], np.concatenate(who)[hit], np.concatenate(where)[hit]
            o = np.lexsort((place, d[:, 2], d[:, 1], d[:, 0], x))
            x, d, place = x[o], d[o], place[o]
            new = np.append(True, x[1:] != x[:-1])[: len(x)]
            first = d[np.flatnonzero(new)][np.cumsum(new) - 1, 0] if len(x) else np.zeros(0, np.int64)
            d, place, first = d[~new], place[~new], first[~new]
            o = np.lexsort((place, d[:, 2], d[:, 1], d[:, 0]))
            d, place, first = d[o], place[o], first[o]
            if len(d):
                one = np.concatenate([[0], np.cumsum((d[1:] != d[:-1]).any(1))])
                head = np.append(True, (place[1:] != place[:-1] + 1) | (one[1:] != one[:-1]))
                b, e, f = _spans(place, first, one, min_words)
                doc.append(d[head])
                a.append(b)
                z.append(e)
                src.append(f)
        d = np.concatenate(doc)
        trim()
        return pa.table([pa.array(np.ascontiguousarray(x)) for x in (*d.T, np.concatenate(a), np.concatenate(z), np.concatenate(src))], names=["doc", "h", "row", "a", "z", "src"])

    def union(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, start, end, kept = [], [], [], []
            for d, spans in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                s = sorted((x["a"], x["z"], x["src"]) for x in spans)
                a, z, k = s[0]
                for a2, z2, k2 in [*s[1:], (1 << 62, 0, 0)]:
                    if a2 <= z:
                        z, k = max(z, z2), min(k, k2)
                    else:
                        ids.append(None if d == _NULL else d)
                        start.append(a)
                        end.append(z)
                        kept.append(None if k == _NULL else k)
                        a, z, k = a2, z2, k2
            yield pa.record_batch([pa.array(x, pa.int64()) for x in (ids, start, end, kept)], names=["doc_id", "start_word", "end_word", "kept_doc_id"])

    groups = base.groupBy("p")
    known = groups.applyInArrow(send, "r int, p int, prints binary").groupBy("r").applyInArrow(meet, "p int, prints binary")
    spans = groups.cogroup(known.groupBy("p")).applyInArrow(offer, _ROWS).groupBy("r").applyInArrow(settle, "doc bigint, h bigint, row bigint, a bigint, z bigint, src bigint")
    each = spans.groupBy("doc", "h", "row").agg(F.collect_list(F.struct("a", "z", "src")).alias("spans")).select("doc", "spans")
    return each.mapInArrow(union, "doc_id bigint, start_word bigint, end_word bigint, kept_doc_id bigint")


def oracle(min_words: int = MIN_WORDS) -> str:
    """The same spans in DuckDB SQL, from every window as text."""
    from .decontam import _tokens

    return f"""
WITH d AS ({_tokens("documents", "doc_id")}),
w AS (SELECT doc_id, p - 1 AS s, md5(array_to_string(w[p : p + {min_words - 1}], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - {min_words} + 2)) AS p FROM d WHERE len(w) >= {min_words})),
f AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id, s) AS k, min(doc_id) OVER (PARTITION BY g) AS kept FROM w),
h AS (SELECT doc_id, s, s + {min_words} AS e, kept FROM f WHERE k > 1),
m AS (SELECT *, CASE WHEN s > max(e) OVER (PARTITION BY doc_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS new FROM h),
n AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY s ROWS UNBOUNDED PRECEDING) AS span FROM m)
SELECT doc_id, min(s) AS start_word, max(e) AS end_word, min(kept) AS kept_doc_id FROM n GROUP BY doc_id, span
"""
