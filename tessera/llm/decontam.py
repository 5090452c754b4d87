"""Operator 4, benchmark decontamination: an FM-index per shard of training text.

The words of a shard's documents, a separator behind each, get a suffix array; its Burrows-Wheeler transform goes into a wavelet
matrix.  All test phrases are searched backwards at once, word by word, as ranks of the wavelet matrix; occurrences are located by
walking from each row to a sampled suffix position.  Overlapping or touching occurrences are merged to spans.

The phrases are the benchmark's, a table whose size doesn't depend on the corpus.  They are broadcast; the bytes of its text, and with
them those of the phrases, are checked before it's read (MAX_BYTES).  Where no phrase has all its words in a shard, there is nothing
to search and the index isn't built.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._spark import merged, n_slices, need
from ._suffix import dense_ranks, suffix_array
from ._text import runs, token_spans, windows_in_doc, words

#: Words of a test phrase; a benchmark item of fewer is searched whole.
PHRASE = 8
SHARD_BYTES = 4 << 20
SAMPLE = 16
#: Bytes of benchmark text at most.  A word takes two bytes at least, so its phrases take 40 times that at most; ordinary text 15 times.
MAX_BYTES = 32 << 20
_SEPARATOR = np.uint64(0)  # no word hashes to it in practice, and it's excluded from phrases


@dataclass
class Phrases:
    """``word[i, :size[i]]`` are the word hashes of phrase i of benchmark item ``item[i]``; ``item`` is least among equal phrases."""

    word: np.ndarray
    size: np.ndarray
    item: np.ndarray


def phrases(benchmark: DataFrame, n: int = PHRASE) -> Phrases:
    """Every n-word phrase of every item; items without words and null ids have none.  item_id must be an integer."""
    t = need(benchmark, "item_id", "text").where("item_id is not null and text is not null")
    kind = t.schema["item_id"].dataType
    if not isinstance(kind, T.IntegralType):
        raise ValueError(f"item_id must be an integer, not {kind.simpleString()}")
    r = t.agg(F.sum(F.octet_length("text") + 16).alias("bytes")).first()
    if (r["bytes"] or 0) > MAX_BYTES:
        raise ValueError(f"{r['bytes']} bytes of benchmark; at most {MAX_BYTES} at once: split it and clean by one part after another")
    t = t.toArrow()
    return phrases_of(t["item_id"].to_numpy().astype(np.int64), t["text"], n)


def phrases_of(ids: np.ndarray, texts, n: int = PHRASE) -> Phrases:
    w = words(texts)
    count = np.diff(w.first)
    word, size, item = [np.zeros((0, n), np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for k in range(1, n + 1):
        at = np.flatnonzero(windows_in_doc(w.first, len(w.hash), n)) if k == n else w.first[:-1][count == k]
        x = np.zeros((len(at), n), np.uint64)
        x[:, :k] = w.hash[at[:, None] + np.arange(k)]
        own = ids[w.doc[at]]
        o = np.lexsort((own, *x.T))
        x, own = x[o], own[o]
        first = np.append(True, (x[1:] != x[:-1]).any(1))[: len(x)]
        word.append(x[first])
        size.append(np.full(first.sum(), k))
        item.append(own[first])
    return Phrases(*map(np.concatenate, (word, size, item)))


class FMIndex:
    """Wavelet matrix over the Burrows-Wheeler transform of a sequence of symbols 0 .. ``kinds`` - 1."""

    def __init__(self, ids: np.ndarray, kinds: int):
        ids, kinds = np.append(ids + 1, 0).astype(np.int32), kinds + 1  # a last symbol less than all others
        n = len(ids)
        sa, _ = suffix_array(ids)
        self.n = n
        self.bwt = ids[sa - 1]  # before the first suffix comes the last symbol
        self.before = np.concatenate([[0], np.cumsum(np.bincount(ids, minlength=kinds))])
        self.levels = []
        x = self.bwt
        for bit in range(max(1, int(kinds - 1).bit_length()) - 1, -1, -1):
            one = (x >> bit & 1).astype(bool)
            zeros = np.zeros(n + 1, np.int32)
            np.cumsum(~one, out=zeros[1:])
            self.levels.append((bit, zeros))
            x = np.concatenate([x[~one], x[one]])
        kept = sa % SAMPLE == 0
        self.sampled = kept
        self.sample_rank = np.concatenate([[0], np.cumsum(kept)])
        self.sample = sa[kept]

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol among the first ``at`` of the transform."""
        base = np.zeros(len(at), np.int64)
        at = at.astype(np.int64)
        for bit, zeros in self.levels:
            one = (symbol >> bit & 1).astype(bool)
            z = int(zeros[-1])
            za, zb = zeros[at], zeros[base]
            at = np.where(one, z + at - za, za)
            base = np.where(one, z + base - zb, zb)
        return at - base

    def step(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self.before[symbol] + self.rank(symbol, at)

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges [lo, hi) of the patterns (one a row, last symbol first searched); empty where symbols are below 0."""
        m, k = patterns.shape
        lo, hi = np.zeros(m, np.int64), np.full(m, self.n, np.int64)
        hi[(patterns < 0).any(1)] = 0
        live = np.flatnonzero(hi > lo)
        patterns = patterns + 1
        for j in range(k - 1, -1, -1):
            s = patterns[live, j]
            lo[live], hi[live] = self.step(s, lo[live]), self.step(s, hi[live])
            live = live[hi[live] > lo[live]]
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows: walk to a sampled one, counting steps."""
        at, steps, out = rows.copy(), np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        live = np.arange(len(rows))
        while len(live):
            here = at[live]
            done = self.sampled[here]
            d = live[done]
            out[d] = self.sample[self.sample_rank[at[d]]] + steps[d]
            live, here = live[~done], here[~done]
            at[live] = self.step(self.bwt[here], here)
            steps[live] += 1
        return out


def occurrences(col, ph: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word, words, item) of every occurrence of a phrase in a string array, through an FM-index."""
    none = np.zeros(0, np.int64)
    w = words(col)
    rows = len(w.first) - 1
    if not len(w.hash) or not len(ph.size):
        return none, none, none, none
    at = np.arange(len(w.hash)) + w.doc
    sym = np.full(len(w.hash) + rows, _SEPARATOR, np.uint64)
    sym[at] = w.hash
    ids, kinds = dense_ranks(sym)
    alphabet = np.empty(kinds, np.uint64)
    alphabet[ids] = sym
    code = np.searchsorted(alphabet, ph.word)
    code[code >= kinds] = 0
    code = np.where((alphabet[code] == ph.word) & (ph.word != _SEPARATOR), code, -1)
    here = (code >= 0).sum(1) >= ph.size
    if not here.any():
        return none, none, none, none
    index = FMIndex(ids, kinds)
    pos, size, item = [none], [none], [none]
    for k in np.unique(ph.size[here]):
        which = np.flatnonzero(here & (ph.size == k))
        lo, hi = index.search(code[which, :k])
        n = np.maximum(hi - lo, 0)
        row = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        pos.append(index.locate(row))
        size.append(np.full(len(row), k))
        item.append(np.repeat(ph.item[which], n))
    pos, size, item = map(np.concatenate, (pos, size, item))
    starts = w.first[:-1] + np.arange(rows)
    text = np.searchsorted(starts, pos, side="right") - 1
    return text, pos - starts[text], size, item


def merge(text: np.ndarray, start: np.ndarray, size: np.ndarray, item: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Touching and overlapping occurrences of one text as (text, start, end, least item) spans."""
    if not len(text):
        return text, start, start, item
    o = np.lexsort((start, text))
    text, start, end, item = text[o], start[o], (start + size)[o], item[o]
    big = int(end.max()) + 1
    reach = np.maximum.accumulate(text * big + end)
    new = np.append(True, (text * big + start)[1:] > reach[:-1])
    head = np.flatnonzero(new)
    last = np.append(head[1:], len(text)) - 1
    return text[head], start[head], reach[last] - text[head] * big, np.minimum.reduceat(item, head)


def find(docs: DataFrame, benchmark: DataFrame, n: int = PHRASE) -> DataFrame:
    """(doc_id, start_word, end_word, start_char, end_char, item_id): spans of ``docs`` that hold benchmark phrases.

    Words are numbered from 0 without those that have no letter or digit, ends are exclusive; case and ASCII punctuation
    don't matter; ``item_id`` is the least of the items found in the span (ties: of the items that have the phrase).  Null and
    empty texts have no span; very long texts are a shard of their own; repeated rows and null ids each have theirs; an empty
    benchmark or table gives an empty result; other columns are ignored.
    """
    held = docs.sparkSession.sparkContext.broadcast(phrases(benchmark, n))
    kind = need(docs, "doc_id", "text").schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in merged(batches, "text", SHARD_BYTES):
            for b in n_slices(big, "text", SHARD_BYTES):
                t, s, e, item = merge(*occurrences(b.column(1), held.value))
                a, z = np.zeros(len(t), np.int64), np.zeros(len(t), np.int64)
                for i, mine in runs(t):
                    begin, end = token_spans(b.column(1)[i].as_py())
                    a[mine], z[mine] = begin[s[mine]], end[e[mine] - 1]
                cols = [b.column(0).take(pa.array(t)), *map(pa.array, (s, e, a, z, item))]
                yield pa.record_batch(cols, names=["doc_id", "start_word", "end_word", "start_char", "end_char", "item_id"])

    return need(docs, "doc_id", "text").mapInArrow(run, f"doc_id {kind}, start_word bigint, end_word bigint, start_char bigint, end_char bigint, item_id bigint")


def cleaned(docs: DataFrame, benchmark: DataFrame, n: int = PHRASE) -> DataFrame:
    """``docs`` without the spans that ``find`` returns, all columns kept; documents of which no word is left are dropped.

    Documents without a span are unchanged, those without words (null, empty) included.  Repeated rows and null ids are cleaned
    each for themselves, very long texts as a shard of their own; an empty table or benchmark changes nothing.  Columns are
    told apart by their place, so other columns may have any names and values.
    """
    held = docs.sparkSession.sparkContext.broadcast(phrases(benchmark, n))
    need(docs, "doc_id", "text")
    at = docs.columns.index("text")
    base = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in base.schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in merged(batches, f"c{at}", SHARD_BYTES):
            for b in n_slices(big, f"c{at}", SHARD_BYTES):
                t, s, e, _ = merge(*occurrences(b.column(at), held.value))
                if not len(t):
                    yield b
                    continue
                text, keep = b.column(at).to_pylist(), np.ones(b.num_rows, bool)
                for i, mine in runs(t):
                    x = text[i]
                    begin, end = token_spans(x)
                    parts, last = [], 0
                    for p, q in zip(s[mine], e[mine]):
                        parts.append(x[last : begin[p]])
                        last = end[q - 1]
                    text[i] = "".join(parts) + x[last:]
                    keep[i] = len(token_spans(text[i])[0]) > 0
                cols = list(b.columns)
                cols[at] = pa.array(text, b.schema.field(at).type)
                yield pa.RecordBatch.from_arrays(cols, names=b.schema.names).filter(pa.array(keep))

    return base.mapInArrow(run, schema).toDF(*docs.columns)


def _tokens(table: str, key: str) -> str:
    blank = "chr(32) || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)"
    return (
        f"SELECT {key}, list_filter(list_transform(string_split(translate(lower(text), {blank}, repeat(' ', 6)), ' '), lambda x: regexp_replace(x, '[!-/:-@\\[-`{{-~\\x00-\\x1f\\x7f]', '', 'g')), lambda x: x <> '') AS w FROM {table}"
    )


ORACLE = f"""
WITH b AS ({_tokens("benchmark", "item_id")}), d AS ({_tokens("documents", "doc_id")}),
bp AS (SELECT item_id, w, least({PHRASE}, len(w)) AS k, unnest(range(1, len(w) - least({PHRASE}, len(w)) + 2)) AS p FROM b WHERE len(w) > 0),
bg AS (SELECT k, array_to_string(w[p : p + k - 1], ' ') AS g, min(item_id) AS item_id FROM bp GROUP BY 1, 2),
ks AS (SELECT DISTINCT k FROM bg),
dp AS (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d, ks WHERE len(w) >= k),
h AS (SELECT doc_id, p - 1 AS s, p - 1 + dp.k AS e, item_id FROM dp JOIN bg ON dp.k = bg.k AND array_to_string(w[p : p + dp.k - 1], ' ') = g),
m AS (SELECT *, max(e) OVER (PARTITION BY doc_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM h),
n AS (SELECT *, sum(CASE WHEN before IS NULL OR s > before THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY s ROWS UNBOUNDED PRECEDING) AS span FROM m)
SELECT doc_id, min(s) AS start_word, max(e) AS end_word, min(item_id) AS item_id FROM n GROUP BY doc_id, span
"""
