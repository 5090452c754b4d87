"""Operator 9, quality rules: repetition within a document, found with a suffix array.

The words of a batch of documents form one sequence in which equal words of different documents are different symbols, so
every common prefix of neighbouring suffixes lies within one document.  Common-prefix intervals of at least
``min_words`` words are that document's maximal repeated passages; the union of their occurrences is the repeated part.
A document is rejected where the repeated part or the longest repeat is too large.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ._spark import n_slices, need
from ._suffix import dense_ranks, lcp_array, suffix_array
from ._text import mix, words

#: Repeats shorter than this are language, not repetition.
MIN_WORDS = 5
#: Largest share of a document's words that repeated passages may cover.
MAX_COVERED = 0.5
#: Longest repeated passage allowed, in words.
MAX_REPEAT = 100
SHARD_BYTES = 6 << 20


def repetition(col, min_words: int = MIN_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, repeated words, longest repeat) of every text of a string array."""
    w = words(col)
    rows = len(w.first) - 1
    n_words = np.diff(w.first).astype(np.int64)
    covered, longest = np.zeros(rows, np.int64), np.zeros(rows, np.int64)
    if len(w.hash) == 0:
        return n_words, covered, longest
    # one separator behind each text; every symbol is salted with its text
    at = np.arange(len(w.hash)) + w.doc
    n = len(w.hash) + rows
    sym = np.empty(n, np.uint64)
    salt = np.arange(1, rows + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    sym[at] = mix(w.hash ^ salt[w.doc])
    ends = w.first[1:] + np.arange(rows)
    sym[ends] = mix(salt)
    ids, _ = dense_ranks(sym)
    sa, rank = suffix_array(ids)
    lcp = lcp_array(ids, sa, rank)
    both = np.maximum(lcp, np.append(lcp[1:], 0))  # longest match of the suffix at this rank with any other
    match = np.zeros(n, np.int64)
    match[sa] = both
    match = match[at]
    match[match < min_words] = 0
    hit = np.flatnonzero(match)
    if len(hit):
        reach = np.zeros(len(match), np.int64)
        reach[hit] = hit + match[hit]
        np.maximum.accumulate(reach, out=reach)  # matches end inside their text, so no reach passes into the next
        covered[:] = np.bincount(w.doc, reach > np.arange(len(reach)), minlength=rows)
        np.maximum.at(longest, w.doc[hit], match[hit])
    return n_words, covered, longest


def _judge(b: pa.RecordBatch, at: int, min_words: int, max_covered: float, max_repeat: int):
    n, cov, top = repetition(b.column(at), min_words)
    share = np.round(cov / np.maximum(n, 1), 6)
    return n, cov, top, share, (n > 0) & (share <= max_covered) & (top <= max_repeat)


def measure(docs: DataFrame, min_words: int = MIN_WORDS, max_covered: float = MAX_COVERED, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """(doc_id, n_words, repeated_words, longest_repeat, covered, keep) for every row of ``docs``, over whole texts.

    A text without words (null, empty, punctuation) has zeros and isn't kept; a share or length at its limit is kept; very long
    texts are searched whole, a text a batch; repeated rows are judged each for itself; null ids keep their rows; an empty table
    gives an empty result; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for b in n_slices(big, "text", SHARD_BYTES):
                n, cov, top, share, ok = _judge(b, 1, min_words, max_covered, max_repeat)
                yield pa.record_batch(
                    [b.column(0), pa.array(n), pa.array(cov), pa.array(top), pa.array(share), pa.array(ok)],
                    names=["doc_id", "n_words", "repeated_words", "longest_repeat", "covered", "keep"],
                )

    kind = need(docs, "doc_id", "text").schema["doc_id"].dataType.simpleString()
    return need(docs, "doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, n_words bigint, repeated_words bigint, longest_repeat bigint, covered double, keep boolean"
    )


def passing(docs: DataFrame, min_words: int = MIN_WORDS, max_covered: float = MAX_COVERED, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """The rows of ``docs`` that ``measure`` keeps, all their columns unchanged and nothing moved between partitions.

    Nulls, empty and long texts, repeated rows and empty tables are ``measure``'s; columns are told apart by their place.
    """
    need(docs, "text")
    at = docs.columns.index("text")
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])  # names may clash, places don't
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in plain.schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for b in n_slices(big, f"c{at}", SHARD_BYTES):
                yield b.filter(pa.array(_judge(b, at, min_words, max_covered, max_repeat)[-1]))

    return plain.mapInArrow(run, schema).toDF(*docs.columns)


def oracle(k: int = MIN_WORDS, max_covered: float = MAX_COVERED, max_repeat: int = MAX_REPEAT) -> str:
    """The same rows in DuckDB SQL: repeated words are the union of recurring k-word windows; the longest repeat is the longest run of
    equal windows at one distance, and k - 1 words more."""
    from .decontam import _tokens

    return f"""
WITH d AS ({_tokens("documents", "doc_id")}),
g AS (SELECT doc_id, p, hash(array_to_string(w[p : p + {k - 1}], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - {k - 2})) AS p FROM d WHERE len(w) >= {k})),
r AS (SELECT doc_id, p, g FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n > 1),
c AS (SELECT doc_id, count(DISTINCT q) AS repeated_words FROM (SELECT doc_id, unnest(range(p, p + {k})) AS q FROM r) GROUP BY doc_id),
e AS (SELECT a.doc_id, b.p - a.p AS far, a.p FROM r a JOIN r b ON a.doc_id = b.doc_id AND a.g = b.g AND a.p < b.p),
l AS (SELECT doc_id, max(n) + {k - 1} AS longest_repeat FROM (SELECT doc_id, count(*) AS n FROM (SELECT *, p - row_number() OVER (PARTITION BY doc_id, far ORDER BY p) AS run FROM e) GROUP BY doc_id, far, run) GROUP BY doc_id),
m AS (SELECT doc_id, coalesce(len(w), 0) AS n_words, coalesce(repeated_words, 0) AS repeated_words, coalesce(longest_repeat, 0) AS longest_repeat FROM d LEFT JOIN c USING (doc_id) LEFT JOIN l USING (doc_id))
SELECT *, round(repeated_words / greatest(n_words, 1), 6) AS covered, n_words > 0 AND round(repeated_words / greatest(n_words, 1), 6) <= {max_covered} AND longest_repeat <= {max_repeat} AS keep FROM m
"""
