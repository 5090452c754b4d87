"""Operator 5, line dedup: two Bloom filters, then exact confirmation of the suspects.

Documents fall into groups of bounded bytes.  A group sends the hashes of its distinct lines, about 2 bytes each, to ranges of the
hash.  A range has two filters of its own, 16 bits a line: one of lines seen once and, for a line whose bits were all there already,
one of lines seen twice; it answers each group with a bit a line.  No line of two groups escapes the twice-filter; a few others pass
it.  Only suspects are shuffled as text, the first of each group, and compared exactly; what a group holds of a line that begins
elsewhere goes, and repeats within a group are settled there.

Filters grow in number with the corpus, not in size; none is broadcast or comes to the driver.  The texts are shuffled once (all
three passes read the same exchange).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._spark import need, text_bytes, trim
from ._text import mix, pack, range_of, runs, unpack

BITS_PER_LINE = 16
K = 4
GROUP_BYTES = 3 << 20
RANGE_BYTES = 32 << 20
#: Bits of a line's hash that are sent within its range.
LOW = 28
_BLANK = " \t\r"


def line_keys(text: str) -> list[str]:
    """Lines as they are compared: without spaces, tabs and carriage returns at the ends."""
    return [x.strip(_BLANK) for x in text.split("\n")]


def hashes(lines: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(x.encode("utf-8", "surrogatepass")) for x in lines), np.uint64, len(lines))


def low(h: np.ndarray) -> np.ndarray:
    return (h & np.uint64((1 << LOW) - 1)).astype(np.int64)


def twice(sets: list[np.ndarray]) -> list[np.ndarray]:
    """For each number of each set (distinct numbers): whether it passes the filter of those that two sets have."""
    bits = np.uint64(1 << max(6, int(BITS_PER_LINE * sum(map(len, sets))).bit_length()))
    once_seen, twice_seen = np.zeros(int(bits), bool), np.zeros(int(bits), bool)

    def positions(x: np.ndarray) -> np.ndarray:
        a = mix(x.astype(np.uint64))
        b = mix(a) | np.uint64(1)
        return np.stack([(a + np.uint64(i) * b) % bits for i in range(K)], axis=1).astype(np.int64)

    for x in sets:
        at = positions(x)
        again = once_seen[at].all(1)
        twice_seen[at[again]] = True
        once_seen[at] = True
    return [twice_seen[positions(x)].all(1) for x in sets]


def _rows(t: pa.Table, key: int, at: int) -> list[tuple]:
    """((has an id, id, hash of the text), row, lines) of a group's rows with a text, in the order of occurrences."""
    out = []
    for i, (k, h, x) in enumerate(zip(t.column(key).to_pylist(), t["h_"].to_pylist(), t.column(at).to_pylist())):
        if x is not None:
            out.append(((k is not None, 0 if k is None else k, h), i, line_keys(x)))
    out.sort(key=lambda r: r[0])
    return out


def _lines(rows: list[tuple]) -> dict[str, tuple]:
    """The place (id, hash, line number) where each line with content occurs first."""
    first: dict[str, tuple] = {}
    for place, _, x in rows:
        for no, line in enumerate(x):
            if line and line not in first:
                first[line] = (*place, no)
    return first


def _dedup(docs: DataFrame) -> DataFrame:
    """Columns c0, c1, ... of ``docs`` in their order, texts deduplicated, then n_lines and n_removed."""
    _, size = text_bytes(need(docs, "doc_id", "text").select("text"))
    names = docs.columns
    n, key, at = len(names), names.index("doc_id"), names.index("text")
    groups, ranges = max(1, -(-size // GROUP_BYTES)), max(4, -(-size // RANGE_BYTES))
    base = docs.toDF(*[f"c{i}" for i in range(n)])
    done = T.StructType([*[T.StructField(f.name, f.dataType, True) for f in base.schema], T.StructField("n_lines", T.LongType()), T.StructField("n_removed", T.LongType())])
    base = base.withColumn("h_", F.xxhash64(f"c{at}"))
    # rows that are alike in id and text are spread by the partition they come from, so that no group is hot
    base = base.withColumn("p_", F.pmod(F.xxhash64(f"c{key}", "h_", F.spark_partition_id()), F.lit(groups)).cast("int"))

    def sent(rows: list[tuple]) -> tuple[list[str], np.ndarray, list[tuple[int, slice]]]:
        """A group's distinct lines, their hashes in order, and the ranges that occur."""
        lines = sorted({x for _, _, ls in rows for x in ls if x})
        h = hashes(lines)
        o = np.argsort(h, kind="stable")
        h = h[o]
        return [lines[i] for i in o], h, list(runs(range_of(h, ranges)))

    def send(k: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        _, h, spans = sent(_rows(t, key, at))
        trim()
        return pa.table([pa.array([r for r, _ in spans], pa.int32()), pa.array([k[0].as_py()] * len(spans), pa.int32()), pa.array([pack(np.unique(low(h[s]))) for _, s in spans], pa.binary())], names=["r", "p", "lines"])

    def meet(k: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        hits = twice([unpack(x.as_py()) for x in t["lines"]])
        rows = [(p, np.packbits(x).tobytes()) for p, x in zip(t["p"].to_pylist(), hits) if x.any()]
        trim()
        return pa.table([pa.array([p for p, _ in rows], pa.int32()), pa.array([k[0].as_py()] * len(rows), pa.int32()), pa.array([x for _, x in rows], pa.binary())], names=["p", "r", "hits"])

    kind = base.schema[f"c{key}"].dataType

    def suspect(k: tuple[pa.Scalar, ...], t: pa.Table, known: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if t.num_rows and known.num_rows:
            rows = _rows(t, key, at)
            lines, h, spans = sent(rows)
            told, first = dict(zip(known["r"].to_pylist(), known["hits"].to_pylist())), _lines(rows)
            for r, s in spans:
                if r in told:
                    _, number = np.unique(low(h[s]), return_inverse=True)
                    hit = np.unpackbits(np.frombuffer(told[r], np.uint8))[number].astype(bool)
                    out += [(x, *first[x]) for x in (lines[s.start + i] for i in np.flatnonzero(hit))]
        trim()
        cols = [pa.array([x[0] for x in out], pa.string()), pa.array([k[0].as_py()] * len(out), pa.int32()), pa.array([x[2] if x[1] else None for x in out], t.schema.field(key).type if t.num_rows else None)]
        cols += [pa.array([x[3] for x in out], pa.int64()), pa.array([x[4] for x in out], pa.int32())]
        return pa.table(cols, names=["line", "p", "id", "hash", "no"])

    def finish(k: tuple[pa.Scalar, ...], t: pa.Table, lost: pa.Table) -> pa.Table:
        text, count, gone = t.column(at).to_pylist(), np.zeros(t.num_rows, np.int64), np.zeros(t.num_rows, np.int64)
        rows, elsewhere = _rows(t, key, at), set(lost["line"].to_pylist())
        first = _lines(rows)
        for place, i, x in rows:
            stay = [not line or line not in elsewhere and first[line] == (*place, no) for no, line in enumerate(x)]
            count[i], gone[i] = len(x), len(x) - sum(stay)
            if gone[i]:
                text[i] = "\n".join(v for v, s in zip(text[i].split("\n"), stay) if s)
        cols = [t.column(i) for i in range(n)]
        cols[at] = pa.array(text, t.schema.field(at).type)
        trim()
        return pa.table([*cols, pa.array(count), pa.array(gone)], names=done.names)

    by = base.groupBy("p_")
    known = by.applyInArrow(send, "r int, p int, lines binary").groupBy("r").applyInArrow(meet, "p int, r int, hits binary")
    found = by.cogroup(known.groupBy("p")).applyInArrow(suspect, f"line string, p int, id {kind.simpleString()}, hash bigint, no int")
    place = F.struct("id", "hash", "no")
    first = found.groupBy("line").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("line", "first")
    lost = found.join(first, "line").where(~place.eqNullSafe(F.col("first"))).select("p", "line")
    return by.cogroup(lost.groupBy("p")).applyInArrow(finish, done)


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated lines removed from ``text``, plus n_lines and n_removed (columns of these names are replaced).

    The first occurrence in order of (doc_id, line) stays; a null doc_id comes first; rows of one doc_id are ordered by a
    hash of their text, and rows alike in both are one occurrence and keep the same lines.  Lines are compared without
    blanks at their ends; blank lines always stay.  A text all of whose lines go is empty; null stays null with 0 lines; very
    long texts are a group of their own; an empty table gives an empty result; every row stays and all other columns, whatever
    their names, are unchanged.
    """
    names = docs.columns
    keep = [F.col(f"c{i}").alias(n) for i, n in enumerate(names) if n not in ("n_lines", "n_removed")]
    return _dedup(docs).select(*keep, "n_lines", "n_removed")


def cleaned(docs: DataFrame) -> DataFrame:
    """``docs``, columns unchanged, without repeated lines; documents whose lines with content were all removed are dropped.

    Documents that had no such line to begin with (null, empty, blank) stay.  Order, ties, repeated rows, null ids and very long
    texts are ``dedup_lines``'s; an empty table gives an empty result.
    """
    need(docs, "doc_id", "text")
    text = F.col(f"c{docs.columns.index('text')}")
    some = F.length(F.translate(text, " \t\r\n", "")) > 0
    return _dedup(docs).where((F.col("n_removed") == 0) | some).select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(docs.columns)])


def deduped(docs: DataFrame) -> DataFrame:
    """(doc_id, text, n_lines, n_removed) for every row."""
    return dedup_lines(need(docs, "doc_id", "text"))


ORACLE = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS no FROM documents
), k AS (
  SELECT *, trim(line, chr(32) || chr(9) || chr(13)) AS key FROM l
), r AS (
  SELECT *, key <> '' AND row_number() OVER (PARTITION BY key ORDER BY doc_id, no) > 1 AS gone FROM k
)
SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY no) FILTER (WHERE NOT gone), '') AS text,
       count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed
FROM r GROUP BY doc_id
"""
