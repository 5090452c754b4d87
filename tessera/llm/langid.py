"""Operator 2, language ID: hyperdimensional profiles.

Every letter has a random vector of +1 and -1, made from its code point.  A trigram's vector binds its letters', permuted by
position, through an elementwise product; a text's vector bundles (sums) those of its trigrams; a language's prototype bundles the
unit vectors of labelled documents.  A document gets the language whose prototype has the largest cosine with it.

The sum over a text's trigrams is its count vector times the trigram vectors: a product of matrices for as many documents and
trigrams at a time as fit in CELLS numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import n_slices, need
from ._text import mix

DIM = 1024
#: Labelled rows at most of each language that prototypes are made from.
TRAIN_ROWS = 2000
#: Counts held at once (4 bytes each), and trigrams whose vectors are (4 KB each).
CELLS, COLUMNS = 1 << 23, 1 << 12
SLICE_BYTES = 1 << 20
_SPACE, _BITS = 32, 21
_SEED = np.uint64(20240229)
_is_letter: list[np.ndarray] = []


def _letters_of_unicode() -> np.ndarray:
    if not _is_letter:  # once a worker
        _is_letter.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _is_letter[0]


def letters(text: str) -> np.ndarray:
    """Code points of the lower-case text, framed by spaces; all that isn't a letter is a space, runs of spaces are one."""
    x = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    out = np.where(_letters_of_unicode()[x], x, _SPACE)
    keep = np.ones(len(out), bool)
    keep[1:] = (out[1:] != _SPACE) | (out[:-1] != _SPACE)
    return out[keep].astype(np.int64)


def letter_vectors(points: np.ndarray) -> np.ndarray:
    """A row of +1 and -1 (int8) for each code point: the bits of hashes of it."""
    word = mix(mix(points.astype(np.uint64) + _SEED)[:, None] + np.arange(DIM // 64, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return (np.unpackbits(word.astype("<u8").view(np.uint8).reshape(len(points), -1), axis=1) * 2).astype(np.int8) - np.int8(1)


def trigram_vectors(codes: np.ndarray) -> np.ndarray:
    """Bound vectors (float32) of trigram codes; the letter at place j is rotated by 2 - j before the product."""
    mask = (1 << _BITS) - 1
    points, at = np.unique(np.stack([codes >> (2 * _BITS), codes >> _BITS & mask, codes & mask]), return_inverse=True)
    a, b, c = at.reshape(3, -1)
    v = letter_vectors(points)
    out = np.roll(v, 2, axis=1)[a]
    out *= np.roll(v, 1, axis=1)[b]
    out *= v[c]
    return out.astype(np.float32)


def embed(texts: list[str | None]) -> np.ndarray:
    """Unit document vectors; zero for a text without a trigram."""
    codes, n = [], []
    for t in texts:
        x = letters(t) if t else np.zeros(0, np.int64)
        u, k = np.unique((x[:-2] << (2 * _BITS)) | (x[1:-1] << _BITS) | x[2:], return_counts=True)
        codes.append(u)
        n.append(k.astype(np.float32))
    out = np.zeros((len(texts), DIM), np.float32)

    def bundle(lo: int, hi: int) -> None:
        code = np.concatenate(codes[lo:hi])
        if not len(code):
            return
        used = np.unique(code)
        if (hi - lo) * len(used) > CELLS and hi - lo > 1:
            bundle(lo, (lo + hi) // 2)
            bundle((lo + hi) // 2, hi)
            return
        row, place, count = np.repeat(np.arange(hi - lo), [len(x) for x in codes[lo:hi]]), np.searchsorted(used, code), np.concatenate(n[lo:hi])
        for a in range(0, len(used), COLUMNS):
            part = used[a : a + COLUMNS]
            hit = (place >= a) & (place < a + len(part)) if len(used) > COLUMNS else slice(None)
            m = np.zeros((hi - lo, len(part)), np.float32)
            m[row[hit], place[hit] - a] = count[hit]
            out[lo:hi] += m @ trigram_vectors(part)

    if len(texts):
        bundle(0, len(texts))
    size = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(size > 0, size, 1)


def prototypes(docs: DataFrame, rows: int = TRAIN_ROWS, label: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages and their unit prototypes from at most about ``rows`` labelled documents each, chosen by a hash of id and text.

    The bundle is summed on the executors: what comes back is one vector of DIM numbers per language and partition.  Rows
    with a null label or text aren't used; null ids and repeated rows are rows like others; a language of which no text has
    a letter has no prototype.
    """
    known = need(docs, "doc_id", "text", label).toDF("doc_id", "text", "label").where("label is not null and text is not null")
    n = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not n:
        return [], np.zeros((0, DIM), np.float32)
    share = F.create_map(*[x for k, v in n.items() for x in (F.lit(k), F.lit(min(1.0, rows / v)))])
    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) / float(1 << 20)  # rows of one id are drawn each for itself
    part = known.where(draw < share[F.col("label")]).select("label", "text")

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for big in batches:
            for b in n_slices(big, "text", SLICE_BYTES):
                lab = b.column(0).to_pylist()
                for x, v in zip(lab, embed(b.column(1).to_pylist())):
                    sums[x] = sums.get(x, 0) + v.astype(np.float64)
        if sums:
            yield pa.record_batch([pa.array(list(sums)), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))], names=["label", "v"])

    got = part.mapInArrow(bundle, "label string, v array<double>").collect()
    total: dict[str, np.ndarray] = {}
    for r in sorted(got, key=lambda r: (r["label"], r["v"])):
        total[r["label"]] = total.get(r["label"], 0) + np.array(r["v"])
    names = sorted(k for k, v in total.items() if np.linalg.norm(v) > 0)
    return names, np.array([total[k] / np.linalg.norm(total[k]) for k in names], np.float32).reshape(len(names), DIM)


def identify(docs: DataFrame, names: list[str], protos: np.ndarray) -> DataFrame:
    """(doc_id, language, cosine, margin) for every row of ``docs``, over whole texts, however long or short.

    ``margin`` is the lead over the second language.  A text without a letter of any script (null, empty, blank, digits,
    punctuation) has a null language and cosine 0; cosines equal to 6 digits go to the lesser name; repeated rows and null ids
    keep their rows; without prototypes all languages are null; an empty table gives an empty result; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for b in n_slices(big, "text", SLICE_BYTES):
                n = b.num_rows
                best, top, gap = np.full(n, -1), np.zeros(n), np.zeros(n)
                if names:
                    v = embed(b.column(1).to_pylist())
                    cos = np.round((v @ protos.T).astype(np.float64), 6)
                    best, top = cos.argmax(1), cos.max(1)
                    rest = np.partition(cos, -2, axis=1)[:, -2] if len(names) > 1 else 0
                    gap = np.round(top - rest, 6)
                    none = ~v.any(1)
                    best[none], top[none], gap[none] = -1, 0, 0
                lang = pa.array([names[k] if k >= 0 else None for k in best], pa.string())
                yield pa.record_batch([b.column(0), lang, pa.array(top, pa.float64()), pa.array(gap, pa.float64())], names=["doc_id", "language", "cosine", "margin"])

    kind = need(docs, "doc_id", "text").schema["doc_id"].dataType.simpleString()
    return need(docs, "doc_id", "text").mapInArrow(run, f"doc_id {kind}, language string, cosine double, margin double")


def detect(docs: DataFrame, rows: int = TRAIN_ROWS, label: str = "lang") -> DataFrame:
    """Prototypes from the labelled rows of ``docs``, then a language for every row."""
    return identify(docs, *prototypes(docs, rows, label))
