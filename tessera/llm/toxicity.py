"""Operator 3, toxicity: compression distance between two zstandard dictionaries.

One dictionary is trained on ordinary labelled text, another on toxic labelled text.  Every window of a document is compressed
twice, against the ordinary dictionary and against the toxic one laid before it; the bytes that the toxic one saves are the
window's distance.  Both compressions know the same ordinary text, so ordinary windows save little; what they do save grows with
a document's length and is taken off.  Whole groups of copies of labelled documents go to one of two halves: the dictionaries are
trained on the one; the size and the segments of the toxic dictionary and the thresholds for a window and for a document are
calibrated on the other.

The ordinary dictionary is made by zstd's own trainer.  Toxic text is ordinary text but for a few words in a document, and that
trainer takes what is frequent, which is what both classes have; so the toxic dictionary is made from all of the toxic texts by
the same greedy rule (take the segment whose runs occur in most texts, count each run once, go on) with runs weighed by how many
more toxic than ordinary texts have them.

Windows are small and zstd stores a block raw unless it shrinks enough, so each begins with a primer that both
dictionaries end with: every match then shows in the length.
"""

from __future__ import annotations

import math
import pickle
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard as zs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import n_slices, need, trim
from ._text import buffers

#: Labelled rows of each class, at most, that the model is fitted on (half for the dictionaries, half for calibration).
TRAIN_ROWS = 4000
WINDOW = 32
ORDINARY_BYTES = 4096
#: Sizes of the toxic dictionary from which calibration chooses.
TOXIC_BYTES = (128, 256, 512, 1024, 2048, 4096)
#: Bytes of its segments, short ones for words and long ones for phrases, from which calibration chooses too, and of the runs by
#: which they are counted.
SEGMENTS, RUN = (10, 24), 6
#: Clean texts with a run that weigh against the toxic ones that have it, in shares of their class.
CONTRAST = 5.0
#: Texts that share this part of their four-word runs with an earlier one are copies of it and count as one text.
COPY = 0.3
#: Times the clean windows' mean saving that calibration may take off every window of a document.
NOISE = (0, 1, 2, 4)
#: What flagging a clean document costs in calibration, in missed toxic ones.
CLEAN_COST = 3.0
PRIMER = bytes(range(128, 160))


@dataclass
class Model:
    ordinary: bytes
    toxic: bytes
    window_saving: int  # a window counts from so many bytes saved
    least: float  # a document is toxic from so many bytes saved by its counting windows, beyond window_saving - 1 each
    noise: float = 0.0  # and beyond so many bytes for each of its windows


def _compressor(content: bytes) -> zs.ZstdCompressor:
    d = zs.ZstdCompressionDict(content, dict_type=zs.DICT_TYPE_RAWCONTENT)
    far = len(content).bit_length()  # all of it stays within reach
    p = zs.ZstdCompressionParameters(
        window_log=max(15, far + 1), chain_log=max(14, far), hash_log=max(14, far), search_log=6, min_match=5, target_length=64, strategy=zs.STRATEGY_LAZY2, write_content_size=False, write_dict_id=False
    )
    d.precompute_compress(compression_params=p)
    return zs.ZstdCompressor(compression_params=p, dict_data=d)


def _train(samples: list[bytes], size: int) -> bytes:
    """Content of a trained dictionary; of too few samples, the samples themselves."""
    try:
        return zs.train_dictionary(size, samples, level=3, k=16, d=6).as_bytes()[8:]
    except zs.ZstdError:
        return b"".join(samples)[:size]


def windows(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text) of windows of about WINDOW bytes that end behind white space and cover every text."""
    n = len(data)
    space = np.flatnonzero((data == 32) | (data == 10) | (data == 9)) + 1
    grid = np.arange(WINDOW, n, WINDOW)
    at = np.searchsorted(space, grid)
    cuts = space[at[at < len(space)]]
    cuts = np.unique(np.concatenate([cuts, off]))
    # a run without white space is cut hard, so that no window grows with it
    long = np.flatnonzero(np.diff(cuts) > 4 * WINDOW)
    if len(long):
        cuts = np.unique(np.concatenate([cuts, *[np.arange(cuts[i] + 2 * WINDOW, cuts[i + 1], 2 * WINDOW) for i in long]]))
    a, b = cuts[:-1], cuts[1:]
    return a, b, np.searchsorted(off, a, side="right") - 1


def packed(col) -> tuple[np.ndarray, zs.BufferWithSegments | None]:
    """(text index of each window, windows behind their primers) of a string array."""
    data, off = buffers(pc.utf8_lower(col))
    if len(data) == 0:
        return np.zeros(0, np.int64), None
    a, b, doc = windows(data, off)
    p, m = len(PRIMER), len(a)
    seg = np.empty((m, 2), np.uint64)
    seg[:, 0] = a + p * np.arange(m)
    seg[:, 1] = b - a + p
    out = np.empty(len(data) + p * m, np.uint8)
    keep = np.ones(len(out), bool)
    at = seg[:, 0].astype(np.int64)[:, None] + np.arange(p)
    out[at] = np.frombuffer(PRIMER, np.uint8)
    keep[at] = False
    out[keep] = data
    return doc, zs.BufferWithSegments(out.tobytes(), seg.tobytes())


def lengths(buf: zs.BufferWithSegments | None, c: zs.ZstdCompressor) -> np.ndarray:
    """Compressed length of every window."""
    return np.fromiter(map(len, c.multi_compress_to_buffer(buf, threads=1)), np.int64, len(buf)) if buf else np.zeros(0, np.int64)


def savings(col, ordinary: zs.ZstdCompressor, toxic: zs.ZstdCompressor) -> tuple[np.ndarray, np.ndarray]:
    """(text index, bytes the toxic dictionary saves) of every window of a string array."""
    doc, buf = packed(col)
    return doc, lengths(buf, ordinary) - lengths(buf, toxic)


def copies(texts: list[str]) -> np.ndarray:
    """A group number for every text: copies share one, so that their peculiarities count once."""
    owner: dict[tuple[str, ...], int] = {}
    out = np.zeros(len(texts), np.int64)
    n = 0
    for k, t in enumerate(texts):
        w = t.split()
        runs = set(zip(w, w[1:], w[2:], w[3:])) or {tuple(w)}
        seen = Counter(owner[r] for r in runs if r in owner)
        g = seen.most_common(1)[0][0] if seen.total() >= COPY * len(runs) else n
        n += g == n
        out[k] = g
        for r in runs:
            owner.setdefault(r, g)
    return out


def _pieces(texts: list[str]) -> list[bytes]:
    """All windows of the texts."""
    data, off = buffers(pa.array(texts, pa.string()))
    if len(data) == 0:
        return []
    a, b, _ = windows(data, off)
    raw = data.tobytes()
    return [raw[i:j] for i, j in zip(a, b)]


def _runs(texts: list[str], group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, the run of RUN bytes at each position as a number, runs, groups of texts that have each); 0: no run."""
    data, off = buffers(pa.array(texts, pa.string()))
    n = max(0, len(data) - RUN + 1)
    run = np.zeros(n, np.uint64)
    for i in range(RUN):
        run = (run << np.uint64(8)) | data[i : i + n].astype(np.uint64)
    doc = np.searchsorted(off, np.arange(n), side="right") - 1
    run[off[doc + 1] < np.arange(n) + RUN] = 0  # across two texts
    bits = np.uint64(64 - 8 * RUN)
    runs, count = np.unique(np.unique((run << bits) | group[doc].astype(np.uint64)) >> bits, return_counts=True)
    return data, run, runs, count


def train_toxic(toxic: list[str], clean: list[str], group: np.ndarray, clean_group: np.ndarray, size: int, segment: int) -> bytes:
    """Content of a dictionary trained on all of the toxic texts, the best segment last, of at most ``size`` bytes.

    A run counts by the toxic texts beyond one that have it, less CONTRAST times as many as would have it if they were clean;
    texts of one group are one.
    """
    data, run, runs, t = _runs(toxic, group)
    _, _, known, c = _runs(clean, clean_group)
    if len(run) < segment or not len(known):
        return b""
    at = np.minimum(np.searchsorted(known, runs), len(known) - 1)
    worth = np.maximum(t - 1 - CONTRAST * np.where(known[at] == runs, c[at], 0) * len(np.unique(group)) / len(np.unique(clean_group)), 0.0)
    worth[runs == 0] = 0
    place = np.searchsorted(runs, run)
    by = np.argsort(place, kind="stable")
    edge = np.searchsorted(place[by], np.arange(len(runs) + 1))
    raw, out, width = data.tobytes(), [], segment - RUN + 1
    total = np.concatenate([[0.0], np.cumsum(worth[place])])
    gain = total[width:] - total[:-width]
    while (len(out) + 1) * segment <= size:
        i = int(gain.argmax())
        if gain[i] < 0.5:  # counts are whole but for the clean share: nothing but rounding is left
            break
        out.append(raw[i : i + segment])
        for r in np.unique(place[i : i + width]):
            p = by[edge[r] : edge[r + 1]]
            for k in range(width):
                q = p - k
                q = q[(q >= 0) & (q < len(gain))]
                gain[q] -= worth[r]
            worth[r] = 0
    return b"".join(reversed(out))


def _halves(texts: list[str]) -> tuple[list[str], np.ndarray, list[str]]:
    """Texts of every second group of copies, their groups, and the other texts (the same ones where there is one group)."""
    g = copies(texts)
    a = [t for t, x in zip(texts, g) if x % 2 == 0]
    return a, g[g % 2 == 0], [t for t, x in zip(texts, g) if x % 2] or a


def fit(toxic: list[str], clean: list[str]) -> Model | None:
    """Dictionaries from one half of the groups of copies, thresholds from the other; None where a class has no row."""
    toxic, clean = [t.lower() for t in toxic], [t.lower() for t in clean]
    if not toxic or not clean:
        return None
    # every second group of copies trains; what calibrates has no copy among it
    (t0, g0, t1), (c0, h0, c1) = map(_halves, (toxic, clean))
    ordinary = _train(_pieces(c0), ORDINARY_BYTES) + PRIMER
    co, model, best = _compressor(ordinary), Model(ordinary, ordinary, 1, math.inf), -math.inf
    (it, tb), (ic, cb) = packed(pa.array(t1, pa.string())), packed(pa.array(c1, pa.string()))
    nt, nc, lt, lc = np.bincount(it, minlength=len(t1)), np.bincount(ic, minlength=len(c1)), lengths(tb, co), lengths(cb, co)
    trained = [(n, train_toxic(t0, c0, g0, h0, max(TOXIC_BYTES), n)) for n in SEGMENTS]
    for own in dict.fromkeys(x[max(0, len(x) - size // n * n) :] + ordinary for n, x in trained for size in TOXIC_BYTES):
        ct = _compressor(own)
        dt, dc = lt - lengths(tb, ct), lc - lengths(cb, ct)
        for w in range(1, 8):
            st = np.bincount(it, np.maximum(dt - w + 1, 0), minlength=len(t1))
            sc = np.bincount(ic, np.maximum(dc - w + 1, 0), minlength=len(c1))
            for noise in np.unique(np.array(NOISE) * sc.sum() / max(1, nc.sum())):
                xt, xc = np.sort(st - noise * nt), np.sort(sc - noise * nc)
                least = np.unique(xt[xt > 0])
                if len(least):
                    gain = 1 - np.searchsorted(xt, least) / len(xt) - CLEAN_COST * (1 - np.searchsorted(xc, least) / len(xc))
                    i = len(gain) - 1 - int(gain[::-1].argmax())
                    if gain[i] >= best:
                        best, model = gain[i], Model(ordinary, own, w, float(least[i]), float(noise))
    return model


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model | None:
    """Fit on at most ``rows`` labelled documents of each class, those least by a hash of their id, in one task.

    Labels with a null id or class and documents with a null text aren't used; a document labelled both ways is one of both;
    labels of equal hash and id are one; repeated documents are used as often as they occur.  Only the model comes to the driver.
    doc_id must be of one type in both tables.
    """
    kinds = [t.schema["doc_id"].dataType.simpleString() for t in (need(docs, "doc_id"), need(labels, "doc_id"))]
    if kinds[0] != kinds[1]:
        raise ValueError(f"doc_id is {kinds[0]} in the documents and {kinds[1]} in the labels")
    lab = need(labels, "doc_id", "toxic").where("doc_id is not null and toxic is not null")
    ids = None
    for c in (1, 0):
        part = lab.where(F.col("toxic") == c).select("doc_id", "toxic").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
        ids = part if ids is None else ids.unionByName(part)

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        text, tox = t["text"].to_pylist(), t["toxic"].to_pylist()
        model = fit([x for x, y in zip(text, tox) if y == 1], [x for x, y in zip(text, tox) if y == 0])
        trim()
        return pa.table({"model": pa.array([pickle.dumps(model)], pa.binary())})

    used = need(docs, "doc_id", "text").where("text is not null").join(F.broadcast(ids), "doc_id").select("doc_id", "text", "toxic")
    got = used.groupBy(F.lit(0).alias("all")).applyInArrow(run, "model binary").first()
    return pickle.loads(got["model"]) if got else None


def toxic_documents(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, windows, hits, saved) of the documents that ``model`` finds toxic, whole texts compressed.

    Null and empty texts have no window and are never toxic; very long texts are cut to windows like others; a document is
    found from the threshold on, equal to it included; repeated rows and null ids are judged each for itself; without a
    model (a class without labelled rows) nothing is; an empty table gives an empty result; other columns are ignored.
    """
    kind = need(docs, "doc_id", "text").schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, windows bigint, hits bigint, saved bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model is None or math.isinf(model.least):
            return
        co, ct = _compressor(model.ordinary), _compressor(model.toxic)
        for big in batches:
            for b in n_slices(big, "text", 4 << 20):
                doc, d = savings(b.column(1), co, ct)
                n = np.bincount(doc, minlength=b.num_rows)
                over = np.maximum(d - model.window_saving + 1, 0)
                saved = np.bincount(doc, over, minlength=b.num_rows)
                hits = np.bincount(doc[over > 0], minlength=b.num_rows)
                i = np.flatnonzero(saved - model.noise * n >= model.least)
                yield pa.record_batch(
                    [b.column(0).take(pa.array(i)), pa.array(n[i]), pa.array(hits[i]), pa.array(saved[i].astype(np.int64))], names=["doc_id", "windows", "hits", "saved"]
                )

    return need(docs, "doc_id", "text").mapInArrow(run, schema)


def detect(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """Train on ``labels`` and return the toxic documents of ``docs``."""
    return toxic_documents(docs, train(docs, labels, rows))
