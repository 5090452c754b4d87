"""Operator 8, token counts: a linear longest-match automaton that counts word pieces without building them.

After Song et al., "Fast WordPiece Tokenization" (2021).  The vocabulary is a trie; each node has a failure link and
the number of tokens popped on the way there, so a word is read once, character by character, and nothing is backed up
over.  A word is white-space delimited and begins with the vocabulary's word mark.  Characters that no piece consists
of count as their UTF-8 bytes (byte fallback), so every word can be counted.
"""

from __future__ import annotations

import os
from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from ._spark import need

#: A public SentencePiece vocabulary of 32,000 pieces.  It's a byte-pair model; the counts here are of the longest matches, which that
#: model's own merges don't always give.
VOCAB = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Words kept with their counts by a Python worker; only speed depends on it.
CACHE = 300_000


def load_pieces(path: str = VOCAB) -> list[str]:
    """The ordinary pieces of a SentencePiece model (no control, unknown or byte pieces)."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=os.fspath(path))
    return [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]


class Automaton:
    """Trie over ``pieces`` with failure links (``link``) and counts of popped tokens (``pops``)."""

    def __init__(self, pieces: Iterable[str]):
        self.next: list[dict[str, int]] = [{}]
        own = [0]  # tokens that the node's string counts as where it is a token, else 0

        def add(piece: str, count: int) -> None:
            at = 0
            for c in piece:
                to = self.next[at].get(c)
                if to is None:
                    to = self.next[at][c] = len(self.next)
                    self.next.append({})
                    own.append(0)
                at = to
            own[at] = own[at] or count

        pieces = [p for p in pieces if p]
        for p in pieces:
            add(p, 1)
        for c in {c for p in pieces for c in p} | {MARK}:
            add(c, len(c.encode()))  # only where it isn't a piece
        self.link = [0] * len(self.next)
        self.pops = [0] * len(self.next)
        queue: deque[int] = deque([0])
        while queue:
            u = queue.popleft()
            for c, v in self.next[u].items():
                queue.append(v)
                if own[v]:
                    self.pops[v] = own[v]  # the whole string is popped as one token; back to the root
                    continue
                z, n = self.link[u], self.pops[u]
                while c not in self.next[z]:  # ends: every character of a piece is in the root
                    n += self.pops[z]
                    z = self.link[z]
                self.link[v], self.pops[v] = self.next[z][c], n

    def count(self, word: str) -> int:
        """Greedy longest-match tokens of a word, mark included in ``word``."""
        step, link, pops = self.next, self.link, self.pops
        u = n = 0
        for c in word:
            to = step[u].get(c)
            while to is None and u:
                n += pops[u]
                u = link[u]
                to = step[u].get(c)
            if to is None:
                n += len(c.encode("utf-8", "surrogatepass"))
            else:
                u = to
        while u:
            n += pops[u]
            u = link[u]
        return n


class _Counts(dict):
    """Word to token count, filled on demand."""

    def __init__(self, automaton: Automaton):
        self.of = automaton.count

    def __missing__(self, word: str) -> int:
        if len(word) > 64:
            return self.of(MARK + word)
        self[word] = n = self.of(MARK + word)
        return n


_made: dict[int, Automaton] = {}  # a worker's, by a hash of their pieces


def counter(pieces: list[str], key: int) -> _Counts:
    if key not in _made:
        _made.clear()
        _made[key] = Automaton(pieces)
    return _Counts(_made[key])


def count_tokens(docs: DataFrame, vocab: str = VOCAB) -> DataFrame:
    """(doc_id, n_words, n_tokens) for every row of ``docs``, over whole texts.

    ``vocab`` is the path of the vocabulary file, read by the driver; its pieces are broadcast (about 0.5 MB, whatever the corpus).
    A null or empty text has 0 words and 0 tokens; very long texts and words are read once, in linear time; null and repeated
    ids keep their rows; an empty table gives an empty result; other columns are ignored.
    """
    pieces = load_pieces(vocab)
    key = xxhash.xxh3_64_intdigest("\n".join(pieces).encode())
    held = docs.sparkSession.sparkContext.broadcast(pieces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = counter(held.value, key)
        get = counts.__getitem__
        for b in batches:
            words, tokens = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64)
            for i, text in enumerate(b.column(1)):
                w = (text.as_py() or "").split()
                words[i], tokens[i] = len(w), sum(map(get, w))
                if len(counts) > CACHE:
                    counts.clear()
            yield pa.record_batch([b.column(0), pa.array(words), pa.array(tokens)], names=["doc_id", "n_words", "n_tokens"])

    kind = need(docs, "doc_id", "text").schema["doc_id"].dataType.simpleString()
    return need(docs, "doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_words bigint, n_tokens bigint")
