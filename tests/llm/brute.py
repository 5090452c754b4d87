"""Slow, plain versions of the operators, to compare with."""

from __future__ import annotations

import re
from collections import Counter

import xxhash

_WORD = re.compile("[^ \t\n\r\x0b\x0c]+")


def bare(token: str) -> str:
    return "".join(c for c in token.lower() if ord(c) > 127 or c.isalnum())


def toks(text):
    return [b for t in _WORD.findall(text or "") if (b := bare(t))]


def tok_spans(text):
    return [m.span() for m in _WORD.finditer(text or "") if bare(m.group())]


def low(i):
    return (i is not None, i or 0)


def signed_hash(text):
    x = xxhash.xxh64_intdigest(text.encode(), 42)
    return x - (x >> 63 << 64)


def repetition(text, least):
    """(words, repeated words, longest repeat)."""
    w = toks(text)
    n = len(w)
    best = [0] * n
    for i in range(n):
        for j in range(n):
            if i != j:
                k = 0
                while max(i, j) + k < n and w[i + k] == w[j + k]:
                    k += 1
                best[i] = max(best[i], k)
    best = [b if b >= least else 0 for b in best]
    covered = {p for i, b in enumerate(best) for p in range(i, i + b)}
    return n, len(covered), max(best, default=0)


def quality(text, least, share, longest):
    n, c, m = repetition(text, least)
    return n, c, m, n > 0 and round(c / n, 6) <= share and m <= longest


def line_dedup(rows):
    """[(doc_id, text)] -> [(doc_id, text, lines, lines removed)] in the same order."""
    at = [(low(i), signed_hash(t)) if t is not None else None for i, t in rows]
    first = {}
    for place, (_, t) in zip(at, rows):
        for no, x in enumerate((t or "").split("\n")):
            if t is not None and (k := x.strip(" \t\r")):
                first[k] = min(first.get(k, (*place, no)), (*place, no))
    out = []
    for place, (i, t) in zip(at, rows):
        if t is None:
            out.append((i, None, 0, 0))
            continue
        x = t.split("\n")
        keep = [v for no, v in enumerate(x) if not (k := v.strip(" \t\r")) or first[k] == (*place, no)]
        out.append((i, "\n".join(keep), len(x), len(x) - len(keep)))
    return out


def grams(text, n):
    w = toks(text)
    k = min(n, len(w))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if k else set()


def jaccard_classes(rows, n, least):
    """{row number: (class id, links)} of rows that have a partner."""
    sets = [grams(t, n) for _, t in rows]
    edges = []
    for x, a in enumerate(sets):
        for y in range(x):
            o = len(a & sets[y])
            if o and o >= least * len(a | sets[y]) - 1e-9:
                edges.append((x, y))
    root = roots(edges)
    links = Counter(v for e in edges for v in e)
    ids = {}
    for x in links:
        if rows[x][0] is not None:
            r = root.get(x, x)
            ids[r] = min(ids.get(r, rows[x][0]), rows[x][0])
    return {x: (ids.get(root.get(x, x)), k) for x, k in links.items()}


def one_of_each(rows, n, least):
    found = jaccard_classes(rows, n, least)
    return [r for x, r in enumerate(rows) if x not in found or found[x][0] in (None, r[0])]


def roots(edges):
    """Every node that isn't the least of its component, with that least node."""
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    out, done = {}, set()
    for s in sorted(near):
        if s in done:
            continue
        stack = [s]
        while stack:
            u = stack.pop()
            if u not in done:
                done.add(u)
                if u != s:
                    out[u] = s
                stack += near[u]
    return out


def contaminated(rows, items, n):
    """[(row number, start word, end word, start char, end char, item)]."""
    best = {}
    for i, t in items:
        w = toks(t) if i is not None else []
        k = min(n, len(w))
        for j in range(len(w) - k + 1 if k else 0):
            p = tuple(w[j : j + k])
            best[p] = min(best.get(p, i), i)
    out = []
    for r, (_, t) in enumerate(rows):
        w, at = toks(t), tok_spans(t)
        hits = sorted((j, j + k, best[p]) for k in {len(p) for p in best} for j in range(len(w) - k + 1) if (p := tuple(w[j : j + k])) in best)
        spans = []
        for a, z, i in hits:
            if spans and a <= spans[-1][1]:
                spans[-1] = [spans[-1][0], max(z, spans[-1][1]), min(i, spans[-1][2])]
            else:
                spans.append([a, z, i])
        out += [(r, a, z, at[a][0], at[z - 1][1], i) for a, z, i in spans]
    return out


def decontaminated(rows, items, n):
    spans = contaminated(rows, items, n)
    out = []
    for r, (i, t) in enumerate(rows):
        mine = [s for s in spans if s[0] == r]
        for s in reversed(mine):
            t = t[: s[3]] + t[s[4] :]
        if not mine or toks(t):
            out.append((i, t))
    return out


def repeats(rows, size):
    """[(doc_id, start word, end word, kept id)] of repeated windows."""
    rows = sorted((r for r in rows if r[1] is not None), key=lambda r: (low(r[0]), signed_hash(r[1])))
    first, out = {}, []
    for i, t in rows:
        w, spans = toks(t), []
        for j in range(len(w) - size + 1):
            g = tuple(w[j : j + size])
            if g in first:
                kept = first[g]
                if spans and j <= spans[-1][1]:
                    spans[-1] = [spans[-1][0], j + size, min(kept, spans[-1][2], key=low)]
                else:
                    spans.append([j, j + size, kept])
            else:
                first[g] = i
        out += [(i, *s) for s in spans]
    return out


def best_fit_rooms(sizes, capacity):
    rooms = []
    for s in sorted(sizes, reverse=True):
        fit = [r for r in rooms if r >= s]
        if fit:
            rooms.remove(min(fit))
            rooms.append(min(fit) - s)
        else:
            rooms.append(capacity - s)
    return sorted(rooms)


def least_bins(sizes, capacity):
    """The least number of bins, by trying everything."""
    sizes = sorted(sizes, reverse=True)
    best = [len(sizes)]

    def go(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(rooms)
            return
        for r in set(rooms):
            if r >= sizes[i]:
                x = list(rooms)
                x.remove(r)
                go(i + 1, [*x, r - sizes[i]])
        go(i + 1, [*rooms, capacity - sizes[i]])

    go(0, [])
    return best[0]


def greedy(word, pieces, longest):
    """Longest-match pieces of a word; characters of no piece as themselves."""
    out = []
    while word:
        k = next((k for k in range(min(longest, len(word)), 0, -1) if word[:k] in pieces), 1)
        out.append(word[:k])
        word = word[k:]
    return out
