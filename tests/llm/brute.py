"""Plain versions of the operators, for small tables."""

from __future__ import annotations

import hashlib


def repeats(rows: list[tuple[int, str | None]], width: int = 100) -> dict[int, tuple]:
    """doc_id: (n_bytes, n_removed, n_spans, kept_sha256)."""
    seen: set[bytes] = set()
    out = {}
    for doc, text in sorted(rows, key=lambda r: r[0]):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - width + 1):
            window = raw[i : i + width]
            if window in seen:
                gone[i : i + width] = b"\1" * width
            else:
                seen.add(window)
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        runs = sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1]))
        out[doc] = (len(raw), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    return out


def shingles(text: str | None, width: int = 5) -> set[tuple]:
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    if not words:
        return set()
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))}


def near_classes(rows: list[tuple[int, str | None]], similarity: float = 0.8) -> dict[int, int]:
    """doc_id: least doc_id of its class, by comparing all pairs."""
    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, (a, x) in enumerate(sets):
        for b, y in sets[:n]:
            if x and y and len(x & y) >= similarity * len(x | y):
                p, q = root(a), root(b)
                parent[max(p, q)] = min(p, q)
    return {i: root(i) for i, _ in sets}


def encoded(text: str | None) -> list[int]:
    from rillbase.llm.units import default_path, tokenizer

    return tokenizer(default_path()).encode(text or "", add_special_tokens=False).ids


def edit_distance_within(item: str, text: str) -> int:
    """The least edits of ``item`` against any part of ``text``."""
    row = [0] * (len(text) + 1)
    for c in item:
        last, row[0] = row[0], row[0] + 1
        for j, d in enumerate(text, 1):
            last, row[j] = row[j], min(last + (c != d), row[j] + 1, row[j - 1] + 1)
    return min(row)


def ngram_scores(rows: list[tuple[int, str | None]], weight: float, growth: float, add: float = 0.1, ids: list | None = None) -> dict[int, tuple]:
    """doc_id: (held_out, n_tokens, n_known, train_tokens, base_score, score), by looking through all training texts for every context. ``ids``: the ids that decide what is held out, if not those of the rows."""
    import math
    import re
    import zlib
    from collections import Counter

    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    texts = {i: [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower)), "\n"] for i, t in rows}
    named = {i: i if ids is None else ids[i] for i in texts}
    held = {i: zlib.crc32(b"" if named[i] is None else str(named[i]).encode()) % 10 == 0 for i in texts}
    grams: Counter = Counter()
    for i, x in texts.items():
        if not held[i]:
            grams.update(tuple(x[a:b]) for a in range(len(x)) for b in range(a + 1, len(x) + 1))
    once = {g[0]: n for g, n in grams.items() if len(g) == 1}
    total, types = sum(once.values()), len(once)
    out = {}
    for i, x in texts.items():
        p = [(once.get(w, 0) + add) / (total + add * (types + 1)) for w in x]
        score, begin = math.log10(p[0]), 0
        for t in range(1, len(x)):
            while begin < t and not grams[tuple(x[begin:t])]:
                begin += 1
            c, k = (grams[tuple(x[begin:t])], grams[tuple(x[begin : t + 1])]) if begin < t else (0, 0)
            a = weight * max(c, 1) ** growth
            score += math.log10((k + a * p[t]) / (c + a) if c else p[t])
        out[i] = (held[i], len(x), sum(w in once for w in x), total, sum(map(math.log10, p)), score)
    return out
