"""Results by direct comparison, for tests."""

from __future__ import annotations

import hashlib
import re


def jaccard(docs: list[tuple], size: int = 5, percent: int = 80) -> list[tuple]:
    """The rows by comparing all pairs, for tests: docs are (id, text)."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for _, text in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(lower))
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    least = [i for i, _ in docs]
    changed = True
    linked = [(a, b) for a in range(len(docs)) for b in range(a) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in linked:
            m = min((x for x in (least[a], least[b]) if x is not None), default=None)
            if least[a] != m or least[b] != m:
                least[a] = least[b] = m
                changed = True
    return [(i, len(s), m) for (i, _), s, m in zip(docs, sets, least, strict=True)]


def contamination(docs: list[tuple], items: list[tuple], window: int = 10) -> list[tuple]:
    """The report's rows by direct comparison, for tests: docs and items are (id, text)."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    cut_words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(lower))
    tests = [(None if i is None else str(i), cut_words(t)) for i, t in items]
    out = []
    for doc_id, text in docs:
        w, hit, names = cut_words(text), set(), set()
        for name, x in tests:
            k = min(window, len(x))
            grams = {tuple(x[i : i + k]) for i in range(len(x) - k + 1)} if k else set()
            for i in range(len(w) - k + 1 if k else 0):
                if tuple(w[i : i + k]) in grams:
                    hit |= set(range(i, i + k))
                    names.add(name)
        out.append((doc_id, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(x for x in names if x is not None)).encode()).hexdigest(), bool(hit)))
    return out
