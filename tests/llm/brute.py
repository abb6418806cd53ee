"""Plain re-statements of the contracts, for small tables."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def shingles(text, n):
    words = WORD.findall((text or "").translate(LOWER))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1)))


def near(rows, n, percent=80):
    """doc_id -> (set size, component, kept) for rows of distinct ids."""
    sets = {i: shingles(t, n) for i, t in rows}
    ids, size = sorted(sets), {i: len(s) for i, s in sets.items()}
    links = []
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            if 100 * min(size[a], size[b]) < percent * max(size[a], size[b]):
                continue  # the union alone is too large
            common = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                links.append((a, b))
    root = roots(ids, links)
    return {i: (len(sets[i]), root[i], root[i] == i) for i in ids}


def substrings(rows, window):
    """doc_id -> (words, removed, sha256 of what stays) for rows of distinct ids."""
    words = {i: WORD.findall(t or "") for i, t in rows}
    first = {}
    for i in sorted(words):
        for at in range(len(words[i]) - window + 1):
            first.setdefault(tuple(words[i][at : at + window]), i)
    out = {}
    for i, w in words.items():
        gone = set()
        for at in range(len(w) - window + 1):
            if first[tuple(w[at : at + window])] < i:
                gone |= set(range(at, at + window))
        stay = " ".join(x for k, x in enumerate(w) if k not in gone)
        out[i] = len(w), len(gone), hashlib.sha256(stay.encode()).hexdigest()
    return out


def edit_distance_within(pattern, text):
    """Least edit distance of the pattern to any part of the text, by the full table, column after column of the pattern."""
    import numpy as np

    codes = np.array([ord(c) for c in text], np.int64)
    row = np.zeros(len(text) + 1, np.int64)
    place = np.arange(len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = np.minimum(np.concatenate([[i], row[:-1] + (codes != ord(p))]), np.concatenate([[i], row[1:] + 1]))
        row = np.minimum.accumulate(new - place) + place  # steps along the text cost one each
    return int(row.min())


def linked_vectors(rows, threshold):
    """(vec_id, vector, label) rows of distinct ids -> vec_id: (links, component)."""
    import numpy as np

    links, count = [], defaultdict(int)
    for x, (i, v, label) in enumerate(rows):
        for j, w, other in rows[x + 1 :]:
            if label is None or label != other or not v or not w or len(v) != len(w):
                continue
            a, b = np.array([np.nan if y is None else y for y in v], float), np.array([np.nan if y is None else y for y in w], float)
            if not np.isfinite(a).all() or not np.isfinite(b).all() or not a.any() or not b.any():
                continue
            if a @ b / np.sqrt((a @ a) * (b @ b)) >= threshold:
                links.append((i, j))
                count[i] += 1
                count[j] += 1
    root = roots([r[0] for r in rows], links)
    return {r[0]: (count[r[0]], root[r[0]]) for r in rows}
