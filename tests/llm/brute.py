"""Plain programs that the operators are held against."""

import re
from collections import defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def shingle_set(text):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return set()
    k = min(5, len(w))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def near_groups(rows):
    """(doc_id, text) -> smallest reachable id of each row with an id."""
    sets = [(d, shingle_set(t)) for d, t in rows]
    root = {d: d for d, _ in sets if d is not None}
    where = defaultdict(set)
    for i, (_, s) in enumerate(sets):
        for g in s:
            where[g].add(i)
    pairs = {(i, j) for own in where.values() for i in own for j in own if i < j}
    links = []
    for i, j in pairs:
        (a, s), (b, t) = sets[i], sets[j]
        if None not in (a, b) and 100 * len(s & t) >= 75 * len(s | t):
            links.append((a, b))
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(root[a], root[b])
            if root[a] != low or root[b] != low:
                root[a] = root[b] = low
                changed = True
    return root


def word_repeats(rows, length):
    """Indexes of removed words per row."""
    first = {}
    cut = [words(t) for _, t in rows]
    for (d, _), w in zip(rows, cut):
        for i in range(len(w) - length + 1):
            if d is not None:
                key = tuple(w[i : i + length])
                first[key] = min(first.get(key, d), d)
    gone = []
    for (d, _), w in zip(rows, cut):
        own = set()
        for i in range(len(w) - length + 1):
            if d is not None and first[tuple(w[i : i + length])] < d:
                own.update(range(i, i + length))
        gone.append(own)
    return cut, gone


def byte_repeats(rows, length):
    """Mask of removed bytes per row."""
    first = {}
    for d, b in rows:
        if d is not None:
            for i in range(len(b) - length + 1):
                key = b[i : i + length]
                first[key] = min(first.get(key, (d, i)), (d, i))
    masks = []
    for d, b in rows:
        mask = [False] * len(b)
        last = 0
        if d is not None:
            for i in range(len(b) - length + 1):
                if first[b[i : i + length]] < (d, i):
                    for j in range(max(i, last), i + length):
                        mask[j] = True
                    last = i + length
        masks.append(mask)
    return masks
