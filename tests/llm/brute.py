"""Plain versions of the operators, for small tables."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def words(text):
    return WORD.findall(text or "")


def quality(text):
    text, w = text or "", words(text)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    twice = {x for x, n in Counter(windows).items() if n > 1}
    repeat = len({i + k for i, x in enumerate(windows) if x in twice for k in range(3)})
    lines = [x for x in text.split("\n") if words(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), repeat


def repeated_bytes(rows, depth=200):
    """[(n_bytes, n_removed, n_spans, sha)] for each row's text."""
    data = [(t or "").encode() for _, t in rows]
    seen = Counter(b[i : i + depth] for b in data for i in range(len(b) - depth + 1))
    out = []
    for b in data:
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - depth + 1):
            if seen[b[i : i + depth]] > 1:
                gone[i : i + depth] = True
        gone = gone[:-1]
        spans = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(gone) else 0
        out.append((len(b), int(gone.sum()), spans, sha(bytes(np.frombuffer(b, np.uint8)[~gone]))))
    return out


def repeated_words(rows, window=13):
    """[(n_words, n_removed, sha)]: windows that a smaller doc_id has too; null ids come last."""
    key = [float("inf") if d is None else d for d, _ in rows]
    first: dict[tuple, float] = {}
    lists = [words(t) for _, t in rows]
    for k, w in zip(key, lists):
        for i in range(len(w) - window + 1):
            x = tuple(w[i : i + window])
            first[x] = min(first.get(x, float("inf")), k)
    out = []
    for k, w in zip(key, lists):
        gone = set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < k:
                gone.update(range(i, i + window))
        out.append((len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone).encode())))
    return out


def common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def similar(a, b, size=5, least=0.8):
    if a == b:
        return True
    x, y = ([tuple(w[i : i + size]) for i in range(len(w) - size + 1)] for w in (a, b))
    bag = sum((Counter(x) & Counter(y)).values())
    if not x or not y or bag < least * (len(x) + len(y) - bag):
        return False
    n = common(x, y)
    return n >= least * (len(x) + len(y) - n) - 1e-9


def near_classes(rows):
    """Index of the class of each row: single links between similar texts."""
    lists = [words(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    shared = defaultdict(list)
    for i, w in enumerate(lists):
        for x in {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or {tuple(w)}:
            shared[x].append(i)
    tried = set()
    for group in shared.values():
        for p, i in enumerate(group):
            for j in group[p + 1 :]:
                if (i, j) not in tried:
                    tried.add((i, j))
                    a, b = find(i), find(j)
                    if a != b and similar(lists[i], lists[j]):
                        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(rows))]
