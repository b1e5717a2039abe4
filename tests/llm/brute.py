"""Plain re-computations, without Spark and without the operators' methods."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

BLANK = "[\x20\x09-\x0d]+"


def words(text):
    return [w for w in re.split(BLANK, text or "") if w]


def union_find(vertices, edges):
    parent = {v: v for v in vertices}

    def root(v):
        while parent[v] != v:
            parent[v] = parent[parent[v]]
            v = parent[v]
        return v

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return {v: root(v) for v in vertices}


def base_counts(text):
    text = text or ""
    own = words(text)
    lines = [x for x in text.split("\n") if words(x)]
    windows = [tuple(own[i : i + 3]) for i in range(len(own) - 2)]
    often = Counter(windows)
    inside = {i + j for i, w in enumerate(windows) if often[w] > 1 for j in range(3)}
    n = len(own)
    failed = n < 50 or 100 * len(inside) > 50 * n
    return (
        n,
        sum(map(len, own)),
        len(re.findall(r"[#*$%&|<>]", text)),
        len(lines) - len(set(lines)),
        len(inside),
        failed,
    )


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def contamination(docs, items):
    """Per (doc_id, text): n_words, n_hit, sorted item ids."""
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(t))
    spots = defaultdict(set)
    sizes = set()
    for item, text in items:
        own = split(text)
        k = min(10, len(own))
        if own:
            sizes.add(k)
            for i in range(len(own) - k + 1):
                spots[tuple(own[i : i + k])].add(item)
    out = []
    for doc, text in docs:
        own, hit, found = split(text), set(), set()
        for k in sizes:
            for i in range(len(own) - k + 1):
                if (w := tuple(own[i : i + k])) in spots:
                    hit |= set(range(i, i + k))
                    found |= spots[w]
        ids = sorted(str(x) for x in found if x is not None)
        digest = hashlib.sha256(",".join(ids).encode()).hexdigest()
        out.append((doc, len(own), len(hit), len(found), digest, bool(hit)))
    return out


def fingerprint(text):
    import xxhash

    own = words(lowered(text))
    shingles = [" ".join(own[i : i + 4]) for i in range(max(1, len(own) - 3))] if own else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near(prints, distance):
    """Components of fingerprints, by comparing every one with all others."""
    import numpy as np

    distinct = np.array(sorted(set(prints)), dtype=np.uint64)
    edges = []
    for i, p in enumerate(distinct):
        for j in np.flatnonzero(np.bitwise_count(distinct[i + 1 :] ^ p) <= distance):
            edges.append((int(p), int(distinct[i + 1 + j])))
    return union_find([int(p) for p in distinct], edges)


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def personal(text):
    out = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": lambda: True,
                "ip": lambda: all(int(p) <= 255 for p in m[0].split(".")),
                "card": lambda: 14 <= len(digits) <= 19 and luhn(digits),
                "phone": lambda: 10 <= len(digits) <= 15,
            }[kind]()
            if good:
                out.append((m.start(), k, m.end(), kind))
    return sorted(out)


def passages(docs, length=50):
    """(doc_id, start, end) of stretches of repeated passages."""
    seen = Counter()
    split = [(d, words(t)) for d, t in docs]
    for _, own in split:
        for i in range(len(own) - length + 1):
            seen[tuple(own[i : i + length])] += 1
    out = []
    for d, own in split:
        run = None
        for i in range(len(own) - length + 1):
            if seen[tuple(own[i : i + length])] > 1:
                if run and i <= run[1]:
                    run[1] = i + length
                else:
                    if run:
                        out.append((d, *run))
                    run = [i, i + length]
        if run:
            out.append((d, *run))
    return sorted(out, key=str)
