"""Plain definitions of what the operators return, over rows in memory."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

LETTERS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
VISIBLE = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


class Union:
    def __init__(self):
        self.parent = {}

    def find(self, x):
        self.parent.setdefault(x, x)
        while self.parent[x] != x:
            x = self.parent[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.parent[max(a, b)] = min(a, b)


def removed_bytes(docs, length):
    """docs: (id, text) in document order."""
    seen, out = set(), {}
    for key, text in docs:
        raw = (text or "").encode()
        covered = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            window = raw[i : i + length]
            if window in seen:
                covered[i : i + length] = b"\1" * length
            seen.add(window)
        kept = bytes(b for b, c in zip(raw, covered) if not c)
        out[key] = (len(raw), sum(covered), len(re.findall(b"\1+", bytes(covered))), hashlib.sha256(kept).hexdigest())
    return out


def shingles(text, size=5):
    words = VISIBLE.findall(lower(text))
    if len(words) < size:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + size]) for i in range(len(words) - size + 1))


def jaccard_components(docs, percent=80):
    sets = {k: shingles(t) for k, t in docs}
    owners, union = defaultdict(list), Union()
    for k, s in sets.items():
        shared = defaultdict(int)
        for x in s:
            for o in owners[x]:
                shared[o] += 1
            owners[x].append(k)
        for o, n in shared.items():
            if 100 * n >= percent * (len(s) + len(sets[o]) - n):
                union.join(k, o)
    return {k: (len(s), union.find(k)) for k, s in sets.items()}


def contamination(docs, items, window=10):
    patterns = defaultdict(set)
    for item, text in items:
        words = LETTERS.findall(lower(text))
        size = min(window, len(words))
        for i in range(len(words) - size + 1 if size else 0):
            patterns[tuple(words[i : i + size])].add("" if item is None else str(item))
    sizes = {len(p) for p in patterns}
    out = []
    for key, text in docs:
        words, hit, found = LETTERS.findall(lower(text)), set(), set()
        for size in sizes:
            for i in range(len(words) - size + 1):
                owners = patterns.get(tuple(words[i : i + size]))
                if owners:
                    hit.update(range(i, i + size))
                    found |= owners
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((key, len(words), len(hit), len(found), digest, bool(hit)))
    return out


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def removed_lines(docs, simhash, edits, distance, similarity, least_words):
    places = defaultdict(list)
    for key, text in docs:
        for i, line in enumerate((text or "").split("\n")):
            words = LETTERS.findall(lower(line))
            if words:
                places[" ".join(words)].append((key, i))
    lines, union = list(places), Union()
    hashes = [simhash(x) if x.count(" ") + 1 >= least_words else None for x in lines]
    for i, a in enumerate(lines):
        for j in range(i):
            b = lines[j]
            if None in (hashes[i], hashes[j]) or (hashes[i] ^ hashes[j]).bit_count() > distance:
                continue
            if 1 - edits(a, b) / max(len(a), len(b)) >= similarity:
                union.join(i, j)
    groups = defaultdict(list)
    for i, line in enumerate(lines):
        groups[union.find(i)] += places[line]
    out = defaultdict(list)
    for members in groups.values():
        for key, i in sorted(members)[1:]:
            out[key].append(i)
    return {k: sorted(v) for k, v in out.items()}


def cosine_links(vectors, least):
    """vectors: (id, label, list or None)."""
    import numpy as np

    rows = [(k, label, np.array(v, float)) for k, label, v in vectors if v and label is not None and None not in v]
    rows = [(k, label, v) for k, label, v in rows if np.isfinite(v).all() and v.any()]
    links, union = defaultdict(int), Union()
    for i, (a, la, x) in enumerate(rows):
        for b, lb, y in rows[:i]:
            if la == lb and len(x) == len(y) and x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= least:
                links[a] += 1
                links[b] += 1
                union.join(a, b)
    return {k: (links[k], union.find(k)) for k, _, _ in vectors}
