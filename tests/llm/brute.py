"""Plain versions of the operators, for small tables."""

from __future__ import annotations

import re
from collections import defaultdict

_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


class Sets:
    def __init__(self, keys):
        self.up = {k: k for k in keys}

    def find(self, k):
        while self.up[k] != k:
            self.up[k] = self.up[self.up[k]]
            k = self.up[k]
        return k

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def shingle_set(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(_LOWER))
    if len(words) < width:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[k : k + width]) for k in range(len(words) - width + 1))


def jaccard_groups(rows, width=4, numerator=85, denominator=100):
    sets = {i: shingle_set(t, width) for i, t in rows}
    groups, ids = Sets(sets), sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[:x]:
            both = len(sets[i] & sets[j])
            if both and denominator * both >= numerator * len(sets[i] | sets[j]):
                groups.join(i, j)
    return {i: (len(s), groups.find(i)) for i, s in sets.items()}


def passage_hits(text, items, window=10):
    """(words, hit words, item ids) of one text."""
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    words = re.findall(pattern, (text or "").translate(_LOWER))
    hit, names = set(), set()
    for name, item in items:
        own = re.findall(pattern, (item or "").translate(_LOWER))
        if not own:
            continue
        size = min(window, len(own))
        windows = {tuple(own[k : k + size]) for k in range(len(own) - size + 1)}
        for k in range(len(words) - size + 1):
            if tuple(words[k : k + size]) in windows:
                hit.update(range(k, k + size))
                names.add(name)
    return len(words), len(hit), names


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def repeated_lines(rows, most=2, least=20):
    at, different = [], {}
    for doc, text in sorted((d, t or "") for d, t in rows):
        for number, line in enumerate(text.split("\n")):
            line = line.strip()
            if len(line) >= least:
                at.append((doc, number, different.setdefault(line, len(different))))
    lines, groups = list(different), Sets(range(len(different)))
    for i in range(len(lines)):
        for j in range(i):
            if abs(len(lines[i]) - len(lines[j])) <= most and edit_distance(lines[i], lines[j]) <= most:
                groups.join(i, j)
    seen, out = set(), defaultdict(set)
    for doc, number, line in at:
        group = groups.find(line)
        if group in seen:
            out[doc].add(number)
        seen.add(group)
    return {d: sorted(v) for d, v in out.items()}


def greedy_pieces(text: bytes, vocabulary: set[bytes]) -> int:
    count = 0
    while text:
        size = next((k for k in range(len(text), 0, -1) if text[:k] in vocabulary), 0)
        if not size:
            return 1
        text, count = text[size:], count + 1
    return count
