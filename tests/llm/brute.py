"""Brute-force versions of the operators, in plain Python."""

import hashlib
import re
from collections import defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def ascii_lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


class Classes:
    def __init__(self, n):
        self.up = list(range(n))

    def of(self, x):
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a, b):
        self.up[self.of(a)] = self.of(b)


def exact(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[ascii_lower(t)].append(i)
    out = []
    for i, t in rows:
        g = groups[ascii_lower(t)]
        keep = max((x for x in g if x is not None), default=None)
        out.append((i, keep, len(g), keep is not None and i == keep, hashlib.sha256(ascii_lower(t).encode()).hexdigest()))
    return sorted(out, key=repr)


def jaccard(rows, width, num, den):
    sets, inverted = [], defaultdict(list)
    for _, t in rows:
        w = WORD.findall(ascii_lower(t))
        sets.append({tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set())
    for k, s in enumerate(sets):
        for g in s:
            inverted[g].append(k)
    classes, links = Classes(len(rows)), [0] * len(rows)
    for k, s in enumerate(sets):
        common = defaultdict(int)
        for g in s:
            for j in inverted[g]:
                if j > k:
                    common[j] += 1
        for j, n in common.items():
            if rows[k][0] is not None and rows[j][0] is not None and n * den >= (len(s) + len(sets[j]) - n) * num:
                links[k] += 1
                links[j] += 1
                classes.join(k, j)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[classes.of(k)] = min(least.get(classes.of(k), i), i)
    return sorted(((i, len(sets[k]), least[classes.of(k)] if i is not None else None, links[k]) for k, (i, _) in enumerate(rows)), key=repr)


def passages(rows, size):
    words = {i: WORD.findall(ascii_lower(t)) for i, t in rows if i is not None}
    own = defaultdict(set)
    for i, w in words.items():
        for k in range(len(w) - size + 1):
            own[tuple(w[k : k + size])].add(i)
    out = []
    for i, w in words.items():
        held = None
        for k in range(len(w) - size + 1):
            if len(own[tuple(w[k : k + size])]) < 2:
                continue
            if held and k <= held[1]:
                held[1] = k + size
            else:
                if held:
                    out.append((i, held[0], held[1] - held[0]))
                held = [k, k + size]
        if held:
            out.append((i, held[0], held[1] - held[0]))
    return sorted(out)


def vectors(rows, threshold=0.9):
    import numpy as np

    fine = [k for k, (i, v) in enumerate(rows) if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    classes, links = Classes(len(rows)), [0] * len(rows)
    for a in fine:
        for b in fine:
            x, y = rows[a][1], rows[b][1]
            if a < b and len(x) == len(y):
                x, y = np.array(x, float), np.array(y, float)
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold:
                    links[a] += 1
                    links[b] += 1
                    classes.join(a, b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[classes.of(k)] = min(least.get(classes.of(k), i), i)
    return sorted(((i, links[k], least[classes.of(k)] if i is not None else None) for k, (i, _) in enumerate(rows)), key=repr)
