"""Plain versions of the operators, for small inputs."""

import re
from collections import Counter, defaultdict


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low)


class Groups:
    def __init__(self, n):
        self.up = list(range(n))

    def root(self, i):
        while self.up[i] != i:
            i = self.up[i]
        return i

    def join(self, i, j):
        self.up[self.root(i)] = self.root(j)

    def lowest(self, ids):
        low = {}
        for i, d in enumerate(ids):
            if d is not None:
                r = self.root(i)
                low[r] = min(low.get(r, d), d)
        return [low.get(self.root(i)) for i in range(len(ids))]


def near_duplicates(docs, percent=85):
    sets = []
    for _, text in docs:
        w = words(text)
        sets.append(frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[i : i + 5]) for i in range(len(w) - 4)]))
    groups, holders, first = Groups(len(docs)), defaultdict(list), {}
    for i, s in enumerate(sets):
        if s in first:
            groups.join(i, first[s])
        elif s:
            first[s] = i
            for x in s:
                holders[x].append(i)
    shared = Counter((a, b) for held in holders.values() for k, b in enumerate(held) for a in held[:k])
    for (a, b), n in shared.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            groups.join(a, b)
    low = groups.lowest([d for d, _ in docs])
    return [(d, len(s), c if s else d, d is not None and d == (c if s else d)) for (d, _), s, c in zip(docs, sets, low)]


def passages(docs, size=50):
    texts = [words(t) for _, t in docs]
    holders = defaultdict(set)
    for i, w in enumerate(texts):
        for p in range(len(w) - size + 1):
            holders[tuple(w[p : p + size])].add(i)
    out = set()
    for i, w in enumerate(texts):
        spans = []
        for p in range(len(w) - size + 1):
            if len(holders[tuple(w[p : p + size])]) > 1:
                if spans and p <= spans[-1][1]:
                    spans[-1][1] = p + size
                else:
                    spans.append([p, p + size])
        out |= {(docs[i][0], a, b) for a, b in spans}
    return out
