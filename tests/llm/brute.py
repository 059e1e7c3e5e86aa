"""Plain versions of what the operators compute, for small inputs."""

from __future__ import annotations

import math
from collections import Counter, defaultdict


def groups(nodes: list, links: list[tuple]) -> dict:
    """The smallest node that each node reaches."""
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def smith_waterman(item: list, text: list, match=2, mismatch=-1, gap=-1) -> int:
    above, best = [0] * (len(text) + 1), 0
    for w in item:
        row = [0]
        for j, t in enumerate(text):
            row.append(max(0, above[j] + (match if w == t else mismatch), above[j + 1] + gap, row[j] + gap))
        best, above = max(best, *row), row
    return best


def kneser_ney(trusted: list[bytes], order: int, discounts) -> callable:
    """Log-probability function of a modified Kneser-Ney model over bytes with ``order - 1`` start bytes."""
    counts: dict[int, Counter] = {order: Counter()}
    for text in trusted:
        data = b"\xff" * (order - 1) + text if text else b""
        counts[order].update(data[i : i + order] for i in range(len(data) - order + 1))
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    tables = {}
    for k in range(1, order + 1):
        d = discounts(Counter(counts[k].values()))
        by = defaultdict(list)
        for g, n in counts[k].items():
            by[g[:-1]].append(n)
        left = lambda n, d=d: d[min(n, 3) - 1]
        tables[k] = (counts[k], {c: (sum(ns), sum(left(n) for n in ns)) for c, ns in by.items()}, left)

    def p(gram: bytes) -> float:
        if not gram:
            return 1 / 256
        n, context, left = tables[len(gram)]
        if gram[:-1] not in context:
            return p(gram[1:])
        total, freed = context[gram[:-1]]
        own = max(n[gram] - left(n[gram]), 0) if gram in n else 0
        return own / total + freed / total * p(gram[1:])

    def logp(text: bytes) -> float:
        data = b"\xff" * (order - 1) + text
        return sum(math.log(p(data[i : i + order])) for i in range(len(text)))

    return logp
