"""Fingerprints, the trie join and components, against brute force."""

import random

import numpy as np
import xxhash
from brute import groups

from mixframe.llm import simhash
from mixframe.llm.common import components, forest


def plain(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprint():
    for text in (None, "", " \t\n", "One", "One two", "a b c", "É É É é x\u00a0y z", "tie tie " * 4, "w " * 200_000):
        short = text if text is None or len(text) < 1000 else "w " * 300
        if text == short:
            assert simhash.fingerprint(text) == plain(text)
    assert simhash.fingerprint("w " * 200_000) == simhash.fingerprint("w " * 300)


def near(values, budget=2):
    return [(a, b) for i, a in enumerate(values) for b in values[i + 1 :] if (a ^ b).bit_count() <= budget]


def sample(n, seed):
    random.seed(seed)
    base = [random.getrandbits(64) for _ in range(n // 4)]
    values = {b ^ (1 << random.randrange(64)) ^ (random.randrange(3) << random.randrange(62)) for b in base for _ in range(4)}
    return sorted(values | {0, 1, 3, 2**64 - 1, 2**63})


def test_linked_finds_every_pair_once():
    for seed in range(3):
        values = sample(2500, seed)
        a = np.array(values, np.uint64)
        i, j = simhash.linked(a, a, 0)
        assert sorted((values[x], values[y]) for x, y in zip(i, j, strict=True)) == sorted(near(values))
        low, high = [v for v in values if v < 2**63], [v for v in values if v >= 2**63]
        i, j = simhash.linked(np.array(low, np.uint64), np.array(high, np.uint64), 1)
        cross = [(x, y) for x, y in near(values) if x < 2**63 <= y]
        assert sorted((low[x], high[y]) for x, y in zip(i, j, strict=True)) == sorted(cross)


def test_trie_links_with_full_nodes(spark):
    values = sample(600, 5)
    values = sorted(set(values) | {12345678 ^ (1 << b) for b in range(40)} | {v ^ 12345678 for v in range(64)})  # a crowded sub-trie
    signed = [v - 2**64 if v >= 2**63 else v for v in values]
    links = simhash.trie_links(spark.createDataFrame([(v,) for v in signed], "fp bigint"), node_rows=16)
    found = [(r.u % 2**64, r.v % 2**64) for r in links.collect()]
    assert all((u ^ v).bit_count() <= 2 or u in values for u, v in found)
    assert groups(values, found) == groups(values, near(values))


def test_near_duplicates(spark):
    texts = [None, "", " ", "a b c d e f g", "A b c d e f g", "q", "q", "other words entirely here"] + ["same same same text"] * 50
    rows = [(100 - i, t, "x", 1) for i, t in enumerate(texts)] + [(None, "q", "x", 1), (None, "alone is this", "y", 2)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, fp string, component_id int")
    prints = {(r[0], r[1]): plain(r[1]) for r in rows}
    links = near(sorted(set(prints.values())))
    root = groups(sorted(set(prints.values())), links)
    ids = {}
    for (doc, _), p in prints.items():
        ids.setdefault(root[p], []).append(doc)
    first = {k: min((d for d in v if d is not None), default=None) for k, v in ids.items()}
    want = sorted((str(d), p, str(first[root[p]])) for (d, _), p in prints.items())
    found = simhash.near_duplicates(docs, ["doc_id"])
    assert sorted((str(r.doc_id), r.fp % 2**64, str(r.component_id)) for r in found.collect()) == want
    assert simhash.near_duplicates(docs.limit(0), ["doc_id"]).collect() == []


def test_components(spark):
    random.seed(3)
    links = [(i, i + 1) for i in range(0, 300)] + [(1000, 1000 + i) for i in range(1, 300)] + [(2000, 2001), (2001, 2000), (7, 7)]
    links += [(random.randrange(5000, 5400), random.randrange(5000, 5400)) for _ in range(250)]
    found = components(spark.createDataFrame(links, "u bigint, v bigint").repartition(7)).collect()
    linked = [p for p in links if p[0] != p[1]]
    want = groups(sorted({n for p in linked for n in p}), linked)
    by_root = {}
    for r in found:
        by_root.setdefault(r.root, set()).add(r.node)
    plain_sets = {}
    for n, root in want.items():
        plain_sets.setdefault(root, set()).add(n)
    assert sorted(map(sorted, by_root.values())) == sorted(map(sorted, plain_sets.values()))
    assert components(spark.createDataFrame([], "u bigint, v bigint")).collect() == []


def test_forest():
    assert forest(5, np.array([4, 3]), np.array([3, 1])).tolist() == [0, 1, 2, 1, 1]
