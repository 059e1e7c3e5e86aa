"""Targets and systematic samples, against plain Python."""

import hashlib
import math
import re

import pytest
from pyspark.sql import functions as F

from mixframe.llm import mixing


def plain(rows, weights=(1, 2, 3), cap=3, seed=7):
    sized = [(d, s, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for d, t, s in rows]
    sources = sorted({s for _, s, _ in sized}, key=lambda s: (s is None, s or ""))
    size = {s: sum(n for _, x, n in sized if x == s) for s in sources}
    weight = {s: weights[k % len(weights)] for k, s in enumerate(sources)}
    total, capped = sum(size.values()), set()
    while True:
        free = [s for s in sources if s not in capped]
        level = (total - sum(cap * size[s] for s in capped)) / sum(weight[s] for s in free) if free else 0
        over = {s for s in free if level * weight[s] > cap * size[s]}
        if not over:
            break
        capped |= over
    target = {s: cap * size[s] if s in capped else level * weight[s] for s in sources}
    out = []
    for s in sources:
        share = math.floor(target[s] / size[s] * 2**32) if size[s] else 0
        text = f"{seed}:" + ("" if s is None else f"s{s}")
        upto = int(hashlib.md5(text.encode()).hexdigest()[:8], 16)
        for d, _, n in sorted((r for r in sized if r[1] == s), key=lambda r: (r[2], hashlib.md5(f"{seed}:{r[0] if r[0] is not None else ''}".encode()).hexdigest())):
            copies, upto = ((upto + share) >> 32) - (upto >> 32), upto + share
            out.append((d, n, size[s], pytest.approx(target[s]), copies * n))
    return out, target


ROWS = [(i, "word " * (i % 37), f"s{i % 3}") for i in range(400)] + [(1000 + i, "many\tmore\u00a0words " * 300, "hot") for i in range(500)]
ROWS += [(2000, None, None), (2001, "a b", None), (None, "x y z", "s1"), (2002, "", "empty"), (3000, "w " * 100_000, "s2")]
KIND = "doc_id bigint, text string, source string"


def key(row):
    return tuple((v is None, str(v)) for v in (row[0], row[1], row[2], row[4]))


def test_mix_matches_plain_version(spark):
    docs = spark.createDataFrame(ROWS, KIND).repartition(5)
    want, target = plain(ROWS)
    found = [tuple(r)[:4] + (r.taken,) for r in mixing.mix(docs, ["doc_id"]).collect()]
    assert sorted(found, key=key) == sorted(want, key=key)
    again = [tuple(r)[:4] + (r.taken,) for r in mixing.mix(docs.repartition(3), ["doc_id"]).collect()]
    assert sorted(again, key=key) == sorted(found, key=key)
    assert sum(target.values()) == pytest.approx(sum(r[1] for r in want))
    taken = sum(r[4] for r in want if r[0] is not None and 1000 <= r[0] < 2000)
    assert taken == pytest.approx(target["hot"], rel=0.02)


def test_repeated_rows_and_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a b", "s", 9, 8), (1, "a b", "s", 9, 8)] * 30, f"{KIND}, size int, copies int")
    mixed = mixing.mix(docs.drop("size", "copies"), ["doc_id", "text", "source"])
    rows = mixing.repeated(mixed, ["doc_id", "text", "source"]).collect()
    assert len(rows) == sum(r.copies for r in mixed.collect()) == 60
    assert {tuple(r) for r in rows} == {(1, "a b", "s")}


def test_empty(spark):
    assert mixing.mix(spark.createDataFrame([], KIND), ["doc_id"]).collect() == []
    blank = mixing.mix(spark.createDataFrame([(1, None, "s"), (2, " ", None)], KIND), ["doc_id"]).collect()
    assert [(r.size, r.target, r.taken) for r in blank] == [(0, 0.0, 0)] * 2


def test_copies_far_along_a_source(spark):
    """Positions that would make the prefix sum pass 64 bits."""
    import random

    rng = random.Random(3)
    rows = [(rng.randrange(1 << bits), rng.randrange(3 << 32), rng.randrange(1 << 32)) for bits in (1, 20, 33, 34, 50) for _ in range(40)]
    rows += [(10**10, 3 << 32, (1 << 32) - 1), (8 * 10**8, 3 << 32, 0), (0, 0, 0)]
    frame = spark.createDataFrame(rows, "p bigint, s bigint, o bigint")
    for r in frame.withColumn("copies", mixing.copies_at(F.col("p"), F.col("s"), F.col("o"))).collect():
        assert r.copies == (((r.p + 1) * r.s + r.o) >> 32) - ((r.p * r.s + r.o) >> 32)
