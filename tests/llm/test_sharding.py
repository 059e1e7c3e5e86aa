"""Shards along the curve: laws, order, pruning, edges."""

import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from mixframe.llm import hilbert, sharding
from mixframe.session import scratch_path

SCHEMA = "doc_id bigint, text string, lang string, source string"


def made(seed, n):
    rng = random.Random(seed)
    rows = [(i, "w " * int(rng.paretovariate(0.8)), rng.choice(["en", "en", "de", None]), f"s{int(rng.paretovariate(1))}") for i in range(n)]
    return rows + [(n + i, "the same text", "en", "hot") for i in range(n // 2)] + [(None, None, None, None), (1, "", "fr", ""), (1, "", "fr", "")]


def cells(values, bits):
    total, before, out = len(values), 0, {}
    for value, n in sorted(Counter(values).items(), key=lambda x: (x[0] is not None, x[0])):
        out[value] = before * (1 << bits) // total
        before += n
    return out


def expected(rows, shards, bits):
    import hashlib

    import numpy as np

    size = [len((t or "").encode()) + 1 for _, t, _, _ in rows]
    classes = [len(bin(s)) - 2 for s in size]
    classes = [b * 32 + (s >> max(b - 5, 0)) for b, s in zip(classes, size, strict=True)]
    columns = [[r[2] for r in rows], [r[3] for r in rows], classes]
    maps = [cells(c, bits) for c in columns]
    curve = hilbert.index(np.array([[m[c[i]] for m, c in zip(maps, columns, strict=True)] for i in range(len(rows))]), bits)
    said = lambda t: (t is not None, hashlib.md5(t.encode()).hexdigest()[:16] if t is not None else "")
    order = sorted(range(len(rows)), key=lambda i: (curve[i], said(rows[i][1]), rows[i][0] is not None, rows[i][0] or 0))
    seen, out = Counter(), []
    for rank, i in enumerate(order):
        shard = rank * shards // len(rows)
        out.append((rows[i][0], rows[i][1], shard, seen[shard]))
        seen[shard] += 1
    return out


def key(row):
    return tuple((x is not None, x) for x in row)


@pytest.mark.parametrize(("n", "shards"), [(300, 8), (40, 3), (2, 8)])
def test_shards_match_a_plain_sort(spark, n, shards):
    rows = made(n, n)
    folder = scratch_path(spark, "shards")
    sharding.write_shards(spark.createDataFrame(rows, SCHEMA).repartition(3), folder, sharding.document_dimensions(), shards=shards)
    out = sharding.read_shards(spark, folder)
    got = out.select("doc_id", "text", "__layout.shard", "__layout.slot").collect()
    assert sorted(map(tuple, got), key=key) == sorted(expected(rows, shards, sharding.BITS), key=key)
    counts = Counter(r.shard for r in got)
    assert max(counts.values()) - min(counts.get(s, 0) for s in range(shards)) <= 1
    one = sharding.read_shards(spark, folder, 1).select("doc_id", "text", "__layout.slot").collect()
    assert sorted(map(tuple, one), key=key) == sorted(((r[0], r[1], r[3]) for r in got if r[2] == 1), key=key)
    runs = spark.read.parquet(f"{folder}/runs")
    assert {r.shard: r.n for r in runs.groupBy("shard").agg(F.sum("rows").alias("n")).collect()} == counts


def test_a_box_reads_only_files_that_meet_it(spark):
    rng = random.Random(1)
    rows = [(i, "w " * rng.randrange(1, 3000), rng.choice(["de", "en", "es", "fr"]), f"s{rng.randrange(16):02}") for i in range(4000)]
    folder = scratch_path(spark, "shards")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sharding.write_shards(spark.createDataFrame(rows, SCHEMA).repartition(4), folder, sharding.document_dimensions())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = spark.read.parquet(f"{folder}/runs").select("path").distinct().count()
    small, large = ((len(f"{'w ' * n}") + 1) for n in (100, 400))
    low, high = (len(bin(s)) - 2 for s in (small, large))
    box = {"source": ("s03", "s04"), "size": (low * 32 + (small >> (low - 5)), high * 32 + (large >> (high - 5)))}
    found = sharding.read_box(spark, folder, box)
    inside = lambda t: box["size"][0] <= (b := len(bin(len(t) + 1)) - 2) * 32 + ((len(t) + 1) >> max(b - 5, 0)) <= box["size"][1]
    assert sorted(r.doc_id for r in found.collect()) == sorted(r[0] for r in rows if r[3] in ("s03", "s04") and inside(r[1]))
    assert len(found.inputFiles()) < files / 3
    assert sharding.read_box(spark, folder, {"lang": ("x", "z")}).count() == 0


def test_clashing_names_empty_tables_long_texts_and_no_python(spark):
    names = SCHEMA + ", curve int, `values` string, `row` int, shard int, part int, `a.b` int, path string"
    long = "ß" * 3_000_000
    rows = [(i, long if i == 3 else "x", "en", "s", 1, "v", 2, 3, 4, 5, "p") for i in range(20)]
    folder = scratch_path(spark, "shards")
    sharding.write_shards(spark.createDataFrame(rows, names), folder, sharding.document_dimensions())
    out = sharding.read_shards(spark, folder)
    assert sorted(tuple(r[:-1]) for r in out.collect()) == sorted(rows)
    digest = out.select(sharding.size_of(F.col("text")).alias("n"), F.crc32("text").alias("c")).orderBy(F.desc("n")).first()
    assert tuple(digest) == (6_000_001, zlib.crc32(long.encode()))
    plan = out._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    with pytest.raises(ValueError, match="reserved"):
        sharding.write_shards(spark.createDataFrame([(1, "", "", "", 1)], SCHEMA + ", __layout int"), folder, sharding.document_dimensions())
    folder = scratch_path(spark, "shards")
    sharding.write_shards(spark.createDataFrame([], SCHEMA), folder, sharding.document_dimensions())
    assert sharding.read_shards(spark, folder).count() == 0 and sharding.read_shards(spark, folder, 2).count() == 0
