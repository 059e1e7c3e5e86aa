"""Collocations against plain counting."""

import random
import re
from collections import Counter

import pytest

from mixframe.llm import phrases

SCHEMA = "doc_id bigint, text string, lang string"


def brute(rows, min_count, order, share, top):
    n, f = Counter(), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            words = tuple(re.findall("[^\x20\x09]+", piece))
            n[lang] += len(words)
            for m in range(1, order + 1):
                for i in range(len(words) - m + 1):
                    f[lang, words[i : i + m]] += 1
    f = {k: v for k, v in f.items() if v >= min_count}
    out = {}
    for (lang, p), a in f.items():
        longer = [v for (g, q), v in f.items() if g == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
        if len(p) < 2 or any(100 * v >= share * a for v in longer):
            continue
        cuts = [(1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p))]
        score, _, left, right = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), left, right))
    ranked = []
    for lang, found in out.items():
        for i, (score, a, phrase, left, right) in enumerate(sorted(found)[:top]):
            ranked.append((lang, i + 1, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(ranked)


def made(seed, docs=60):
    rng = random.Random(seed)
    words = ["The", "a", "of", "Zé", "\x01x", "a\x00b", "\x00", "new", "york", "city", "ÄB", "b"]
    rows = []
    for i in range(docs):
        said = []
        for _ in range(rng.randrange(60)):
            said += ["new", "York", "city", "hall"] if rng.random() < 0.1 else [rng.choice(words)]
            said.append(rng.choice(["", "", "", ".", "\n", "\t ", "!?"]))
        rows.append((i, " ".join(said), rng.choice(["en", "en", "fr", None, "und"])))
    return rows + [(1, None, "en"), (1, "", "fr"), (None, "a of a of a of", "en"), (5, "a of a of a of", "en")] + rows[:7]


@pytest.mark.parametrize(("least", "order", "share", "top"), [(3, 5, 100, 2000), (2, 3, 60, 20), (4, 5, 100, 5)])
def test_collocations_match_counting(spark, least, order, share, top):
    rows = made(least)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = phrases.collocations(docs, least, order, share, top)
    assert sorted(map(tuple, got.collect())) == brute(rows, least, order, share, top)


def test_small_limits_and_parts_change_nothing(spark, monkeypatch):
    """Words are handed on in pieces, and parts are cut inside the phrases of one first word."""
    monkeypatch.setattr(phrases, "WORD_LIMIT", 5)
    monkeypatch.setattr(phrases, "PLACE_LIMIT", 40)
    monkeypatch.setattr(phrases, "OUT_ROWS", 3)
    rng = random.Random(5)
    rows = [(i, " ".join(["hot", *rng.choices("abcdefghij", k=3), "hot"]), "en") for i in range(400)]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "37")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = phrases.collocations(spark.createDataFrame(rows, SCHEMA).repartition(4), 3)
        assert sorted(map(tuple, got.collect())) == brute(rows, 3, 5, 100, 2000)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_a_full_filter_only_lengthens_windows(spark, monkeypatch):
    monkeypatch.setattr(phrases, "FILTER_BITS", 1 << 10)
    monkeypatch.setattr(phrases, "BITS_PER_WORD", 1)
    rows = [(i, f"w{i % 900} x y w{i % 700}", "en") for i in range(3000)]
    got = phrases.collocations(spark.createDataFrame(rows, SCHEMA), 4)
    assert sorted(map(tuple, got.collect())) == brute(rows, 4, 5, 100, 2000)


def test_empty_tables_long_texts_and_clashing_names(spark):
    assert phrases.collocations(spark.createDataFrame([], SCHEMA), 2).count() == 0
    assert phrases.collocations(spark.createDataFrame([(1, None, None), (2, " .\t", "en")], SCHEMA), 1).count() == 0
    text = "to be or not to be. " * 30_000
    rows = [(1, text, "en", 1, "x", 2, "y", 0, 0)]
    names = "doc_id bigint, text string, lang string, n bigint, phrase string, rank int, parts string, grown int, __part int"
    got = sorted(map(tuple, phrases.collocations(spark.createDataFrame(rows, names), 100).collect()))
    assert got == brute([(1, text, "en")], 100, 5, 100, 2000)


def test_counts_beyond_64_bits_are_exact(spark):
    """1000 a n and l r pass 64 bits."""
    big = 10**12 + 7
    counts = [("en", "a", 3 * big), ("en", "b", 2 * big + 1), ("en", "a\0b", big)]
    totals = spark.createDataFrame([("en", 9 * big + 5)], "lang string, n bigint")
    row = phrases.scored(spark.createDataFrame(counts, "lang string, phrase string, n bigint"), totals).collect()[0]
    assert row.score == 1000 * big * (9 * big + 5) // (3 * big * (2 * big + 1))
