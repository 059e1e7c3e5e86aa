"""Seeds and alignments, against plain Smith-Waterman over whole texts."""

import random
import re

import numpy as np
import pytest
from brute import smith_waterman

from mixframe.llm import decontaminate as d


def words(n, seed):
    random.seed(seed)
    return [f"w{random.randrange(4000)}" for _ in range(n)]


def edited(item, every, seed):
    random.seed(seed)
    out = []
    for i, w in enumerate(item):
        out += [f"x{random.randrange(99)}"] if i % every == every - 1 else [w, "extra"] if i % 11 == 10 else [w]
    return out


ITEMS = [words(n, n) for n in (30, 45, 60, 20, 25)] + [["one", "two"], []]
BENCH = [(i, " ".join(w)) for i, w in enumerate(ITEMS)] + [(7, None), (None, " ".join(ITEMS[3])), (8, "Ein Über-Satz, ganz: kurz!")]


def docs():
    rows = [" ".join(words(80, 100 + i)) for i in range(30)]
    for i, item in enumerate(ITEMS[:5]):
        rows.append(" ".join(words(50, 200 + i) + item + words(40, 300 + i)))
        rows.append(" ".join(words(50, 210 + i) + edited(item, 5, i) + words(40, 310 + i)).upper())
        rows.append(" ".join(edited(item, 8, i)))
        rows.append(" ".join(words(30, 5) + item[: len(item) // 4] + words(30, 6)))  # a quarter is no copy
    rows += [" ".join(words(20, 7) + ITEMS[0] + ITEMS[1] + words(5000, 8) + ITEMS[0]), "ein ÜBER satz ganz kurz", None, "", "two"]
    return list(enumerate(rows)) + [(5000 + i, " ".join(ITEMS[2])) for i in range(60)] + [(None, " ".join(ITEMS[2]))]


def plain(rows, bench):
    out = {}
    for doc, text in rows:
        said = re.findall(r"\w+", (text or "").lower())
        for item, benchmark in bench:
            asked = re.findall(r"\w+", (benchmark or "").lower())
            if len(asked) >= d.SEED_WORDS and len(said):
                score = smith_waterman(asked, said) / (2 * len(asked))
                if score >= d.THRESHOLD:
                    out[(doc, item)] = score
    return out


@pytest.mark.parametrize("bits", [d.FILTER_BITS, 64])
def test_matches_plain_alignment(spark, bits):
    rows = docs()
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id bigint, text string, item_id int, leaks string").repartition(4)
    bench = spark.createDataFrame([(*b, 2) for b in BENCH], "item_id bigint, text string, score int")
    found = d.with_matches(table.drop("leaks"), bench, filter_bits=bits)
    got = {(r.doc_id, m.item_id): m.score for r in found.collect() for m in r.leaks}
    small = [(i, t) for i, t in rows if t is None or len(t) < 3000]
    want = plain(small, BENCH)
    assert {k: v for k, v in got.items() if k[0] != 50} == pytest.approx(want)
    assert {k[1] for k in got if k[0] == 50} == {0, 1}
    assert found.count() == len(rows) and found.columns == ["doc_id", "text", "item_id", "leaks"]


def test_spans_point_at_the_copy(spark):
    text = " ".join(words(70, 1) + ITEMS[1] + words(9, 2))
    bench = spark.createDataFrame([(None, " ".join(ITEMS[1])), (3, " ".join(ITEMS[1]))], "item_id bigint, text string")
    (row,) = d.with_matches(spark.createDataFrame([(1, text)], "doc_id bigint, text string"), bench).collect()
    assert [tuple(m) for m in row.leaks] == [(i, 1.0, 70, 70 + len(ITEMS[1]), 1) for i in (None, 3)]


def test_rarest_of_each_stretch(spark):
    seeds = spark.createDataFrame([(1, 1, 100 + i, i) for i in range(10)], "one bigint, two bigint, gram bigint, place int")
    counts = spark.createDataFrame([(100 + i, n) for i, n in enumerate([9, 2, 2, 7, 5, 6, 7, 8, 90])], "gram bigint, n bigint")
    found = {r.gram: r.rare for r in d.with_rarity(seeds, counts, 4).collect()}
    assert found == {100 + i: i in (1, 2, 4, 8) for i in range(9)}  # the last n-gram is held by no text


def test_frequent_ngrams_alone_make_no_pair(spark):
    item = " ".join(ITEMS[0][:8])
    bench = spark.createDataFrame([(5, 6, item)], "one bigint, two bigint, text string")
    common, rare, two = " ".join(ITEMS[0][:3]), " ".join(ITEMS[0][1:4]), " ".join(ITEMS[0][4:8])
    texts = [(i, 0, f"{common} n{i}") for i in range(5)] + [(10, 0, f"z {rare}"), (11, 0, f"y y {two}")] + [(12, 0, item)] * 3
    docs = spark.createDataFrame(texts, "one bigint, two bigint, text string")
    found = {r.one: sorted(r.starts) for r in d.shared_places(docs, bench, stretch=2).collect()}
    assert found == {10: [0], 11: [-2], 12: [0]}


def test_align_matches_plain():
    rng = np.random.default_rng(1)
    item, windows = rng.integers(1, 6, 12), rng.integers(1, 6, (20, 30))
    best, _ = d.align(item, windows)
    assert best.tolist() == [smith_waterman(item.tolist(), w.tolist()) for w in windows]


def test_empty(spark):
    none, bench = spark.createDataFrame([], "doc_id bigint, text string"), spark.createDataFrame([], "item_id bigint, text string")
    assert d.with_matches(none, bench).collect() == []
    some = spark.createDataFrame([(1, "a b c")], "doc_id bigint, text string")
    assert [tuple(r) for r in d.with_matches(some, bench).collect()] == [(1, "a b c", [])]
    assert d.with_matches(none, spark.createDataFrame(BENCH, "item_id bigint, text string")).collect() == []


@pytest.mark.parametrize("copies", [11, 1000])
@pytest.mark.parametrize("every", [4, 5, 6])
def test_many_edited_copies_are_found(spark, copies, every):
    broken = " ".join("x" if i % every == every - 1 else w for i, w in enumerate(ITEMS[1]))
    docs = spark.createDataFrame([(n, broken) for n in range(copies)], "doc_id bigint, text string")
    bench = spark.createDataFrame([(1, " ".join(ITEMS[1]))], "item_id bigint, text string")
    found = d.with_matches(docs, bench).collect()
    assert len(found) == copies and all([m.item_id for m in r.leaks] == [1] for r in found)


def test_bound_holds():
    rng = np.random.default_rng(3)
    item, windows = rng.integers(1, 30, 12), rng.integers(0, 60, (200, 30))
    assert (d.most(item, windows) >= d.align(item, windows)[0]).all()
