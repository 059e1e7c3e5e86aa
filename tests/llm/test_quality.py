"""The n-gram model and its scores, against dictionaries."""

import random

import numpy as np
import pytest
from brute import kneser_ney
from pyspark.sql import functions as F

from mixframe.llm import quality


def plain_discounts(of):
    n1, n2, n3, n4 = (of.get(i, 0) for i in (1, 2, 3, 4))
    if not (n1 and n2 and n3 and n4):
        return [0.5, 1.0, 1.5]
    y = n1 / (n1 + 2 * n2)
    return [min(max(d, 0.01), i) for i, d in enumerate((1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3), 1)]


def texts(n, seed):
    random.seed(seed)
    words = ["the", "of", "né", "тест", "a", "word", "ing", "\n", "42"]
    return [" ".join(random.choice(words) for _ in range(random.randrange(1, 60))) for _ in range(n)]


@pytest.mark.parametrize("rows", [quality.SHARD_ROWS, 900])
def test_scores_match_plain_model(spark, rows):
    trusted, asked = texts(60, 1), texts(25, 2) + ["", None, "x", "\x00\x7f unseen ﬂ bytes", "the of " * 30_000, "QQ" * 40]
    models = quality.train(spark.createDataFrame([(t,) for t in trusted + [None, ""]], "text string"))
    logp = kneser_ney([t.encode() for t in trusted], quality.ORDER, plain_discounts)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(asked)], "key bigint, text string").repartition(3)
    found = {r.key: r for r in quality.log_perplexity(docs, models, shard_rows=rows).collect()}
    for i, t in enumerate(asked):
        if t and len(t) < 10_000:
            assert found[i].bytes == len(t.encode()) and found[i].logp == pytest.approx(logp(t.encode()), rel=1e-9)
    assert set(found) == {i for i, t in enumerate(asked) if t}
    assert found[29].bytes == 7 * 30_000


def test_long_texts_in_pieces():
    data = "abcdefghij" * 50
    whole = [g for _, gram, _ in quality._blocks([data], 1 << 20) for g in gram.tolist()]
    cut = [g for _, gram, _ in quality._blocks([data, None, ""], 64) for g in gram.tolist()]
    assert whole == cut and len(whole) == 500


def test_postings_round_trip():
    rng = np.random.default_rng(0)
    both = np.unique(rng.integers(0, 1 << 20, 5000))
    gram, doc, times = both >> 10, both & 1023, rng.integers(1, 700, len(both))
    for d in (doc, doc + 100_000):
        keys, many, docs, n = quality._postings_of(quality._postings(gram, d, times))
        assert np.repeat(keys, many).tolist() == gram.tolist() and docs.tolist() == d.tolist() and n.tolist() == times.tolist()
    empty = quality._postings(gram[:0], doc[:0], times[:0])
    assert [len(x) for x in quality._postings_of(empty)] == [0] * 4


def test_shards_agree(spark):
    grams = [0, 1, 255, 65_535, 4_711]
    rows = spark.createDataFrame([(g,) for g in grams], "g bigint").select(quality._shard_column(F.col("g"), 13)).collect()
    assert [r[0] for r in rows] == quality._shard(np.array(grams), 13).tolist()


def test_thresholds_are_quantiles(spark):
    random.seed(0)
    rows = [(lang, random.random() * (2 if lang == "a" else 5)) for lang in "aab" for _ in range(500)]
    found = {r.lang: r.threshold for r in quality.thresholds(spark.createDataFrame(rows, "lang string, log_perplexity double"), 0.9).collect()}
    for lang, value in found.items():
        own = sorted(v for k, v in rows if k == lang)
        assert 0 <= value - own[int(np.ceil(0.9 * len(own))) - 1] < 1.1 * quality.BIN


def test_classifier_tells_junk(spark):
    rows = [(i, t, "x" if i % 2 else None) for i, t in enumerate(texts(300, 3))]
    rows += [(1000 + i, "#%&/! ~~ 0x" * 9, "x") for i in range(5)] + [(2000, None, "x"), (2001, "", None), (None, "the of word", "new"), (3, rows[3][1], "x")]
    docs = spark.createDataFrame([(*r, 1.0, 0) for r in rows], "doc_id bigint, text string, lang string, threshold double, key int")
    trusted = spark.createDataFrame([(i,) for i in [*range(200), None, 5, 5]], "doc_id bigint")
    found = quality.classify(docs, trusted, F.col("doc_id") % 5 == 0, ["doc_id"], shard_rows=1000).collect()
    assert len(found) == len(rows)
    good = [r.passes for r in found if r.doc_id is not None and r.doc_id < 300]
    assert sum(good) >= 0.9 * len(good)
    assert not any(r.passes for r in found if r.doc_id is not None and r.doc_id >= 1000)
    assert [(r.n_bytes, r.perplexity) for r in found if r.doc_id in (2000, 2001)] == [(0, None)] * 2
    none = quality.classify(docs, trusted.limit(0), F.lit(False), ["doc_id"]).collect()
    assert all(r.perplexity is None or r.perplexity == pytest.approx(256) for r in none)
    assert quality.classify(docs.limit(0), trusted, F.lit(False), ["doc_id"]).collect() == []
