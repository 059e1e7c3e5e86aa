"""The pipeline's stages, each against what it must keep."""

from collections import Counter

import corpus_pipeline as pipeline
from mixframe.llm import mixing, simhash

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_take_effect(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    bench = spark.read.parquet(f"{folder}/benchmark.parquet").collect()
    odd = [(9_000_001, None, "en", "s", 0), (9_000_002, "123", "en", "s", 3), (9_000_003, f"Und so weiter. {bench[0].text}", "en", None, 9), (None, "the and of that is", None, None, 1)]
    docs = docs.unionByName(spark.createDataFrame(odd, docs.schema))
    one = pipeline.language_id(spark, docs, folder)
    rows = one.collect()
    kept = {r.doc_id for r in rows}
    assert one.columns == COLUMNS and not kept & {9_000_001, 9_000_002} and {9_000_003, None} <= kept
    assert len(rows) >= 0.99 * (docs.count() - 2)
    one = spark.createDataFrame(rows, docs.schema)
    two = pipeline.simhash_dedup(spark, one, folder)
    groups = simhash.near_duplicates(one, ["doc_id"]).collect()
    rows = two.collect()
    assert two.columns == COLUMNS and sorted(str(r.doc_id) for r in rows) == sorted({str(r.component_id) for r in groups})
    two = spark.createDataFrame(rows, docs.schema)
    three = pipeline.decontamination(spark, two, folder)
    left = three.collect()
    gone = [r for r in rows if r not in left]
    assert three.columns == COLUMNS and all(any(b.text in r.text for b in bench) for r in gone) and len(gone) > 0
    assert not any(b.text in r.text for b in bench for r in left)
    three = spark.createDataFrame(left, docs.schema)
    four = pipeline.mix(spark, three, folder)
    times = {r.doc_id: r.copies for r in mixing.mix(three, ["doc_id"]).collect() if r.copies}
    mixed = four.collect()
    assert four.columns == COLUMNS and Counter(r.doc_id for r in mixed) == times
    five = pipeline.token_output(spark, spark.createDataFrame(mixed, docs.schema), folder).collect()
    assert Counter(r.doc_id for r in five) == times
    assert sum(r.n_tokens for r in five) == max(r.start + r.n_tokens for r in five)


def test_repeated_ids_and_empty(spark, folder):
    schema = spark.read.parquet(f"{folder}/documents.parquet").schema
    rows = [(1, "alpha beta gamma delta", "en", "a", 1), (1, "alpha beta gamma delta", "en", "a", 1), (1, "quite other words in here", "en", "a", 1), (2, "alpha beta gamma delta", "en", "b", 2)]
    kept = pipeline.simhash_dedup(spark, spark.createDataFrame(rows, schema), folder).collect()
    assert sorted(r.text for r in kept) == [rows[0][1], rows[2][1]]
    rows = [(None, f"{w} only here and nowhere else {w} {w}s", None, None, 1) for w in ("harbour", "meadow", "meadow")]
    kept = pipeline.simhash_dedup(spark, spark.createDataFrame(rows, schema), folder).collect()
    assert sorted(r.text for r in kept) == [rows[0][1], rows[1][1]]
    none = spark.createDataFrame([], schema)
    for _, stage in pipeline.STAGES:
        assert stage(spark, none, folder).collect() == []
