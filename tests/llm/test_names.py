"""Kept columns that have the names of results: every operator keeps both."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from mixframe.llm import decontaminate, language, mixing, quality, secrets, simhash, urls
from mixframe.llm.common import free_name

TEXT = "one two three four five six seven eight nine ten token=abcdefghijklmnop"
KIND = "doc_id bigint, text string, lang string, source string, n_chars bigint"
RESULTS = {
    "mix": ["size", "source_size", "target", "copies", "taken"],
    "simhash": ["fp", "root", "component_id"],
    "secrets": ["blob", *[r.kind for r in secrets.RULES]],
    "urls": ["host", "path", "canonical", "rule", "possible", "listed", "verdict"],
    "quality": ["n_bytes", "perplexity", "threshold", "passes"],
}
EXTRA = [*dict.fromkeys(name for names in RESULTS.values() for name in names), "leaks", "Copies.of"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, TEXT + f" {i % 3}", "en", "s", 5) for i in range(30)] + [(30, None, None, None, None)]
    plain = spark.createDataFrame(rows, KIND).withColumn("url", F.lit("http://a.net/es/x"))
    return plain.select("*", *[F.lit(f"own {name}").alias(name) for name in EXTRA])


def run(name, docs, spark, path):
    if name == "mix":
        return mixing.mix(docs, docs.columns)
    if name == "simhash":
        return simhash.near_duplicates(docs, docs.columns)
    if name == "secrets":
        secrets.scan_new(docs, path)
        return secrets.findings(docs, path, docs.columns)
    if name == "urls":
        listed = spark.createDataFrame([("http://b.net/",)], "canonical string")
        return urls.judge(docs, listed, [urls.Rule("block", "net", "/es/")], docs.columns)
    return quality.classify(docs, docs.select("doc_id"), language.held_out(), docs.columns)


@pytest.mark.parametrize("name", sorted(RESULTS))
def test_kept_columns_and_results_are_both_there(spark, docs, tmp_path, name):
    found = run(name, docs, spark, str(tmp_path / "ledger"))
    assert found.columns == [*docs.columns, *[f"{r}_" for r in RESULTS[name]]]
    rows = found.collect()
    assert len(rows) == 31 and all(r[e] == f"own {e}" for r in rows for e in EXTRA)


def test_matches_beside_a_column_of_their_name(spark, docs):
    benchmark = spark.createDataFrame([(7, "one two three four five six seven eight nine ten")], "item_id bigint, text string")
    rows = decontaminate.with_matches(docs, benchmark).collect()
    assert all(r["leaks"] == "own leaks" and r["Copies.of"] == "own Copies.of" for r in rows)
    assert sum(len(r["leaks_"]) for r in rows) == 30


def test_mix_repeats_rows_with_a_column_named_copies(spark, docs):
    mixed = mixing.mix(docs, docs.columns)
    rows = mixing.repeated(mixed, docs.columns)
    assert rows.columns == docs.columns
    assert rows.count() == mixed.agg(F.sum("copies_")).first()[0]


def test_stages_keep_clashing_columns(spark, docs, folder):
    for stage in (corpus_pipeline.simhash_dedup, corpus_pipeline.decontamination, corpus_pipeline.mix):
        found = stage(spark, docs, folder)
        assert found.columns == docs.columns and found.count() > 0


def test_free_names():
    assert free_name("size", ["a"]) == "size" and free_name("size", ["SIZE", "size_"]) == "size__"
