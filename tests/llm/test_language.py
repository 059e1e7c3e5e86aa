"""Language prediction: held-out accuracy, rejection, edges."""

import random
import zlib

from pyspark.sql import functions as F

from mixframe.llm import language


def test_held_out_accuracy(spark, folder):
    docs = spark.read.parquet(folder.replace("0.001", "0.01") + "/documents.parquet")
    model = language.fit(language.training_rows(docs))
    found = language.predict(docs, model).withColumn("held", language.held_out()).collect()
    assert {r.doc_id for r in found if r.held} == {r.doc_id for r in found if zlib.crc32(str(r.doc_id).encode()) % 5 == 0}
    tested = [r for r in found if r.held]
    right = sum(r.language.lang_pred == r.lang for r in tested)
    assert len(tested) > 100 and right >= 0.97 * len(tested)
    assert all(0 <= r.language.score <= 1 for r in found)
    assert sum(r.language.rejected for r in found) <= 0.005 * len(found)


def test_rejection_and_edges(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = language.fit(language.training_rows(docs))
    random.seed(2)
    foreign = " ".join("".join(random.choice("абвгдежзиклмнопрстуф") for _ in range(6)) for _ in range(300))
    long = docs.first().text * 200
    rows = [(1, None, "en"), (2, "", "en"), (3, "12 % !\n", "en"), (4, foreign, "en"), (5, long, None), (5, long, None), (None, "de la", "x")]
    found = language.predict(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), model).collect()
    by_id = {r.doc_id: r.language for r in found}
    assert len(found) == 7
    assert all(by_id[i].lang_pred == "und" and by_id[i].score == 0 and by_id[i].rejected for i in (1, 2, 3))
    assert by_id[4].rejected and by_id[4].lang_pred in model.languages and not by_id[5].rejected


def test_nothing_to_learn_from(spark):
    kind = "doc_id bigint, text string, lang string, language string"
    none = spark.createDataFrame([(None, "words here", "en", "x"), (5, "words", None, "x")], kind)
    model = language.fit(language.training_rows(none))
    assert model.languages == []
    assert [tuple(r.language) for r in language.predict(none, model).collect()] == [("und", 0.0, True)] * 2
    assert language.predict(none.where(F.lit(False)), model).collect() == []


def test_a_language_nobody_taught_is_rejected(spark, folder):
    docs = spark.read.parquet(folder.replace("0.001", "0.01") + "/documents.parquet")
    model = language.fit(language.training_rows(docs.where("lang <> 'fr'")))
    found = language.predict(docs, model).select("lang", "language.rejected").collect()
    foreign, known = ([r.rejected for r in found if (r.lang == "fr") == f] for f in (True, False))
    assert len(foreign) > 100 and sum(foreign) >= 0.95 * len(foreign)
    assert sum(known) <= 0.01 * len(known)


def test_copies_do_not_crowd_out_a_language(spark):
    random.seed(4)
    said = {lang: [" ".join(random.choice(words) for _ in range(40)) for _ in range(60)]
            for lang, words in {"xx": ["bolo", "kuma", "tiru", "naso", "weki"], "yy": ["strengt", "plicht", "grumf", "zwecks"]}.items()}
    rows = [(lang, t) for lang, texts in said.items() for t in texts] + [("xx", None)] * 20_000 + [("xx", said["xx"][0] + " kuma")] * 20_000
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(4)
    model = language.fit(docs, sample=20, unseen=10)
    assert {lang: len(h) for lang, h in language.chosen(docs.where("text IS NOT NULL"), 30).items()} == {"xx": 30, "yy": 30}
    wanted = docs.where("text IS NOT NULL").distinct()
    answers = language.predict(wanted, model).collect()
    assert all(r.language.lang_pred == r.lang for r in answers)
    assert sum(r.language.rejected for r in answers) <= 2
