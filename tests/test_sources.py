import pytest
from pyspark.sql import types as T

from mixframe.catalog.tables import column, embeddings_config, events_config, lines_config
from mixframe.config import FeatureSpec, TableConfig, schema_from_config
from mixframe.sources import dataset, dataset_or_fallback, densify, select_roles, split_labels

CONFIG = {
    "idCols": ["id"],
    "labelCols": ["label"],
    "exceptCols": ["skip"],
    "noExportCols": ["b"],
    "featureColumns": [
        column("id", "INTEGER"),
        column("label", "INTEGER"),
        column("skip", "FLOAT"),
        column("b", "FLOAT"),
        column("a", "FLOAT", [2]),
        column("word", "STRING", kind="fcVocabIndicator", vocabulary=["x"]),
    ],
    "modelType": "m",
    "modelParam": {"m": {"gamma": 0.1}},
}


def config(**paths):
    return TableConfig.from_dict({**CONFIG, "dataSource": {**paths, "numTrain": 3}})


def rows(spark):
    return spark.createDataFrame([(1, 0, 1.5, [1.0, 2.0], "x"), (2, 1, None, [3.0, 4.0], None)],
                                 "id long, label long, b float, a array<float>, word string")


def test_roles_are_sorted_and_disjoint():
    c = config()
    assert c.features == ["a", "b", "word"]
    assert c.names("export") == ["a", "word", "id"]
    assert c.names("no_export") == ["b"]
    assert c.params == {"gamma": 0.1}
    with pytest.raises(ValueError):
        c.names("other")


def test_schema(spark):
    assert schema_from_config(config()) == T.StructType.fromDDL(
        "a array<float>, b float, word string, label bigint, id bigint"
    )


@pytest.mark.parametrize(
    "bad",
    [
        column("a", "DECIMAL"),
        column("a", "FLOAT", kind="fcOther"),
        column("a", "STRING", kind="fcVocabIndicator"),
        column("a", "STRING", kind="fcHashEmbedding", hashSize=3),
    ],
)
def test_bad_columns_are_refused(bad):
    with pytest.raises(ValueError):
        FeatureSpec.from_dict(bad)


def test_fixed_limits():
    spec = FeatureSpec.from_dict(column("core_user_id", "STRING", kind="fcHashEmbedding", hashSize=99999, embeddingSize=3))
    assert (spec.buckets, spec.embedding_size) == (10000, 64)


@pytest.mark.parametrize("fmt", ["parquet", "orc", "json"])
def test_formats_round_trip(spark, tmp_path, fmt):
    path = str(tmp_path / "train")
    rows(spark).write.format(fmt).save(path)
    found = dataset(spark, config(train=path), "train", fmt).orderBy("id").collect()
    assert [(r.id, r.label, r.b, r.a, r.word) for r in found] == [(1, 0, 1.5, [1.0, 2.0], "x"), (2, 1, None, [3.0, 4.0], None)]


def test_csv_reads_json_arrays(spark, tmp_path):
    path = str(tmp_path / "train")
    rows(spark).selectExpr("id", "label", "b", "to_json(a) a", "word").write.option("header", True).csv(path)
    found = dataset(spark, config(train=path), "train", "csv").orderBy("id").collect()
    assert [r.a for r in found] == [[1.0, 2.0], [3.0, 4.0]]


def test_hidden_files_are_skipped_and_empty_split_falls_back(spark, tmp_path):
    train, empty = tmp_path / "train", tmp_path / "eval"
    rows(spark).write.parquet(str(train))
    empty.mkdir()
    (empty / ".hidden").write_text("not a table")
    c = config(train=str(train), eval=str(empty))
    assert dataset(spark, c, "eval").count() == 0
    assert dataset_or_fallback(spark, c, "eval").count() == 2
    assert dataset_or_fallback(spark, c, "test").count() == 2


def test_bad_splits_and_formats(spark, folder):
    with pytest.raises(ValueError):
        dataset(spark, config(train="x"), "dev")
    with pytest.raises(ValueError):
        dataset(spark, config(), "train")
    with pytest.raises(ValueError):
        dataset(spark, events_config(folder), "train", "xml")


def test_only_declared_columns_are_read(spark, folder):
    plan = dataset(spark, lines_config(folder), "train")._jdf.queryExecution().executedPlan().toString()
    assert "l_shipdate" not in plan and "l_tax" not in plan


def test_split_labels(spark, folder):
    c = embeddings_config(folder)
    features, labels = split_labels(dataset(spark, c, "train"), c)
    assert features.columns == ["vec_id", "embedding"] and labels.columns == ["vec_id", "label"]
    assert select_roles(dataset(spark, c, "train"), c, "export").columns == ["embedding", "vec_id"]


def test_densify(spark):
    df = spark.createDataFrame([(None, None, [None, "a"], [None, 2])], "s string, n double, l array<string>, m array<int>")
    assert list(densify(df).first()) == ["__unknown__", 0.0, ["__unknown__", "a"], [0, 2]]
    assert list(densify(df, ["n"]).first())[0] is None
