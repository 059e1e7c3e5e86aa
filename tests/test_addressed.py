"""Prediction files addressed by position."""

import os

import pytest
from pyspark.sql import functions as F

from mixframe.sinks import addressed

SCHEMA = "id bigint, name string"


def _rows(spark, n):
    return spark.range(n).select((F.col("id") * 3 + 5).alias("id"), F.concat(F.lit('a "b", '), F.col("id")).alias("name")).orderBy(F.rand(1))


@pytest.mark.parametrize("fmt", ["json", "csv", "text"])
def test_a_position_is_read_from_one_file(spark, tmp_path, fmt):
    path = str(tmp_path / "out")
    assert addressed.write_addressed(_rows(spark, 95), path, ["id"], fmt, rows_per_file=10) == 95
    found = addressed.records(spark, path, SCHEMA, 37, fmt=fmt)
    assert len(found.inputFiles()) == 1
    assert [tuple(r) for r in found.collect()] == [(37 * 3 + 5, 'a "b", 37', 37)]
    some = addressed.records(spark, path, SCHEMA, 28, 31, fmt)
    assert len(some.inputFiles()) == 2
    assert sorted(r["id"] for r in some.collect()) == [i * 3 + 5 for i in range(28, 32)]
    assert addressed.records(spark, path, SCHEMA, 95, fmt=fmt).count() == 0


def test_manifest_and_files(spark, tmp_path):
    path = str(tmp_path / "out")
    addressed.write_addressed(_rows(spark, 95), path, ["id"], rows_per_file=10)
    listed = [tuple(r) for r in addressed.manifest(spark, path).orderBy("file_number").collect()]
    assert listed == [(k, k * 10, min(k * 10 + 10, 95) - 1, min(10, 95 - k * 10)) for k in range(10)]
    for k in range(10):
        files = [f for f in os.listdir(f"{path}/file_number={k}") if f.startswith("part-")]
        assert len(files) == 1


def test_composite_repeated_and_null_ids(spark, tmp_path):
    path = str(tmp_path / "out")
    rows = spark.createDataFrame([(None, "x"), (1, "b"), (1, "b"), (1, None), (0, "z")], SCHEMA)
    assert addressed.write_addressed(rows, path, ["id", "name"], rows_per_file=2) == 5
    back = addressed.records(spark, path, SCHEMA, 0, 4).orderBy("position").collect()
    assert [(r["id"], r["name"]) for r in back] == [(None, "x"), (0, "z"), (1, None), (1, "b"), (1, "b")]


def test_empty_clash_and_format(spark, tmp_path):
    path = str(tmp_path / "out")
    assert addressed.write_addressed(_rows(spark, 3).limit(0), path, ["id"]) == 0
    assert addressed.manifest(spark, path).count() == 0 and addressed.records(spark, path, SCHEMA, 0).count() == 0
    with pytest.raises(ValueError, match="position"):
        addressed.write_addressed(_rows(spark, 3).withColumn("position", F.lit(1)), path, ["id"])
    with pytest.raises(ValueError, match="unsupported"):
        addressed.write_addressed(_rows(spark, 3), path, ["id"], "xml")
