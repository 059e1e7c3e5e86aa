"""The streaming queries on a table that is a folder of part files, as Spark writes it, and on the same rows in one file."""

import os

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from mixframe.catalog import catalog

ROWS = 90


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    """The same embeddings, as one file and as a folder of five."""
    one, parts = (str(tmp_path_factory.mktemp(n)) for n in ("one", "parts"))
    values = F.transform(F.sequence(F.lit(1), F.lit(64)), lambda d: F.sin(F.col("vec_id") * d * 0.37).cast("float"))
    rows = spark.range(ROWS).select(
        F.col("id").alias("vec_id"), (F.col("id") % 3).cast("int").alias("label")
    ).select("vec_id", values.alias("embedding"), "label")
    rows.repartition(5, "vec_id").write.parquet(f"{parts}/embeddings.parquet")
    pq.write_table(rows.toArrow(), f"{one}/embeddings.parquet")
    assert os.path.isfile(f"{one}/embeddings.parquet")
    assert len([f for f in os.listdir(f"{parts}/embeddings.parquet") if f.endswith(".parquet")]) == 5
    return one, parts


def _both(spark, folders, name):
    return [sorted(catalog()[name].run(spark, folder).collect()) for folder in folders]


def test_cluster_metrics_stream_of_part_files(spark, folders):
    one, parts = _both(spark, folders, "cluster_metrics_stream")
    assert one == parts and parts[0]["rows"] == ROWS


def test_init_stream_of_part_files(spark, folders):
    one, parts = _both(spark, folders, "init_stream")
    assert [(r["k"], r["dim"]) for r in parts] == [(k, 64) for k in range(4)] == [(r["k"], r["dim"]) for r in one]


def test_metrics_stream_of_part_files(spark, folders):
    one, parts = _both(spark, folders, "metrics_stream")
    assert len(parts) == 1 and list(parts[0]) == pytest.approx(list(one[0]))


def test_score_stream_of_part_files(spark, folders):
    one, parts = _both(spark, folders, "score_stream")
    assert [r["vec_id"] for r in parts] == list(range(ROWS))
    assert [r["assignments"] for r in parts] == [r["assignments"] for r in one]
    assert [r["confidence"] for r in parts] == pytest.approx([r["confidence"] for r in one])
