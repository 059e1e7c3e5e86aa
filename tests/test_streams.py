"""Running cluster metrics of a stream, and the end of an initialising one."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from mixframe.model import Mixture
from mixframe.operators import metrics, scoring
from mixframe.plans.training import start_model
from mixframe.streaming import jobs

MODEL = Mixture(np.array([0.5, 0.5]), np.array([[1.0, 0.0], [-1.0, 0.5]]), np.ones((2, 2)))


def _codes(spark, part):
    ids = spark.range(part * 40, part * 40 + 40 - 7 * part)
    return ids.select("id", F.array(F.sin(F.col("id") * 1.3) * 2, F.cos(F.col("id") * 0.7)).alias("z_mu"), F.lit(part).cast("bigint").alias("part"))


def _write(spark, folder, parts):
    for part in parts:
        _codes(spark, part).coalesce(1).write.mode("append").parquet(folder)


def _source(spark, folder):
    stream = spark.readStream.schema("id bigint, z_mu array<double>, part bigint").option("maxFilesPerTrigger", 1)
    return stream.option("latestFirst", False).parquet(folder)


def _expected(spark, parts):
    rows = _codes(spark, 0)
    for part in range(1, parts):
        rows = rows.unionAll(_codes(spark, part))
    scored = scoring.assign(scoring.joint_log_prob(rows, MODEL))
    ch = metrics.calinski_harabasz(scored, mode="running", batch_col="part").first()[0]
    return ch, metrics.simplified_silhouette(scored, MODEL, "batch_min", "part").first()[0]


def test_running_cluster_metrics_across_a_restart(spark, tmp_path):
    folder, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    for parts, new in ((2, [0, 1]), (4, [2, 3])):
        for part in new:
            # one file after another, so that a micro-batch is a part
            _write(spark, folder, [part])
            jobs.cluster_metrics_stream(_source(spark, folder), MODEL, out, state).awaitTermination()
        last = jobs.running_cluster_metrics(spark, out).orderBy(F.desc("batch")).first()
        ch, silhouette = _expected(spark, parts)
        assert last["batch"] == parts - 1
        assert (last["calinski_harabasz"], last["simple_silhouette"]) == (pytest.approx(ch), pytest.approx(silhouette))


def test_empty_micro_batch_leaves_no_row(spark, tmp_path):
    out = str(tmp_path / "out")
    _write(spark, str(tmp_path / "in"), [0])
    rows = _source(spark, str(tmp_path / "in")).where("id < 0")
    jobs.cluster_metrics_stream(rows, MODEL, out, str(tmp_path / "state")).awaitTermination()
    assert jobs.running_cluster_metrics(spark, out).count() == 0


def _init(spark, tmp_path, steps):
    pool, model, state = (str(tmp_path / n) for n in ("pool", "model", "state"))
    query = jobs.init_stream(_source(spark, str(tmp_path / "in")), pool, model, state, steps, 2, start_model(2, 2), max_iter=5)
    return jobs.await_model(query, spark, pool, model, steps)


def test_short_stream_is_an_error_and_goes_on(spark, tmp_path):
    _write(spark, str(tmp_path / "in"), [0])
    with pytest.raises(ValueError, match="after 1 of the 2"):
        _init(spark, tmp_path, 2)
    _write(spark, str(tmp_path / "in"), [1])
    first = _init(spark, tmp_path, 2)
    assert first.k == 2
    # more micro-batches come after the fit, which stays
    _write(spark, str(tmp_path / "in"), [2])
    assert np.array_equal(_init(spark, tmp_path, 2).means, first.means)


def test_stream_without_rows_is_an_error(spark, tmp_path):
    (tmp_path / "in").mkdir()
    with pytest.raises(ValueError, match="after 0 of the 1"):
        _init(spark, tmp_path, 0.5)
