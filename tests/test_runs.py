"""Batches that share one partitioning: the same numbers as with joins, and one exchange of the rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from mixframe.model import Mixture
from mixframe.operators import metrics, scoring
from mixframe.operators.file_batches import sequential_batches_file_order
from mixframe.operators.losses import sigmoid_recon_loss
from mixframe.operators.runs import Aligned, aligned_batches

MODEL = Mixture(np.array([0.5, 0.3, 0.2]), np.array([[0.0, 1.0], [2.0, 0.0], [-1.0, -1.0]]), np.ones((3, 2)))


@pytest.fixture(scope="module")
def rows(spark):
    x = [F.sin(F.col("id") * c).alias("v") for c in (1.7, 0.3)]
    codes = spark.range(1000).select("id", F.array(*[F.lit(2.0) * c for c in x]).alias("z_mu"))
    codes = codes.withColumn("z_sigma", F.transform("z_mu", lambda v: v * 0.1 - 1.0))
    codes = codes.withColumn("batch_id", F.floor(F.col("id") / 64).cast("bigint"))
    return codes.withColumn("x", F.transform("z_mu", lambda v: F.abs(v) / 2)).withColumn("xhat", F.col("z_mu"))


def _numbers(df, key="id"):
    return {r[key]: [np.round(v, 12).tolist() if isinstance(v, list) else v for v in r] for r in df.collect()}


def exchanges(df):
    """Exchanges of a plan that are not broadcasts."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if "Exchange " in line and "Broadcast" not in line]


BATCHES = Aligned("batch_id")


def test_window_scores_equal_joined_ones(rows):
    plain = scoring.predict(rows, MODEL, ["id"], z=None, batch_col="batch_id")
    assert _numbers(scoring.predict(rows, MODEL, ["id"], z=None, aligned=BATCHES)) == _numbers(plain)
    joint = scoring.joint_log_prob(rows, MODEL)
    by_join = scoring.inverse_min_max(joint, batch_col="batch_id").select("id", "p")
    assert _numbers(scoring.inverse_min_max(joint, aligned=BATCHES).select("id", "p")) == _numbers(by_join)


def test_window_metrics_equal_joined_ones(rows):
    with_join = scoring.score(rows, MODEL, batch_col="batch_id")
    with_window = scoring.score(rows, MODEL, aligned=BATCHES)
    settings = {"z_sigma": "z_sigma", "logits": "xhat", "logit_range": 50.0}
    expected = metrics.evaluate(with_join, MODEL, batch_col="batch_id", **settings).first().asDict()
    found = metrics.evaluate(with_window, MODEL, aligned=BATCHES, **settings).first().asDict()
    assert found == pytest.approx(expected, rel=1e-9)
    loss = sigmoid_recon_loss(rows, "x", "xhat", 50.0, aligned=BATCHES).first()[0]
    assert loss == pytest.approx(sigmoid_recon_loss(rows, "x", "xhat", 50.0, "batch_id").first()[0], rel=1e-12)


def test_one_exchange_of_the_rows(spark, rows, tmp_path):
    rows.drop("batch_id").repartition(5).write.parquet(str(tmp_path / "t"))
    stored = spark.read.parquet(str(tmp_path / "t"))
    batched = sequential_batches_file_order(stored, 64)
    plan = exchanges(scoring.predict(batched, MODEL, ["id"], z=None, aligned=BATCHES))
    moved = [line for line in plan if "hashpartitioning(batch_id" in line]
    # all others belong to the table of offsets, which has a row for each file
    small = [line for line in plan if "__file" in line or "SinglePartition" in line]
    assert len(moved) == 1 and len(moved) + len(small) == len(plan)


def test_hot_batch_is_joined_instead(rows):
    hot = rows.withColumn("batch_id", F.when(F.col("id") < 600, 0).otherwise(F.col("batch_id")))
    assert aligned_batches(hot, "batch_id", hot=500) is None
    assert aligned_batches(hot, "batch_id", hot=700) == BATCHES


def test_edges(rows):
    empty = rows.limit(0)
    assert aligned_batches(empty, "batch_id") == BATCHES
    assert scoring.predict(empty, MODEL, ["id"], z=None, aligned=BATCHES).count() == 0
    nulls = rows.withColumn("batch_id", F.when(F.col("id") >= 100, F.col("batch_id")))
    plain = scoring.predict(nulls, MODEL, ["id"], z=None, batch_col="batch_id")
    assert _numbers(scoring.predict(nulls, MODEL, ["id"], z=None, aligned=BATCHES)) == _numbers(plain)
