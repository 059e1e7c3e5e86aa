"""Training steps from stored batches, and their log."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from mixframe.model import Mixture
from mixframe.operators import finetune
from mixframe.operators.batch_store import store_batches
from mixframe.operators.latent_fit import LatentFit, fit_latent
from mixframe.plans.training import shuffled_store, train_mixture
from mixframe.session import scratch_path
from mixframe.sinks.step_log import StepLog, read_log

RNG = np.random.default_rng(8)
MODEL = Mixture(np.array([0.4, 0.6]), np.array([[0.0, 0.5], [2.0, 1.0]]), np.ones((2, 2)))


@pytest.fixture(scope="module")
def codes(spark):
    rows = [(i, RNG.normal(size=2).tolist(), RNG.normal(size=2).tolist()) for i in range(230)]
    return spark.createDataFrame(rows, "id long, z_mu array<double>, z_sigma array<double>").repartition(4).cache()


def close(a, b):
    return all(np.allclose(x, y, rtol=1e-9) for x, y in ((a.weights, b.weights), (a.means, b.means), (a.variances, b.variances)))


def test_steps_from_the_store_equal_steps_of_the_table(codes):
    batched = codes.withColumn("batch_id", F.floor(F.col("id") / 50).cast("bigint"))
    args = MODEL, [0.5, 1.0, 0.25, 1.0, 1.0, 0.5, 1.0], [1e-3] * 7
    plain, losses = finetune.finetune_mixture(batched, *args, batch_col="batch_id")
    store = store_batches(batched, "batch_id", 5, 50, part_rows=100)
    stored, again = finetune.finetune_mixture(store, *args)
    assert close(plain, stored) and np.allclose(losses, again)
    with pytest.raises(ValueError, match="5 batches"):
        store.batch(5)


def test_a_step_opens_one_part(codes):
    store = shuffled_store(codes, "id", 20, 1000, seed=3)
    assert store.batches == 12 and store.per_part == 5000
    store = store_batches(codes.withColumn("batch_id", F.floor(F.col("id") / 20).cast("bigint")), "batch_id", 12, 20, part_rows=60)
    seen = []
    for step in range(12):
        rows = store.step(step)
        assert all(f"part={step // 3}/" in f for f in rows.inputFiles())
        seen += [r.id for r in rows.collect()]
        assert "batch_id" in rows._jdf.queryExecution().executedPlan().toString().split("PushedFilters")[1]
    assert sorted(seen) == list(range(230)) and [r.id for r in store.step(12).collect()] == seen[:20]


def test_few_steps_store_few_batches(codes):
    store = shuffled_store(codes, "id", 20, 2, seed=3)
    assert store.batches == 2 and store.batch(0).count() == 20 and store.batch(1).count() == 20


def test_train_mixture_in_mini_batches(spark, codes):
    path = scratch_path(spark, "log")
    settings = dict(clusters=2, init_steps=2, batch_size=64, beta_steps=3, static_steps=2, rate=1e-3, max_iter=20, seed=4)
    result = train_mixture(codes, "id", **settings, mini_batches=True, log=StepLog(spark, path, "a", every=2))
    start = train_mixture(codes, "id", **settings | {"beta_steps": 0, "static_steps": 0}).model
    store = shuffled_store(codes, "id", 64, 5, 4)
    assert store.batches == 4
    weights = [(i / 3) ** 3 + 0.0005 for i in (1, 2, 3)] + [1.0, 1.0]
    model, losses = finetune.finetune_mixture(store, start, weights, [1e-3] * 5)
    assert close(result.model, model) and np.allclose(result.losses, losses)
    rows = {(r.step, r.name): r.value for r in read_log(spark, path, "a").collect()}
    assert len(rows) == read_log(spark, path).count() == 20
    assert all(np.isclose(rows[i, "latent_loss"], losses[i]) and rows[i, "anneal_factor"] == weights[i] for i in range(5))


def test_a_retried_step_replaces_its_rows(spark):
    path = scratch_path(spark, "log")
    assert read_log(spark, path).count() == 0
    log = StepLog(spark, path, "r", every=10)
    for step in range(25):
        log.add(step, loss=step)
    log.flush()
    log = StepLog(spark, path, "r", every=10)  # lost after step 13: goes on there
    for step in range(13, 30):
        log.add(step, loss=100 + step)
    log.flush()
    other = StepLog(spark, path, "s")
    other.add(0, loss=1, rate=2)
    other.flush()
    values = {r.step: r.value for r in read_log(spark, path, "r").collect()}
    assert values == {i: i if i < 13 else 100 + i for i in range(30)} and read_log(spark, path, "r").count() == 30
    assert read_log(spark, path).count() == 32


def test_fit_latent_logs_every_round(spark, codes):
    path = scratch_path(spark, "log")
    settings = LatentFit(code=2, hidden=4, clusters=2, gamma_rounds=2, init_steps=1, beta_rounds=1, static_rounds=1, batch_size=32, max_iter=5)
    fit = fit_latent(codes, "z_mu", "id", settings, log=StepLog(spark, path, "fit"))
    rows = {r.step: r.value for r in read_log(spark, path, "fit").where("name = 'loss'").collect()}
    assert [rows[i] for i in range(4)] == fit.losses
