import numpy as np
import pytest
from pyspark.sql import functions as F

from mixframe.model import Mixture, as_mixture, grouped_model
from mixframe.operators import scoring


def mixture(k=3, d=2, seed=0):
    rng = np.random.default_rng(seed)
    return Mixture(rng.dirichlet(np.ones(k)), rng.normal(size=(k, d)), rng.uniform(0.5, 2, (k, d)))


def points(spark, n=60, d=2, seed=1):
    rng = np.random.default_rng(seed)
    return spark.createDataFrame([(i, rng.normal(size=d).tolist(), i % 4) for i in range(n)], "id long, z_mu array<double>, b long")


def collected(df, column):
    return np.array([r[column] for r in df.orderBy("id").collect()])


def test_density_against_numpy(spark):
    m, df = mixture(), points(spark)
    z = collected(df, "z_mu")
    delta = z[:, None, :] - m.means[None]
    expected = -0.5 * (2 * np.log(2 * np.pi) + (delta**2 / m.variances).sum(2) + np.log(m.variances).sum(1))
    assert np.allclose(collected(scoring.component_log_prob(df, m), "log_prob"), expected)
    assert np.allclose(collected(scoring.joint_log_prob(df, m), "joint"), expected + np.log(m.weights))


@pytest.mark.parametrize("batch", [None, "b"])
def test_invariants(spark, batch):
    out = scoring.score(points(spark), mixture(), batch_col=batch).cache()
    p, gamma, joint = (collected(out, c) for c in ("p", "gamma", "joint"))
    assert np.allclose(gamma.sum(1), 1)
    assert p.max() <= 0 and p.min() >= -20
    assert (gamma.argmax(1) == joint.argmax(1)).all() and (collected(out, "assignments") == joint.argmax(1)).all()
    batches = collected(out, "b") if batch else np.zeros(len(p))
    for b in set(batches):
        assert np.isclose(p[batches == b].max(), 0) and np.isclose(p[batches == b].min(), -20)


@pytest.mark.parametrize("batch", [None, "b"])
def test_predict_equals_score(spark, batch):
    df, m = points(spark), mixture()
    scored = scoring.score(df, m, batch_col=batch)
    predicted = scoring.predict(df, m, ["id"], z_sigma=None, z=None, batch_col=batch)
    assert predicted.columns == ["id", "z_mu", "gamma", "assignments"]
    assert np.allclose(collected(scored, "gamma"), collected(predicted, "gamma"))
    assert (collected(scored, "assignments") == collected(predicted, "assignments")).all()


def test_steps_equal_score(spark):
    df, m = points(spark), mixture()
    steps = scoring.responsibilities(scoring.inverse_min_max(scoring.joint_log_prob(df, m)))
    assert np.allclose(collected(steps, "gamma"), collected(scoring.score(df, m), "gamma"))


def test_partitions_do_not_matter(spark):
    df, m = points(spark), mixture()
    one, many = (collected(scoring.score(d, m), "gamma") for d in (df.coalesce(1), df.repartition(9)))
    assert np.array_equal(one, many)


def test_ties_take_the_lowest_component(spark):
    m = Mixture([0.5, 0.5], [[1.0], [1.0]], [[1.0], [1.0]])
    df = spark.createDataFrame([(0, [3.0])], "id long, z_mu array<double>")
    assert scoring.score(df, m).first().assignments == 0
    assert scoring.predict(df, m, ["id"], z_sigma=None, z=None).first().assignments == 0


def test_single_component_and_single_row(spark):
    m = Mixture([1.0], [[0.0]], [[1.0]])
    df = spark.createDataFrame([(0, [3.0])], "id long, z_mu array<double>")
    row = scoring.score(df, m).first()
    assert row.gamma == [1.0] and row.p == [0.0] and row.assignments == 0


def test_nan_rows_do_not_spoil_the_range(spark):
    m = mixture()
    clean = points(spark, 20)
    dirty = clean.unionByName(spark.createDataFrame([(99, [float("nan"), 0.0], 0)], clean.schema))
    for run in (lambda d: scoring.score(d, m), lambda d: scoring.predict(d, m, ["id"], z_sigma=None, z=None)):
        assert np.allclose(collected(run(dirty).filter("id < 99"), "gamma"), collected(run(clean), "gamma"))


def test_wrong_width_and_null_vectors_fail(spark):
    for bad in ([1.0], [1.0, None], None):
        df = spark.createDataFrame([(0, bad)], "id long, z_mu array<double>")
        with pytest.raises(Exception, match="every vector must hold 2 numbers"):
            scoring.joint_log_prob(df, mixture()).collect()


def test_empty_table(spark):
    assert scoring.score(points(spark).filter("id < 0"), mixture()).count() == 0


def test_model_checks(spark):
    with pytest.raises(ValueError):
        Mixture([0.0, 1.0], [[0.0], [1.0]], [[1.0], [1.0]])
    with pytest.raises(ValueError):
        Mixture([0.5, 0.5], [[0.0], [1.0]], [[1.0], [0.0]])
    with pytest.raises(ValueError):
        Mixture([1.0], [[0.0], [1.0]], [[1.0], [1.0]])
    m = mixture()
    again = as_mixture(m.to_table(spark))
    assert np.allclose(again.means, m.means) and np.allclose(again.variances, m.variances)
    with pytest.raises(ValueError):
        as_mixture(m.to_table(spark).filter("k > 0"))
    with pytest.raises(ValueError):
        as_mixture(m.to_table(spark).filter("k > 9"))


def test_grouped_model(spark):
    df = spark.createDataFrame([("a", [1.0]), ("a", [3.0]), ("b", [5.0]), ("b", [9.0]), ("b", [7.0])], "g string, v array<double>")
    m = grouped_model(df, "v", "g")
    assert np.allclose(m.weights, [0.4, 0.6]) and np.allclose(m.means, [[2], [7]]) and np.allclose(m.variances, [[1], [8 / 3]])


def test_grouped_model_refuses_ragged_vectors(spark):
    for bad in ([3.0], [1.0, None], None):
        df = spark.createDataFrame([("a", [1.0, 2.0]), ("a", [2.0, 5.0]), ("a", bad)], "g string, v array<double>")
        with pytest.raises(Exception, match="expected 2 values"):
            grouped_model(df, "v", "g")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans_are_narrow(spark, folder):
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").withColumnRenamed("embedding", "z_mu")
    m = grouped_model(rows, "z_mu", "label")
    plan = plan_of(scoring.predict(rows, m, ["vec_id"], z_sigma=None, z=None))
    assert "Join" not in plan and "Cartesian" not in plan and "Exchange hashpartitioning" not in plan
    # one function call in the range pass and one in the scoring pass, and no pass reads the label
    assert plan.count("ArrowEvalPython") == 2 and "label" not in plan


def test_a_filter_on_the_result_does_not_score_twice(spark, folder):
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").withColumnRenamed("embedding", "z_mu")
    m = grouped_model(rows, "z_mu", "label")
    confident = scoring.predict(rows, m, ["vec_id"], z_sigma=None, z=None).filter(F.array_max("gamma") > 0.9)
    assert plan_of(confident).count("ArrowEvalPython") == 2
    assert confident.select(F.explode("gamma")).count() > 0


@pytest.mark.parametrize("limit", [None, 0])
def test_rows_without_a_batch_are_one_batch(spark, monkeypatch, limit):
    if limit is not None:
        from mixframe.operators import lookup

        forced = lambda *args, **kwargs: lookup.lookup_join(*args, **{**kwargs, "limit": limit})
        monkeypatch.setattr(scoring, "lookup_join", forced)
    df = points(spark).withColumn("b", F.when(F.col("b") > 0, F.col("b")))
    filled = df.withColumn("b", F.coalesce("b", F.lit(9)))
    a, b = (scoring.score(d, mixture(), batch_col="b") for d in (df, filled))
    assert a.count() == 60 and np.allclose(collected(a, "p"), collected(b, "p"))
    predicted = scoring.predict(df, mixture(), ["id"], z_sigma=None, z=None, batch_col="b")
    assert np.allclose(collected(predicted, "gamma"), collected(a, "gamma"))
