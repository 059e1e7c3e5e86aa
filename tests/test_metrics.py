import numpy as np
import pytest
from pyspark.sql import functions as F

from mixframe.catalog.schedules import SERIES
from mixframe.functions import schedule
from mixframe.functions.schedule import Schedule
from mixframe.model import Mixture
from mixframe.operators import losses, metrics, scoring

RNG = np.random.default_rng(7)
Z = RNG.normal(size=(80, 3)) + np.arange(80)[:, None] % 3
MODEL = Mixture([0.2, 0.3, 0.5], [[0.0, 0, 0], [1, 1, 1], [2, 2, 2]], np.ones((3, 3)))


@pytest.fixture(scope="module")
def scored(spark):
    df = spark.createDataFrame([(i, z.tolist(), i // 20) for i, z in enumerate(Z)], "id long, z_mu array<double>, b long")
    out = scoring.score(df.repartition(3), MODEL).withColumn("z_sigma", F.transform("z_mu", lambda v: v / 4 - 1))
    return out.withColumn("x", F.col("z_mu")).withColumn("xhat", MODEL.centre_of("assignments")).cache()


def value(df):
    return df.first()[0]


def dispersion(z, labels):
    mean = z.mean(0)
    groups = [z[labels == k] for k in set(labels)]
    between = sum(len(g) * ((g.mean(0) - mean) ** 2).sum() for g in groups)
    return between, sum(((g - g.mean(0)) ** 2).sum() for g in groups), len(groups)


def test_calinski_against_numpy(scored):
    labels = np.array([r.assignments for r in scored.orderBy("id").collect()])
    b, w, k = dispersion(Z, labels)
    assert np.isclose(value(metrics.calinski_harabasz(scored)), b * (80 - k) / (w * (k - 1)))
    bs, ws, scores = [], [], []
    for batch in range(4):
        part = slice(batch * 20, batch * 20 + 20)
        b, w, k = dispersion(Z[part], labels[part])
        bs.append(b), ws.append(w)
        scores.append(np.mean(bs) * (20 - k) / (np.mean(ws) * (k - 1)))
    running = metrics.calinski_harabasz(scored, mode="running", batch_col="b")
    assert np.isclose(value(running), np.mean(scores))


def test_one_batch_is_exact(scored):
    single = scored.withColumn("b", F.lit(0).cast("bigint"))
    assert np.isclose(value(metrics.calinski_harabasz(single, mode="running", batch_col="b")), value(metrics.calinski_harabasz(scored)))
    whole = metrics.simplified_silhouette(scored, MODEL, "batch_min")
    assert np.isclose(value(metrics.simplified_silhouette(single, MODEL, "batch_min", "b")), value(whole))


def test_calinski_is_one_without_spread(spark):
    df = spark.createDataFrame([([1.0], 0), ([1.0], 0)], "z_mu array<double>, assignments int")
    assert value(metrics.calinski_harabasz(df)) == 1.0


def test_calinski_far_from_the_origin(spark):
    z = RNG.normal(size=(50, 2))
    labels = np.arange(50) % 2
    b, w, k = dispersion(z, labels)
    df = spark.createDataFrame([((row + 1e7).tolist(), int(l)) for row, l in zip(z, labels)], "z_mu array<double>, assignments int")
    assert np.isclose(value(metrics.calinski_harabasz(df)), b * 48 / w, rtol=1e-4)


def test_silhouette_against_numpy(scored):
    labels = np.array([r.assignments for r in scored.orderBy("id").collect()])
    d = np.sqrt(((Z[:, None] - MODEL.means[None]) ** 2).sum(2))
    own = d[np.arange(80), labels]
    d[np.arange(80), labels] = np.inf
    near = d.min(1)
    assert np.isclose(value(metrics.simplified_silhouette(scored, MODEL)), ((near - own) / np.maximum(own, near)).mean())
    least = near.min()
    assert np.isclose(value(metrics.simplified_silhouette(scored, MODEL, "batch_min")), ((least - own) / np.maximum(own, least)).mean())
    with pytest.raises(ValueError):
        metrics.simplified_silhouette(scored, MODEL, "other")


def test_single_component_gives_null(spark):
    one = Mixture([1.0], [[0.0]], [[1.0]])
    df = spark.createDataFrame([([1.0], 0)], "z_mu array<double>, assignments int")
    assert value(metrics.simplified_silhouette(df, one)) is None
    assert value(metrics.simplified_silhouette(df, one, "batch_min")) is None
    assert value(metrics.separation(one.to_table(spark))) is None


def test_separation(spark):
    assert np.isclose(value(metrics.separation(MODEL.to_table(spark))), np.sqrt(3) * 4 / 3)
    same = Mixture([0.5, 0.5], [[1.0], [1.0]], [[1.0], [1.0]])
    assert value(metrics.separation(same.to_table(spark))) == 0.0


def test_running_mean_across_chunks(spark):
    values = RNG.normal(size=50)
    weights = RNG.integers(1, 9, 50)
    df = spark.createDataFrame([(i * 3, float(v), int(w)) for i, (v, w) in enumerate(zip(values, weights))], "b long, v double, w int")
    out = metrics.running_mean(df.repartition(4), "b", {"v": "m"}, weight="w", chunk=7).orderBy("b").collect()
    assert np.allclose([r.m for r in out], np.cumsum(values * weights) / np.cumsum(weights))


def test_reconstruction_checks_lengths(spark):
    df = spark.createDataFrame([([1.0, 2.0], [1.0])], "x array<double>, xhat array<double>")
    with pytest.raises(Exception, match="equal length"):
        metrics.reconstruction_metrics(df).collect()


def test_evaluate_agrees_with_the_single_metrics(scored, spark):
    for batch in (None, "b"):
        record = metrics.evaluate(scored, MODEL.to_table(spark), z_sigma="z_sigma", frame=(3, 1), batch_col=batch).first()
        recon = metrics.reconstruction_metrics(scored).first()
        for name in ("mean_absolute_error", "mean_squared_error", "mean_cosine_distance"):
            assert np.isclose(record[name], recon[name])
        mode = "batch_min" if batch else "per_sample"
        assert np.isclose(record.simple_silhouette, value(metrics.simplified_silhouette(scored, MODEL, mode, batch)))
        loss = losses.static_loss(losses.mse_recon_loss(scored, height=3, width=1), losses.mixture_latent_loss(scored, MODEL))
        assert np.isclose(record.loss, value(loss))


def test_histogram_edges(spark):
    df = spark.createDataFrame([(v,) for v in [0.0, 0.5, 1.0, 2.0, 5.0, float("nan"), None]], "v double")
    found = {r.bin: r.n for r in metrics.histogram(df, "v", 4, 0.0, 2.0).collect()}
    assert found == {0: 1, 1: 1, 2: 1, 3: 2}
    assert metrics.histogram(df.filter("v < 0"), "v").count() == 0
    wide = metrics.histogram(df, "v", 6, -1.0, 5.0).orderBy("bin").collect()
    assert [r.n for r in wide] == [0, 2, 1, 1, 0, 1] and [r.lower for r in wide] == [-1.0, 0.0, 1.0, 2.0, 3.0, 4.0]
    assert [r.n for r in metrics.histogram(df.filter("v < 0"), "v", 2, 0.0, 1.0).collect()] == [0, 0]
    assert metrics.histogram(df.filter("v = 2"), "v").first().n == 1


def test_losses_on_no_rows(scored):
    assert value(losses.kl_standard_normal(scored.filter("id < 0"))) is None


def test_losses_against_numpy(scored):
    s = Z / 4 - 1
    assert np.isclose(value(losses.kl_standard_normal(scored)), -0.5 * (1 + s - Z**2 - np.exp(s)).sum(1).mean())
    exact = value(losses.mixture_latent_loss(scored, MODEL, exact=True))
    counted = value(losses.mixture_latent_loss(scored, MODEL))
    assert np.isclose(counted - exact, 0.5 * 3 * 2 * np.log(2 * np.pi))
    stable = losses.sigmoid_recon_loss(scored.withColumn("l", F.transform("x", lambda v: v * 1000)), "x", "l")
    assert np.isfinite(value(stable))


def test_phases(spark):
    steps = spark.range(10100).select(F.col("id").alias("s"), SERIES.phase("id").alias("p"), SERIES.cycle("id").alias("c"))
    counted = {(r.p, r.c): r["count"] for r in steps.groupBy("p", "c").count().collect()}
    assert counted == {
        ("start", None): 1, ("gamma", None): 6000, ("gmm_init", None): 5, ("beta", 1): 3900, ("static", 1): 99,
        ("static", 2): 1, ("beta", 2): 94,
    }


def test_fractional_initialisation(spark):
    s = Schedule(10, 0.3, 4, 2, 100, 0.1)
    found = {r.id: r.p for r in spark.range(20).select("id", s.phase("id").alias("p")).collect()}
    assert [i for i, p in found.items() if p == "gmm_init"] == [11]
    factors = [r.a for r in spark.range(11, 18).select(s.anneal_factor("id").alias("a")).collect()]
    assert np.allclose(factors, [0.1, 0.1 + 1 / 64, 0.1 + 1 / 8, 0.1 + 27 / 64, 1.1, 1.1, 0.1])


def test_learning_rate_checks(spark):
    for bad in (None, (1,), (1.0, 0.5), (1, 1)):
        with pytest.raises(ValueError):
            schedule.learning_rate("id", 0.1, "Exponential", bad)


def test_running_mean_of_ids_far_apart(spark, monkeypatch):
    monkeypatch.setattr(metrics, "MAX_CHUNKS", 5)
    values = RNG.normal(size=40)
    df = spark.createDataFrame([(i * 10**9, float(v)) for i, v in enumerate(values)], "b long, v double")
    out = metrics.running_mean(df, "b", {"v": "m"}, chunk=6).orderBy("b").collect()
    assert np.allclose([r.m for r in out], np.cumsum(values) / np.arange(1, 41))
    assert out[0].asDict().keys() == {"b", "v", "m"}


def test_a_derived_array_is_computed_once(spark):
    from mixframe.functions import hashing

    df = spark.range(10).withColumn("v", F.array(F.lit(1.0), F.lit(2.0)))
    noisy = df.withColumn("n", hashing.add_noise("v", "id", 1.0))
    for out in (metrics.reconstruction_metrics(noisy, "v", "n"), metrics.histogram(noisy, "n", 4, -5.0, 5.0)):
        assert out._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1
