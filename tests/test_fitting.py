import numpy as np
import pytest
from pyspark.sql import functions as F

from mixframe.functions.mixture import log_prob_matrix, softmax
from mixframe.model import Mixture
from mixframe.operators import finetune, fitting
from mixframe.operators.latent_fit import LatentFit, fit_latent, initial_weights, loss_and_gradient, mixture_gradient
from mixframe.plans.training import anneal_weights, start_model, train_mixture

RNG = np.random.default_rng(3)
CENTRES = np.array([[0.0, 0.0, 0.0], [6.0, 0.0, 1.0], [0.0, 7.0, -2.0]])
X = np.concatenate([c + RNG.normal(size=(60, 3)) * (0.5 + i / 2) for i, c in enumerate(CENTRES)])


@pytest.fixture(scope="module")
def df(spark):
    rows = [(i, x.tolist(), (0.1 * x - 1).tolist()) for i, x in enumerate(X)]
    return spark.createDataFrame(rows, "id long, z_mu array<double>, z_sigma array<double>").repartition(5).cache()


def test_lloyd_against_numpy(df):
    centres = X[[0, 70, 140]].copy()
    for _ in range(3):
        label = ((X[:, None] - centres[None]) ** 2).sum(2).argmin(1)
        cost = ((X - centres[label]) ** 2).sum()
        centres = np.array([X[label == k].mean(0) for k in range(3)])
    out = fitting.lloyd(df, "z_mu", X[[0, 70, 140]], 3)
    assert np.allclose(out.centres, centres) and np.isclose(out.cost, cost)


def test_lloyd_keeps_an_empty_cluster(df):
    far = np.array([[0.0, 0.0, 0.0], [1e6, 1e6, 1e6]])
    out = fitting.lloyd(df, "z_mu", far, 2)
    assert np.allclose(out.centres[1], 1e6) and np.allclose(out.centres[0], X.mean(0))


def test_kmeans_finds_the_clusters(df):
    found = fitting.kmeans(df, "z_mu", 3, restarts=3)
    order = [int(((found.centres - c) ** 2).sum(1).argmin()) for c in CENTRES]
    assert sorted(order) == [0, 1, 2] and np.abs(found.centres[order] - CENTRES).max() < 0.7


def test_expectation_maximisation_against_numpy(df):
    centres = CENTRES + 0.3
    label = ((X[:, None] - centres[None]) ** 2).sum(2).argmin(1)
    model = Mixture(
        np.bincount(label) / len(X), centres, np.array([X[label == k].var(0) + 1e-6 for k in range(3)])
    )
    for _ in range(4):
        r = softmax(log_prob_matrix(X, model, True))
        n = r.sum(0)
        means = r.T @ X / n[:, None]
        variances = np.array([(r[:, [k]] * (X - means[k]) ** 2).sum(0) / n[k] for k in range(3)]) + 1e-6
        model = Mixture(n / n.sum(), means, variances)
    fit = fitting.diag_gmm(df, "z_mu", centres, max_iter=4, tolerance=None)
    assert np.allclose(fit.model.weights, model.weights) and np.allclose(fit.model.means, model.means)
    assert np.allclose(fit.model.variances, model.variances)


def test_likelihood_never_falls_and_converges(df):
    fit = fitting.diag_gmm(df, "z_mu", X[[0, 1, 2]], max_iter=60)
    assert fit.converged and len(fit.log_likelihood) < 60
    assert all(b >= a - 1e-6 for a, b in zip(fit.log_likelihood, fit.log_likelihood[1:]))


def test_a_component_without_rows_survives(df):
    fit = fitting.diag_gmm(df, "z_mu", np.array([[0.0, 0, 0], [1e3, 1e3, 1e3]]), max_iter=2, tolerance=None)
    assert fit.model.weights[1] > 0 and np.isfinite(fit.model.means).all()


def test_equal_rows_keep_the_variance_floor(spark):
    df = spark.range(20).select(F.array(F.lit(2.0)).alias("v"))
    fit = fitting.diag_gmm(df, "v", np.array([[2.0]]), max_iter=3, tolerance=None)
    assert np.allclose(fit.model.variances, 1e-6) and np.allclose(fit.model.means, 2)


def test_empty_table_is_refused(df):
    empty = df.filter("id < 0")
    with pytest.raises(ValueError):
        fitting.diag_gmm(empty, "z_mu", CENTRES)
    with pytest.raises(ValueError):
        train_mixture(empty, "id", 3, 2, 60, beta_steps=1, static_steps=1)
    with pytest.raises(ValueError):
        finetune.latent_loss_gradient(empty, MODEL)


def test_momentum_blend(spark):
    old = Mixture([0.3, 0.7], [[0.0], [1.0]], [[1.0], [2.0]])
    blended = fitting.momentum_update(old, [[2.0], [3.0]], [[4.0], [5.0]], 0.5)
    assert np.allclose(blended.means, [[0.25], [1.25]]) and np.allclose(blended.variances, [[1.375], [2.375]])
    assert np.allclose(blended.weights, old.weights)
    direct = fitting.momentum_update(old.to_table(spark), [[2.0], [3.0]], [[4.0], [5.0]], 0.5, direct=True)
    assert np.allclose(direct.means, [[2], [3]]) and np.allclose(direct.variances, [[4], [5]])


MODEL = Mixture([0.5, 0.2, 0.4], CENTRES + 0.2, np.full((3, 3), 1.3))


def loss_of(values):
    model = Mixture(values["pi"], values["mu"], values["var"])
    return mixture_gradient(X, 0.1 * X - 1, model)[0]


def numeric(values, key, at, step=1e-5):
    ends = []
    for sign in (1, -1):
        moved = {k: v.copy() for k, v in values.items()}
        moved[key][at] += sign * step
        ends.append(loss_of(moved))
    return (ends[0] - ends[1]) / (2 * step)


def test_gradient_by_finite_differences(df):
    loss, gradient = finetune.latent_loss_gradient(df, MODEL)
    values = {"pi": MODEL.weights, "mu": MODEL.means, "var": MODEL.variances}
    assert np.isclose(loss, loss_of(values))
    for key, at in [("pi", (0,)), ("pi", (2,)), ("mu", (0, 0)), ("mu", (2, 1)), ("var", (1, 2)), ("var", (2, 0))]:
        assert np.isclose(gradient[key][at], numeric(values, key, at), rtol=1e-4, atol=1e-6), (key, at)
    _, local = mixture_gradient(X, 0.1 * X - 1, MODEL)
    for key in values:
        assert np.allclose(local[key], gradient[key])


def test_code_gradient_by_finite_differences():
    z, s = X[::9].copy(), 0.1 * X[::9] - 1
    _, gradient = mixture_gradient(z, s, MODEL)
    for array, key in ((z, "z"), (s, "s")):
        for at in ((0, 0), (7, 2), (15, 1)):
            ends = []
            for sign in (1, -1):
                array[at] += sign * 1e-5
                ends.append(mixture_gradient(z, s, MODEL)[0])
                array[at] -= sign * 1e-5
            assert np.isclose(gradient[key][at], (ends[0] - ends[1]) / 2e-5, rtol=1e-4, atol=1e-6)


def test_constant_gamma_differs(df):
    _, full = finetune.latent_loss_gradient(df, MODEL)
    _, held = finetune.latent_loss_gradient(df, MODEL, through_gamma=False)
    assert not np.allclose(full["mu"], held["mu"])


@pytest.mark.parametrize("name", finetune.OPTIMIZERS)
def test_optimizers_lower_the_loss(df, name):
    rate = {"SGD": 1e-2, "Adagrad": 1e-2}.get(name, 1e-3)
    _, losses = finetune.finetune_mixture(df, MODEL, [1.0] * 4, [rate] * 4, name)
    assert losses[-1] < losses[0]


def test_optimizer_rules():
    g = {"x": np.array([2.0])}
    start = {"x": np.array([1.0])}
    assert np.isclose(finetune.Optimizer("SGD").update(start, g, 0.1)["x"], 0.8)
    assert np.isclose(finetune.Optimizer("Adagrad").update(start, g, 0.1)["x"], 1 - 0.1 * 2 / np.sqrt(4.1))
    assert np.isclose(finetune.Optimizer("RMSProp").update(start, g, 0.1)["x"], 1 - 0.1 * 2 / np.sqrt(1.3))
    adam = finetune.Optimizer("Adam")
    assert np.isclose(adam.update(start, g, 0.1)["x"], 0.9, atol=1e-6)
    assert adam.steps == 1
    with pytest.raises(ValueError):
        finetune.Optimizer("Momentum")


def test_steps_by_batch(df):
    batched = df.withColumn("batch_id", (F.col("id") % 3).cast("bigint"))
    _, losses = finetune.finetune_mixture(batched, MODEL, [0.0] * 4, [0.1] * 4, "SGD", batch_col="batch_id")
    single = [finetune.latent_loss_gradient(batched.filter(F.col("batch_id") == b), MODEL)[0] for b in (0, 1, 2, 0)]
    assert np.allclose(losses, single)
    with pytest.raises(ValueError):
        finetune.finetune_mixture(df, MODEL, [1.0], [])


def test_train_mixture(df):
    result = train_mixture(df, "id", 3, 2, 60, beta_steps=2, static_steps=1, rate=1e-3, optimizer="SGD")
    assert result.model.k == 3 and len(result.losses) == 3
    assert anneal_weights(2, 1, 0.5) == [0.625, 1.5, 1.0]
    start = start_model(4, 5)
    assert np.abs(start.weights - 0.25).max() <= 0.05 and np.abs(start.variances - 1).max() <= 0.2


@pytest.mark.parametrize("phase", ["gamma", "beta"])
def test_network_gradient_by_finite_differences(phase):
    settings = LatentFit(code=3, hidden=5, clusters=3, gamma_rounds=1, init_steps=1, beta_rounds=1, static_rounds=1)
    x = RNG.normal(size=(12, 4))
    eps = RNG.normal(size=(12, 3))
    w = initial_weights(4, settings) | {"pi": MODEL.weights.copy(), "mu": MODEL.means / 5, "var": MODEL.variances.copy()}
    loss, gradient = loss_and_gradient(x, x, eps, w, phase, 0.7)
    for key, g in gradient.items():
        at = tuple(n // 2 for n in g.shape)
        ends = []
        for sign in (1, -1):
            moved = {k: v.copy() for k, v in w.items()}
            moved[key][at] += sign * 1e-6
            ends.append(loss_and_gradient(x, x, eps, moved, phase, 0.7)[0])
        assert np.isclose(g[at], (ends[0] - ends[1]) / 2e-6, rtol=1e-3, atol=1e-5), key


def test_latent_fit_lowers_the_loss(df):
    settings = LatentFit(code=2, hidden=8, clusters=3, gamma_rounds=5, init_steps=1, beta_rounds=1, static_rounds=1,
                         batch_size=16, rate=0.01, max_iter=10)
    out = fit_latent(df, "z_mu", "id", settings)
    assert out.losses[4] < 0.7 * out.losses[0]
    assert out.model.k == 3 and out.model.dim == 2 and len(out.losses) == 7
    with pytest.raises(ValueError):
        initial_weights(10**6, LatentFit(2, 10**6, 3, 1, 1, 1, 1))


def test_sums_of_many_blocks(spark):
    """More numbers than a block holds, over several tasks; a task shuffles a row for each block and no more."""
    k, d, n = 40, 2500, 24
    centres = np.arange(k * d, dtype=float).reshape(k, d) * 1e-3
    rng = np.random.default_rng(5)
    x = centres[rng.integers(0, k, n)] + rng.normal(size=(n, d)) * 1e-4
    df = spark.createDataFrame([(row.tolist(),) for row in x], "v array<double>").repartition(3)
    sums = fitting.partition_sums(df, ["v"], fitting._cluster_sums(centres, second=True))
    label = ((x[:, None, :] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
    for name, power in (("s1", 1), ("s2", 2)):
        want = np.zeros((k, d))
        np.add.at(want, label, (x - centres[label]) ** power)
        np.testing.assert_allclose(sums[name].reshape(k, d), want, atol=1e-12)
    np.testing.assert_array_equal(sums["n"], np.bincount(label, minlength=k))
    blocks = sum(-(-len(v) // fitting.BLOCK_NUMBERS) for v in sums.values())
    assert fitting.parts_batch(sums).num_rows == blocks
    assert fitting.partition_sums(df.limit(0), ["v"], fitting._cluster_sums(centres, second=True)) == {}
