"""Local steps of the latent fit that would make a mixture weight or variance zero or negative."""

from dataclasses import replace

import numpy as np
import pytest

from mixframe.operators import latent_fit, scoring
from mixframe.operators.latent_fit import LatentFit, fit_latent, initial_weights
from mixframe.operators.network import encode
from mixframe.plans.latent import read_latent, train_latent
from mixframe.session import scratch_path
from mixframe.sinks.step_log import StepLog, read_log

SETTINGS = LatentFit(code=2, hidden=6, clusters=2, gamma_rounds=1, init_steps=1, beta_rounds=1, static_rounds=2, batch_size=32, max_iter=10, rate=0.01)
RNG = np.random.default_rng(4)
X = np.concatenate([RNG.normal(size=(60, 4)) * 0.3 + c for c in (0.0, 1.5)])


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(X)], "id long, x array<float>").repartition(1).cache()


def _narrow(variance):
    """Weights of codes without spread about two centres: every gradient makes the variances smaller."""
    w = initial_weights(4, SETTINGS)
    w["mean_w"][:], w["logvar_w"][:], w["logvar_b"][:] = 0.0, 0.0, -20.0
    return w | {"pi": np.full(2, 0.5), "mu": np.zeros((2, 2)), "var": np.full((2, 2), variance)}


def test_step_past_zero_goes_half_of_the_way(rows):
    whole = replace(SETTINGS, batch_size=len(X))
    found = latent_fit._round(rows, "x", "id", _narrow(0.008), "static", 1.0, 0, whole)
    np.testing.assert_allclose(found["var"], 0.004)
    assert found["shortened"] == 4 and np.isfinite(found["loss"])
    # a step that stays above zero is taken whole
    found = latent_fit._round(rows, "x", "id", _narrow(0.012), "static", 1.0, 0, whole)
    np.testing.assert_allclose(found["var"], 0.002, rtol=1e-4)
    assert found["shortened"] == 0


def test_fit_goes_on_after_steps_past_zero(rows):
    fit = fit_latent(rows, "x", "id", replace(SETTINGS, rate=0.2))
    assert sum(fit.shortened) > 0 and len(fit.shortened) == len(fit.losses) == 4
    assert np.all(np.isfinite(fit.losses)) and np.all(fit.model.variances > 0) and np.all(fit.model.weights > 0)
    assert fit_latent(rows, "x", "id", SETTINGS).shortened == [0, 0, 0, 0]


def test_step_that_is_no_number_is_still_an_error(rows):
    w = _narrow(0.5)
    w["logvar_b"][:] = np.nan
    with pytest.raises(Exception, match="not a number"):
        latent_fit._round(rows, "x", "id", w, "static", 1.0, 0, SETTINGS)


def test_trained_after_steps_past_zero_is_published_and_used(spark, rows):
    folder = scratch_path(spark, "models")
    log = StepLog(spark, f"{folder}-log", "run")
    version = train_latent(rows, "x", "id", replace(SETTINGS, rate=0.2), folder, (2, 2, 1), log)
    assert sum(r.value for r in read_log(spark, f"{folder}-log").where("name = 'shortened_steps'").collect()) > 0
    coder, model = read_latent(spark, folder, version)
    found = scoring.predict(encode(rows, coder, "x"), model, ["id"], z=None).select("id", "gamma", "assignments").collect()
    assert sorted(r["id"] for r in found) == list(range(len(X)))
    assert all(np.isclose(sum(r["gamma"]), 1.0) and 0 <= r["assignments"] < 2 for r in found)
