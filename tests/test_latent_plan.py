"""Train, publish, read, predict, evaluate; and what is not read."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from mixframe.catalog.tables import column
from mixframe.config import TableConfig
from mixframe.functions.mixture import log_prob_matrix
from mixframe.model import Mixture
from mixframe.operators.dense import DenseCoder
from mixframe.operators.latent_fit import LatentFit, encode_dense, fit_latent, trained_coder
from mixframe.operators.network import decode, encode
from mixframe.plans.evaluation import evaluate_rows
from mixframe.plans.latent import read_latent, train_latent
from mixframe.plans.prediction import predict_dataset
from mixframe.session import scratch_path
from mixframe.sinks import model_store
from mixframe.sinks.step_log import StepLog, read_log

RNG = np.random.default_rng(2)
SETTINGS = LatentFit(code=2, hidden=6, clusters=2, gamma_rounds=2, init_steps=1, beta_rounds=1, static_rounds=1, batch_size=32, max_iter=10, rate=0.01)
X = np.concatenate([RNG.normal(size=(60, 4)) * 0.3 + c for c in (0.0, 1.5)])


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(X)], "id long, x array<float>").repartition(3).cache()


@pytest.fixture(scope="module")
def published(spark, rows):
    folder = scratch_path(spark, "models")
    log = StepLog(spark, f"{folder}-log", "run")
    assert train_latent(rows, "x", "id", SETTINGS, folder, (2, 2, 1), log) == 1
    assert read_log(spark, f"{folder}-log").where("name = 'loss'").count() == 4
    return folder


def test_a_published_network_predicts_and_evaluates(spark, rows, published):
    coder, model = read_latent(spark, published)
    folder = scratch_path(spark, "split")
    rows.write.parquet(f"{folder}/test")
    config = TableConfig.from_dict({"idCols": ["id"], "featureColumns": [column("id", "INTEGER"), column("x", "FLOAT", [4])]})
    config = TableConfig(config.columns, config.ids, config.labels, paths={"test": f"{folder}/test"})
    predictions = predict_dataset(spark, config, coder, model, (2, 2))
    assert predictions.columns == ["id", "z_mu", "z_sigma", "z", "gamma", "assignments"]
    coded = decode(encode(rows, coder), coder)
    x = np.array(X, np.float32).astype(float)
    mean, log_variance = coder.encode_rows(x)
    found = {r.id: r for r in coded.collect()}
    assert np.allclose([found[i].z_mu for i in range(len(x))], mean) and np.allclose([found[i].z_sigma for i in range(len(x))], log_variance)
    assert np.allclose([found[i].xhat for i in range(len(x))], coder.decode_rows(mean))
    labels = log_prob_matrix(mean, model, True).argmax(axis=1)
    assert [r.assignments for r in predictions.orderBy("id").collect()] == labels.tolist()
    record = evaluate_rows(rows, config, coder, model, (2, 2), decode_mean=True).first()
    assert np.isclose(record.mean_squared_error, ((coder.decode_rows(mean) - x) ** 2).mean())
    # the decoder's output as logits, as they are and mapped to a range
    logits = coder.decode_rows(mean)
    latent = record.loss - 4 * record.mean_squared_error
    for top in (None, 50.0):
        used = logits if top is None else (logits - logits.min()) / (logits.max() - logits.min() + 1e-12) * top
        entropy = (np.maximum(used, 0) - used * x + np.log1p(np.exp(-np.abs(used)))).mean()
        other = evaluate_rows(rows, config, coder, model, (2, 2), decode_mean=True, sigmoid=True, logit_range=top).first()
        assert np.isclose(other.loss - latent, entropy, rtol=1e-6)
    same = {r.id: r.z_mu for r in encode_dense(rows, "x", coder.weights).collect()}
    assert np.allclose([same[i] for i in range(len(x))], mean)


def test_versions_are_published_as_a_whole(spark, published):
    coder, model = read_latent(spark, published, 1)
    weights = {name: w + 1 for name, w in coder.weights.items()}
    assert model_store.save(spark, published, weights, model, {"frame": [2, 2, 1]}) == 2
    assert model_store.versions(spark, published) == [1, 2]
    assert np.array_equal(read_latent(spark, published)[0].weights["enc_w"], weights["enc_w"])
    assert np.array_equal(read_latent(spark, published, 1)[0].weights["enc_w"], coder.weights["enc_w"])
    # tables without a manifest, and a manifest that is not yet in place, are not versions
    model_store.weight_blocks(spark, weights).write.parquet(f"{published}/data/half/weights")
    spark.range(1).select(F.lit("{").alias("value")).write.text(f"{published}/manifests/3.json.abc.tmp")
    assert model_store.versions(spark, published) == [1, 2]
    with pytest.raises(ValueError, match="no published version 3"):
        read_latent(spark, published, 3)
    with pytest.raises(ValueError, match="no published version"):
        model_store.load(spark, scratch_path(spark, "none"))


def test_a_manifest_that_does_not_fit_its_tables_is_refused(spark, published):
    folder = scratch_path(spark, "models")
    model_store.save(spark, folder, {"a": np.zeros(3)}, Mixture(np.ones(1), np.zeros((1, 2)), np.ones((1, 2))))
    text = json.loads(spark.read.text(f"{folder}/manifests/1.json").first()[0]) | {"blocks": 7}
    assert model_store._publish(spark, f"{folder}/manifests/2.json", json.dumps(text))
    assert not model_store._publish(spark, f"{folder}/manifests/2.json", "{}")
    with pytest.raises(ValueError, match="does not hold"):
        model_store.load(spark, folder)


def test_weights_of_many_blocks_come_back(spark):
    weights = {"big": RNG.normal(size=(130, 70)), "one": np.array([2.5]), "none": np.zeros((0, 3))}
    back = model_store.weights_of(model_store.weight_blocks(spark, weights).repartition(4))
    assert all(np.array_equal(back[n], w) and back[n].shape == w.shape for n, w in weights.items())
    with pytest.raises(ValueError, match="more than"):
        model_store.weights_of(model_store.weight_blocks(spark, {f"w{i}": np.zeros(1) for i in range(10_002)}), limit=1)


def test_dense_coder_checks_its_shapes(rows):
    fit = fit_latent(rows, "x", "id", SETTINGS)
    assert trained_coder(fit).frame == (1, 4, 1)
    with pytest.raises(ValueError, match="frame"):
        trained_coder(fit, (3, 3, 1))
    with pytest.raises(ValueError, match="missing"):
        DenseCoder({"enc_w": np.zeros((4, 2))}, (1, 4, 1))
    with pytest.raises(ValueError, match="bias"):
        DenseCoder(fit.weights | {"dec_b": np.zeros(1)}, (1, 4, 1))
