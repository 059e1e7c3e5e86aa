"""Data-parallel training of a dense latent network together with its mixture.

One round is one Spark job: every task starts from the same weights, takes mini-batch steps on its own rows, and
returns its weights times its row count; a DataFrame aggregate averages them. The average of locally trained weights is
not the sequence of steps one machine would take, so losses are to be checked, not weights. Hidden layers are dense.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mixframe.functions import arrow, mixture
from mixframe.functions.hashing import normals, row_seed
from mixframe.model import Mixture, vector_width
from mixframe.operators.dense import DenseCoder
from mixframe.operators.finetune import Optimizer, responsibility
from mixframe.operators.fitting import PARTS, added_parts, diag_gmm, init_sample, kmeans, momentum_update, parts_batch
from mixframe.operators.network import MAX_WEIGHTS, elu
from mixframe.session import cut
from mixframe.sinks.step_log import StepLog

Weights = dict[str, np.ndarray]
MIXTURE_KEYS = ("pi", "mu", "var")
POSITIVE_KEYS = ("pi", "var")


@dataclass(frozen=True)
class LatentFit:
    """Sizes, rounds of each phase, and step settings.

    A step of a mixture weight or variance that would end at or below zero goes half of the way there instead. Local steps
    grow in number with the rows of a task, and a variance of few times the rate meets such a step sooner or later; the loss
    rises without bound towards zero, so later gradients lead away from it. All other steps are taken as they are.
    """

    code: int
    hidden: int
    clusters: int
    gamma_rounds: int
    init_steps: float
    beta_rounds: int
    static_rounds: int
    cycles: int = 1
    batch_size: int = 128
    gamma: float = 5e-4
    rate: float = 2e-3
    noise: float = 1e-8
    optimizer: str = "Adam"
    seed: int = 0
    max_iter: int = 10000
    restarts: int = 10

    def rounds(self) -> list[tuple[str, float]]:
        """Phase and loss weight of every round."""
        ramp = [("beta", (i / self.beta_rounds) ** 3 + self.gamma) for i in range(1, self.beta_rounds + 1)]
        cycle = ramp + [("static", 1.0)] * self.static_rounds
        return [("gamma", self.gamma)] * self.gamma_rounds + cycle * self.cycles


@dataclass(frozen=True, eq=False)
class FittedLatent:
    """Network weights, the mixture, the mean training loss of every round, and its number of shortened steps.

    ``shortened`` counts weights and variances, over all tasks: many of them say that the rate is too high.
    """

    weights: Weights
    model: Mixture
    losses: list[float]
    shortened: list[int] = field(default_factory=list)


def initial_weights(inputs: int, settings: LatentFit) -> Weights:
    rng = np.random.default_rng(settings.seed)
    sizes = {
        "enc": (inputs, settings.hidden),
        "mean": (settings.hidden, settings.code),
        "logvar": (settings.hidden, settings.code),
        "dec": (settings.code, settings.hidden),
        "out": (settings.hidden, inputs),
    }
    if sum(a * b + b for a, b in sizes.values()) > MAX_WEIGHTS:
        raise ValueError(f"more than {MAX_WEIGHTS} weights")
    weights: Weights = {}
    for name, (rows, cols) in sizes.items():
        limit = np.sqrt(6.0 / (rows + cols))
        weights[f"{name}_w"] = rng.uniform(-limit, limit, (rows, cols))
        weights[f"{name}_b"] = np.zeros(cols)
    return weights


def _encode(x: np.ndarray, w: Weights) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    h = elu(x @ w["enc_w"] + w["enc_b"])
    return h, h @ w["mean_w"] + w["mean_b"], h @ w["logvar_w"] + w["logvar_b"]


def encode_dense(df: DataFrame, col: str, weights: Weights) -> DataFrame:
    """``df`` with ``z_mu`` and ``z_sigma`` of a dense network."""
    inputs = weights["enc_w"].shape[0]

    def both(values: pa.Array) -> pa.Array:
        _, mean, log_variance = _encode(arrow.matrix(values, inputs), weights)
        return pa.StructArray.from_arrays([arrow.lists(mean), arrow.lists(log_variance)], names=["z_mu", "z_sigma"])

    coded = df.withColumn(
        "__latent", arrow.row_function(both, "struct<z_mu: array<double>, z_sigma: array<double>>")(F.col(col))
    )
    kept = [c for c in df.columns if c not in ("z_mu", "z_sigma")]
    return coded.select(*kept, "__latent.z_mu", "__latent.z_sigma")


def trained_coder(fit: FittedLatent, frame: tuple[int, int, int] | None = None) -> DenseCoder:
    """The trained network for ``encode``, ``decode`` and the plans; without a frame its input is one row of pixels."""
    return DenseCoder(fit.weights, frame or (1, fit.weights["enc_w"].shape[0], 1))


def mixture_gradient(z: np.ndarray, log_variance: np.ndarray, model: Mixture) -> tuple[float, Weights]:
    """Mixture latent loss of one mini-batch and its gradient by codes (``z``, ``s``) and by the mixture."""
    rows = len(z)
    negated = -mixture.log_prob_matrix(z, model, with_weights=True)
    low, high = negated.min(), negated.max()
    r = responsibility(z, log_variance, model, low, high)
    a, g = r.by_joint / rows, r.gamma / rows
    pull = -mixture.SCALE * (r.by_p * r.offset).sum() / rows / (high - low + mixture.RANGE_GUARD) ** 2
    a[np.unravel_index(negated.argmin(), negated.shape)] += pull
    a[np.unravel_index(negated.argmax(), negated.shape)] -= pull
    inverse = 1.0 / model.variances
    spread = np.exp(log_variance)
    gradient = {
        "z": np.zeros(z.shape),
        "s": -0.5 / rows + 0.5 * spread * (g @ inverse),
        "pi": (a - g).sum(axis=0) / model.weights,
        "mu": np.zeros(model.means.shape),
        "var": np.zeros(model.means.shape),
    }
    for k in range(model.k):
        delta = z - model.means[k]
        scaled = (a - g)[:, [k]] * delta * inverse[k]
        gradient["z"] -= scaled
        gradient["mu"][k] = scaled.sum(axis=0)
        ratio = delta * delta * inverse[k]
        direct = g[:, [k]] * (1.0 - ratio - spread * inverse[k])
        gradient["var"][k] = 0.5 * inverse[k] * (a[:, [k]] * (ratio - 1.0) + direct).sum(axis=0)
    return float(r.loss.mean()), gradient


def loss_and_gradient(
    x: np.ndarray, target: np.ndarray, eps: np.ndarray, w: Weights, phase: str, factor: float
) -> tuple[float, Weights]:
    """Loss of a mini-batch in a phase, and its gradient by all weights.

    The warm-up decodes the mean code and adds the weighted divergence from the standard normal; later phases decode
    the drawn code and add the weighted mixture loss.
    """
    rows = len(x)
    h, mean, log_variance = _encode(x, w)
    warm = phase == "gamma"
    deviation = np.exp(log_variance / 2.0)
    code = mean if warm else mean + deviation * eps
    back = elu(code @ w["dec_w"] + w["dec_b"])
    error = back @ w["out_w"] + w["out_b"] - target
    loss = float((error * error).sum() / rows)
    grad: Weights = {}

    by_output = 2.0 * error / rows
    grad["out_w"], grad["out_b"] = back.T @ by_output, by_output.sum(axis=0)
    by_back = (by_output @ w["out_w"].T) * np.where(back > 0, 1.0, back + 1.0)
    grad["dec_w"], grad["dec_b"] = code.T @ by_back, by_back.sum(axis=0)
    by_mean = by_back @ w["dec_w"].T
    if warm:
        by_log_variance = factor * -0.5 * (1.0 - np.exp(log_variance)) / rows
        loss += factor * float(-0.5 * (1.0 + log_variance - mean * mean - np.exp(log_variance)).sum() / rows)
        by_mean = by_mean + factor * mean / rows
    else:
        model = Mixture(w["pi"], w["mu"], w["var"])
        latent, g = mixture_gradient(mean, log_variance, model)
        loss += factor * latent
        by_log_variance = by_mean * eps * 0.5 * deviation + factor * g["s"]
        by_mean = by_mean + factor * g["z"]
        grad |= {key: factor * g[key] for key in MIXTURE_KEYS}
    grad["mean_w"], grad["mean_b"] = h.T @ by_mean, by_mean.sum(axis=0)
    grad["logvar_w"], grad["logvar_b"] = h.T @ by_log_variance, by_log_variance.sum(axis=0)
    by_h = (by_mean @ w["mean_w"].T + by_log_variance @ w["logvar_w"].T) * np.where(h > 0, 1.0, h + 1.0)
    grad["enc_w"], grad["enc_b"] = x.T @ by_h, by_h.sum(axis=0)
    return loss, grad


def shortened_steps(before: Weights, after: Weights) -> int:
    """Let mixture weights and variances that stepped to zero or past it go half of the way; the number of them."""
    found = 0
    for key in POSITIVE_KEYS:
        past = after[key] <= 0
        if past.any():
            after[key] = np.where(past, before[key] / 2.0, after[key])
            found += int(past.sum())
    return found


def _round(rows: DataFrame, col: str, id_col: str, w: Weights, phase: str, factor: float, index: int, s: LatentFit) -> Weights:
    """Weights averaged over the tasks' local steps; key ``loss`` holds the mean loss, ``shortened`` a count."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, rule, count, total, shortened = dict(w), Optimizer(s.optimizer), 0, 0.0, 0
        for batch in batches:
            x_all = arrow.matrix(batch.column(0), w["enc_w"].shape[0]) if batch.num_rows else np.empty((0, 1))
            seeds = batch.column(1).to_numpy(zero_copy_only=False)
            for start in range(0, len(x_all), s.batch_size):
                x, ids = x_all[start : start + s.batch_size], seeds[start : start + s.batch_size]
                noisy = x + s.noise * normals(ids + 1, x.shape[1]) if s.noise else x
                loss, grad = loss_and_gradient(noisy, x, normals(ids, s.code), own, phase, factor)
                stepped = rule.update({key: own[key] for key in grad}, grad, s.rate)
                if phase != "gamma":
                    shortened += shortened_steps(own, stepped)
                    if not all(np.all(stepped[key] > 0) for key in POSITIVE_KEYS):
                        raise ValueError("a step made a mixture weight or variance zero or not a number; lower the rate")
                own |= stepped
                count, total = count + len(x), total + loss * len(x)
        if count:
            sums = {key: count * value.ravel() for key, value in own.items()}
            counted = {"loss": total, "rows": float(count), "shortened": float(shortened)}
            yield parts_batch(sums | {key: np.array([value]) for key, value in counted.items()})

    seeded = rows.select(col, row_seed(id_col, s.seed + index).alias("seed"))
    sums = added_parts(seeded.mapInArrow(local, PARTS))
    if not sums:
        raise ValueError("no rows to train on")
    n = sums.pop("rows")[0]
    loss, shortened = sums.pop("loss")[0] / n, sums.pop("shortened")[0]
    found = {key: (value / n).reshape(w[key].shape) for key, value in sums.items()}
    return found | {"loss": np.array(loss), "shortened": np.array(shortened)}


def fit_latent(df: DataFrame, col: str, id_col: str, settings: LatentFit, log: StepLog | None = None) -> FittedLatent:
    """Warm-up rounds, mixture initialisation on a pooled sample of codes, then annealed and static rounds.

    ``log`` gets loss, loss weight, rate and shortened steps of every round, from the round's own job.
    """
    rows = df.select(id_col, col).persist(StorageLevel.MEMORY_AND_DISK)
    weights = initial_weights(vector_width(rows, col), settings)
    losses: list[float] = []
    shortened: list[int] = []
    model: Mixture | None = None
    for index, (phase, factor) in enumerate(settings.rounds()):
        if phase != "gamma" and model is None:
            model = _initialise(rows, col, id_col, weights, settings)
            weights |= {"pi": model.weights, "mu": model.means, "var": model.variances}
        weights = _round(rows, col, id_col, weights, phase, factor, index, settings)
        losses.append(float(weights.pop("loss")))
        shortened.append(int(weights.pop("shortened")))
        if log is not None:
            log.add(index, loss=losses[-1], anneal_factor=factor, learning_rate=settings.rate, shortened_steps=shortened[-1])
    if log is not None:
        log.flush()
    model = model or _initialise(rows, col, id_col, weights, settings)
    rows.unpersist()
    if "pi" in weights:
        model = replace(model, weights=weights.pop("pi"), means=weights.pop("mu"), variances=weights.pop("var"))
    return FittedLatent(weights, model, losses, shortened)


def _initialise(rows: DataFrame, col: str, id_col: str, weights: Weights, s: LatentFit) -> Mixture:
    pool = init_sample(rows, id_col, s.init_steps, s.batch_size, s.seed)
    codes = cut(encode_dense(pool, col, weights).select("z_mu"))
    centres = kmeans(codes, "z_mu", s.clusters, s.seed, restarts=s.restarts).centres
    fit = diag_gmm(codes, "z_mu", centres, s.max_iter)
    start = Mixture(np.full(s.clusters, 1.0 / s.clusters), centres, np.ones(centres.shape))
    return momentum_update(start, centres, fit.model.variances, s.gamma)
