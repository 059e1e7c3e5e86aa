"""Gradient steps on the mixture parameters with the latent codes held fixed."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mixframe.functions import arrow, mixture
from mixframe.model import Mixture
from mixframe.operators.batch_store import BatchStore
from mixframe.operators.fitting import Sums, partition_sums
from mixframe.sinks.step_log import StepLog

# Constants of the four update rules.
ADAM_BETA_1, ADAM_BETA_2, ADAM_EPSILON = 0.9, 0.999, 1e-8
ADAGRAD_START = 0.1
RMSPROP_DECAY, RMSPROP_START, RMSPROP_EPSILON = 0.9, 1.0, 1e-10
OPTIMIZERS = ("Adagrad", "Adam", "RMSProp", "SGD")

Gradients = dict[str, np.ndarray]


@dataclass
class Optimizer:
    """Update rule over named arrays; keeps its running moments between steps."""

    name: str = "Adam"
    steps: int = 0
    moments: dict[str, list[np.ndarray]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.name not in OPTIMIZERS:
            raise ValueError(f"unknown optimizer {self.name!r}")

    def update(self, values: Gradients, gradients: Gradients, rate: float) -> Gradients:
        self.steps += 1
        return {key: values[key] - self._step(key, gradients[key], rate) for key in values}

    def _step(self, key: str, g: np.ndarray, rate: float) -> np.ndarray:
        if self.name == "SGD":
            return rate * g
        if self.name == "Adagrad":
            (total,) = self.moments.setdefault(key, [np.full(g.shape, ADAGRAD_START)])
            total += g * g
            return rate * g / np.sqrt(total)
        if self.name == "RMSProp":
            (square,) = self.moments.setdefault(key, [np.full(g.shape, RMSPROP_START)])
            square += (1.0 - RMSPROP_DECAY) * (g * g - square)
            return rate * g / np.sqrt(square + RMSPROP_EPSILON)
        first, second = self.moments.setdefault(key, [np.zeros(g.shape), np.zeros(g.shape)])
        first += (1.0 - ADAM_BETA_1) * (g - first)
        second += (1.0 - ADAM_BETA_2) * (g * g - second)
        corrected = rate * math.sqrt(1.0 - ADAM_BETA_2**self.steps) / (1.0 - ADAM_BETA_1**self.steps)
        return corrected * first / (np.sqrt(second) + ADAM_EPSILON)


@dataclass(frozen=True, eq=False)
class Responsibility:
    """Per-row quantities of the latent loss for a batch whose negated joint spans [low, high]."""

    gamma: np.ndarray
    loss: np.ndarray
    by_p: np.ndarray
    by_joint: np.ndarray
    offset: np.ndarray


def responsibility(
    z: np.ndarray, log_variance: np.ndarray, model: Mixture, low: float, high: float
) -> Responsibility:
    """Soft assignment, loss, and the loss's derivatives by the rescaled joint and by the joint (not yet / rows)."""
    span = high - low + mixture.RANGE_GUARD
    joint = mixture.log_prob_matrix(z, model, with_weights=True)
    offset = -joint - low
    gamma = mixture.softmax(offset / span * mixture.SCALE)
    log_gamma = np.log(np.maximum(gamma, np.finfo(np.float64).tiny))
    inverse = 1.0 / model.variances
    spread = np.exp(log_variance)
    constant = np.log(model.variances).sum(axis=1) + model.dim * model.dim * mixture.LOG_2PI
    quadratic = np.empty(gamma.shape)
    for k in range(model.k):
        delta = z - model.means[k]
        quadratic[:, k] = (delta * delta + spread) @ inverse[k] + constant[k]
    by_gamma = -np.log(model.weights) + log_gamma + 1.0 + 0.5 * quadratic
    by_p = gamma * (by_gamma - (gamma * by_gamma).sum(axis=1, keepdims=True))
    row_loss = -0.5 * (1.0 + log_variance).sum(axis=1) + (gamma * (by_gamma - 1.0)).sum(axis=1)
    return Responsibility(gamma, row_loss, by_p, -mixture.SCALE / span * by_p, offset)


def _gradient_sums(
    model: Mixture, low: float, high: float, through_gamma: bool
) -> Callable[[list[pa.Array]], Sums]:
    def reduce(columns: list[pa.Array]) -> Sums:
        z, s = arrow.matrix(columns[0], model.dim), arrow.matrix(columns[1], model.dim)
        shape = (model.k, model.dim)
        names = ("a1", "a2", "g1", "g2")
        sums: Sums = {name: np.zeros(shape) for name in names}
        sums |= {"a0": np.zeros(model.k), "g0": np.zeros(model.k), "scalars": np.zeros(3)}
        for part in arrow.blocks(len(z), model.dim):
            r = responsibility(z[part], s[part], model, low, high)
            a = r.by_joint if through_gamma else np.zeros(r.by_joint.shape)
            spread = np.exp(s[part])
            sums["a0"] += a.sum(axis=0)
            sums["g0"] += r.gamma.sum(axis=0)
            sums["scalars"] += [len(r.loss), r.loss.sum(), (r.by_p * r.offset).sum()]
            for k in range(model.k):
                delta = z[part] - model.means[k]
                square = delta * delta
                sums["a1"][k] += a[:, k] @ delta
                sums["a2"][k] += a[:, k] @ square
                sums["g1"][k] += r.gamma[:, k] @ delta
                sums["g2"][k] += r.gamma[:, k] @ (square + spread)
        return sums

    return reduce


def _extremes(df: DataFrame, model: Mixture, z_mu: str) -> dict[str, object]:
    """Range of the negated joint over rows and components, and the rows and components where it is reached."""
    joint = df.select(F.col(z_mu).alias("z"), mixture.log_prob(z_mu, model, with_weights=True).alias("j"))
    best, worst = F.array_max("j"), F.array_min("j")
    found = joint.agg(
        F.max(best).alias("best"),
        F.min(worst).alias("worst"),
        F.max_by(F.struct("z", (F.array_position("j", best) - 1).alias("k")), best).alias("at_best"),
        F.min_by(F.struct("z", (F.array_position("j", worst) - 1).alias("k")), worst).alias("at_worst"),
    ).first()
    if found["best"] is None:
        raise ValueError("no rows to take a gradient on")
    return found.asDict()


def latent_loss_gradient(
    df: DataFrame, model: Mixture, z_mu: str = "z_mu", z_sigma: str = "z_sigma", through_gamma: bool = True
) -> tuple[float, Gradients]:
    """Mixture latent loss of the table as one batch, and its gradient by weights, centres and variances.

    Two jobs: the range of the joint, then the sums. With ``through_gamma`` the responsibilities are differentiated
    too, through the softmax and the rescaling with its two extreme elements; without it they are held constant, as in
    expectation-maximisation.
    """
    ends = _extremes(df, model, z_mu)
    low, high = -ends["best"], -ends["worst"]
    span = high - low + mixture.RANGE_GUARD
    sums = partition_sums(df, [z_mu, z_sigma], _gradient_sums(model, low, high, through_gamma))
    rows, loss, leverage = sums["scalars"]
    shape = model.means.shape
    a0, a1, a2 = sums["a0"], sums["a1"].reshape(shape), sums["a2"].reshape(shape)
    g0, g1, g2 = sums["g0"], sums["g1"].reshape(shape), sums["g2"].reshape(shape)
    if through_gamma:
        # the derivative by the two ends of the range falls on the elements that attain them
        pull = -mixture.SCALE * leverage / span**2
        for at, weight in (("at_best", pull), ("at_worst", -pull)):
            k = int(ends[at]["k"])
            delta = np.asarray(ends[at]["z"], dtype=np.float64) - model.means[k]
            a0[k] += weight
            a1[k] += weight * delta
            a2[k] += weight * delta * delta
    inverse = 1.0 / model.variances
    half_square = 0.5 * inverse * inverse
    gradient = {
        "pi": (a0 - g0) / model.weights,
        "mu": (a1 - g1) * inverse,
        "var": (a2 - g2) * half_square + 0.5 * inverse * (g0 - a0)[:, None],
    }
    return float(loss / rows), {key: value / rows for key, value in gradient.items()}


def finetune_mixture(
    df: DataFrame | BatchStore,
    model: Mixture,
    weights: list[float],
    rates: list[float],
    optimizer: str | Optimizer = "Adam",
    z_mu: str = "z_mu",
    z_sigma: str = "z_sigma",
    through_gamma: bool = True,
    batch_col: str | None = None,
    log: StepLog | None = None,
) -> tuple[Mixture, list[float]]:
    """One gradient step for each entry of ``weights`` (the loss weight: anneal factor, or 1) and ``rates``.

    A step uses the whole table, or with ``batch_col`` the next of its consecutive batch ids. Persist ``df`` when
    there are several steps. A ``BatchStore`` in place of the table gives each step its batch without a scan of the others.
    Returns the model and the unweighted loss before each step; ``log`` gets loss, weight and rate of each step.
    """
    if len(weights) != len(rates):
        raise ValueError("one loss weight and one learning rate are needed for each step")
    rule = Optimizer(optimizer) if isinstance(optimizer, str) else optimizer
    batches = None
    if batch_col is not None and not isinstance(df, BatchStore):
        batches = int(df.agg(F.max(batch_col)).first()[0]) + 1
    history: list[float] = []
    for step, (weight, rate) in enumerate(zip(weights, rates, strict=True)):
        if isinstance(df, BatchStore):
            rows = df.step(step)
        else:
            rows = df if batches is None else df.filter(F.col(batch_col) == step % batches)
        loss, gradient = latent_loss_gradient(rows, model, z_mu, z_sigma, through_gamma)
        history.append(loss)
        if log is not None:
            log.add(step, latent_loss=loss, anneal_factor=weight, anneal_loss=weight * loss, learning_rate=rate)
        values = {"pi": model.weights, "mu": model.means, "var": model.variances}
        updated = rule.update(values, {key: weight * g for key, g in gradient.items()}, rate)
        model = Mixture(updated["pi"], updated["mu"], updated["var"])
    if log is not None:
        log.flush()
    return model, history
