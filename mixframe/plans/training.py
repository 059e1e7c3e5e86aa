"""Training of the mixture on latent codes: pool, initialise, then anneal."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame

from mixframe.model import Mixture, vector_width
from mixframe.operators.batch_store import BatchStore, store_batches
from mixframe.operators.batching import id_rank
from mixframe.operators.file_batches import permuted_batches
from mixframe.operators.finetune import Optimizer, finetune_mixture
from mixframe.operators.fitting import diag_gmm, init_sample, kmeans, momentum_update
from mixframe.session import cut
from mixframe.sinks.step_log import StepLog


@dataclass(frozen=True, eq=False)
class Training:
    """The trained mixture, the centres it started from, and the latent loss before each gradient step."""

    model: Mixture
    centres: np.ndarray
    losses: list[float]


def start_model(clusters: int, dim: int, seed: int = 0) -> Mixture:
    """Random parameters before initialisation: truncated normals around 1/K, 0 and 1."""
    # fixed values: standard deviations relative to the mean weight, and of centres and variances
    spread_weight, spread = 0.1, 0.1
    rng = np.random.default_rng(seed)

    def truncated(shape: tuple[int, ...]) -> np.ndarray:
        draw = rng.standard_normal(shape)
        while np.any(np.abs(draw) > 2.0):
            draw = np.where(np.abs(draw) > 2.0, rng.standard_normal(shape), draw)
        return draw

    weights = (1.0 + spread_weight * truncated((clusters,))) / clusters
    return Mixture(weights, spread * truncated((clusters, dim)), 1.0 + spread * truncated((clusters, dim)))


def initialise_mixture(
    df: DataFrame,
    id_col: str,
    model: Mixture,
    init_steps: float,
    batch_size: int,
    z_mu: str = "z_mu",
    gamma: float = 0.0,
    direct: bool = False,
    seed: int = 0,
    max_iter: int = 10000,
) -> Mixture:
    """Fit k-means and a diagonal mixture on the pooled sample and blend them into ``model``.

    The pool is checkpointed: dozens of rounds read it, and a lost executor must not cost the scan that drew it.
    """
    pool = cut(init_sample(df, id_col, init_steps, batch_size, seed).select(z_mu))
    centres = kmeans(pool, z_mu, model.k, seed).centres
    fit = diag_gmm(pool, z_mu, centres, max_iter)
    return momentum_update(model, centres, fit.model.variances, gamma, direct)


def anneal_weights(beta_steps: int, static_steps: int, gamma: float) -> list[float]:
    """Loss weights of one cycle: the cubic ramp, then ones."""
    return [(step / beta_steps) ** 3 + gamma for step in range(1, beta_steps + 1)] + [1.0] * static_steps


def shuffled_store(codes: DataFrame, id_col: str, batch_size: int, steps: int, seed: int = 0) -> BatchStore:
    """The batches of one shuffled pass, as far as ``steps`` steps need them.

    The rows are ranked once; the batch of a row follows from its rank by a permutation.
    """
    rows = codes.count()
    batches = min(steps, max(1, math.ceil(rows / batch_size)))
    ranked = id_rank(codes, [id_col], "__rank")
    batched = permuted_batches(ranked, "__rank", rows, batch_size, 1, seed, "batch_id", first=batches)
    return store_batches(batched.drop("__rank", "epoch"), "batch_id", batches, batch_size)


def train_mixture(
    df: DataFrame,
    id_col: str,
    clusters: int,
    init_steps: float,
    batch_size: int,
    beta_steps: int,
    static_steps: int,
    cycles: int = 1,
    gamma: float = 0.0005,
    rate: float = 1e-4,
    decay: tuple[int, float] | None = None,
    minimum_rate: float = 0.0,
    optimizer: str = "Adam",
    z_mu: str = "z_mu",
    z_sigma: str = "z_sigma",
    direct: bool = False,
    seed: int = 0,
    max_iter: int = 10000,
    mini_batches: bool = False,
    log: StepLog | None = None,
) -> Training:
    """Initialise a mixture on codes that are already encoded, then run annealed and static gradient steps.

    A gradient step is two jobs over the whole table; with ``mini_batches`` over the next batch of a shuffled pass, which is stored
    by batches so that a step reads at most one partition of them. ``log`` gets the scalars of every step.
    """
    codes = df.select(id_col, z_mu, z_sigma).persist(StorageLevel.MEMORY_AND_DISK)
    dim = vector_width(codes, z_mu)
    start = initialise_mixture(
        codes, id_col, start_model(clusters, dim, seed), init_steps, batch_size, z_mu, gamma, direct, seed, max_iter
    )
    weights = anneal_weights(beta_steps, static_steps, gamma) * cycles
    every, factor = decay or (1, 1.0)
    rates = [max(rate * math.pow(factor, step / every), minimum_rate) for step in range(len(weights))]
    source = shuffled_store(codes, id_col, batch_size, len(weights), seed) if mini_batches and weights else codes
    model, losses = finetune_mixture(source, start, weights, rates, Optimizer(optimizer), z_mu, z_sigma, log=log)
    codes.unpersist()
    return Training(model, start.means, losses)
