"""Fitting the mixture: pooled sample, k-means, diagonal expectation-maximisation and the momentum blend.

Every round is one Spark job. A task reduces its rows to K * D sums, the sums are added block by block after a shuffle, and
only they reach the driver; the next round starts from literals, so the lineage never grows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mixframe.functions import arrow
from mixframe.functions.mixture import log_prob_matrix
from mixframe.functions.vectors import doubles
from mixframe.model import Mixture, ModelLike, check_parameter_count
from mixframe.operators.batching import first_shuffled_rows

# Defaults of the expectation-maximisation, and the unit of a fractional number of pooled batches.
MAX_ITER = 10000
TOLERANCE = 1e-3
VARIANCE_FLOOR = 1e-6
FRACTION_ROWS = 256

Sums = dict[str, np.ndarray]
PARTS = "name string, block int, parts array<double>"
#: Numbers in one row of a task's sums.
BLOCK_NUMBERS = 4096


def init_sample(
    df: DataFrame, id_col: str, init_steps: float, batch_size: int, seed: int = 0
) -> DataFrame:
    """The pooled rows the mixture is initialised from: ``init_steps`` shuffled batches.

    A fraction below one takes that share of 256 rows, at least one, of a single batch. Other fractions round up.
    """
    if init_steps < 1:
        rows = min(batch_size, max(1, int(init_steps * FRACTION_ROWS)))
    else:
        rows = math.ceil(init_steps) * batch_size
    return first_shuffled_rows(df, id_col, rows, seed)


def parts_batch(arrays: Sums) -> pa.RecordBatch:
    """Named flat arrays as rows ``(name, block, parts)`` of up to ``BLOCK_NUMBERS`` numbers."""
    rows = [
        (name, block, values[at : at + BLOCK_NUMBERS])
        for name, values in arrays.items()
        for block, at in enumerate(range(0, len(values), BLOCK_NUMBERS))
    ]
    names, blocks, parts = zip(*rows, strict=True) if rows else ((), (), ())
    columns = [pa.array(names, pa.string()), pa.array(blocks, pa.int32()), pa.array(parts, pa.list_(pa.float64()))]
    return pa.RecordBatch.from_arrays(columns, names=["name", "block", "parts"])


def partition_sums(df: DataFrame, columns: list[str], reduce: Callable[[list[pa.Array]], Sums]) -> Sums:
    """Sum named arrays over all rows: ``reduce`` turns one Arrow batch into arrays, tasks add theirs up first.

    A task emits a few blocks for each name, whatever its number of rows, so a hot partition costs no more to combine.
    """

    def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Sums = {}
        for batch in batches:
            if batch.num_rows:
                for name, values in reduce([batch.column(c) for c in columns]).items():
                    flat = np.asarray(values, dtype=np.float64).ravel()
                    total[name] = total[name] + flat if name in total else flat
        yield parts_batch(total)

    return added_parts(df.select(*columns).mapInArrow(reduced, PARTS))


def _add_blocks(total: dict[tuple[str, int], np.ndarray], batch: pa.RecordBatch) -> None:
    """Add the rows of ``PARTS`` to ``total``, which has one array for each name and block."""
    parts = batch.column("parts")
    flat = parts.flatten().to_numpy(zero_copy_only=False)
    ends = np.cumsum(pc.list_value_length(parts).to_numpy(zero_copy_only=False))
    for name, block, own in zip(
        batch.column("name").to_pylist(), batch.column("block").to_pylist(), np.split(flat, ends[:-1]), strict=True
    ):
        key = (name, block)
        if key in total:
            total[key] += own
        else:
            total[key] = own.copy()


def _added_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[tuple[str, int], np.ndarray] = {}
    for batch in batches:
        if batch.num_rows:
            _add_blocks(total, batch)
    for (name, block), parts in total.items():
        columns = [pa.array([name]), pa.array([block], pa.int32()), pa.array([parts], pa.list_(pa.float64()))]
        yield pa.RecordBatch.from_arrays(columns, names=["name", "block", "parts"])


def added_parts(partial: DataFrame) -> Sums:
    """Element-wise sums of rows ``(name, block, parts)``; as many numbers reach the driver as one task emitted.

    Blocks meet by one shuffle and are added as they stream in: a reducer holds one array for each of its blocks.
    """
    total: dict[tuple[str, int], np.ndarray] = {}
    for batch in partial.repartition("name", "block").mapInArrow(_added_blocks, PARTS).toArrow().to_batches():
        if batch.num_rows:
            _add_blocks(total, batch)
    names = sorted({name for name, _ in total})
    return {name: np.concatenate([total[key] for key in sorted(total) if key[0] == name]) for name in names}


def _stored(df: DataFrame, vector: str, rounds: int) -> tuple[DataFrame, Callable[[], object]]:
    """The vectors alone, kept between rounds when there is more than one."""
    vectors = df.select(vector)
    if rounds > 1:
        vectors = vectors.persist(StorageLevel.MEMORY_AND_DISK)
    return vectors, vectors.unpersist


def nearest_centre(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest centre (lowest on a tie) and its squared distance."""
    squared = np.empty((len(x), len(centres)))
    for part in arrow.blocks(len(x), x.shape[1]):
        for k, centre in enumerate(centres):
            delta = x[part] - centre
            squared[part, k] = np.einsum("ij,ij->i", delta, delta)
    label = squared.argmin(axis=1)
    return label, squared[np.arange(len(x)), label]


def _cluster_sums(centres: np.ndarray, second: bool) -> Callable[[list[pa.Array]], Sums]:
    """Count, and sum and square sum of the offsets from the nearest centre, for each centre."""
    k, d = centres.shape

    def reduce(columns: list[pa.Array]) -> Sums:
        x = arrow.matrix(columns[0], d)
        label, squared = nearest_centre(x, centres)
        order = np.argsort(label, kind="stable")
        offsets = x[order] - centres[label[order]]
        n = np.bincount(label, minlength=k)
        used = np.flatnonzero(n)
        starts = (np.cumsum(n) - n)[used]
        sums = {"n": n.astype(np.float64), "s1": np.zeros((k, d)), "cost": np.array([squared.sum()])}
        sums["s1"][used] = np.add.reduceat(offsets, starts, axis=0)
        if second:
            sums["s2"] = np.zeros((k, d))
            sums["s2"][used] = np.add.reduceat(offsets * offsets, starts, axis=0)
        return sums

    return reduce


@dataclass(frozen=True, eq=False)
class Clustering:
    """Centres (K x D) and the summed squared distance of the rows to the centres of the last round's start."""

    centres: np.ndarray
    cost: float


def lloyd(
    df: DataFrame, vector: str, centres: np.ndarray, rounds: int = 1, tolerance: float | None = None
) -> Clustering:
    """K-means rounds from given centres; a cluster that loses all rows keeps its centre.

    Stops early when no centre coordinate moves by more than ``tolerance``.
    """
    centres = np.array(centres, dtype=np.float64)
    check_parameter_count(*centres.shape)
    rows, release = _stored(df, vector, rounds)
    cost = math.nan
    for _ in range(rounds):
        sums = partition_sums(rows, [vector], _cluster_sums(centres, second=False))
        if not sums:
            break
        n = sums["n"][:, None]
        step = sums["s1"].reshape(centres.shape) / np.where(n > 0, n, 1.0)
        centres, cost = centres + step, float(sums["cost"][0])
        if tolerance is not None and np.abs(step).max() <= tolerance:
            break
    release()
    return Clustering(centres, cost)


def kmeans(
    df: DataFrame,
    vector: str,
    k: int,
    seed: int = 0,
    max_iter: int = 300,
    restarts: int = 10,
    parallelism: int = 4,
) -> Clustering:
    """K-means from scratch with Spark ML, best of several seeds; ``parallelism`` of them run at a time."""
    rows = df.select(array_to_vector(doubles(vector)).alias("features")).persist(StorageLevel.MEMORY_AND_DISK)

    @inheritable_thread_target(df.sparkSession)
    def fit(restart: int) -> Clustering:
        fitted = KMeans(k=k, seed=seed + restart, maxIter=max_iter, tol=1e-4).fit(rows)
        return Clustering(np.array([c.tolist() for c in fitted.clusterCenters()]), float(fitted.summary.trainingCost))

    with ThreadPool(max(1, min(parallelism, restarts))) as pool:
        found = pool.map(fit, range(max(1, restarts)))
    rows.unpersist()
    return min(found, key=lambda clustering: clustering.cost)


def _em_sums(model: Mixture) -> Callable[[list[pa.Array]], Sums]:
    """Weighted count, offsets and squared offsets from the current centres, and the log-likelihood."""

    def reduce(columns: list[pa.Array]) -> Sums:
        x = arrow.matrix(columns[0], model.dim)
        joint = log_prob_matrix(x, model, with_weights=True)
        top = joint.max(axis=1, keepdims=True)
        weight = np.exp(joint - top)
        total = weight.sum(axis=1, keepdims=True)
        weight /= total
        s1, s2 = np.zeros(model.means.shape), np.zeros(model.means.shape)
        for part in arrow.blocks(len(x), model.dim):
            for j in range(model.k):
                delta = x[part] - model.means[j]
                s1[j] += weight[part, j] @ delta
                s2[j] += weight[part, j] @ (delta * delta)
        likelihood = float((top + np.log(total)).sum())
        return {"n": weight.sum(axis=0), "s1": s1, "s2": s2, "likelihood": np.array([likelihood, len(x)])}

    return reduce


def _components(sums: Sums, origin: np.ndarray, floor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights, means and floored variances from sums of offsets from ``origin``."""
    n = sums["n"] + 10.0 * np.finfo(np.float64).eps
    first = sums["s1"].reshape(origin.shape) / n[:, None]
    second = sums["s2"].reshape(origin.shape) / n[:, None]
    return n / sums["n"].sum(), origin + first, second - first * first + floor


@dataclass(frozen=True, eq=False)
class MixtureFit:
    """A fitted mixture, the mean log-likelihood seen by each round, and whether the rounds converged."""

    model: Mixture
    log_likelihood: list[float]
    converged: bool


def diag_gmm(
    df: DataFrame,
    vector: str,
    means_init: np.ndarray,
    max_iter: int = MAX_ITER,
    tolerance: float | None = TOLERANCE,
    floor: float = VARIANCE_FLOOR,
) -> MixtureFit:
    """Expectation-maximisation of a diagonal mixture from given centres.

    Weights and variances start from the hard assignment to the centres. The rounds stop when the mean log-likelihood
    changes by less than ``tolerance``; ``None`` runs all of them. Each round uses the ordinary log-sum-exp, not the
    rescaled joint.
    """
    origin = np.array(means_init, dtype=np.float64)
    check_parameter_count(*origin.shape)
    rows, release = _stored(df, vector, 2 + max_iter)
    start = partition_sums(rows, [vector], _cluster_sums(origin, second=True))
    if not start:
        raise ValueError("no rows to fit a mixture on")
    weights, _, variances = _components(start, origin, floor)
    model = Mixture(weights, origin, variances)
    history: list[float] = []
    converged = False
    for _ in range(max_iter):
        sums = partition_sums(rows, [vector], _em_sums(model))
        total, count = sums["likelihood"]
        history.append(float(total / count))
        model = Mixture(*_components(sums, model.means, floor))
        if tolerance is not None and len(history) > 1 and abs(history[-1] - history[-2]) < tolerance:
            converged = True
            break
    release()
    return MixtureFit(model, history, converged)


def momentum_update(
    model: ModelLike, centres: np.ndarray, variances: np.ndarray, factor: float, direct: bool = False
) -> Mixture:
    """Blend fresh parameters into a model with weight (1 - factor) ** 3.

    Centres come from k-means and variances from the expectation-maximisation; the mixture weights stay as they are.
    ``direct`` replaces instead of blending.
    """
    old = model if isinstance(model, Mixture) else Mixture.from_table(model)
    m = 1.0 if direct else (1.0 - factor) ** 3
    return Mixture(
        old.weights,
        (1.0 - m) * old.means + m * np.asarray(centres),
        (1.0 - m) * old.variances + m * np.asarray(variances),
    )


def momentum_update_table(model: DataFrame, fresh: DataFrame, factor: float, direct: bool = False) -> DataFrame:
    """The same blend on model tables: ``fresh`` has k, mu and var; K rows on both sides."""
    m = 1.0 if direct else (1.0 - factor) ** 3

    def blend(old: str, new: str) -> F.Column:
        return F.zip_with(old, new, lambda a, b: a * F.lit(1.0 - m) + b * F.lit(m))

    joined = model.alias("o").join(fresh.select("k", F.col("mu").alias("m2"), F.col("var").alias("v2")), "k")
    return joined.select("k", "pi", blend("mu", "m2").alias("mu"), blend("var", "v2").alias("var"))
