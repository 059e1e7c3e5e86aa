"""Row-level mixture formulas as Arrow UDF columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from mixframe.functions import arrow
from mixframe.model import Mixture

# Fixed values of the scaled joint: range of the transform and the guard of its denominator.
SCALE = -20.0
RANGE_GUARD = 1e-12
LOG_2PI = float(np.log(2.0 * np.pi))


def log_prob_matrix(z: np.ndarray, model: Mixture, with_weights: bool) -> np.ndarray:
    """N x K log densities, from the plain differences (the expanded square cancels badly for narrow components)."""
    inverse = 1.0 / model.variances
    constant = -0.5 * (model.dim * LOG_2PI + np.log(model.variances).sum(axis=1))
    if with_weights:
        constant = constant + np.log(model.weights)
    out = np.empty((len(z), model.k))
    for part in arrow.blocks(len(z), model.dim):
        rows = z[part]
        for k in range(model.k):
            delta = rows - model.means[k]
            np.multiply(delta, delta, out=delta)
            out[part, k] = constant[k] - 0.5 * (delta @ inverse[k])
    return out


def softmax(p: np.ndarray) -> np.ndarray:
    e = np.exp(p - p.max(axis=1, keepdims=True)) if p.size else p.copy()
    return e / e.sum(axis=1, keepdims=True)


def log_prob(z: str | Column, model: Mixture, with_weights: bool) -> Column:
    def density(values: pa.Array) -> pa.Array:
        return arrow.lists(log_prob_matrix(arrow.matrix(values, model.dim), model, with_weights))

    return arrow.row_function(density, "array<double>", once=True)(F.col(z) if isinstance(z, str) else z)


def scaled(joint: str | Column, low: Column, high: Column) -> Column:
    """Negated joint mapped linearly so that the batch's range becomes [-20, 0]."""

    def rescale(values: pa.Array, lo: pa.Array, hi: pa.Array) -> pa.Array:
        lows, highs = arrow.numbers(lo)[:, None], arrow.numbers(hi)[:, None]
        return arrow.lists((-arrow.matrix(values) - lows) / (highs - lows + RANGE_GUARD) * SCALE)

    return arrow.row_function(rescale, "array<double>", once=True)(F.col(joint) if isinstance(joint, str) else joint, low, high)


def softmax_column(p: str | Column) -> Column:
    def normalise(values: pa.Array) -> pa.Array:
        return arrow.lists(softmax(arrow.matrix(values)))

    return arrow.row_function(normalise, "array<double>", once=True)(F.col(p) if isinstance(p, str) else p)


def rescaled_softmax(joint: str | Column, low: Column, high: Column) -> Column:
    """Rescaled joint and its softmax in one pass, as ``struct<p, gamma>``."""

    def both(values: pa.Array, lo: pa.Array, hi: pa.Array) -> pa.Array:
        lows, highs = arrow.numbers(lo)[:, None], arrow.numbers(hi)[:, None]
        p = (-arrow.matrix(values) - lows) / (highs - lows + RANGE_GUARD) * SCALE
        return pa.StructArray.from_arrays([arrow.lists(p), arrow.lists(softmax(p))], names=["p", "gamma"])

    column = F.col(joint) if isinstance(joint, str) else joint
    return arrow.row_function(both, "struct<p: array<double>, gamma: array<double>>", once=True)(column, low, high)


def negated_range(z: str | Column, model: Mixture) -> Column:
    """Least and greatest negated joint of a row, as ``struct<low, high>``; null for a row with NaN."""

    def bounds(values: pa.Array) -> pa.Array:
        joint = log_prob_matrix(arrow.matrix(values, model.dim), model, with_weights=True)
        low, high = -joint.max(axis=1), -joint.min(axis=1)
        ends = [pa.array(v, mask=np.isnan(v)) for v in (low, high)]
        return pa.StructArray.from_arrays(ends, names=["low", "high"])

    return arrow.row_function(bounds, "struct<low: double, high: double>", once=True)(F.col(z) if isinstance(z, str) else z)


def soft_and_hard(z: str | Column, model: Mixture, low: Column, high: Column) -> Column:
    """Soft and hard assignment of a row in one pass, as ``struct<gamma, assignments>``."""

    def both(values: pa.Array, lo: pa.Array, hi: pa.Array) -> pa.Array:
        joint = log_prob_matrix(arrow.matrix(values, model.dim), model, with_weights=True)
        lows, highs = arrow.numbers(lo)[:, None], arrow.numbers(hi)[:, None]
        gamma = softmax((-joint - lows) / (highs - lows + RANGE_GUARD) * SCALE)
        hard = pa.array(joint.argmax(axis=1).astype(np.int32))
        return pa.StructArray.from_arrays([arrow.lists(gamma), hard], names=["gamma", "assignments"])

    column = F.col(z) if isinstance(z, str) else z
    return arrow.row_function(both, "struct<gamma: array<double>, assignments: int>", once=True)(column, low, high)


def first_argmax(values: str | Column) -> Column:
    """Position of the largest element from 0; the lowest one wins a tie."""
    v = F.col(values) if isinstance(values, str) else values
    return (F.array_position(v, F.array_max(v)) - 1).cast("int")


def distance_matrix(z: np.ndarray, model: Mixture) -> np.ndarray:
    """N x K Euclidean distances to the centres."""
    out = np.empty((len(z), model.k))
    for part in arrow.blocks(len(z), model.dim):
        for k in range(model.k):
            delta = z[part] - model.means[k]
            out[part, k] = np.sqrt(np.einsum("ij,ij->i", delta, delta))
    return out


def distances(z: str | Column, model: Mixture) -> Column:
    """Euclidean distance of a vector to each of the K centres."""

    def euclidean(values: pa.Array) -> pa.Array:
        return arrow.lists(distance_matrix(arrow.matrix(values, model.dim), model))

    return arrow.row_function(euclidean, "array<double>", once=True)(F.col(z) if isinstance(z, str) else z)


def own_and_near(z: str, label: str, model: Mixture, positive_only: bool) -> Column:
    """Distance to the own centre and to the nearest other one, as ``struct<own, near>``.

    With ``positive_only`` a distance of zero to another centre does not count; ``near`` is null when none is left.
    """

    def both(values: pa.Array, labels: pa.Array) -> pa.Array:
        d = distance_matrix(arrow.matrix(values, model.dim), model)
        at = np.arange(len(d)), labels.to_numpy(zero_copy_only=False).astype(np.int64)
        own = d[at]
        d[at] = np.inf
        if positive_only:
            d[d <= 0] = np.inf
        near = d.min(axis=1)
        ends = [pa.array(own), pa.array(near, mask=np.isinf(near))]
        return pa.StructArray.from_arrays(ends, names=["own", "near"])

    return arrow.row_function(both, "struct<own: double, near: double>", once=True)(F.col(z), F.col(label))


def error_sums(x: str, xhat: str) -> Column:
    """Sums over the elements of a row, as ``struct<absolute, squared, product>``."""

    def sums(values: pa.Array, estimates: pa.Array) -> pa.Array:
        a = arrow.matrix(values)
        b = arrow.matrix(estimates, a.shape[1])
        error = a - b
        found = (np.abs(error), error * error, a * b)
        return pa.StructArray.from_arrays(
            [pa.array(f.sum(axis=1)) for f in found], names=["absolute", "squared", "product"]
        )

    kind = "struct<absolute: double, squared: double, product: double>"
    return arrow.row_function(sums, kind, once=True)(F.col(x), F.col(xhat))


def latent_loss_terms(
    z_mu: str, z_sigma: str, gamma: str, model: Mixture, exact: bool = False
) -> Column:
    """Mixture latent loss of one row.

    The normaliser D * log(2 pi) is added for every dimension, D times in total, because the reported values count it
    so; ``exact`` adds it once.
    """
    normaliser = model.dim * LOG_2PI * (1 if exact else model.dim)
    log_var = np.log(model.variances).sum(axis=1)
    inverse = 1.0 / model.variances
    log_weights = np.log(model.weights)

    def loss(mu: pa.Array, log_variance: pa.Array, responsibility: pa.Array) -> pa.Array:
        m, s = arrow.matrix(mu, model.dim), arrow.matrix(log_variance, model.dim)
        g = arrow.matrix(responsibility, model.k)
        quadratic = np.empty(g.shape)
        for part in arrow.blocks(len(m), model.dim):
            spread = np.exp(s[part])
            for k in range(model.k):
                delta = m[part] - model.means[k]
                quadratic[part, k] = (delta * delta + spread) @ inverse[k]
        entropy = np.where(g > 0, g * np.log(np.where(g > 0, g, 1.0)), 0.0)
        value = -0.5 * (1.0 + s).sum(axis=1) - g @ log_weights + entropy.sum(axis=1)
        return pa.array(value + 0.5 * (g * (quadratic + log_var + normaliser)).sum(axis=1))

    return arrow.row_function(loss, "double", once=True)(F.col(z_mu), F.col(z_sigma), F.col(gamma))
