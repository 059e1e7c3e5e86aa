"""Losses: one-row tables, so that they compose as scalar subqueries and never as joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mixframe.functions import mixture
from mixframe.functions.vectors import elements
from mixframe.model import ModelLike, as_mixture
from mixframe.operators.lookup import lookup_join
from mixframe.operators.runs import Aligned, by_batch

# The series variant scales its logits to [0, 50], and its mixture loss by 0.02.
LOGIT_RANGE = 50.0
SERIES_LATENT_SCALE = 0.02


def kl_standard_normal(df: DataFrame, z_mu: str = "z_mu", z_sigma: str = "z_sigma", out: str = "kl") -> DataFrame:
    """Mean over rows of the divergence of N(z_mu, exp(z_sigma)) from the standard normal."""
    mu, s = F.col(z_mu), F.col(z_sigma)
    term = -0.5 * (1.0 + s - mu * mu - F.exp(s))
    return elements(df, z_mu, z_sigma).agg((F.sum(term) / F.count_if(F.col("pos") == 0)).alias(out))


def mixture_latent_loss(
    df: DataFrame,
    model: ModelLike,
    z_mu: str = "z_mu",
    z_sigma: str = "z_sigma",
    gamma: str = "gamma",
    scale: float = 1.0,
    exact: bool = False,
    out: str = "latent_loss",
) -> DataFrame:
    """Mean mixture latent loss; see ``mixture.latent_loss_terms`` for ``exact``."""
    terms = mixture.latent_loss_terms(z_mu, z_sigma, gamma, as_mixture(model), exact)
    return df.select(terms.alias("t")).agg((F.avg("t") * F.lit(float(scale))).alias(out))


def _cross_entropy(x: Column, logits: Column) -> Column:
    return F.greatest(logits, F.lit(0.0)) - logits * x + F.log1p(F.exp(-F.abs(logits)))


def sigmoid_recon_loss(
    df: DataFrame,
    x: str = "x",
    logits: str = "logits",
    scale_to: float | None = None,
    batch_col: str | None = None,
    out: str = "recon_loss",
    aligned: Aligned | None = None,
) -> DataFrame:
    """Mean sigmoid cross-entropy over all elements.

    With ``scale_to`` the logits are first mapped to [0, scale_to] by the range of their batch (the whole table
    without ``batch_col``); ``aligned`` batches take it from a window.
    """
    if scale_to is None:
        return elements(df, x, logits).agg(F.avg(_cross_entropy(F.col(x), F.col(logits))).alias(out))
    least, greatest = F.min(F.array_min(logits)), F.max(F.array_max(logits))
    low, high = least.alias("__low"), greatest.alias("__high")
    if aligned is not None:
        ranged = df.select(aligned.batch, x, logits).select(
            x, logits, by_batch(least, aligned).alias("__low"), by_batch(greatest, aligned).alias("__high")
        )
        long = elements(ranged, x, logits, keep=("__low", "__high"))
        lo, hi = F.col("__low"), F.col("__high")
    elif batch_col is None:
        long = elements(df, x, logits).withColumn("__span", df.select(F.struct(low, high)).scalar())
        lo, hi = F.col("__span.__low"), F.col("__span.__high")
    else:
        ranged = lookup_join(df.select(batch_col, x, logits), df.groupBy(batch_col).agg(low, high), batch_col, 40)
        long = elements(ranged, x, logits, keep=("__low", "__high"))
        lo, hi = F.col("__low"), F.col("__high")
    scaled = (F.col(logits) - lo) / (hi - lo + F.lit(mixture.RANGE_GUARD)) * F.lit(float(scale_to))
    return long.agg(F.avg(_cross_entropy(F.col(x), scaled)).alias(out))


def mse_recon_loss(
    df: DataFrame, x: str = "x", xhat: str = "xhat", height: int = 1, width: int = 1, out: str = "recon_loss"
) -> DataFrame:
    """Mean squared error times the number of pixels; channels do not count."""
    error = F.col(x) - F.col(xhat)
    return elements(df, x, xhat).agg((F.avg(error * error) * F.lit(float(height * width))).alias(out))


def _weighted_sum(first: DataFrame, second: DataFrame, weight: float | Column, out: str) -> DataFrame:
    factor = weight if isinstance(weight, Column) else F.lit(float(weight))
    return first.sparkSession.range(1).select((first.scalar() + factor * second.scalar()).alias(out))


def gamma_loss(recon: DataFrame, kl: DataFrame, gamma: float, out: str = "gamma_loss") -> DataFrame:
    """Loss of the warm-up phase."""
    return _weighted_sum(recon, kl, gamma, out)


def anneal_loss(recon: DataFrame, latent: DataFrame, factor: float, out: str = "anneal_loss") -> DataFrame:
    """Loss of the annealed phase."""
    return _weighted_sum(recon, latent, factor, out)


def static_loss(recon: DataFrame, latent: DataFrame, out: str = "static_loss") -> DataFrame:
    """Loss of the static phase, also the reported one."""
    return _weighted_sum(recon, latent, 1.0, out)
