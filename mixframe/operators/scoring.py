"""Scoring rows against a mixture: log densities, responsibilities and assignments. All but the range are narrow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mixframe.functions import mixture
from mixframe.model import ModelLike, as_mixture
from mixframe.operators.lookup import lookup_join
from mixframe.operators.runs import Aligned, by_batch


def component_log_prob(df: DataFrame, model: ModelLike, z_mu: str = "z_mu", out: str = "log_prob") -> DataFrame:
    """Log density of every row under each component, as an array of K numbers."""
    return df.withColumn(out, mixture.log_prob(z_mu, as_mixture(model), with_weights=False))


def joint_log_prob(df: DataFrame, model: ModelLike, z_mu: str = "z_mu", out: str = "joint") -> DataFrame:
    """Log density plus log weight for each component."""
    return df.withColumn(out, mixture.log_prob(z_mu, as_mixture(model), with_weights=True))


def _range(joint: str) -> tuple[Column, Column]:
    """Least and greatest negated joint of a group of rows; NaN, which sorts above all numbers, is left out."""
    low, high = -F.array_max(joint), -F.array_min(joint)
    return F.min(F.when(~F.isnan(low), low)), F.max(F.when(~F.isnan(high), high))


def _with_range(
    df: DataFrame, ends: DataFrame, low: Column, high: Column, batch_col: str | None, aligned: Aligned | None = None
) -> tuple[DataFrame, Column, Column]:
    """``df`` with the aggregates ``low`` and ``high`` of ``ends`` for its batch, and the two as columns.

    Without a batch they are a scalar subquery of one row; with one they are joined back on the batch id. With
    ``aligned`` they come from a window over the batch; ``df`` then has the columns that they read.
    """
    if aligned is not None:
        ranged = df.withColumn("__low", by_batch(low, aligned)).withColumn("__high", by_batch(high, aligned))
        return ranged, F.col("__low"), F.col("__high")
    if batch_col is None:
        span = ends.select(F.struct(low.alias("low"), high.alias("high"))).scalar()
        return df.withColumn("__span", span), F.col("__span.low"), F.col("__span.high")
    ranges = ends.groupBy(batch_col).agg(low.alias("__low"), high.alias("__high"))
    return lookup_join(df, ranges, batch_col, row_bytes=40), F.col("__low"), F.col("__high")


def inverse_min_max(
    df: DataFrame, joint: str = "joint", out: str = "p", batch_col: str | None = None, aligned: Aligned | None = None
) -> DataFrame:
    """The joint rescaled so that each batch's range over rows and components becomes [-20, 0].

    Without ``batch_col`` the whole table is one batch. Either way the joint is read twice; persist ``df`` where a
    second scan costs more than storing it. With ``aligned`` batches the table is read and moved once.
    """
    ranged, low, high = _with_range(df, df, *_range(joint), batch_col, aligned)
    return ranged.withColumn(out, mixture.scaled(joint, low, high)).select(*df.columns, out)


def responsibilities(df: DataFrame, p: str = "p", out: str = "gamma") -> DataFrame:
    """Soft assignment: softmax over the components."""
    return df.withColumn(out, mixture.softmax_column(p))


def assign(df: DataFrame, joint: str = "joint", out: str = "assignments") -> DataFrame:
    """Hard assignment. The rescaling is increasing in the joint, so the batch does not matter; lowest k wins ties."""
    return df.withColumn(out, mixture.first_argmax(joint))


def _batch_keys(batch_col: str | None, aligned: Aligned | None) -> list[str]:
    if aligned is not None:
        return [aligned.batch]
    return [batch_col] if batch_col else []


def score(
    df: DataFrame, model: ModelLike, z_mu: str = "z_mu", batch_col: str | None = None, aligned: Aligned | None = None
) -> DataFrame:
    """``df`` with joint, p, gamma and assignments."""
    mixture_model = as_mixture(model)
    joint = joint_log_prob(df, mixture_model, z_mu)
    ends_of = mixture.negated_range(z_mu, mixture_model).alias("__ends")
    ends = df.select(*_batch_keys(batch_col, aligned), ends_of)
    rows = joint if aligned is None else joint.select("*", ends_of)
    ranged, low, high = _with_range(rows, ends, F.min("__ends.low"), F.max("__ends.high"), batch_col, aligned)
    soft = ranged.withColumn("__soft", mixture.rescaled_softmax("joint", low, high))
    return assign(soft.select(*joint.columns, "__soft.p", "__soft.gamma"))


def predict(
    df: DataFrame,
    model: ModelLike,
    ids: list[str],
    z_mu: str = "z_mu",
    z_sigma: str | None = "z_sigma",
    z: str | None = "z",
    batch_col: str | None = None,
    aligned: Aligned | None = None,
) -> DataFrame:
    """Prediction records: ids, the latent columns that exist, gamma and assignments; never labels.

    The same numbers as ``score``, with one function call per pass: a first pass for the range of the joint, and a
    second one from the code straight to both assignments. With ``aligned`` batches (see
    ``runs``) it is one pass, and the rows move once.
    """
    mixture_model = as_mixture(model)
    latent = [c for c in (z_mu, z_sigma, z) if c is not None]
    batch = _batch_keys(batch_col, aligned)
    narrow = df.select(*dict.fromkeys([*ids, *latent, *batch]))
    ends_of = mixture.negated_range(z_mu, mixture_model).alias("__ends")
    ends = narrow.select(*batch, ends_of)
    rows = narrow if aligned is None else narrow.select("*", ends_of)
    ranged, low, high = _with_range(rows, ends, F.min("__ends.low"), F.max("__ends.high"), batch_col, aligned)
    assigned = ranged.withColumn("__out", mixture.soft_and_hard(z_mu, mixture_model, low, high))
    return assigned.select(*ids, *latent, "__out.gamma", "__out.assignments")
