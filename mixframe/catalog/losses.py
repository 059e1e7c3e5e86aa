"""Losses on the embeddings, reconstructed by their cluster centres."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mixframe.catalog.base import RECONSTRUCTED, Query, latent, reconstructed, rounded
from mixframe.operators import losses

GAMMA = 0.0005
FACTOR = 0.3
CROSS = "greatest({l}, 0) - {l} * x + ln(1 + exp(-abs({l})))"
TERMS = f"""{RECONSTRUCTED},
kl AS (SELECT sum(-0.5 * (1 + s - x * x - exp(s))) / count(DISTINCT vec_id) AS kl FROM r),
q AS (
  SELECT r.vec_id, m.k, sum(ln(m.var) + ((r.x - m.mu) * (r.x - m.mu) + exp(r.s)) / m.var) AS q, any_value(m.w) AS w
  FROM r JOIN model m USING (d) GROUP BY r.vec_id, m.k),
comp AS (
  SELECT vec_id, sum(g * (ln(g) - ln(w) + 0.5 * (q + 64 * 64 * ln(2 * pi())))) AS c,
         sum(g * (ln(g) - ln(w) + 0.5 * (q + 64 * ln(2 * pi())))) AS c_once
  FROM q JOIN gamma USING (vec_id, k) GROUP BY vec_id),
prior AS (SELECT vec_id, -0.5 * sum(1 + s) AS h FROM r GROUP BY vec_id),
latent AS (SELECT avg(h + c) AS l2, avg(h + c_once) AS l2_once FROM comp JOIN prior USING (vec_id)),
recon AS (SELECT 64 * avg((x - xhat) * (x - xhat)) AS l4 FROM r)"""


def _kl(spark: SparkSession, folder: str) -> DataFrame:
    return losses.kl_standard_normal(latent(spark, folder)).select(rounded("kl").alias("kl"))


def _latent(scale: float, exact: bool) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        rows, model = reconstructed(spark, folder)
        loss = losses.mixture_latent_loss(rows, model, scale=scale, exact=exact)
        return loss.select(rounded("latent_loss").alias("latent_loss"))

    return run


def _sigmoid(scale_to: float | None, batches: bool = False) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        rows, _ = reconstructed(spark, folder)
        rows = rows.withColumn("batch_id", F.floor(F.col("vec_id") / 128))
        loss = losses.sigmoid_recon_loss(rows, "x", "xhat", scale_to, "batch_id" if batches else None)
        return loss.select(rounded("recon_loss").alias("recon_loss"))

    return run


def _mse(spark: SparkSession, folder: str) -> DataFrame:
    rows, _ = reconstructed(spark, folder)
    return losses.mse_recon_loss(rows, height=8, width=8).select(rounded("recon_loss").alias("recon_loss"))


def _gamma(spark: SparkSession, folder: str) -> DataFrame:
    rows, _ = reconstructed(spark, folder)
    loss = losses.gamma_loss(losses.mse_recon_loss(rows, height=8, width=8), losses.kl_standard_normal(rows), GAMMA)
    return loss.select(rounded("gamma_loss").alias("gamma_loss"))


def _mixed(factor: float | None) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        rows, model = reconstructed(spark, folder)
        recon, mixed = losses.mse_recon_loss(rows, height=8, width=8), losses.mixture_latent_loss(rows, model)
        loss = losses.static_loss(recon, mixed) if factor is None else losses.anneal_loss(recon, mixed, factor)
        return loss.select(rounded(loss.columns[0]).alias(loss.columns[0]))

    return run


def scaled_sql(over: str) -> str:
    return f"(xhat - min(xhat) OVER ({over})) / (max(xhat) OVER ({over}) - min(xhat) OVER ({over}) + 1e-12) * 50"


QUERIES = [
    Query("kl_standard_normal", _kl, f"WITH {TERMS}\nSELECT round(kl, 6) + 0.0 AS kl FROM kl"),
    Query(
        "mixture_latent_loss",
        _latent(1.0, False),
        f"WITH {TERMS}\nSELECT round(l2, 6) + 0.0 AS latent_loss FROM latent",
    ),
    Query(
        "mixture_latent_loss_exact",
        _latent(1.0, True),
        f"WITH {TERMS}\nSELECT round(l2_once, 6) + 0.0 AS latent_loss FROM latent",
    ),
    Query(
        "mixture_latent_loss_series",
        _latent(losses.SERIES_LATENT_SCALE, False),
        f"WITH {TERMS}\nSELECT round(l2 * 0.02, 6) + 0.0 AS latent_loss FROM latent",
    ),
    Query(
        "sigmoid_recon_loss",
        _sigmoid(None),
        f"WITH {RECONSTRUCTED}\nSELECT round(avg({CROSS.format(l='xhat')}), 6) + 0.0 AS recon_loss FROM r",
    ),
    Query(
        "sigmoid_recon_loss_scaled",
        _sigmoid(losses.LOGIT_RANGE),
        f"""WITH {RECONSTRUCTED},
t AS (SELECT x, {scaled_sql("")} AS l FROM r)
SELECT round(avg({CROSS.format(l="l")}), 6) + 0.0 AS recon_loss FROM t""",
    ),
    Query(
        "sigmoid_recon_loss_batches",
        _sigmoid(losses.LOGIT_RANGE, batches=True),
        f"""WITH {RECONSTRUCTED},
t AS (SELECT x, {scaled_sql("PARTITION BY floor(vec_id / 128)")} AS l FROM r)
SELECT round(avg({CROSS.format(l="l")}), 6) + 0.0 AS recon_loss FROM t""",
    ),
    Query("mse_recon_loss", _mse, f"WITH {TERMS}\nSELECT round(l4, 6) + 0.0 AS recon_loss FROM recon"),
    Query(
        "gamma_loss",
        _gamma,
        f"WITH {TERMS}\nSELECT round(l4 + {GAMMA} * kl, 6) + 0.0 AS gamma_loss FROM recon, kl",
    ),
    Query(
        "anneal_loss",
        _mixed(FACTOR),
        f"WITH {TERMS}\nSELECT round(l4 + {FACTOR} * l2, 6) + 0.0 AS anneal_loss FROM recon, latent",
    ),
    Query(
        "static_loss",
        _mixed(None),
        f"WITH {TERMS}\nSELECT round(l4 + l2, 6) + 0.0 AS static_loss FROM recon, latent",
    ),
]
