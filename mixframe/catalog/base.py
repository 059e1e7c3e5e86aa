"""Shared inputs of the checkable queries, once in Spark and once in SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mixframe.functions.vectors import exploded
from mixframe.model import Mixture, grouped_model
from mixframe.operators import scoring

Run = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    """A named query; without ``sql`` only its rows are checked."""

    name: str
    run: Run
    sql: str | None = None


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def rounded(col: str | Column, digits: int = 6) -> Column:
    """Rounded for comparison; adding zero turns -0.0 into 0.0."""
    return F.round(F.col(col) if isinstance(col, str) else col, digits) + F.lit(0.0)


def long(df: DataFrame, ids: list[str], vector: str, digits: int = 6, pos: str = "pos") -> DataFrame:
    """One row for each element of an array: ids, position from 0, rounded value."""
    return exploded(df, list(ids), F.col(vector), pos, "value").select(
        *ids, pos, rounded(F.col("value").cast("double"), digits).alias("value")
    )


# --- embeddings -------------------------------------------------------------------------------------------------

DIMENSIONS = 64


def latent(spark: SparkSession, folder: str) -> DataFrame:
    """Embeddings as latent codes: vec_id, label, z_mu and the derived log-variance z_sigma."""
    codes = table(spark, folder, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("z_mu"))
    return codes.withColumn("z_sigma", F.transform("z_mu", lambda v: F.log(F.lit(0.01) + v * v)))


def label_model(spark: SparkSession, folder: str) -> Mixture:
    """Mixture of the labels: frequency, mean and variance."""
    return grouped_model(table(spark, folder, "embeddings"), "embedding", "label")


def scored(spark: SparkSession, folder: str, batch_col: str | None = None) -> tuple[DataFrame, Mixture]:
    """Latent codes scored against the label model, and that model."""
    model = label_model(spark, folder)
    rows = latent(spark, folder)
    if batch_col is not None:
        rows = rows.withColumn(batch_col, F.floor(F.col("vec_id") / 128).cast("bigint"))
    return scoring.score(rows, model, batch_col=batch_col), model


def reconstructed(spark: SparkSession, folder: str, batch_col: str | None = None) -> tuple[DataFrame, Mixture]:
    """Scored rows with x = the code and xhat = the centre of the row's cluster, and the model."""
    rows, model = scored(spark, folder, batch_col)
    return rows.withColumn("x", F.col("z_mu")).withColumn("xhat", model.centre_of("assignments")), model


# CTEs with the same content. ``e``: one row for each element; ``model``: one row for each component and dimension.
ELEMENTS = """e AS (
  SELECT vec_id, label, generate_subscripts(embedding, 1) - 1 AS d, unnest(embedding)::DOUBLE AS x FROM embeddings)"""
MODEL = f"""{ELEMENTS},
moments AS (SELECT label, d, count(*) AS n, avg(x) AS mu, var_pop(x) AS var FROM e GROUP BY label, d),
model AS (
  SELECT dense_rank() OVER (ORDER BY label) - 1 AS k, d, mu, var, n / sum(n) OVER (PARTITION BY d) AS w FROM moments)"""
JOINT = f"""{MODEL},
dens AS (
  SELECT vec_id, k, -0.5 * ({DIMENSIONS} * ln(2 * pi()) + sum((x - mu) * (x - mu) / var)) - 0.5 * sum(ln(var)) AS dens,
         any_value(w) AS w
  FROM e JOIN model USING (d) GROUP BY vec_id, k),
joint AS (SELECT vec_id, k, dens, dens + ln(w) AS j FROM dens)"""
ASSIGNED = """assigned AS (
  SELECT vec_id, arg_max(k, (j, -k)) AS a FROM joint GROUP BY vec_id)"""


def gamma_sql(batch: str | None = None) -> str:
    """CTEs ``p`` (rescaled joint) and ``gamma`` (softmax), for the whole table or per batch expression."""
    over = f"PARTITION BY {batch}" if batch else ""
    return f"""p AS (
  SELECT vec_id, k, j, (-j - min(-j) OVER ({over})) / (max(-j) OVER ({over}) - min(-j) OVER ({over}) + 1e-12) * -20 AS p
  FROM joint),
gamma AS (SELECT vec_id, k, j, p, exp(p) / sum(exp(p)) OVER (PARTITION BY vec_id) AS g FROM p)"""


SCORED = f"{JOINT},\n{gamma_sql()},\n{ASSIGNED}"
# x, its reconstruction xhat, and the log-variance s, for each row and dimension
RECONSTRUCTED = f"""{SCORED},
r AS (
  SELECT e.vec_id, e.d, e.x, m.mu AS xhat, ln(0.01 + e.x * e.x) AS s, a.a
  FROM e JOIN assigned a USING (vec_id) JOIN model m ON m.k = a.a AND m.d = e.d)"""


# --- line items: a longer table of four scalar features --------------------------------------------------------------

LINE_IDS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
LINE_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def lines(spark: SparkSession, folder: str) -> DataFrame:
    """Line items with their four numbers as a vector z_mu."""
    source = table(spark, folder, "lineitem")
    return source.select(*LINE_IDS, "l_returnflag", "l_linestatus", F.array(*LINE_FEATURES).alias("z_mu"))


def line_model(spark: SparkSession, folder: str) -> Mixture:
    """Mixture of the return flags."""
    return grouped_model(lines(spark, folder), "z_mu", "l_returnflag")


LINE_MODEL = f"""c AS (
  SELECT l_returnflag AS g, count(*) / sum(count(*)) OVER () AS w,
         {", ".join(f"avg({c}) AS m{i}, var_pop({c}) AS v{i}" for i, c in enumerate(LINE_FEATURES))}
  FROM lineitem GROUP BY 1),
model AS (SELECT *, row_number() OVER (ORDER BY g) - 1 AS k FROM c)"""
# the key columns repeat now and then, so rows get a number of their own
LINE_JOINT = f"""{LINE_MODEL},
numbered AS (SELECT *, row_number() OVER () AS row_id FROM lineitem),
joint AS (
  SELECT row_id, {", ".join(LINE_IDS)}, l_returnflag, k, ln(w) - 0.5 * (4 * ln(2 * pi())
         {"".join(f" + ({c} - m{i}) * ({c} - m{i}) / v{i} + ln(v{i})" for i, c in enumerate(LINE_FEATURES))}) AS j
  FROM numbered CROSS JOIN model)"""


def log_prob_long(df: DataFrame, column: str) -> DataFrame:
    return long(df, ["vec_id"], column, pos="k")
