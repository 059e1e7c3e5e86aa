"""Mixture scoring on the embeddings and on the line items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mixframe.catalog.base import (
    ASSIGNED,
    JOINT,
    LINE_IDS,
    LINE_JOINT,
    MODEL,
    SCORED,
    Query,
    gamma_sql,
    label_model,
    latent,
    line_model,
    lines,
    log_prob_long,
    long,
    rounded,
    scored,
)
from mixframe.operators import scoring
from mixframe.operators.runs import aligned_batches

BATCH = "floor(vec_id / 128)"


def _model(spark: SparkSession, folder: str) -> DataFrame:
    model = label_model(spark, folder).to_table(spark)
    flat = model.select("k", "pi", F.posexplode(F.arrays_zip("mu", "var")).alias("d", "e"))
    return flat.select(
        "k", "d", rounded("pi").alias("pi"), rounded("e.mu").alias("mu"), rounded("e.var").alias("var")
    )


def _component(spark: SparkSession, folder: str) -> DataFrame:
    out = scoring.component_log_prob(latent(spark, folder), label_model(spark, folder))
    return log_prob_long(out, "log_prob")


def _joint(spark: SparkSession, folder: str) -> DataFrame:
    return log_prob_long(scoring.joint_log_prob(latent(spark, folder), label_model(spark, folder)), "joint")


def _column(name: str, batch_col: str | None = None):
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return long(scored(spark, folder, batch_col)[0], ["vec_id"], name, pos="k")

    return run


def _assign(spark: SparkSession, folder: str) -> DataFrame:
    return scored(spark, folder)[0].select("vec_id", "assignments")


def _predict(spark: SparkSession, folder: str) -> DataFrame:
    out = scoring.predict(latent(spark, folder), label_model(spark, folder), ["vec_id"], z=None)
    return out.select(
        "vec_id",
        rounded(F.element_at("z_mu", 1)).alias("first_mu"),
        rounded(F.element_at("z_sigma", 1)).alias("first_sigma"),
        rounded(F.array_max("gamma")).alias("confidence"),
        F.size("gamma").alias("clusters"),
        "assignments",
    )


def cluster_summary(spark: SparkSession, folder: str) -> DataFrame:
    """The flagship: assemble, score, and report size and mean confidence of each cluster."""
    rows, _ = scored(spark, folder)
    return rows.groupBy("assignments").agg(
        F.count(F.lit(1)).alias("n"),
        rounded(F.avg(F.array_max("gamma"))).alias("mean_confidence"),
        rounded(F.avg(F.array_max("joint")), 4).alias("mean_joint"),
    )


def _lines(spark: SparkSession, folder: str) -> DataFrame:
    out = scoring.predict(lines(spark, folder), line_model(spark, folder), LINE_IDS, z_sigma=None, z=None)
    return out.select(*LINE_IDS, "assignments", rounded(F.array_max("gamma")).alias("confidence"))


def _lines_by_batch(spark: SparkSession, folder: str) -> DataFrame:
    """All line items in batches of 100 order keys, whose ranges come from a window."""
    batched = lines(spark, folder).withColumn("batch_id", F.floor(F.col("l_orderkey") / 100).cast("bigint"))
    aligned = aligned_batches(batched, "batch_id")
    out = scoring.predict(batched, line_model(spark, folder), LINE_IDS, z_sigma=None, z=None, batch_col="batch_id", aligned=aligned)
    return out.select(*LINE_IDS, "assignments", rounded(F.array_max("gamma")).alias("confidence"))


def _line_summary(spark: SparkSession, folder: str) -> DataFrame:
    ids = ["l_returnflag"]
    rows = scoring.predict(lines(spark, folder), line_model(spark, folder), ids, z_sigma=None, z=None)
    return rows.groupBy("l_returnflag", "assignments").agg(
        F.count(F.lit(1)).alias("n"), rounded(F.avg(F.array_max("gamma"))).alias("mean_confidence")
    )


LINE_SCORED = f"""{LINE_JOINT},
p AS (SELECT *, (-j - min(-j) OVER ()) / (max(-j) OVER () - min(-j) OVER () + 1e-12) * -20 AS p FROM joint),
scored AS (
  SELECT row_id, {", ".join(LINE_IDS)}, l_returnflag, arg_max(k, (j, -k))::INTEGER AS assignments, max(exp(p)) / sum(exp(p)) AS confidence
  FROM p GROUP BY ALL)"""

LINE_BATCH = "OVER (PARTITION BY floor(l_orderkey / 100))"

QUERIES = [
    Query(
        "label_model",
        _model,
        f"""WITH {MODEL}
SELECT k::INTEGER AS k, d::INTEGER AS d, round(w, 6) + 0.0 AS pi, round(mu, 6) + 0.0 AS mu, round(var, 6) + 0.0 AS var
FROM model""",
    ),
    Query(
        "component_log_prob",
        _component,
        f"WITH {JOINT}\nSELECT vec_id, k::INTEGER AS k, round(dens, 6) + 0.0 AS value FROM joint",
    ),
    Query("joint_log_prob", _joint, f"WITH {JOINT}\nSELECT vec_id, k::INTEGER AS k, round(j, 6) + 0.0 AS value FROM joint"),
    Query(
        "inverse_min_max",
        _column("p"),
        f"WITH {JOINT}, {gamma_sql()}\nSELECT vec_id, k::INTEGER AS k, round(p, 6) + 0.0 AS value FROM p",
    ),
    Query(
        "inverse_min_max_batches",
        _column("p", "batch_id"),
        f"WITH {JOINT}, {gamma_sql(BATCH)}\nSELECT vec_id, k::INTEGER AS k, round(p, 6) + 0.0 AS value FROM p",
    ),
    Query(
        "responsibilities",
        _column("gamma"),
        f"WITH {JOINT}, {gamma_sql()}\nSELECT vec_id, k::INTEGER AS k, round(g, 6) + 0.0 AS value FROM gamma",
    ),
    Query(
        "responsibilities_batches",
        _column("gamma", "batch_id"),
        f"WITH {JOINT}, {gamma_sql(BATCH)}\nSELECT vec_id, k::INTEGER AS k, round(g, 6) + 0.0 AS value FROM gamma",
    ),
    Query("assign", _assign, f"WITH {JOINT}, {ASSIGNED}\nSELECT vec_id, a::INTEGER AS assignments FROM assigned"),
    Query(
        "predict",
        _predict,
        f"""WITH {SCORED},
top AS (SELECT vec_id, max(g) AS g, count(*) AS n FROM gamma GROUP BY vec_id)
SELECT vec_id, round(x, 6) + 0.0 AS first_mu, round(ln(0.01 + x * x), 6) + 0.0 AS first_sigma,
       round(g, 6) + 0.0 AS confidence, n::INTEGER AS clusters, a::INTEGER AS assignments
FROM e JOIN top USING (vec_id) JOIN assigned USING (vec_id) WHERE d = 0""",
    ),
    Query(
        "cluster_summary",
        cluster_summary,
        f"""WITH {SCORED},
top AS (SELECT vec_id, max(g) AS g, max(j) AS j FROM gamma GROUP BY vec_id)
SELECT a::INTEGER AS assignments, count(*) AS n, round(avg(g), 6) + 0.0 AS mean_confidence,
       round(avg(j), 4) + 0.0 AS mean_joint
FROM top JOIN assigned USING (vec_id) GROUP BY a""",
    ),
    Query(
        "predict_lines",
        _lines,
        f"""WITH {LINE_SCORED}
SELECT {", ".join(LINE_IDS)}, assignments, round(confidence, 6) + 0.0 AS confidence FROM scored""",
    ),
    Query(
        "predict_lines_batches",
        _lines_by_batch,
        f"""WITH {LINE_JOINT}{LINE_SCORED[len(LINE_JOINT):].replace("OVER ()", LINE_BATCH)}
SELECT {", ".join(LINE_IDS)}, assignments, round(confidence, 6) + 0.0 AS confidence FROM scored""",
    ),
    Query(
        "cluster_summary_lines",
        _line_summary,
        f"""WITH {LINE_SCORED}
SELECT l_returnflag, assignments, count(*) AS n, round(avg(confidence), 6) + 0.0 AS mean_confidence
FROM scored GROUP BY 1, 2""",
    ),
]
