"""Sinks read back, streaming jobs run to their end, user scorers, and the data-parallel latent fit."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mixframe.catalog.base import (
    LINE_FEATURES,
    LINE_IDS,
    SCORED,
    Query,
    Run,
    label_model,
    latent,
    line_model,
    lines,
    reconstructed,
    rounded,
    table,
)
from mixframe.catalog.metrics import CH_EXACT, QUALITY
from mixframe.catalog.scoring import LINE_SCORED
from mixframe.catalog.tables import column, events_config
from mixframe.config import TableConfig
from mixframe.operators import metrics, scoring
from mixframe.operators.custom import custom_scorer
from mixframe.operators.latent_fit import LatentFit, fit_latent
from mixframe.operators.network import encode
from mixframe.plans.latent import read_latent, train_latent
from mixframe.plans.training import start_model
from mixframe.session import scratch_path
from mixframe.sinks import addressed, predictions
from mixframe.streaming import jobs

RECORD = "vec_id bigint, z_mu array<double>, gamma array<double>, assignments int"


def _predictions(spark: SparkSession, folder: str) -> DataFrame:
    return scoring.predict(latent(spark, folder), label_model(spark, folder), ["vec_id"], z_sigma=None, z=None)


def _indexed(spark: SparkSession, folder: str) -> DataFrame:
    """Running positions of the orders in the reverse of their keys."""
    orders = table(spark, folder, "orders").select((F.col("o_orderkey") * -3 + 7).alias("key"), "o_custkey")
    return predictions.with_index(orders, "key").select(F.col("index").alias("position"), "key", "o_custkey")


def _summary(df: DataFrame) -> DataFrame:
    return df.select(
        "vec_id",
        rounded(F.array_max("gamma")).alias("confidence"),
        rounded(F.element_at("z_mu", -1)).alias("last_mu"),
        "assignments",
    )


def _written(fmt: str) -> Run:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        path = scratch_path(spark, f"predictions-{fmt}")
        predictions.write_predictions(_predictions(spark, folder), path, fmt)
        if fmt == "json":
            return _summary(spark.read.schema(RECORD).json(path))
        if fmt == "text":
            rows = spark.read.text(path).select(F.from_json("value", RECORD).alias("r"))
            return _summary(rows.select("r.*"))
        rows = spark.read.option("header", True).option("escape", '"').csv(path)
        return _summary(
            rows.select(
                F.col("vec_id").cast("bigint").alias("vec_id"),
                F.from_json("z_mu", "array<double>").alias("z_mu"),
                F.from_json("gamma", "array<double>").alias("gamma"),
                F.col("assignments").cast("int").alias("assignments"),
            )
        )

    return run


def _lines_written(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "predictions-lines")
    scored = scoring.predict(lines(spark, folder), line_model(spark, folder), LINE_IDS, z_sigma=None, z=None)
    predictions.write_predictions(scored, path, "json")
    back = spark.read.schema("l_orderkey bigint, gamma array<double>, assignments int").json(path)
    return back.groupBy("assignments").agg(
        F.count(F.lit(1)).alias("n"), rounded(F.avg(F.array_max("gamma"))).alias("mean_confidence")
    )


def _addressed(spark: SparkSession, folder: str) -> DataFrame:
    """All orders in files of 1,000, read back with the position of the file that each lies in."""
    path = scratch_path(spark, "orders-by-position")
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    addressed.write_addressed(orders, path, ["o_orderkey"], "json", rows_per_file=1000)
    back = spark.read.schema("o_orderkey bigint, o_custkey bigint, o_orderpriority string, file_number bigint").json(path)
    files = addressed.manifest(spark, path)
    return back.join(F.broadcast(files), "file_number").select("o_orderkey", "o_custkey", "o_orderpriority", "first", "last")


def _sample(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "sample")
    predictions.write_sample(_predictions(spark, folder), path, ["vec_id"], 10)
    return _summary(spark.read.schema(RECORD).json(path))


def _metrics(spark: SparkSession, folder: str) -> DataFrame:
    rows, _ = reconstructed(spark, folder)
    written = predictions.write_metrics(
        metrics.reconstruction_metrics(rows), scratch_path(spark, "metrics"), stamp="20240101_000000"
    )
    back = spark.read.json(written)
    return back.select(*[rounded(c).alias(c) for c in back.columns])


def _flatten(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select(
        F.array("n_chars").alias("n_chars"),
        F.encode("text", "UTF-8").alias("text"),
        F.array(F.encode("lang", "UTF-8"), F.encode("source", "UTF-8")).alias("tags"),
        F.array("doc_id").alias("doc_id"),
    )
    flat = predictions.flatten_record(documents, ["doc_id"], {"doc_id": 1, "n_chars": 1})
    return flat.select("doc_id", "n_chars", F.md5("text").alias("text_md5"), F.array_join("tags", "/").alias("tags"))


def _stream(spark: SparkSession, folder: str) -> DataFrame:
    """Embeddings as a file stream, whether the table is one file or a folder of part files.

    The path is a pattern because a stream takes a plain path for a folder, and refuses a single file.
    """
    schema = "vec_id bigint, embedding array<float>, label int"
    source = spark.readStream.schema(schema).parquet(f"{folder}/embeddings.parque[t]")
    return source.select("vec_id", F.col("embedding").cast("array<double>").alias("z_mu"))


def _score_stream(spark: SparkSession, folder: str) -> DataFrame:
    out = scratch_path(spark, "stream-scores")
    query = jobs.score_stream(
        _stream(spark, folder), label_model(spark, folder), out, scratch_path(spark, "stream-state"), ["vec_id"]
    )
    query.awaitTermination()
    return _summary(spark.read.parquet(out))


def _metrics_stream(spark: SparkSession, folder: str) -> DataFrame:
    out = scratch_path(spark, "stream-metrics")
    model = label_model(spark, folder)
    joint = scoring.joint_log_prob(_stream(spark, folder), model)
    rows = scoring.assign(joint).select(F.col("z_mu").alias("x"), model.centre_of("assignments").alias("xhat"))
    jobs.metrics_stream(rows, out, scratch_path(spark, "stream-state")).awaitTermination()
    found = jobs.running_metrics(spark, out)
    return found.select(*[rounded(c).alias(c) for c in found.columns])


def _cluster_stream(spark: SparkSession, folder: str) -> DataFrame:
    out = scratch_path(spark, "stream-clusters")
    state = scratch_path(spark, "stream-state")
    jobs.cluster_metrics_stream(_stream(spark, folder), label_model(spark, folder), out, state).awaitTermination()
    found = jobs.running_cluster_metrics(spark, out)
    return found.select("rows", *[rounded(c).alias(c) for c in ("simple_silhouette", "calinski_harabasz")])


def _init_stream(spark: SparkSession, folder: str) -> DataFrame:
    model, pool = scratch_path(spark, "stream-model"), scratch_path(spark, "stream-pool")
    query = jobs.init_stream(
        _stream(spark, folder), pool, model, scratch_path(spark, "stream-state"), init_steps=1, k=4, start=start_model(4, 64)
    )
    fitted = jobs.await_model(query, spark, pool, model, 1).to_table(spark)
    return fitted.select("k", "pi", F.size("mu").alias("dim"))


def _scorer(spark: SparkSession, folder: str) -> DataFrame:
    def score(batch: pd.DataFrame) -> pd.DataFrame:
        weight = batch["event_type"].map({"purchase": 3.0, "signup": 2.0}).fillna(1.0)
        return pd.DataFrame({"score": weight * batch["value"] + batch["user_id"] % 7})

    run = custom_scorer(score, "score double")
    return run(table(spark, folder, "events"), events_config(folder)).select("event_id", rounded("score").alias("score"))


def _batch_scorer_config() -> TableConfig:
    names = [*LINE_IDS, *LINE_FEATURES]
    kinds = {name: "INTEGER" if name in LINE_IDS else "FLOAT" for name in names}
    return TableConfig.from_dict({"idCols": LINE_IDS, "featureColumns": [column(n, k) for n, k in kinds.items()]})


def _line_scorer(spark: SparkSession, folder: str) -> DataFrame:
    def score(batch: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"net": batch["l_extendedprice"] * (1 - batch["l_discount"]) * (1 + batch["l_tax"])})

    run = custom_scorer(score, "net double")
    return run(table(spark, folder, "lineitem"), _batch_scorer_config()).select(*LINE_IDS, rounded("net", 6).alias("net"))


def _trained_latent(spark: SparkSession, folder: str) -> DataFrame:
    """Train on all embeddings, publish, read back, and predict with what was published."""
    settings = LatentFit(code=4, hidden=16, clusters=4, gamma_rounds=2, init_steps=2, beta_rounds=2, static_rounds=1)
    rows, models = table(spark, folder, "embeddings").select("vec_id", "embedding"), scratch_path(spark, "models")
    version = train_latent(rows, "embedding", "vec_id", settings, models, (8, 8, 1))
    coder, model = read_latent(spark, models, version)
    scored = scoring.predict(encode(rows, coder, "embedding"), model, ["vec_id"], z=None)
    return scored.select("vec_id", "assignments", F.size("gamma").alias("components"), F.size("z_mu").alias("code"))


def _fit_latent(spark: SparkSession, folder: str) -> DataFrame:
    settings = LatentFit(code=4, hidden=16, clusters=4, gamma_rounds=2, init_steps=2, beta_rounds=2, static_rounds=1)
    result = fit_latent(table(spark, folder, "embeddings"), "embedding", "vec_id", settings)
    return result.model.to_table(spark).select("k", F.size("mu").alias("dim"), F.lit(len(result.losses)).alias("rounds"))


TOP = f"""WITH {SCORED},
top AS (SELECT vec_id, max(g) AS g FROM gamma GROUP BY vec_id),
out AS (
  SELECT vec_id, round(g, 6) + 0.0 AS confidence, round(x, 6) + 0.0 AS last_mu, a::INTEGER AS assignments
  FROM e JOIN top USING (vec_id) JOIN assigned USING (vec_id) WHERE d = 63)
SELECT * FROM out"""
RECON = f"""WITH {SCORED},
r AS (SELECT e.x, m.mu AS xhat FROM e JOIN assigned a USING (vec_id) JOIN model m ON m.k = a.a AND m.d = e.d)
SELECT round(avg(abs(x - xhat)), 6) + 0.0 AS mean_absolute_error,
       round(avg((x - xhat) * (x - xhat)), 6) + 0.0 AS mean_squared_error,
       round(1 - avg(x * xhat), 6) + 0.0 AS mean_cosine_distance
FROM r"""

QUERIES = [
    Query(
        "prediction_index",
        _indexed,
        """SELECT row_number() OVER (ORDER BY o_orderkey DESC) - 1 AS position, o_orderkey * -3 + 7 AS key, o_custkey
FROM orders""",
    ),
    Query("write_json", _written("json"), TOP),
    Query("write_csv", _written("csv"), TOP),
    Query("write_text", _written("text"), TOP),
    Query(
        "write_json_lines",
        _lines_written,
        f"""WITH {LINE_SCORED}
SELECT assignments, count(*) AS n, round(avg(confidence), 6) + 0.0 AS mean_confidence FROM scored GROUP BY 1""",
    ),
    Query(
        "write_addressed",
        _addressed,
        """WITH p AS (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS i, count(*) OVER () AS n FROM orders)
SELECT o_orderkey, o_custkey, o_orderpriority, (i // 1000) * 1000 AS first, least((i // 1000 + 1) * 1000, n) - 1 AS last FROM p""",
    ),
    Query("write_sample", _sample, f"{TOP} ORDER BY vec_id LIMIT 10"),
    Query("write_metrics", _metrics, RECON),
    Query(
        "flatten_record",
        _flatten,
        "SELECT doc_id, n_chars, md5(text) AS text_md5, lang || '/' || source AS tags FROM documents",
    ),
    Query("score_stream", _score_stream, TOP),
    Query("metrics_stream", _metrics_stream, RECON),
    Query(
        "cluster_metrics_stream",
        _cluster_stream,
        f"""WITH {QUALITY}
SELECT n AS rows, round((SELECT s FROM sil_whole), 6) + 0.0 AS simple_silhouette, round({CH_EXACT}, 6) + 0.0 AS calinski_harabasz
FROM ch""",
    ),
    Query("init_stream", _init_stream),
    Query(
        "custom_scorer",
        _scorer,
        """SELECT event_id, round(CASE event_type WHEN 'purchase' THEN 3 WHEN 'signup' THEN 2 ELSE 1 END * value
       + user_id % 7, 6) + 0.0 AS score
FROM events""",
    ),
    Query(
        "custom_scorer_lines",
        _line_scorer,
        f"""SELECT {", ".join(LINE_IDS)}, round(l_extendedprice * (1 - l_discount) * (1 + l_tax), 6) + 0.0 AS net
FROM lineitem""",
    ),
    Query("trained_latent", _trained_latent),
    Query("fit_latent", _fit_latent),
]
