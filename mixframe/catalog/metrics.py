"""Metrics on the embeddings scored against the label model."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mixframe.catalog.base import (
    ELEMENTS,
    LINE_FEATURES,
    MODEL,
    RECONSTRUCTED,
    SCORED,
    Query,
    Run,
    label_model,
    latent,
    lines,
    long,
    reconstructed,
    rounded,
    scored,
    table,
)
from mixframe.catalog.losses import CROSS, TERMS, scaled_sql
from mixframe.operators import histograms, metrics
from mixframe.operators.losses import LOGIT_RANGE, SERIES_LATENT_SCALE
from mixframe.sinks.predictions import scalar_rows

BATCH = "floor(vec_id / 128)"


def _reconstruction(spark: SparkSession, folder: str) -> DataFrame:
    rows, _ = reconstructed(spark, folder)
    return rows


def _mae(spark: SparkSession, folder: str) -> DataFrame:
    found = metrics.mean_absolute_error(_reconstruction(spark, folder))
    return found.select(rounded("mean_absolute_error").alias("mean_absolute_error"))


def _mse(spark: SparkSession, folder: str) -> DataFrame:
    found = metrics.mean_squared_error(_reconstruction(spark, folder))
    return found.select(rounded("mean_squared_error").alias("mean_squared_error"))


def _cosine(channels: int) -> Run:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        found = metrics.mean_cosine_distance(_reconstruction(spark, folder), channels=channels)
        return found.select(rounded("mean_cosine_distance").alias("mean_cosine_distance"))

    return run


def _separation(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.separation(label_model(spark, folder).to_table(spark)).select(rounded("separation").alias("separation"))


def _distances(spark: SparkSession, folder: str) -> DataFrame:
    return long(
        metrics.center_distances(latent(spark, folder), label_model(spark, folder)), ["vec_id"], "distances", pos="k"
    )


def _silhouette(mode: str, batch_col: str | None) -> Run:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        rows, model = scored(spark, folder, batch_col)
        found = metrics.simplified_silhouette(rows, model, mode, batch_col)
        return found.select(rounded("silhouette").alias("silhouette"))

    return run


def _calinski(mode: str, batch_col: str | None) -> Run:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        rows, _ = scored(spark, folder, batch_col)
        found = metrics.calinski_harabasz(rows, mode=mode, batch_col=batch_col)
        return found.select(rounded("calinski_harabasz").alias("calinski_harabasz"))

    return run


def _calinski_lines(spark: SparkSession, folder: str) -> DataFrame:
    rows = lines(spark, folder)
    found = metrics.calinski_harabasz(rows, "z_mu", "l_returnflag")
    return found.select(rounded("calinski_harabasz").alias("calinski_harabasz"))


def _running(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events").withColumn("batch_id", F.floor(F.col("event_id") / 64).cast("bigint"))
    batches = events.groupBy("batch_id").agg(F.avg("value").alias("value"), F.count(F.lit(1)).alias("n"))
    plain = metrics.running_mean(batches, "batch_id", {"value": "by_batch"}, chunk=10)
    weighted = metrics.running_mean(plain, "batch_id", {"value": "by_element"}, weight="n", chunk=10)
    return weighted.select("batch_id", rounded("by_batch").alias("by_batch"), rounded("by_element").alias("by_element"))


def _evaluate(batch_col: str | None, latent_scale: float = 1.0, logits: str | None = None, logit_range: float | None = None) -> Run:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        rows, model = reconstructed(spark, folder, batch_col)
        rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
        loss = {"latent_scale": latent_scale, "logits": logits, "logit_range": logit_range}
        record = metrics.evaluate(rows, model, z_sigma="z_sigma", frame=(8, 8), batch_col=batch_col, **loss)
        return record.select(*[rounded(c).alias(c) for c in record.columns])

    return run


def _histogram(spark: SparkSession, folder: str) -> DataFrame:
    found = metrics.histogram(latent(spark, folder), "z_mu", 16)
    return found.select("bin", rounded("lower").alias("lower"), rounded("upper").alias("upper"), "n")


def _histograms(spark: SparkSession, folder: str) -> DataFrame:
    """Codes, responsibilities, log-variances and the model's arrays, in one pass."""
    rows, model = scored(spark, folder)
    return histograms.histograms(rows, ["z_mu", "z_sigma", "p"], model).select("name", "bin", "lower", "upper", "n")


def _assignment_histogram(spark: SparkSession, folder: str) -> DataFrame:
    rows, _ = scored(spark, folder)
    return metrics.histogram(rows, "assignments", 10, -0.5, 9.5)


def _scalar_log(spark: SparkSession, folder: str) -> DataFrame:
    logged = scalar_rows(100, metrics.reconstruction_metrics(_reconstruction(spark, folder)))
    return logged.select("step", "name", rounded("value").alias("value"))


# Dispersions and silhouettes, over the whole table and by batch.
QUALITY = f"""{SCORED},
la AS (SELECT e.vec_id, {BATCH} AS b, e.d, e.x, a.a FROM e JOIN assigned a USING (vec_id)),
dist AS (
  SELECT vec_id, k, sqrt(sum((x - mu) * (x - mu))) AS dist FROM e JOIN model USING (d) GROUP BY vec_id, k),
ab AS (
  SELECT vec_id, {BATCH} AS b, any_value(dist) FILTER (k = a) AS own, min(dist) FILTER (k <> a) AS near,
         min(dist) FILTER (k <> a AND dist > 0) AS positive
  FROM dist JOIN assigned USING (vec_id) GROUP BY vec_id),
sil AS (SELECT avg((near - own) / greatest(near, own)) AS s FROM ab),
sil_whole AS (
  SELECT avg((m - own) / greatest(m, own)) AS s FROM (SELECT own, min(positive) OVER () AS m FROM ab)),
sil_batch AS (
  SELECT avg((m - own) / greatest(m, own)) AS s FROM (SELECT own, min(positive) OVER (PARTITION BY b) AS m FROM ab)),
ch AS (
  SELECT count(DISTINCT vec_id) AS n, count(DISTINCT a) AS k, sum((mk - m) * (mk - m)) AS between_,
         sum((x - mk) * (x - mk)) AS within_
  FROM (SELECT *, avg(x) OVER (PARTITION BY a, d) AS mk, avg(x) OVER (PARTITION BY d) AS m FROM la)),
chb AS (
  SELECT b, count(DISTINCT vec_id) AS n, count(DISTINCT a) AS k, sum((mk - m) * (mk - m)) AS between_,
         sum((x - mk) * (x - mk)) AS within_
  FROM (SELECT *, avg(x) OVER (PARTITION BY b, a, d) AS mk, avg(x) OVER (PARTITION BY b, d) AS m FROM la) GROUP BY b),
chr AS (SELECT n, k, avg(between_) OVER (ORDER BY b) AS bm, avg(within_) OVER (ORDER BY b) AS wm FROM chb),
sep AS (
  SELECT avg(dist) AS separation
  FROM (SELECT a.k, b.k, sqrt(sum((a.mu - b.mu) * (a.mu - b.mu))) AS dist
        FROM model a JOIN model b ON a.d = b.d AND a.k < b.k GROUP BY a.k, b.k))"""
CH = "SELECT round({e}, 6) + 0.0 AS calinski_harabasz FROM {t}"
CH_EXACT = "between_ * (n - k) / (within_ * (k - 1))"
CH_RUNNING = "avg(bm * (n - k) / (wm * (k - 1)))"


SQUARED = "64 * avg((x - xhat) * (x - xhat))"


def _entropy(over: str) -> str:
    """Sigmoid cross-entropy of the rescaled logits, as a scalar subquery."""
    return f"(SELECT avg({CROSS.format(l='l')}) FROM (SELECT x, {scaled_sql(over)} AS l FROM r))"


def _evaluate_sql(silhouette: str, calinski: str, latent_loss: str, recon: str = SQUARED) -> str:
    return f"""SELECT round(avg(abs(x - xhat)), 6) + 0.0 AS mean_absolute_error,
       round(avg((x - xhat) * (x - xhat)), 6) + 0.0 AS mean_squared_error,
       round(1 - avg(x * xhat), 6) + 0.0 AS mean_cosine_distance,
       round((SELECT separation FROM sep), 6) + 0.0 AS separation,
       round((SELECT s FROM {silhouette}), 6) + 0.0 AS simple_silhouette,
       round(({calinski}), 6) + 0.0 AS calinski_harabasz,
       round(({latent_loss}) + {recon}, 6) + 0.0 AS loss
FROM r"""


# the same CTE names as in SCORED, with the joint rescaled batch by batch
BATCH_TERMS = TERMS.replace("OVER ()", f"OVER (PARTITION BY {BATCH})")


def _with_quality(terms: str) -> str:
    return terms + QUALITY[len(SCORED) :]


# sign, power of two and quarter of the octave; numbers below 2 ** -40 count as zero
STEP_BINS = """bins AS (
  SELECT name, CASE WHEN v = 0 OR abs(v) < pow(2, -40) THEN 0
    ELSE sign(v) * ((floor(log2(abs(v))) + 40) * 4 + floor((abs(v) / pow(2, floor(log2(abs(v)))) - 1) * 4) + 1) END::INTEGER AS bin
  FROM tensors WHERE v IS NOT NULL AND NOT isnan(v)),
used AS (SELECT name, min(bin) AS low, max(bin) AS high FROM bins GROUP BY name),
every AS (SELECT name, unnest(range(low, high + 1))::INTEGER AS bin FROM used),
ends AS (
  SELECT name, bin, pow(2, (abs(bin) - 1) // 4 - 40) * (1 + (abs(bin) - 1) % 4 / 4) AS near, pow(2, abs(bin) // 4 - 40) * (1 + abs(bin) % 4 / 4) AS far
  FROM every)
SELECT name, bin, CASE WHEN bin = 0 THEN -pow(2, -40) WHEN bin < 0 THEN -far ELSE near END AS lower,
       CASE WHEN bin = 0 THEN pow(2, -40) WHEN bin < 0 THEN -near ELSE far END AS upper,
       (SELECT count(*) FROM bins b WHERE b.name = ends.name AND b.bin = ends.bin) AS n FROM ends"""

QUERIES = [
    Query(
        "mean_absolute_error",
        _mae,
        f"WITH {RECONSTRUCTED}\nSELECT round(avg(abs(x - xhat)), 6) + 0.0 AS mean_absolute_error FROM r",
    ),
    Query(
        "mean_squared_error",
        _mse,
        f"WITH {RECONSTRUCTED}\nSELECT round(avg((x - xhat) * (x - xhat)), 6) + 0.0 AS mean_squared_error FROM r",
    ),
    Query(
        "mean_cosine_distance",
        _cosine(1),
        f"WITH {RECONSTRUCTED}\nSELECT round(1 - avg(x * xhat), 6) + 0.0 AS mean_cosine_distance FROM r",
    ),
    Query(
        "mean_cosine_distance_channels",
        _cosine(4),
        f"""WITH {RECONSTRUCTED},
pixel AS (SELECT vec_id, d // 4 AS pixel, sum(x * xhat) AS dot FROM r GROUP BY 1, 2)
SELECT round(1 - avg(dot), 6) + 0.0 AS mean_cosine_distance FROM pixel""",
    ),
    Query("separation", _separation, f"WITH {QUALITY}\nSELECT round(separation, 6) + 0.0 AS separation FROM sep"),
    Query(
        "center_distances",
        _distances,
        f"""WITH {MODEL}
SELECT vec_id, k::INTEGER AS k, round(sqrt(sum((x - mu) * (x - mu))), 6) + 0.0 AS value
FROM e JOIN model USING (d) GROUP BY vec_id, k""",
    ),
    Query(
        "simplified_silhouette",
        _silhouette("per_sample", None),
        f"WITH {QUALITY}\nSELECT round(s, 6) + 0.0 AS silhouette FROM sil",
    ),
    Query(
        "simplified_silhouette_whole",
        _silhouette("batch_min", None),
        f"WITH {QUALITY}\nSELECT round(s, 6) + 0.0 AS silhouette FROM sil_whole",
    ),
    Query(
        "simplified_silhouette_batches",
        _silhouette("batch_min", "batch_id"),
        f"WITH {QUALITY}\nSELECT round(s, 6) + 0.0 AS silhouette FROM sil_batch",
    ),
    Query(
        "histograms",
        _histograms,
        f"""WITH {SCORED},
tensors AS (
  SELECT 'z_mu' AS name, x AS v FROM e UNION ALL SELECT 'z_sigma', ln(0.01 + x * x) FROM e UNION ALL SELECT 'p', p FROM p
  UNION ALL SELECT 'pi', any_value(w) FROM model GROUP BY k UNION ALL SELECT 'mu', mu FROM model UNION ALL SELECT 'var', var FROM model),
{STEP_BINS}""",
    ),
    Query("calinski_harabasz", _calinski("exact", None), f"WITH {QUALITY}\n" + CH.format(e=CH_EXACT, t="ch")),
    Query(
        "calinski_harabasz_running",
        _calinski("running", "batch_id"),
        f"WITH {QUALITY}\n" + CH.format(e=CH_RUNNING, t="chr"),
    ),
    Query(
        "calinski_harabasz_lines",
        _calinski_lines,
        f"""WITH x AS (
  SELECT l_returnflag AS a, unnest(range(4)) AS d, unnest([{", ".join(LINE_FEATURES)}]) AS x FROM lineitem),
c AS (SELECT *, avg(x) OVER (PARTITION BY a, d) AS mk, avg(x) OVER (PARTITION BY d) AS m FROM x),
ch AS (
  SELECT count(*) / 4 AS n, count(DISTINCT a) AS k, sum((mk - m) * (mk - m)) AS between_,
         sum((x - mk) * (x - mk)) AS within_ FROM c)
"""
        + CH.format(e=CH_EXACT, t="ch"),
    ),
    Query(
        "running_mean",
        _running,
        """WITH b AS (SELECT floor(event_id / 64)::BIGINT AS batch_id, avg(value) AS value, count(*) AS n FROM events GROUP BY 1)
SELECT batch_id, round(avg(value) OVER (ORDER BY batch_id), 6) + 0.0 AS by_batch,
       round(sum(value * n) OVER (ORDER BY batch_id) / sum(n) OVER (ORDER BY batch_id), 6) + 0.0 AS by_element
FROM b""",
    ),
    Query(
        "evaluate",
        _evaluate(None),
        f"WITH {_with_quality(TERMS)}\n"
        + _evaluate_sql("sil", f"SELECT {CH_EXACT} FROM ch", "SELECT l2 FROM latent"),
    ),
    Query(
        "evaluate_batches",
        _evaluate("batch_id"),
        f"WITH {_with_quality(BATCH_TERMS)}\n"
        + _evaluate_sql("sil_batch", f"SELECT {CH_RUNNING} FROM chr", "SELECT l2 FROM latent"),
    ),
    Query(
        "evaluate_series",
        _evaluate(None, SERIES_LATENT_SCALE),
        f"WITH {_with_quality(TERMS)}\n"
        + _evaluate_sql("sil", f"SELECT {CH_EXACT} FROM ch", "SELECT 0.02 * l2 FROM latent"),
    ),
    Query(
        "evaluate_sigmoid",
        _evaluate(None, 1.0, "xhat", LOGIT_RANGE),
        f"WITH {_with_quality(TERMS)}\n"
        + _evaluate_sql("sil", f"SELECT {CH_EXACT} FROM ch", "SELECT l2 FROM latent", _entropy("")),
    ),
    Query(
        "evaluate_sigmoid_batches",
        _evaluate("batch_id", SERIES_LATENT_SCALE, "xhat", LOGIT_RANGE),
        f"WITH {_with_quality(BATCH_TERMS)}\n"
        + _evaluate_sql(
            "sil_batch", f"SELECT {CH_RUNNING} FROM chr", "SELECT 0.02 * l2 FROM latent", _entropy(f"PARTITION BY {BATCH}")
        ),
    ),
    Query(
        "histogram",
        _histogram,
        f"""WITH {ELEMENTS},
span AS (SELECT min(x) AS low, (max(x) - min(x)) / 16 AS width FROM e),
b AS (SELECT least(greatest(floor((x - low) / width), 0), 15)::INTEGER AS bin, count(*) AS n FROM e, span GROUP BY 1)
SELECT r.bin::INTEGER AS bin, round(low + r.bin * width, 6) + 0.0 AS lower, round(low + (r.bin + 1) * width, 6) + 0.0 AS upper,
       coalesce(n, 0)::BIGINT AS n
FROM span CROSS JOIN range(16) AS r(bin) LEFT JOIN b ON b.bin = r.bin""",
    ),
    Query(
        "histogram_assignments",
        _assignment_histogram,
        f"""WITH {SCORED}
SELECT r.bin::INTEGER AS bin, r.bin - 0.5::DOUBLE AS lower, r.bin + 0.5::DOUBLE AS upper, count(a)::BIGINT AS n
FROM range(10) AS r(bin) LEFT JOIN assigned ON a = r.bin GROUP BY r.bin""",
    ),
    Query(
        "scalar_log",
        _scalar_log,
        f"""WITH {RECONSTRUCTED}
SELECT 100::BIGINT AS step, 'mean_absolute_error' AS name, round(avg(abs(x - xhat)), 6) + 0.0 AS value FROM r
UNION ALL SELECT 100, 'mean_squared_error', round(avg((x - xhat) * (x - xhat)), 6) + 0.0 FROM r
UNION ALL SELECT 100, 'mean_cosine_distance', round(1 - avg(x * xhat), 6) + 0.0 FROM r""",
    ),
]
