"""Streaming jobs. One micro-batch is one batch of the batch-dependent operators.

Every micro-batch is written to a folder of its own id, overwritten when the batch is retried, so a restart after a
lost executor or driver neither drops nor doubles rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from mixframe.functions.vectors import elements
from mixframe.model import Mixture, ModelLike, as_mixture
from mixframe.operators.fitting import diag_gmm, kmeans, momentum_update
from mixframe.operators.metrics import batch_dispersions, dispersion_ratio, running_mean, silhouette_sums
from mixframe.operators.scoring import assign, joint_log_prob, predict

Writer = Callable[[DataFrame, int], None]

# Fixed value: rows of which a fraction below one is pooled.
POOL_ROWS = 256


def _start(stream: DataFrame, write: Writer, checkpoint: str, available_now: bool) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def _batch_path(path: str, batch_id: int) -> str:
    return f"{path.rstrip('/')}/batch={batch_id}"


def score_stream(
    stream: DataFrame,
    model: ModelLike,
    path: str,
    checkpoint: str,
    ids: list[str],
    z_mu: str = "z_mu",
    z_sigma: str | None = None,
    z: str | None = None,
    available_now: bool = True,
) -> StreamingQuery:
    """Predictions of a stream of latent rows, partitioned by micro-batch; each is rescaled by its own range."""
    mixture = as_mixture(model)

    def write(rows: DataFrame, batch_id: int) -> None:
        held = rows.persist()  # the range and the scores both read it; a remote source is fetched once
        try:
            predictions = predict(held, mixture, ids, z_mu, z_sigma, z)
            predictions.write.mode("overwrite").parquet(_batch_path(path, batch_id))
        finally:
            held.unpersist()

    return _start(stream, write, checkpoint, available_now)


def metrics_stream(
    stream: DataFrame, path: str, checkpoint: str, x: str = "x", xhat: str = "xhat", available_now: bool = True
) -> StreamingQuery:
    """Sums and counts of the reconstruction errors of every micro-batch; ``running_metrics`` reads them."""

    def write(rows: DataFrame, batch_id: int) -> None:
        a, b = F.col(x), F.col(xhat)
        sums = elements(rows, x, xhat).agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(F.abs(a - b)).alias("absolute"),
            F.sum((a - b) * (a - b)).alias("squared"),
            F.sum(a * b).alias("product"),
        )
        sums.write.mode("overwrite").parquet(_batch_path(path, batch_id))

    return _start(stream, write, checkpoint, available_now)


def running_metrics(spark: SparkSession, path: str, channels: int = 1) -> DataFrame:
    """The metrics over all micro-batches written so far."""
    sums = spark.read.parquet(path)
    return sums.agg(
        (F.sum("absolute") / F.sum("n")).alias("mean_absolute_error"),
        (F.sum("squared") / F.sum("n")).alias("mean_squared_error"),
        (1.0 - F.sum("product") * F.lit(float(channels)) / F.sum("n")).alias("mean_cosine_distance"),
    )


def cluster_metrics_stream(
    stream: DataFrame, model: ModelLike, path: str, checkpoint: str, z_mu: str = "z_mu", available_now: bool = True
) -> StreamingQuery:
    """The cluster statistics of every micro-batch, one row each; ``running_cluster_metrics`` reads them.

    The rows written are the state of the running metrics: a restarted stream goes on from them, a retried micro-batch replaces its
    own. A micro-batch without rows leaves none.
    """
    mixture = as_mixture(model)

    def write(rows: DataFrame, batch_id: int) -> None:
        held = assign(joint_log_prob(rows.select(z_mu), mixture, z_mu)).select(z_mu, "assignments").persist()
        try:
            spread = batch_dispersions(held, z_mu, "assignments")
            quality = silhouette_sums(held, mixture, z_mu)
            found = spread.withColumn("__s", quality.select(F.struct("*")).scalar())
            found = found.select("rows", "labels", "between", "within", "__s.silhouette", "__s.silhouettes")
            found.where("rows > 0").coalesce(1).write.mode("overwrite").parquet(_batch_path(path, batch_id))
        finally:
            held.unpersist()

    return _start(stream, write, checkpoint, available_now)


CLUSTER_STATE = "rows bigint, labels bigint, between double, within double, silhouette double, silhouettes bigint, batch bigint"


def running_cluster_metrics(spark: SparkSession, path: str) -> DataFrame:
    """After every micro-batch written so far: rows, running silhouette and running dispersion ratio.

    The silhouette is the mean over all rows up to there, whose b is the least distance in their micro-batch. The dispersion ratio is
    the mean of the scores of the micro-batches, each with the running means of the dispersions: as of
    ``calinski_harabasz(mode="running")``.
    """
    states = spark.read.schema(CLUSTER_STATE).parquet(path)
    spread = running_mean(states, "batch", {"between": "__between", "within": "__within"})
    scored = spread.withColumn("__ch", dispersion_ratio(F.col("rows"), F.col("labels"), F.col("__between"), F.col("__within")))
    scored = running_mean(scored, "batch", {"__ch": "calinski_harabasz"})
    mean = F.coalesce(F.col("silhouette") / F.nullif("silhouettes", F.lit(0)), F.lit(0.0))
    found = running_mean(scored.withColumn("__s", mean), "batch", {"__s": "simple_silhouette"}, weight="silhouettes")
    return found.select("batch", "rows", "simple_silhouette", "calinski_harabasz")


def init_stream(
    stream: DataFrame,
    pool_path: str,
    model_path: str,
    checkpoint: str,
    init_steps: float,
    k: int,
    start: Mixture,
    gamma: float = 0.0,
    z_mu: str = "z_mu",
    seed: int = 0,
    max_iter: int = 10000,
    available_now: bool = True,
) -> StreamingQuery:
    """Pool the first micro-batches, then fit k-means and the mixture once and write the model table.

    ``init_steps`` below one pools that share of ``POOL_ROWS`` rows, at least one, of the first micro-batch: the first in the
    order of a hash of the code.

    A marker beside the model, written last, says that the fit is done: a micro-batch that is retried after it does not fit again. The
    model is one file, so it is there or not. A stream may end before there are enough micro-batches: see ``await_model``.
    """
    last = math.ceil(init_steps) - 1

    def write(rows: DataFrame, batch_id: int) -> None:
        if batch_id > last:
            return
        if init_steps < 1:
            rows = rows.orderBy(F.xxhash64(z_mu, F.lit(seed))).limit(max(1, int(init_steps * POOL_ROWS)))
        rows.select(z_mu).write.mode("overwrite").parquet(_batch_path(pool_path, batch_id))
        if batch_id < last:
            return
        if _marked(rows.sparkSession, model_path, checkpoint):
            return
        pool = rows.sparkSession.read.parquet(pool_path).filter(F.col("batch") <= last)
        centres = kmeans(pool, z_mu, k, seed).centres
        fit = diag_gmm(pool, z_mu, centres, max_iter)
        fitted = momentum_update(start, centres, fit.model.variances, gamma)
        fitted.to_table(rows.sparkSession).coalesce(1).write.mode("overwrite").parquet(model_path)
        marker = rows.sparkSession.createDataFrame([(batch_id + 1, checkpoint)], MARKER)
        marker.coalesce(1).write.mode("overwrite").parquet(_marker_path(model_path))

    return _start(stream, write, checkpoint, available_now)


MARKER = "batches bigint, checkpoint string"


def _marker_path(model_path: str) -> str:
    return f"{model_path.rstrip('/')}.fitted"


def _rows_or_none(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def _marked(spark: SparkSession, model_path: str, checkpoint: str | None = None) -> bool:
    marker = _rows_or_none(spark, _marker_path(model_path), MARKER)
    if marker is None:
        return False
    return bool(marker.where(F.lit(True) if checkpoint is None else F.col("checkpoint") == checkpoint).head(1))


def await_model(query: StreamingQuery, spark: SparkSession, pool_path: str, model_path: str, init_steps: float) -> Mixture:
    """The model of an ``init_stream`` whose stream has an end; an error if it ended with too few micro-batches."""
    query.awaitTermination()
    model = fitted_model(spark, model_path) if _marked(spark, model_path) else None
    if model is None:
        pooled = _rows_or_none(spark, pool_path, "batch bigint")
        seen = 0 if pooled is None else pooled.select("batch").distinct().count()
        raise ValueError(f"the stream ended after {seen} of the {max(1, math.ceil(init_steps))} micro-batches to pool")
    return model


def fitted_model(spark: SparkSession, model_path: str) -> Mixture | None:
    """The model ``init_stream`` wrote, or None while it is still pooling."""
    try:
        return Mixture.from_table(spark.read.parquet(model_path))
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
