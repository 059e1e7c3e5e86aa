"""Reconstruction and cluster-quality metrics."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mixframe.functions import mixture
from mixframe.functions.vectors import doubles, elements, exploded
from mixframe.model import Mixture, ModelLike, as_mixture
from mixframe.operators.batching import global_rank
from mixframe.operators.lookup import lookup_join
from mixframe.operators.losses import sigmoid_recon_loss
from mixframe.operators.runs import Aligned, by_batch

# Rows of the small per-batch table that one task accumulates.
PREFIX_CHUNK = 100_000
# Chunk totals that one task accumulates.
MAX_CHUNKS = 1_000_000


def reconstruction_metrics(df: DataFrame, x: str = "x", xhat: str = "xhat", channels: int = 1) -> DataFrame:
    """Mean absolute error, mean squared error and mean cosine distance in one scan.

    The cosine distance is one minus the mean over pixels of the channel-wise product; nothing is normalised.
    """
    a, b = F.col(x), F.col(xhat)
    return elements(df, x, xhat).agg(
        F.avg(F.abs(a - b)).alias("mean_absolute_error"),
        F.avg((a - b) * (a - b)).alias("mean_squared_error"),
        (1.0 - F.avg(a * b) * F.lit(float(channels))).alias("mean_cosine_distance"),
    )


def mean_absolute_error(df: DataFrame, x: str = "x", xhat: str = "xhat") -> DataFrame:
    return reconstruction_metrics(df, x, xhat).select("mean_absolute_error")


def mean_squared_error(df: DataFrame, x: str = "x", xhat: str = "xhat") -> DataFrame:
    return reconstruction_metrics(df, x, xhat).select("mean_squared_error")


def mean_cosine_distance(df: DataFrame, x: str = "x", xhat: str = "xhat", channels: int = 1) -> DataFrame:
    return reconstruction_metrics(df, x, xhat, channels).select("mean_cosine_distance")


def separation(model: DataFrame, out: str = "separation") -> DataFrame:
    """Mean Euclidean distance of the pairs of centres; null for a single centre.

    Works on the K model rows only: each centre is measured against the K literal centres in a narrow pass.
    """
    return _separation(model, as_mixture(model), out)


def _separation(table: DataFrame, m: Mixture, out: str) -> DataFrame:
    if m.k == 1:
        return table.agg(F.lit(None).cast("double").alias(out))
    values = exploded(table.select(mixture.distances("mu", m).alias("d")), [], F.col("d"), "k", "x")
    return values.agg((F.sum("x") / F.lit(float(m.k * m.k - m.k))).alias(out))


def center_distances(df: DataFrame, model: ModelLike, z_mu: str = "z_mu", out: str = "distances") -> DataFrame:
    """Distance of every row to each of the K centres."""
    return df.withColumn(out, mixture.distances(z_mu, as_mixture(model)))


def _silhouette(own: Column, near: Column) -> Column:
    return (near - own) / F.nullif(F.greatest(own, near), F.lit(0.0))


def simplified_silhouette(
    df: DataFrame,
    model: ModelLike,
    mode: str = "per_sample",
    batch_col: str | None = None,
    z_mu: str = "z_mu",
    label: str = "assignments",
    out: str = "silhouette",
    aligned: Aligned | None = None,
) -> DataFrame:
    """Mean of (b - a) / max(a, b) with a = distance to the own model centre.

    ``per_sample``: b is the row's nearest other centre. ``batch_min``: b is one number for the batch, the smallest
    positive distance of any of its rows to a centre other than its own. Null for a single centre. ``aligned`` batches
    take it from a window over two numbers a row.
    """
    if mode not in ("per_sample", "batch_min"):
        raise ValueError(f"unknown silhouette mode {mode!r}")
    batch = [aligned.batch] if aligned else [batch_col] if batch_col else []
    quality = mixture.own_and_near(z_mu, label, as_mixture(model), positive_only=mode == "batch_min")
    own, near = F.col("__q.own").alias("__own"), F.col("__q.near").alias("__near")
    rows = df.select(*batch, quality.alias("__q")).select(*batch, own, near)
    if mode == "batch_min":
        least = F.min("__near").alias("__near")
        if aligned is not None:
            rows = rows.select("__own", by_batch(F.min("__near"), aligned).alias("__near"))
        elif batch_col is None:
            rows = rows.select("__own", rows.select(least).scalar().alias("__near"))
        else:
            rows = lookup_join(rows.drop("__near"), rows.groupBy(batch_col).agg(least), batch_col, row_bytes=32)
    return rows.agg(F.avg(_silhouette(F.col("__own"), F.col("__near"))).alias(out))


def silhouette_sums(df: DataFrame, model: ModelLike, z_mu: str = "z_mu", label: str = "assignments") -> DataFrame:
    """Sum and number of the ``batch_min`` silhouettes of one batch."""
    quality = mixture.own_and_near(z_mu, label, as_mixture(model), positive_only=True)
    rows = df.select(quality.alias("__q")).select("__q.own", "__q.near")
    value = _silhouette(F.col("own"), rows.select(F.min("near")).scalar())
    return rows.select(value.alias("v")).agg(F.sum("v").alias("silhouette"), F.count("v").alias("silhouettes"))


def _dispersions(df: DataFrame, z: str, label: str, batch: list[str]) -> DataFrame:
    """For each batch: rows, labels present, between-cluster and within-cluster dispersion.

    One exploded aggregate to (batch, label, dimension) moments, combined on the map side; the rest works on those.
    """
    values = exploded(df, [*batch, F.col(label).alias("__label")], doubles(z), "__d", "__x")
    moments = values.groupBy(*batch, "__label", "__d").agg(
        F.count("__x").alias("__n"), F.avg("__x").alias("__mean"), F.var_pop("__x").alias("__var")
    )
    # the clusters of one batch and dimension: at most K rows
    clusters = Window.partitionBy(*batch, "__d")
    centre = F.sum(F.col("__n") * F.col("__mean")).over(clusters) / F.sum("__n").over(clusters)
    centred = moments.withColumn("__off", F.col("__mean") - centre)
    first = F.col("__d") == 0
    return centred.groupBy(*batch).agg(
        F.sum(F.when(first, F.col("__n"))).alias("__rows"),
        F.count_if(first).alias("__labels"),
        F.sum(F.col("__n") * F.col("__off") * F.col("__off")).alias("__between"),
        F.sum(F.col("__n") * F.col("__var")).alias("__within"),
    )


def batch_dispersions(df: DataFrame, z: str = "z_mu", label: str = "assignments") -> DataFrame:
    """Rows, labels present, and between- and within-cluster dispersion of one batch."""
    found = _dispersions(df, z, label, [])
    return found.select(*[F.col(f"__{c}").alias(c) for c in ("rows", "labels", "between", "within")])


def _ratio(between: Column, within: Column) -> Column:
    return dispersion_ratio(F.col("__rows"), F.col("__labels"), between, within)


def dispersion_ratio(n: Column, k: Column, between: Column, within: Column) -> Column:
    """B (n - k) / (W (k - 1)); one where the denominator is zero."""
    denominator = within * (k - 1)
    return F.when(denominator == 0, F.lit(1.0)).otherwise(between * (n - k) / F.nullif(denominator, F.lit(0.0)))


def calinski_harabasz(
    df: DataFrame,
    z: str = "z_mu",
    label: str = "assignments",
    mode: str = "exact",
    batch_col: str | None = None,
    out: str = "calinski_harabasz",
) -> DataFrame:
    """Ratio of between- to within-cluster dispersion, B (n - k) / (W (k - 1)); one where the denominator is zero.

    ``exact`` treats the table as one batch. ``running`` scores every batch with the running means of B and W and its
    own n and k, then averages the scores.
    """
    if mode == "exact":
        return _dispersions(df, z, label, []).select(_ratio(F.col("__between"), F.col("__within")).alias(out))
    if mode != "running" or batch_col is None:
        raise ValueError("mode is exact, or running with a batch column")
    # one row for each batch: kept, because the ids' range, the totals and the rows all read it
    batches = _dispersions(df, z, label, [batch_col]).persist(StorageLevel.MEMORY_AND_DISK)
    running = running_mean(batches, batch_col, {"__between": "__mb", "__within": "__mw"})
    return running.agg(F.avg(_ratio(F.col("__mb"), F.col("__mw"))).alias(out))


def running_mean(
    df: DataFrame, order: str, columns: dict[str, str], weight: str | None = None, chunk: int = PREFIX_CHUNK
) -> DataFrame:
    """Streaming mean in the order of a unique bigint batch id: the (weighted) mean of all rows up to each row.

    ``columns`` maps a value column to its output name. The rows are cut into chunks; sums run inside each chunk and
    start from the total of the chunks before it, so no task sees more than ``chunk`` rows or all of the chunk totals.
    Ids far apart are ranked first, so that chunks stay full.
    """
    position = order
    ends = df.agg(F.min(order).alias("low"), F.max(order).alias("high")).first()
    rows = df
    if ends["low"] is not None and (ends["high"] - ends["low"]) // chunk > MAX_CHUNKS:
        rows, position = global_rank(df, order, "__rank", chunk), "__rank"
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    rows = rows.withColumn("__w", w).withColumn("__chunk", F.floor(F.col(position) / F.lit(chunk)))
    for i, name in enumerate(columns):
        rows = rows.withColumn(f"__v{i}", F.col(name) * F.col("__w"))
    parts = ["__w", *[f"__v{i}" for i in range(len(columns))]]
    totals = rows.groupBy("__chunk").agg(*[F.sum(p).alias(p) for p in parts])
    before = Window.orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("__chunk", *[F.coalesce(F.sum(p).over(before), F.lit(0.0)).alias(f"{p}o") for p in parts])
    upto = Window.partitionBy("__chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    joined = lookup_join(rows, offsets, "__chunk", row_bytes=16 * (len(parts) + 1))
    sums = {p: F.sum(p).over(upto) + F.col(f"{p}o") for p in parts}
    means = [(sums[f"__v{i}"] / sums["__w"]).alias(out) for i, out in enumerate(columns.values())]
    return joined.select(*df.columns, *means)


def histogram(df: DataFrame, col: str, bins: int = 30, low: float | None = None, high: float | None = None) -> DataFrame:
    """Equal-width histogram of a scalar or of all elements of an array column: bin, lower edge, upper edge, n.

    Without limits the range of the data is used. The last bin is closed; values outside the limits count in the
    outermost bins; NaN and null are left out. Empty bins count 0; a table
    without values has no bins unless both limits are given.
    """
    is_array = df.schema[col].dataType.typeName() == "array"
    empty = False
    values = exploded(df, [], doubles(col), "d", "v") if is_array else df.select(F.col(col).cast("double").alias("v"))
    values = values.filter(F.col("v").isNotNull() & ~F.isnan("v"))
    if low is None or high is None:
        found = values.agg(F.min("v").alias("low"), F.max("v").alias("high")).first()
        if found["low"] is None:
            found, empty = {"low": 0.0, "high": 0.0}, True
        low = found["low"] if low is None else low
        high = found["high"] if high is None else high
    width = (high - low) / bins or 1.0
    index = F.least(F.greatest(F.floor((F.col("v") - F.lit(low)) / F.lit(width)), F.lit(0)), F.lit(bins - 1))
    counted = values.groupBy(index.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    every = df.sparkSession.range(0 if empty else bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(F.broadcast(counted), "bin", "left").select(
        "bin",
        (F.lit(low) + F.col("bin") * F.lit(width)).alias("lower"),
        (F.lit(low) + (F.col("bin") + 1) * F.lit(width)).alias("upper"),
        F.coalesce("n", F.lit(0).cast("bigint")).alias("n"),
    )


def evaluate(
    df: DataFrame,
    model: ModelLike,
    x: str = "x",
    xhat: str = "xhat",
    z_mu: str = "z_mu",
    z_sigma: str | None = None,
    frame: tuple[int, int] = (1, 1),
    channels: int = 1,
    batch_col: str | None = None,
    latent_scale: float = 1.0,
    logits: str | None = None,
    logit_range: float | None = None,
    aligned: Aligned | None = None,
) -> DataFrame:
    """All metrics of a scored table in one record; with ``z_sigma`` also the reported loss.

    The loss is the reconstruction loss plus ``latent_scale`` times the mixture loss. The reconstruction loss is the
    squared error times the pixels, or with a ``logits`` column the sigmoid cross-entropy, whose logits ``logit_range``
    first maps to [0, logit_range] by the range of their batch.

    ``df`` has assignments and, for the loss, gamma. The row-wise metrics share one scan, the dispersions take another.
    With ``batch_col`` the batch-dependent metrics are taken batch by batch, for ``aligned`` batches
    by windows instead of joins. ``df`` is read once more for each scalar
    subquery, so persist it when scoring it is dear.
    """
    m = as_mixture(model)
    batch_col = aligned.batch if aligned else batch_col
    rows = df.select(
        F.size(x).alias("n"),
        mixture.error_sums(x, xhat).alias("e"),
        mixture.own_and_near(z_mu, "assignments", m, positive_only=False).alias("q"),
        *([] if z_sigma is None else [mixture.latent_loss_terms(z_mu, z_sigma, "gamma", m).alias("latent")]),
    )
    squared = F.sum("e.squared") / F.sum("n")
    record = [
        (F.sum("e.absolute") / F.sum("n")).alias("mean_absolute_error"),
        squared.alias("mean_squared_error"),
        (1.0 - F.sum("e.product") * F.lit(float(channels)) / F.sum("n")).alias("mean_cosine_distance"),
        F.avg(_silhouette(F.col("q.own"), F.col("q.near"))).alias("simple_silhouette"),
    ]
    if z_sigma is not None:
        recon = F.lit(0.0) if logits else squared * F.lit(float(frame[0] * frame[1]))
        record.append((recon + F.avg("latent") * F.lit(float(latent_scale))).alias("loss"))
    found = rows.agg(*record)
    if z_sigma is not None and logits is not None:
        entropy = sigmoid_recon_loss(df, x, logits, logit_range, batch_col, aligned=aligned)
        found = found.withColumn("loss", F.col("loss") + entropy.scalar())
    if batch_col is not None:
        by_batch = simplified_silhouette(df, m, "batch_min", batch_col, z_mu, aligned=aligned)
        found = found.withColumn("simple_silhouette", by_batch.scalar())
    mode = "exact" if batch_col is None else "running"
    dispersion = calinski_harabasz(df, z_mu, mode=mode, batch_col=batch_col)
    apart = _separation(m.to_table(df.sparkSession), m, "separation")
    return found.withColumn("separation", apart.scalar()).withColumn("calinski_harabasz", dispersion.scalar())
