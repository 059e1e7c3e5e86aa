"""Mini-batch ids: an exact global rank without a global sort in one task."""

from __future__ import annotations

import math

from pyspark import StorageLevel
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mixframe.functions.hashing import md5_long
from mixframe.operators.lookup import lookup_join
from mixframe.session import cut

DEFAULT_BATCH = 512
# Rows that one task sorts when ranking, and the most buckets a ranking uses.
BUCKET_ROWS = 1_000_000
MAX_BUCKETS = 1 << 16
# Sampled keys for each quantile that cuts two buckets.
KEYS_PER_BUCKET = 200
# A bucket this many times larger than planned holds a key that repeats.
HOT_FACTOR = 8
HASH_DIGITS = 15


def _bucket_count(rows: int) -> int:
    return max(1, min(MAX_BUCKETS, math.ceil(rows / BUCKET_ROWS)))


def _ranked(
    df: DataFrame, bucket: str, order: list[str | Column], out: str, expected: int, epoch: tuple[int, int] | None = None
) -> DataFrame:
    """Position of every row from 0, given a bucket column that is monotone in the order.

    Counting the buckets reads only the key columns and shuffles one row per bucket and task. The offsets are a window
    over that small table, and the rows themselves are shuffled once, by bucket. A bucket far above the ``expected``
    size means that one key repeats; then the rows are sorted instead. ``epoch``, the buckets and rows of one of several
    equal passes, keeps the window to the buckets of a pass, however many passes there are.
    """
    counts = df.groupBy(bucket).agg(F.count(F.lit(1)).alias("__n")).persist(StorageLevel.MEMORY_AND_DISK)
    largest = counts.agg(F.max("__n")).first()[0] or 0
    if largest > HOT_FACTOR * max(expected, BUCKET_ROWS):
        counts.unpersist()
        return sorted_rank(df, order, out)
    buckets, rows = epoch or (1, 0)
    turn = F.floor(F.col(bucket) / F.lit(buckets)).cast("bigint") if epoch else F.lit(0).cast("bigint")
    earlier = Window.partitionBy("__turn").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("__n").over(earlier), F.lit(0)) + F.col("__turn") * F.lit(rows)
    offsets = counts.withColumn("__turn", turn).select(bucket, before.alias("__offset"))
    within = Window.partitionBy(bucket).orderBy(*order)
    ranked = lookup_join(df, offsets, bucket, row_bytes=32)
    return ranked.withColumn(out, F.row_number().over(within) - 1 + F.col("__offset")).drop("__offset")


def sorted_rank(df: DataFrame, order: list[str | Column], out: str) -> DataFrame:
    """Position of every row from 0, for keys that need not be unique; equal keys come in any order.

    A range sort whose last key is random, so that the copies of one key fill as many tasks as they need. The sorted
    rows are checkpointed with their place in the partition, which makes the random choice final, and the counts of
    the partitions give the offsets.
    """
    spread = df.withColumn("__spread", F.rand(0))
    partitioned = spread.repartitionByRange(*order, "__spread").sortWithinPartitions(*order, "__spread")
    placed = cut(partitioned.drop("__spread").withColumn("__place", F.monotonically_increasing_id()))
    part = F.shiftright("__place", 33)
    placed = placed.withColumn("__part", part)
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    offsets = counts.select("__part", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__offset"))
    ranked = lookup_join(placed, offsets, "__part", row_bytes=32)
    position = F.col("__place").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("__offset")
    return ranked.withColumn(out, position).drop("__place", "__part", "__offset")


def global_rank(df: DataFrame, key: str, out: str = "rank", rows_per_bucket: int | None = None) -> DataFrame:
    """Exact position of every row, from 0, in the order of a numeric key; rows of equal keys come in any order.

    Buckets are cut at the key's approximate quantiles, so they stay even however the keys are spread.
    """
    if not isinstance(df.schema[key].dataType, T.NumericType):
        raise TypeError(f"{key} must be numeric; use sorted_rank for other ids")
    rows = df.select(key).count()
    buckets = _bucket_count(rows) if rows_per_bucket is None else max(1, math.ceil(rows / rows_per_bucket))
    cuts: list[float] = []
    if buckets > 1:
        shares = [i / buckets for i in range(1, buckets)]
        # the cuts only balance the buckets, whose rows are then counted exactly, so a sample of the keys is enough
        numeric = df.select(F.col(key).cast("double").alias("key"))
        if rows > KEYS_PER_BUCKET * buckets:
            numeric = numeric.sample(KEYS_PER_BUCKET * buckets / rows, seed=0)
        found = numeric.approxQuantile("key", shares, 1.0 / (4 * buckets))
        cuts = sorted({c for c in found if math.isfinite(c)})
    # NaN is the largest key: it shares the last bucket with infinity and comes after it there
    keyed = df.withColumn("__key", F.nanvl(F.col(key).cast("double"), F.lit(float("inf"))))
    if cuts:
        splits = [float("-inf"), *cuts, float("inf")]
        bucketed = Bucketizer(splits=splits, inputCol="__key", outputCol="__bucket").transform(keyed)
    else:
        bucketed = keyed.withColumn("__bucket", F.lit(0.0))
    # null keys come first, as in the order of the key
    bucketed = bucketed.withColumn("__bucket", F.coalesce("__bucket", F.lit(-1.0)))
    return _ranked(bucketed, "__bucket", [key], out, rows // buckets).drop("__key", "__bucket")


def id_rank(df: DataFrame, ids: list[str], out: str = "rank", rows_per_bucket: int | None = None) -> DataFrame:
    """Position of every row, from 0, in the order of its ids; null comes first, rows of equal ids in any order.

    A single numeric id is ranked by buckets of its quantiles; text and composite ids by a range sort. Without ids the rows
    keep no order of their own: one is drawn and checkpointed.
    """
    if len(ids) == 1 and isinstance(df.schema[ids[0]].dataType, T.NumericType):
        return global_rank(df, ids[0], out, rows_per_bucket)
    return sorted_rank(df, list(ids), out)


def sequential_batches(
    df: DataFrame,
    id_col: str | list[str],
    size: int = DEFAULT_BATCH,
    out: str = "batch_id",
    rows_per_bucket: int | None = None,
) -> DataFrame:
    """Consecutive batches of ``size`` rows in the order of one or several ids; only the last one may be short."""
    ranked = id_rank(df, [id_col] if isinstance(id_col, str) else id_col, "__rank", rows_per_bucket)
    return ranked.withColumn(out, F.floor(F.col("__rank") / size).cast("bigint")).drop("__rank")


def _shuffle_key(id_col: str, seed: int) -> Column:
    return md5_long(id_col, F.col("epoch"), F.lit(seed), digits=HASH_DIGITS)


def shuffled_batches(
    df: DataFrame,
    id_col: str,
    size: int,
    epochs: int = 1,
    seed: int = 0,
    out: str = "batch_id",
    rows_per_bucket: int | None = None,
) -> DataFrame:
    """``epochs`` full passes, each in a hash order of its own, cut into batches of ``size``.

    The passes are repeated before they are cut, so a batch may straddle two epochs. The leading digits of the hash are
    the ranking bucket: evenly filled for unique ids.
    """
    per_epoch = df.select(id_col).count()
    buckets = _bucket_count(per_epoch) if rows_per_bucket is None else max(1, math.ceil(per_epoch / rows_per_bucket))
    step = math.ceil(16**HASH_DIGITS / buckets)
    repeated = df.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    keyed = repeated.withColumn("__hash", _shuffle_key(id_col, seed))
    bucketed = keyed.withColumn(
        "__bucket", F.col("epoch").cast("bigint") * F.lit(buckets) + F.floor(F.col("__hash") / F.lit(float(step)))
    )
    order = ["epoch", "__hash", id_col]
    ranked = _ranked(bucketed, "__bucket", order, "__rank", per_epoch // buckets, (buckets, per_epoch))
    return ranked.withColumn(out, F.floor(F.col("__rank") / size).cast("bigint")).drop("__rank", "__hash", "__bucket")


def take_batches(df: DataFrame, n: int, batch_col: str = "batch_id") -> DataFrame:
    """The first ``n`` batches."""
    return df.filter(F.col(batch_col) < n)


def first_shuffled_rows(df: DataFrame, id_col: str, n: int, seed: int = 0) -> DataFrame:
    """Exactly the first ``n`` rows of ``shuffled_batches``' hash order, without ranking the whole table.

    A hash threshold that expects a few more than ``n`` rows is a plain filter on the scan; only the rows below it are
    ranked. When fewer than ``n`` turn up, the threshold is raised, so the answer is exact.
    """
    rows = df.select(id_col).count()
    if n <= 0:
        return df.limit(0)
    if n > rows:
        epochs = math.ceil(n / rows) if rows else 1
        return take_batches(shuffled_batches(df, id_col, n, epochs, seed), 1).drop("batch_id", "epoch")
    keyed = df.withColumn("epoch", F.lit(0)).withColumn("__hash", _shuffle_key(id_col, seed))
    wanted = n + 6.0 * math.sqrt(n) + 10.0
    while True:
        limit = int(min(1.0, wanted / rows) * 16**HASH_DIGITS)
        below = keyed.filter(F.col("__hash") < F.lit(limit))
        if limit >= 16**HASH_DIGITS or below.select("__hash").count() >= n:
            break
        wanted *= 2.0
    buckets = _bucket_count(int(wanted))
    bucketed = below.withColumn("__bucket", F.floor(F.col("__hash") / F.lit(float(math.ceil(limit / buckets)))))
    ranked = _ranked(bucketed, "__bucket", ["__hash", id_col], "__rank", int(wanted) // buckets)
    return ranked.filter(F.col("__rank") < n).select(*df.columns)
