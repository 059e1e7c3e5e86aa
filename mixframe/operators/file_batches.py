"""Mini-batch ids from the order of files, without sorting rows, and shuffled ones by permutation.

A row of a Parquet file has a position in it, which the scan gives as hidden metadata. With the rows of earlier files
added, it is the row's number in the table. The scan counts the files (one small row each), so numbering the rows takes one aggregate and
a join with a small table: no row moves. A shuffled pass is a permutation of these numbers; further passes cost nothing more.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mixframe.functions import arrow
from mixframe.functions.permutation import number_at, place_of
from mixframe.operators.batching import DEFAULT_BATCH
from mixframe.operators.lookup import BROADCAST_BYTES, lookup_join

FILE, ROW = "_metadata.file_path", "_metadata.row_index"
#: Bytes of a file's row in the table of offsets, and of a wanted row's number.
FILE_BYTES, NUMBER_BYTES = 512, 24


def file_offsets(df: DataFrame) -> tuple[DataFrame, int]:
    """``__file``, rows ``n`` and rows of earlier files ``__offset`` of each file of a scan, in the order of their paths; and all rows."""
    counts = df.select(F.col(FILE).alias("__file")).groupBy("__file").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.orderBy("__file").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("__offset", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    return offsets, counts.agg(F.sum("n")).first()[0] or 0


def file_order(df: DataFrame, out: str = "rank", offsets: DataFrame | None = None) -> DataFrame:
    """``df`` with the number of every row, from 0, in the order of the files' paths and the rows inside them.

    ``df`` must be a scan of Parquet files: its columns may be chosen, its rows not yet filtered. The table of offsets has a row for
    each file and is broadcast if its counted size allows it. With the ``offsets`` of a scan, ``df`` may be some files of it.
    """
    offsets = file_offsets(df)[0] if offsets is None else offsets
    placed = df.select("*", F.col(FILE).alias("__file"), F.col(ROW).alias("__row"))
    numbered = lookup_join(placed, offsets.drop("n"), "__file", row_bytes=FILE_BYTES)
    return numbered.withColumn(out, F.col("__offset") + F.col("__row")).drop("__file", "__row", "__offset")


def sequential_batches_file_order(df: DataFrame, size: int = DEFAULT_BATCH, out: str = "batch_id") -> DataFrame:
    """Consecutive batches of ``size`` rows as the files hold them; only the last one may be short."""
    return file_order(df, "__rank").withColumn(out, F.floor(F.col("__rank") / size).cast("bigint")).drop("__rank")


def permuted_batches(
    ranked: DataFrame, rank: str, rows: int, size: int, epochs: int = 1, seed: int = 0, out: str = "batch_id", first: int | None = None
) -> DataFrame:
    """``epochs`` full passes over ``rows`` rows numbered by ``rank``, each in an order of its own, cut into batches of ``size``.

    The passes come one after another before they are cut, so a batch may straddle two epochs. The batch of a row in an epoch is a
    function of its number, so no pass is sorted, stored or shuffled. ``first`` gives the rows of the first batches only: the
    epochs that they do not reach are never made, and rows beyond them are filtered where they are read.
    """
    if first is not None:
        epochs = min(epochs, math.ceil(first * size / rows)) if rows and first > 0 else 0
    repeated = ranked.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1)) if epochs else F.array().cast("array<int>")))
    place = F.col("epoch").cast("bigint") * F.lit(rows) + place_of(rank, "epoch", rows, seed)
    batched = repeated.withColumn(out, F.floor(place / F.lit(size)).cast("bigint"))
    return batched if first is None else batched.filter(F.col(out) < first)


def shuffled_file_batches(df: DataFrame, size: int, epochs: int = 1, seed: int = 0, out: str = "batch_id") -> DataFrame:
    """``permuted_batches`` of a scan, numbered in file order: two small jobs, and no row moves."""
    offsets, rows = file_offsets(df)
    return permuted_batches(file_order(df, "__rank", offsets), "__rank", rows, size, epochs, seed, out).drop("__rank")


def first_shuffled_file_batches(
    df: DataFrame, n: int, size: int, epochs: int = 1, seed: int = 0, out: str = "batch_id", limit: int = BROADCAST_BYTES
) -> DataFrame:
    """The first ``n`` batches of ``shuffled_file_batches``, found by the inverse permutation.

    The places of the batches give the numbers of their rows, and these the files; files without such a row are not read.
    The numbers are broadcast if they fit, so the table is read where it lies; more of them are a join.
    """
    offsets, rows = file_offsets(df)
    wanted = min(n * size, epochs * rows)
    ids = df.sparkSession.range(max(0, wanted)).select(
        F.floor(F.col("id") / F.lit(max(1, rows))).cast("int").alias("epoch"), F.col("id").alias("__at")
    )
    place = (F.col("__at") - F.col("epoch").cast("bigint") * F.lit(rows)).cast("bigint")
    numbers = ids.select("epoch", F.floor(F.col("__at") / F.lit(size)).cast("bigint").alias(out), number_at(place, "epoch", rows, seed).alias("__number"))
    if wanted * NUMBER_BYTES > limit:
        return file_order(df, "__number", offsets).join(numbers, "__number").drop("__number")
    # few numbers: their files are known before the table is read; the driver lists the files of a scan anyway
    listed = offsets.select("__file", "__offset").orderBy("__offset").toArrow().to_pydict()
    starts = np.array(listed["__offset"], np.int64)

    def file_of(number: pa.Array) -> pa.Array:
        return pa.array(np.searchsorted(starts, number.to_numpy(zero_copy_only=False), "right").astype(np.int64) - 1)

    met = numbers.select(arrow.row_function(file_of, "bigint")("__number").alias("f")).distinct().collect()
    some = df.filter(F.col(FILE).isin(sorted(listed["__file"][r.f] for r in met)))
    return file_order(some, "__number", offsets).join(F.broadcast(numbers), "__number").drop("__number")
