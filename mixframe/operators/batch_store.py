"""Batches of a table stored so that a training step reads its own batch and nothing else."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mixframe.session import scratch_path

#: Rows of a partition of batches: large enough for a file, small enough for one task.
PART_ROWS = 100_000


@dataclass(frozen=True, eq=False)
class BatchStore:
    """Consecutive batches in folders of ``per_part`` batches each, every folder sorted by batch."""

    path: str
    schema: T.StructType
    batch_col: str
    batches: int
    per_part: int
    read: Callable[[str], DataFrame]

    def part(self, batch: int) -> str:
        return f"{self.path}/part={batch // self.per_part}"

    def batch(self, number: int) -> DataFrame:
        """The rows of one batch: one folder is listed, and its row groups of other batches are skipped."""
        if not 0 <= number < self.batches:
            raise ValueError(f"there are {self.batches} batches, not a batch {number}")
        return self.read(self.part(number)).filter(F.col(self.batch_col) == number)

    def step(self, step: int) -> DataFrame:
        """The batch of a training step; after the last batch comes the first one again."""
        return self.batch(step % self.batches)


def store_batches(
    df: DataFrame, batch_col: str, batches: int, size: int, path: str | None = None, part_rows: int = PART_ROWS
) -> BatchStore:
    """Write the batches 0 to ``batches`` - 1 of ``df``, of about ``size`` rows each, to a new shared folder.

    The rows are shuffled once, by folder. The folders hold equally many batches, so none is hot.
    """
    if batches < 1:
        raise ValueError("no batches to store")
    spark = df.sparkSession
    path = path or scratch_path(spark, "batches")
    per_part = max(1, part_rows // max(1, size))
    part = F.floor(F.col(batch_col) / F.lit(per_part)).cast("int")
    parts = -(-batches // per_part)
    dealt = df.withColumn("part", part).repartition(parts, "part").sortWithinPartitions("part", batch_col)
    dealt.write.partitionBy("part").parquet(path)
    schema = df.schema
    return BatchStore(path, schema, batch_col, batches, per_part, spark.read.schema(schema).parquet)
