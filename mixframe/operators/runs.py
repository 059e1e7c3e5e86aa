"""Statistics of a row's batch from a window: the rows move once, by batch, and are read once.

Joining a table of batch statistics back reads the rows twice, and moves them as soon as that table, which has a row for
each 512 rows, is too large to broadcast. A window over the batch moves them once at any size. Arrow functions forget how their
input was partitioned, so the window comes after the function that it reads from; a repartition before it would be lost.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The most rows of a batch that one task may hold as a window.
HOT_BATCH_ROWS = 2_000_000


@dataclass(frozen=True)
class Aligned:
    """Says that the batches of a column are small enough for one task each; null is a batch."""

    batch: str


def largest_batch(df: DataFrame, batch_col: str) -> int:
    """Rows of the largest batch: a small aggregate over the batch column alone, combined before its shuffle."""
    return df.groupBy(batch_col).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0


def aligned_batches(df: DataFrame, batch_col: str, hot: int = HOT_BATCH_ROWS) -> Aligned | None:
    """``Aligned`` if the largest batch, which is counted, has at most ``hot`` rows.

    A larger one would be one task's whole window. For None the operators join the statistics of a batch back, with salt where they
    are too many to broadcast. Batches of a known size (``sequential_batches``) need no count: use ``Aligned`` itself.
    """
    return Aligned(batch_col) if largest_batch(df, batch_col) <= hot else None


def by_batch(aggregate: Column, aligned: Aligned) -> Column:
    """An aggregate of a row's batch, for every row."""
    return aggregate.over(Window.partitionBy(aligned.batch))
