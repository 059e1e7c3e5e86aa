"""JVM-side helpers on array columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def doubles(col: str | Column) -> Column:
    """An array column in double precision."""
    return (F.col(col) if isinstance(col, str) else col).cast("array<double>")


def checked(col: str | Column, length: int, nulls: bool = True) -> Column:
    """The array itself when it has ``length`` elements; an error for the task otherwise.

    ``nulls=False`` also refuses null elements.
    """
    c = F.col(col) if isinstance(col, str) else col
    found = F.coalesce(F.size(c).cast("string"), F.lit("null"))
    right = c.isNotNull() & (F.size(c) == length)
    if not nulls:
        right = right & (F.size(F.array_compact(c)) == length)
    return F.when(right, c).otherwise(F.raise_error(F.concat(F.lit(f"expected {length} values, got "), found)))


def exploded(df: DataFrame, keep: list[str | Column], array: Column, pos: str, value: str) -> DataFrame:
    """One row for each array element, with its position from 0; empty and null arrays give none.

    The outer form and the filter on the position say the same as a plain ``posexplode``, for which the optimizer
    would add a non-empty check below the projection and compute a derived array twice.
    """
    return df.select(*keep, F.posexplode_outer(array).alias(pos, value)).filter(F.col(pos).isNotNull())


def elements(df: DataFrame, *cols: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row for each position of parallel arrays: ``pos`` and one double column for each array.

    ``arrays_zip`` and ``posexplode`` are generated code, and the aggregates that follow combine inside each task, so
    this costs about a scan and shuffles only the aggregate's groups.
    """
    first = F.size(cols[0])
    same = F.lit(True)
    for other in cols[1:]:
        same = same & (F.size(other) == first)
    zipped = F.arrays_zip(*[F.col(c) for c in cols])
    wrong = F.raise_error(F.lit("parallel arrays must have equal length"))
    guarded = F.when(same, zipped).otherwise(wrong) if len(cols) > 1 else zipped
    doubled = df.select(*keep, *[doubles(c).alias(c) for c in cols])
    return exploded(doubled, list(keep), guarded, "pos", "e").select(
        *keep, "pos", *[F.col("e")[c].alias(c) for c in cols]
    )
