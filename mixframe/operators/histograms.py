"""Histograms of many tensors in one pass, with bins that do not depend on the data.

A bin is a sign, a power of two and one of ``STEPS`` equal parts of the numbers from that power to the next. Such bins need no pass for the
range, have a bounded relative width for numbers of any size, and the counts of two tables, tasks or steps add up.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from mixframe.model import ModelLike, as_mixture
from mixframe.operators.fitting import Sums, partition_sums

#: Parts of an octave, and the powers of two that have bins: smaller numbers count as zero, larger ones in the last bin.
STEPS = 4
LOWEST, HIGHEST = -40, 64
#: Bins of one sign; the bin of zero lies between the two signs.
SIDE = (HIGHEST - LOWEST) * STEPS
SCHEMA = "name string, bin int, lower double, upper double, n bigint"


def bins_of(values: np.ndarray) -> np.ndarray:
    """Bin of each number: 0 about zero, 1 .. SIDE for positive and -1 .. -SIDE for negative ones, by size. Not for NaN."""
    size = np.abs(values)
    fraction, power = np.frexp(size)
    part = np.floor((fraction * 2.0 - 1.0) * STEPS)
    with np.errstate(invalid="ignore"):
        raw = (power - 1 - LOWEST) * STEPS + part + 1
    raw = np.where(np.isinf(size), SIDE, np.clip(raw, 0, SIDE))
    return (np.sign(values) * np.where(size == 0, 0, raw)).astype(np.int64)


def edge(index: np.ndarray) -> np.ndarray:
    """Lower end of positive bin ``index``; SIDE + 1 has the upper end of the last, infinity."""
    octave, part = np.divmod(index - 1, STEPS)
    return np.where(index > SIDE, np.inf, np.ldexp(1.0 + part / STEPS, octave + LOWEST))


def edges_of(bins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper ends of bins; a bin holds its end next to zero, and bin 0 neither end."""
    size = np.abs(bins)
    near, far = np.where(size == 0, -edge(np.ones_like(size)), edge(np.maximum(size, 1))), edge(size + 1)
    return np.where(bins < 0, -far, near), np.where(bins < 0, -near, far)


def counts_of(values: np.ndarray) -> np.ndarray:
    """Numbers in each bin, from -SIDE to SIDE; NaN is left out."""
    numbers = values[~np.isnan(values)]
    return np.bincount(bins_of(numbers) + SIDE, minlength=2 * SIDE + 1)


def _flat(column: pa.Array) -> np.ndarray:
    """All numbers of a scalar or array column; null is left out."""
    while pa.types.is_list(column.type) or pa.types.is_large_list(column.type):
        column = column.flatten()
    return column.drop_null().cast(pa.float64(), safe=False).to_numpy(zero_copy_only=False)


def column_counts(df: DataFrame, columns: list[str]) -> Sums:
    """Counts of several scalar or array columns in one query: a task sends its bins, however many rows it has."""

    def reduce(batch: list[pa.Array]) -> Sums:
        return {name: counts_of(_flat(values)) for name, values in zip(columns, batch, strict=True)}

    return partition_sums(df, columns, reduce)


def model_counts(model: ModelLike) -> Sums:
    """Counts of a model's weights, means and variances."""
    m = as_mixture(model)
    return {name: counts_of(np.ravel(v)) for name, v in (("pi", m.weights), ("mu", m.means), ("var", m.variances))}


def merged(*counts: Sums) -> Sums:
    """Counts of several tables, tasks or steps together."""
    total: Sums = {}
    for part in counts:
        for name, n in part.items():
            total[name] = total[name] + n if name in total else n
    return total


def histogram_table(spark: SparkSession, counts: Sums) -> DataFrame:
    """Rows (name, bin, lower, upper, n) from the lowest to the highest used bin of each name, empty ones between them included."""
    rows = []
    for name in sorted(counts):
        used = np.flatnonzero(counts[name])
        if not len(used):
            continue
        index = np.arange(used[0], used[-1] + 1)
        lower, upper = edges_of(index - SIDE)
        rows += zip([name] * len(index), (index - SIDE).tolist(), lower.tolist(), upper.tolist(), counts[name][index].astype(int).tolist(), strict=True)
    return spark.createDataFrame(rows, SCHEMA)


def histograms(df: DataFrame, columns: list[str], model: ModelLike | None = None) -> DataFrame:
    """Histograms of columns, and of a model's own arrays, in one pass over the rows.

    Null and NaN are left out, also inside arrays, which may have any lengths. Infinite numbers count in the outermost bins. A column without
    numbers has no rows. The names pi, mu and var are the model's; columns of these names are an error beside it.
    """
    own = model_counts(model) if model is not None else {}
    if clash := sorted(set(own) & set(columns)):
        raise ValueError(f"columns {clash} have the names of the model's arrays")
    return histogram_table(df.sparkSession, {**column_counts(df, columns), **own})


def histogram_log(run: str, step: int, found: DataFrame, path: str) -> None:
    """The histograms of a step as its own folder below ``path``, which a retried step replaces."""
    found.coalesce(1).write.mode("overwrite").parquet(f"{path.rstrip('/')}/run={run}/step={step}")
