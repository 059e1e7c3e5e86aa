"""Arrow list columns as numpy matrices, and back.

Row-level linear algebra (a vector against K centres, a convolution) runs in Arrow UDFs: Spark's array lambdas are
interpreted element by element and measured 20 times slower on 64-dimensional vectors. Whole-table reductions stay on
the JVM side, see ``mixframe.functions.vectors``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

BLOCK_VALUES = 1 << 17


def row_function(fn: Callable[..., pa.Array], returns: str, once: bool = False) -> Callable:
    """An Arrow UDF.

    Filters on other columns move below it, to the scan. A filter on its own result would be moved too, and run it
    twice; ``once`` keeps every filter above it. It is for the scoring functions, whose results are what one filters
    on, and which may hold a scalar subquery that cannot move.
    """
    function = F.arrow_udf(fn, returns)
    return function.asNondeterministic() if once else function


def matrix(column: pa.Array, width: int | None = None) -> np.ndarray:
    """Rows of a list column as a float64 matrix; null, short and long vectors are errors."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    rows = len(column)
    if not rows:
        return np.empty((0, width or 0))
    lengths = np.diff(column.offsets.to_numpy())
    width = int(lengths[0]) if width is None else width
    values = column.flatten()
    if column.null_count or values.null_count or np.any(lengths != width):
        raise ValueError(f"every vector must hold {width} numbers")
    return values.to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(rows, width)


def numbers(column: pa.Array) -> np.ndarray:
    """A numeric column as float64; nulls become NaN."""
    return column.to_numpy(zero_copy_only=False).astype(np.float64, copy=False)


def lists(values: np.ndarray) -> pa.ListArray:
    """A matrix as a list column with one list for each row."""
    rows, width = values.shape
    offsets = pa.array(np.arange(rows + 1, dtype=np.int32) * np.int32(width))
    return pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(values, dtype=np.float64).ravel()))


def blocks(rows: int, width: int) -> Iterator[slice]:
    """Row ranges whose temporary arrays of ``width`` values per row stay in the processor cache."""
    step = max(1, BLOCK_VALUES // max(1, width))
    for start in range(0, rows, step):
        yield slice(start, min(rows, start + step))
