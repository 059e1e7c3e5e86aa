"""Feature transforms on single columns: scalars, categories, padded series and frames."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from mixframe.config import DTYPES, FeatureSpec
from mixframe.functions import arrow
from mixframe.functions.vectors import checked, doubles


def numeric(spec: FeatureSpec) -> Column:
    """A declared numeric column in its declared type; a vector must have its declared length and no null."""
    col = F.col(spec.name).cast(spec.spark_type)
    return checked(col, spec.length, nulls=False).alias(spec.name) if spec.length is not None else col.alias(spec.name)


def vocab_indicator(col: str | Column, vocabulary: Sequence[str], many: bool = False) -> Column:
    """One count for each vocabulary entry; a value outside the vocabulary, or null, counts nowhere.

    With ``many`` the column is a list and every element is counted.
    """
    c = F.col(col) if isinstance(col, str) else col
    if not vocabulary:
        raise ValueError("a vocabulary is needed")
    if many:
        # removing an entry shortens the list by its number of occurrences
        hits = [F.size(c) - F.size(F.array_remove(c, v)) for v in vocabulary]
        return F.array(*[F.coalesce(h, F.lit(0)).cast("double") for h in hits])
    return F.array(*[F.coalesce(c == F.lit(v), F.lit(False)).cast("double") for v in vocabulary])


def as_vector(col: str | Column, is_array: bool) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return doubles(c) if is_array else F.array(c.cast("double"))


def assemble(vectors: Sequence[Column]) -> Column:
    """Vectors put one after the other; the caller orders them by feature name."""
    return F.concat(*vectors)


def cast_float(col: str | Column, dtype: str = "FLOAT") -> Column:
    """An array of numbers in the declared element type."""
    c = F.col(col) if isinstance(col, str) else col
    return c.cast(f"array<{DTYPES[dtype].simpleString()}>")


def pad(col: str | Column, before: int, after: int) -> Column:
    """Zeros on both ends of a series; nothing changes when both counts are zero."""
    c = doubles(col)
    if before + after <= 0:
        return c
    return F.concat(F.array_repeat(F.lit(0.0), before), c, F.array_repeat(F.lit(0.0), after))


def to_frame(col: str | Column, height: int, width: int) -> Column:
    """A row-major frame of ``height * width`` numbers; another length is an error."""
    return checked(doubles(col), height * width)


def frame_rows(col: str | Column, height: int, width: int) -> Column:
    """The nested view of a frame: ``height`` rows of ``width`` numbers."""
    frame = to_frame(col, height, width)
    return F.transform(
        F.sequence(F.lit(0), F.lit(height - 1)), lambda r: F.slice(frame, r * F.lit(width) + F.lit(1), width)
    )


def scalar_plane(col: str | Column, height: int, width: int) -> Column:
    """A scalar repeated over a frame."""
    c = F.col(col) if isinstance(col, str) else col
    return F.array_repeat(c.cast("double"), height * width)


def categorical_planes(vector: str | Column, size: int, height: int, width: int) -> list[Column]:
    """One constant frame for each of the ``size`` components of a category vector."""
    v = doubles(vector)
    return [F.array_repeat(v[i], height * width) for i in range(size)]


def stack_channels(planes: Sequence[Column]) -> Column:
    """Frames of equal size interleaved pixel by pixel: row-major (height, width, channel)."""

    channels = len(planes)
    if channels == 1:
        return planes[0]

    def interleave(nested: pa.Array) -> pa.Array:
        flat = arrow.matrix(nested.flatten())
        pixels = flat.shape[1]
        return arrow.lists(
            flat.reshape(len(nested), channels, pixels).transpose(0, 2, 1).reshape(len(nested), channels * pixels)
        )

    return arrow.row_function(interleave, "array<double>")(F.array(*planes))


def bilinear_taps(source: int, target: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower index, upper index and upper weight for each target position (no half-pixel shift, last index held)."""
    position = np.arange(target) * (source / target)
    low = np.minimum(np.floor(position).astype(int), source - 1)
    return low, np.minimum(low + 1, source - 1), position - low


def resize_bilinear(
    col: str | Column, frame: tuple[int, int], target: tuple[int, int], channels: int = 1
) -> Column:
    """A (height, width, channel) frame resampled to another height and width."""
    c = F.col(col) if isinstance(col, str) else col
    if tuple(frame) == tuple(target):
        return doubles(c)
    top, bottom, wy = bilinear_taps(frame[0], target[0])
    left, right, wx = bilinear_taps(frame[1], target[1])

    def resample(values: pa.Array) -> pa.Array:
        x = arrow.matrix(values, frame[0] * frame[1] * channels)
        out = np.empty((len(x), target[0] * target[1] * channels))
        for part in arrow.blocks(len(x), out.shape[1]):
            image = x[part].reshape(-1, frame[0], frame[1], channels)
            rows = image[:, top] + (image[:, bottom] - image[:, top]) * wy[None, :, None, None]
            full = rows[:, :, left] + (rows[:, :, right] - rows[:, :, left]) * wx[None, None, :, None]
            out[part] = full.reshape(full.shape[0], -1)
        return arrow.lists(out)

    return arrow.row_function(resample, "array<double>")(c)
