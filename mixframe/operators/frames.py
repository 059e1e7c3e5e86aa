"""Whole-row feature assembly: vectors, frames and embedding lookups."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mixframe.config import FeatureSpec, TableConfig
from mixframe.functions import arrow, features
from mixframe.functions.hashing import hash_bucket
from mixframe.functions.vectors import doubles
from mixframe.model import check_parameter_count
from mixframe.operators.lookup import BROADCAST_BYTES, lookup_join


def bucket_embedding(df: DataFrame, bucket: str, table: DataFrame, size: int, out: str) -> DataFrame:
    """The dense vector of each row's bucket, from a table ``(bucket, vec)``.

    The table has at most 10,000 buckets of ``size`` numbers; it is broadcast when that is small enough. A bucket
    without a vector is an error, as is a vector of another size.
    """
    vectors = table.select(F.col("bucket").alias(bucket), features.checked("vec", size).alias(out))
    joined = lookup_join(df, vectors, bucket, row_bytes=8 * size + 32, how="left", limit=BROADCAST_BYTES)
    missing = F.raise_error(F.concat(F.lit("no vector for bucket "), F.col(bucket).cast("string")))
    return joined.withColumn(out, F.when(F.col(bucket).isNull() | F.col(out).isNotNull(), F.col(out)).otherwise(missing))


def bucket_embedding_mean(df: DataFrame, buckets: str, table: DataFrame, size: int, out: str) -> DataFrame:
    """Mean vector of each row's list of buckets, repeats counted; an empty or null list gives zeros.

    Null elements do not count. The table has at most 10,000 buckets; its size is checked as a model's is, and it goes to
    the tasks, so rows stay where they are and need no id. A bucket without a vector is an error, as is one of another
    size.
    """
    rows = table.select(F.col("bucket").cast("bigint").alias("bucket"), doubles(features.checked("vec", size, nulls=False)).alias("vec"))
    check_parameter_count(rows.count(), size)
    found = rows.orderBy("bucket").toArrow()
    known = found["bucket"].to_numpy()
    vectors = np.array(found["vec"].to_pylist(), dtype=np.float64).reshape(len(known), size)

    def mean(column: pa.Array) -> pa.Array:
        lengths = np.diff(column.offsets.to_numpy())
        values = column.flatten()
        row = np.repeat(np.arange(len(column)), np.where(column.is_null().to_numpy(zero_copy_only=False), 0, lengths))
        present = values.is_valid().to_numpy(zero_copy_only=False)
        row, bucket = row[present], values.drop_null().to_numpy().astype(np.int64)
        at = np.minimum(np.searchsorted(known, bucket), max(0, len(known) - 1))
        missing = np.ones(len(bucket), bool) if not len(known) else known[at] != bucket
        if missing.any():
            raise ValueError(f"no vector for bucket {bucket[missing][0]}")
        sums = np.zeros((len(column), size))
        np.add.at(sums, row, vectors[at])
        return arrow.lists(sums / np.maximum(np.bincount(row, minlength=len(column)), 1)[:, None])

    return df.withColumn(out, arrow.row_function(mean, "array<double>")(F.col(buckets).cast("array<bigint>")))


def _hashed(name: str, buckets: int) -> Column:
    """Buckets of the elements of a list column; null stays null."""
    return F.transform(name, lambda v: F.when(v.isNotNull(), hash_bucket(v, buckets)))


def _with_embeddings(
    df: DataFrame, config: TableConfig, tables: dict[str, DataFrame]
) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with one looked-up vector column for each hashed feature, and the names of those columns."""
    vectors: dict[str, str] = {}
    for name in config.features:
        spec = config.columns[name]
        if spec.kind != "fcHashEmbedding":
            continue
        if name not in tables:
            raise ValueError(f"column {name} needs an embedding table")
        bucket, vector = f"__{name}_bucket", f"__{name}_vector"
        if spec.shape:  # a list: every element has its bucket, and the vectors are pooled
            df = df.withColumn(bucket, _hashed(name, spec.buckets))
            df = bucket_embedding_mean(df, bucket, tables[name], spec.embedding_size, vector).drop(bucket)
        else:
            df = df.withColumn(bucket, hash_bucket(name, spec.buckets))
            df = bucket_embedding(df, bucket, tables[name], spec.embedding_size, vector).drop(bucket)
        vectors[name] = vector
    return df, vectors


def _vector(spec: FeatureSpec, vectors: dict[str, str]) -> Column:
    if spec.kind == "fcVocabIndicator":
        return features.vocab_indicator(spec.name, spec.params["vocabulary"], many=bool(spec.shape))
    if spec.kind == "fcHashEmbedding":
        return F.col(vectors[spec.name])
    return features.as_vector(features.numeric(spec), bool(spec.shape))


def assemble_features(
    df: DataFrame, config: TableConfig, out: str = "x", tables: dict[str, DataFrame] | None = None
) -> DataFrame:
    """All feature columns, in name order, as one vector."""
    joined, vectors = _with_embeddings(df, config, tables or {})
    parts = [_vector(config.columns[name], vectors) for name in config.features]
    return joined.withColumn(out, features.assemble(parts)).drop(*vectors.values())


def _planes(spec: FeatureSpec, vectors: dict[str, str], frame: tuple[int, int], padding: tuple[int, int]) -> list[Column]:
    height, width = frame
    if spec.kind == "fcNumeric" and spec.shape:
        return [features.to_frame(features.pad(features.numeric(spec), *padding), height, width)]
    if spec.kind == "fcNumeric":
        return [features.scalar_plane(features.numeric(spec), height, width)]
    size = spec.embedding_size if spec.kind == "fcHashEmbedding" else len(spec.params["vocabulary"])
    return features.categorical_planes(_vector(spec, vectors), size, height, width)


def to_cube(
    df: DataFrame,
    config: TableConfig,
    frame: tuple[int, int],
    padding: tuple[int, int] = (0, 0),
    interp: tuple[int, int] | None = None,
    out: str = "x",
    tables: dict[str, DataFrame] | None = None,
) -> DataFrame:
    """Every feature as one or more frames, in name order, stacked as channels and resampled to ``interp``.

    Series are padded and cut into rows, scalars fill a frame, and each component of a category fills one of its own.
    The result is row-major (height, width, channel). Apart from embedding lookups the plan is narrow.
    """
    joined, vectors = _with_embeddings(df, config, tables or {})
    planes = [p for name in config.features for p in _planes(config.columns[name], vectors, frame, padding)]
    cube = features.stack_channels(planes)
    if interp is not None:
        cube = features.resize_bilinear(cube, frame, interp, len(planes))
    return joined.withColumn(out, cube).drop(*vectors.values())


def channel_count(config: TableConfig) -> int:
    """Number of channels ``to_cube`` produces."""
    sizes = {"fcNumeric": lambda s: 1, "fcHashEmbedding": lambda s: s.embedding_size}
    return sum(
        sizes.get(config.columns[n].kind, lambda s: len(s.params["vocabulary"]))(config.columns[n])
        for n in config.features
    )
