"""Splits of a declared dataset as DataFrames."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mixframe.config import SPLITS, TableConfig

FORMATS = ("parquet", "orc", "json", "csv")
# Fixed value: stands in for a missing string.
UNKNOWN = "__unknown__"


def dataset(spark: SparkSession, config: TableConfig, split: str, fmt: str = "parquet") -> DataFrame:
    """All regular, non-hidden files of a split's directory, with the declared columns only.

    CSV has no arrays: vectors are read as JSON text, the way the CSV sink writes them. A record that does not parse as
    declared is an error, not a row of nulls.
    """
    if split not in SPLITS:
        raise ValueError(f"invalid split {split!r}; expected one of {', '.join(SPLITS)}")
    if split not in config.paths:
        raise ValueError(f"no path is declared for split {split!r}")
    if fmt not in FORMATS:
        raise ValueError(f"unsupported source format {fmt!r}")
    schema, path = config.schema(), config.paths[split]
    if fmt == "json":
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    if fmt != "csv":
        return _self_described(spark, schema, path, fmt)
    # a user schema would bind CSV columns by position, so the header names them and the declared types follow
    raw = spark.read.option("header", True).option("escape", '"').csv(path)
    if not raw.columns:
        return spark.createDataFrame([], schema)
    parsed = [
        F.from_json(f.name, f.dataType, {"mode": "FAILFAST"}) if isinstance(f.dataType, T.ArrayType) else F.col(f.name).cast(f.dataType)
        for f in schema.fields
    ]
    return raw.select(*[c.alias(f.name) for c, f in zip(parsed, schema.fields, strict=True)])


def _self_described(spark: SparkSession, schema: T.StructType, path: str, fmt: str) -> DataFrame:
    """Files that carry their own types: the declared columns are cast where the stored type differs."""
    try:
        stored = spark.read.format(fmt).load(path)
    except AnalysisException as error:
        if error.getCondition() != "UNABLE_TO_INFER_SCHEMA":
            raise
        return spark.createDataFrame([], schema)
    missing = [name for name in schema.names if name not in stored.columns]
    if missing:
        raise ValueError(f"columns missing in {path}: {', '.join(missing)}")
    return stored.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


def dataset_or_fallback(
    spark: SparkSession, config: TableConfig, split: str, fallback: str = "train", fmt: str = "parquet"
) -> DataFrame:
    """The split, or the fallback split when it has no row or no declared path."""
    if split not in SPLITS:
        raise ValueError(f"invalid split {split!r}; expected one of {', '.join(SPLITS)}")
    if split in config.paths:
        found = dataset(spark, config, split, fmt)
        if not found.isEmpty():
            return found
    return dataset(spark, config, fallback, fmt)


def select_roles(df: DataFrame, config: TableConfig, *roles: str) -> DataFrame:
    """The columns of the given roles; features come in name order."""
    wanted = [name for role in roles for name in config.names(role)]
    return df.select(*dict.fromkeys(wanted))


def split_labels(df: DataFrame, config: TableConfig) -> tuple[DataFrame, DataFrame]:
    """Ids with features, and ids with labels. Labels are never an input of a model."""
    return select_roles(df, config, "ids", "features"), select_roles(df, config, "ids", "labels")


def densify(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Missing strings become ``__unknown__`` and missing numbers 0, in scalars and inside arrays."""
    names = set(df.columns if cols is None else cols)

    def filled(f: T.StructField) -> F.Column:
        column = F.col(f.name)
        if f.name not in names:
            return column
        if isinstance(f.dataType, T.ArrayType):
            zero = _default(f.dataType.elementType)
            return column if zero is None else F.transform(column, lambda x: F.coalesce(x, zero)).alias(f.name)
        zero = _default(f.dataType)
        return column if zero is None else F.coalesce(column, zero).alias(f.name)

    return df.select(*[filled(f) for f in df.schema.fields])


def _default(dtype: T.DataType) -> F.Column | None:
    if isinstance(dtype, T.StringType):
        return F.lit(UNKNOWN)
    return F.lit(0).cast(dtype) if isinstance(dtype, T.NumericType) else None
