"""Prediction, sample, metric and model files."""

from __future__ import annotations

import math
from datetime import datetime

from pyspark.sql import Column, DataFrame, DataFrameWriter
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mixframe.config import TableConfig
from mixframe.operators.batching import id_rank

# Rows of one prediction file, and the output formats.
ROWS_PER_FILE = 100_000
FORMATS = ("json", "csv", "text")


def flatten_record(df: DataFrame, ids: list[str], lengths: dict[str, int] | None = None) -> DataFrame:
    """Ids first, then predictions; bytes become text, and arrays declared with length 1 become scalars."""
    lengths = lengths or {}

    def flat(f: T.StructField) -> Column:
        column = F.col(f.name)
        if isinstance(f.dataType, T.BinaryType):
            column = F.decode(column, "UTF-8")
        elif isinstance(f.dataType, T.ArrayType):
            if isinstance(f.dataType.elementType, T.BinaryType):
                column = F.transform(column, lambda x: F.decode(x, "UTF-8"))
            if lengths.get(f.name) == 1:
                column = F.element_at(column, 1)
        return column.alias(f.name)

    fields = {f.name: f for f in df.schema.fields}
    ordered = [*ids, *[name for name in fields if name not in ids]]
    return df.select(*[flat(fields[name]) for name in ordered])


def declared_lengths(config: TableConfig, code: int, clusters: int) -> dict[str, int]:
    """Array lengths of a prediction record, for ``flatten_record``."""
    ids = {name: config.columns[name].length or 0 for name in config.ids if name in config.columns}
    return {**ids, "z_mu": code, "z_sigma": code, "z": code, "gamma": clusters}


def with_index(df: DataFrame, order: str | list[str], name: str = "index") -> DataFrame:
    """The running position of every record in the order of its ids, first; an id of that name stays instead."""
    if name in df.columns:
        return df
    return id_rank(df, [order] if isinstance(order, str) else order, name).select(name, *df.columns)


def _text_arrays(df: DataFrame) -> DataFrame:
    complex_types = (T.ArrayType, T.StructType, T.MapType)
    return df.select(
        *[F.to_json(f.name).alias(f.name) if isinstance(f.dataType, complex_types) else f.name for f in df.schema.fields]
    )


def checked_format(fmt: str) -> str:
    if fmt.lower() not in FORMATS:
        raise ValueError(f"unsupported prediction format {fmt!r}")
    return fmt.lower()


def write_predictions(
    df: DataFrame,
    path: str,
    fmt: str = "json",
    rows_per_file: int = ROWS_PER_FILE,
    compression: str = "gzip",
    mode: str = "errorifexists",
) -> None:
    """Prediction files of at most ``rows_per_file`` rows, written by all tasks at once.

    ``json``: one object a line. ``csv``: header, minimal quoting, arrays as JSON text. ``text``: one JSON record a
    line in a single text column. Rows of fewer source files than files to write are dealt out first, because encoding
    and compressing cost more than the shuffle; rows come in no particular order.
    """
    fmt = checked_format(fmt)
    files = math.ceil(df.count() / rows_per_file)
    if files > max(1, len(df.inputFiles())):
        df = df.repartition(files)

    save(df, path, fmt, mode, {"maxRecordsPerFile": rows_per_file, "compression": compression})


def save(df: DataFrame, path: str, fmt: str, mode: str, options: dict[str, object], by: str | None = None) -> None:
    """``df`` as files of one of ``FORMATS``, in a folder for each value of ``by``."""

    def to(frame: DataFrame) -> DataFrameWriter:
        writer = frame.write.mode(mode).options(**options)
        return writer.partitionBy(by) if by else writer

    if fmt == "json":
        to(df).option("ignoreNullFields", False).json(path)
    elif fmt == "csv":
        to(_text_arrays(df)).option("header", True).option("escape", '"').csv(path)
    else:
        record = F.to_json(F.struct(*[F.col(c) for c in df.columns if c != by])).alias("value")
        to(df.select(record, *([by] if by else []))).text(path)


def sample(df: DataFrame, ids: list[str], n: int = 10) -> DataFrame:
    """The first ``n`` records in id order: a top-k, not a sort of the table."""
    return df.orderBy(*ids).limit(n)


def write_sample(df: DataFrame, path: str, ids: list[str], n: int = 10, mode: str = "errorifexists") -> None:
    """The first ``n`` records as one JSON file."""
    sample(df, ids, n).coalesce(1).write.mode(mode).json(path)


def write_metrics(metrics: DataFrame, folder: str, name: str = "eval_metric", stamp: str | None = None) -> str:
    """A one-row metrics table as one JSON object in a dated folder; returns its path."""
    path = f"{folder.rstrip('/')}/{name}_{stamp or datetime.now().strftime('%Y%m%d_%H%M%S')}.json"
    metrics.coalesce(1).write.option("ignoreNullFields", False).json(path)
    return path


def scalar_rows(step: int, metrics: DataFrame) -> DataFrame:
    """A one-row metrics table as rows ``(step, name, value)``."""
    pairs = [F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in metrics.columns]
    return metrics.select(F.lit(step).cast("bigint").alias("step"), F.inline(F.array(*pairs)))


def scalar_log(step: int, metrics: DataFrame, path: str) -> None:
    """Append the scalars of a step to a metrics table."""
    scalar_rows(step, metrics).coalesce(1).write.mode("append").parquet(path)


def write_model(model: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A model or weight table as Parquet; ``spark.read.parquet`` loads it."""
    model.write.mode(mode).parquet(path)
