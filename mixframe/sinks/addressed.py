"""Prediction files addressed by position: file k holds the records k * n to (k + 1) * n - 1 of the id order, and a manifest says which.

A reader finds a record, or a range of them, without a scan: the manifest names the file, and no other is opened.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from mixframe.operators.batching import id_rank
from mixframe.sinks.predictions import ROWS_PER_FILE, checked_format, save

FILE = "file_number"
POSITION = "position"
MANIFEST = "file_number bigint, first bigint, last bigint, rows bigint"


def _manifest_path(path: str) -> str:
    return f"{path.rstrip('/')}.manifest"


def write_addressed(
    df: DataFrame,
    path: str,
    ids: list[str],
    fmt: str = "json",
    rows_per_file: int = ROWS_PER_FILE,
    compression: str = "gzip",
    mode: str = "errorifexists",
) -> int:
    """Write ``df`` in the order of ``ids`` and return its number of records; rows of equal ids come in any order.

    Ranking and dealing the rows to files are one shuffle each. Records are counted by the job that writes them, and the manifest, which
    has a row for each file, follows from their number; it is written last, so files without one are not yet complete. Every
    record has its ``position``. Columns named ``file_number`` or ``position`` are an error. An empty table has an empty manifest.
    """
    fmt = checked_format(fmt)
    if clash := sorted({FILE, POSITION} & set(df.columns)):
        raise ValueError(f"columns {clash} have the names of the file's position")
    spark = df.sparkSession
    placed = id_rank(df, ids, POSITION).withColumn(FILE, F.floor(F.col(POSITION) / F.lit(rows_per_file)).cast("bigint"))
    dealt = placed.repartition(FILE).sortWithinPartitions(FILE, POSITION)
    seen = Observation()
    save(dealt.observe(seen, F.count(F.lit(1)).alias("rows")), path, fmt, mode, {"compression": compression}, FILE)
    total = seen.get["rows"]
    files = spark.range(-(-total // rows_per_file)).select(F.col("id").alias(FILE), (F.col("id") * rows_per_file).alias("first"))
    files = files.withColumn("last", F.least(F.col("first") + rows_per_file, F.lit(total)) - 1)
    listed = files.withColumn("rows", F.col("last") - F.col("first") + 1)
    listed.write.mode("overwrite" if mode == "overwrite" else "errorifexists").parquet(_manifest_path(path))
    return total


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """File number, first and last position, and rows of every file."""
    return spark.read.schema(MANIFEST).parquet(_manifest_path(path))


def records(spark: SparkSession, path: str, schema: str, first: int, last: int | None = None, fmt: str = "json") -> DataFrame:
    """The records at positions ``first`` to ``last``, with their ``position``; only the files that hold them are read.

    ``schema`` has the written columns in their order, without the position. Positions beyond the last record give no row.
    """
    fmt = checked_format(fmt)
    last = first if last is None else last
    met = manifest(spark, path).where((F.col("last") >= first) & (F.col("first") <= last)).select(FILE).collect()
    whole = f"{schema}, {POSITION} bigint"
    if not met:
        return spark.createDataFrame([], whole)
    folders = [f"{path.rstrip('/')}/{FILE}={row[FILE]}" for row in met]
    if fmt == "json":
        found = spark.read.schema(whole).json(folders)
    elif fmt == "csv":
        found = spark.read.schema(whole).option("header", True).option("escape", '"').csv(folders)
    else:
        found = spark.read.text(folders).select(F.from_json("value", whole).alias("r")).select("r.*")
    return found.where(F.col(POSITION).between(first, last))
