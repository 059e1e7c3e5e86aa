"""Prediction: read a split, build the input, encode, score, and write."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mixframe.config import TableConfig
from mixframe.functions.hashing import reparameterize
from mixframe.model import ModelLike
from mixframe.operators.batching import DEFAULT_BATCH, sequential_batches
from mixframe.operators.frames import to_cube
from mixframe.operators.network import AnyCoder, encode
from mixframe.operators.runs import Aligned
from mixframe.operators.scoring import predict
from mixframe.sinks.predictions import declared_lengths, flatten_record, with_index, write_predictions, write_sample
from mixframe.sources import dataset_or_fallback, densify


def encoded(
    df: DataFrame,
    config: TableConfig,
    coder: AnyCoder,
    frame: tuple[int, int],
    padding: tuple[int, int] = (0, 0),
    interp: tuple[int, int] | None = None,
    tables: dict[str, DataFrame] | None = None,
    seed: int = 0,
) -> DataFrame:
    """Declared rows as frames ``x`` with their codes ``z_mu``, ``z_sigma`` and a drawn ``z``; ids are densified.

    The draw is seeded by all ids together. Rows without declared ids are seeded by their code, so equal rows draw alike.
    """
    ids = list(config.ids)
    cubes = to_cube(densify(df, ids), config, frame, padding, interp, "x", tables).select(*ids, "x")
    coded = encode(cubes, coder, "x")
    return coded.withColumn("z", reparameterize("z_mu", "z_sigma", ids or F.col("z_mu").cast("string"), seed))


def predict_dataset(
    spark: SparkSession,
    config: TableConfig,
    coder: AnyCoder,
    model: ModelLike,
    frame: tuple[int, int],
    padding: tuple[int, int] = (0, 0),
    interp: tuple[int, int] | None = None,
    split: str = "test",
    fmt: str = "parquet",
    tables: dict[str, DataFrame] | None = None,
    batches: bool = False,
) -> DataFrame:
    """Predictions of a split (the training split when it is empty): ids, codes, gamma and assignments.

    The responsibilities are rescaled over the whole table, or with ``batches`` over 512 rows at a time in id order. The
    codes are persisted: the range of the joint and the scores both read them, and encoding twice would cost far
    more than the few numbers of a code.
    """
    rows = dataset_or_fallback(spark, config, split, fmt=fmt)
    codes = encoded(rows, config, coder, frame, padding, interp, tables).persist(StorageLevel.MEMORY_AND_DISK)
    if not batches:
        return predict(codes, model, list(config.ids))
    batched = sequential_batches(codes, list(config.ids), DEFAULT_BATCH, "batch_id")
    return predict(batched, model, list(config.ids), aligned=Aligned("batch_id"))


def write_run(
    predictions: DataFrame, config: TableConfig, folder: str, fmt: str, samples: int = 10, index: bool = False
) -> None:
    """Prediction files and one sample file below ``folder``; arrays declared with one element become scalars.

    ``index`` adds the running position of every record, unless an id has that name.
    """
    ids = list(config.ids)
    flat = flatten_record(predictions, ids, declared_lengths(config, 0, 0))
    if index:
        flat = with_index(flat, ids)
    write_predictions(flat, f"{folder}/prediction", fmt)
    if samples:
        write_sample(flat, f"{folder}/sample", ids, samples)
