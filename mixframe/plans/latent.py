"""From training to prediction with one trained network: train and publish, then read and use what was published."""

from __future__ import annotations

from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession

from mixframe.model import Mixture
from mixframe.operators.dense import DenseCoder
from mixframe.operators.latent_fit import FittedLatent, LatentFit, fit_latent
from mixframe.sinks import model_store
from mixframe.sinks.step_log import StepLog


def publish(spark: SparkSession, folder: str, fit: FittedLatent, settings: LatentFit, frame: tuple[int, int, int]) -> int:
    """Store a fit as the next version of ``folder``."""
    return model_store.save(spark, folder, fit.weights, fit.model, {"fit": asdict(settings), "frame": list(frame)})


def train_latent(
    df: DataFrame, col: str, id_col: str, settings: LatentFit, folder: str, frame: tuple[int, int, int], log: StepLog | None = None
) -> int:
    """Train on the vectors ``col`` and publish the network with its mixture; returns the version."""
    return publish(df.sparkSession, folder, fit_latent(df, col, id_col, settings, log), settings, frame)


def read_latent(spark: SparkSession, folder: str, version: int | None = None) -> tuple[DenseCoder, Mixture]:
    """The network and the mixture of a published version, for ``predict_dataset`` and ``evaluate_rows``."""
    found = model_store.load(spark, folder, version)
    return DenseCoder(found.weights, tuple(found.settings["frame"])), found.mixture
