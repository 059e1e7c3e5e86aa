"""Evaluation of a split: encode, decode, score, and report every metric in one record."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame

from mixframe.config import TableConfig
from mixframe.model import Mixture
from mixframe.operators.batching import DEFAULT_BATCH, sequential_batches
from mixframe.operators.metrics import evaluate
from mixframe.operators.network import AnyCoder, decode
from mixframe.operators.runs import Aligned
from mixframe.operators.scoring import score
from mixframe.plans.prediction import encoded


def evaluate_rows(
    df: DataFrame,
    config: TableConfig,
    coder: AnyCoder,
    model: Mixture,
    frame: tuple[int, int],
    padding: tuple[int, int] = (0, 0),
    interp: tuple[int, int] | None = None,
    batches: bool = False,
    decode_mean: bool = False,
    tables: dict[str, DataFrame] | None = None,
    latent_scale: float = 1.0,
    sigmoid: bool = False,
    logit_range: float | None = None,
) -> DataFrame:
    """The metrics record of declared rows.

    ``batches`` takes the batch-dependent metrics over batches of 512 rows in id order and averages them, else they
    are exact over the table. ``decode_mean`` decodes the mean code instead of the drawn one, as in the warm-up.
    ``tables`` has the vectors of hashed features, ``latent_scale`` weighs the mixture loss in the reported one. ``sigmoid``
    takes the decoder's output as logits of a sigmoid reconstruction, which ``logit_range`` first maps to [0, logit_range] by the range
    of their batch. The scored rows are persisted, because several aggregates read them.
    """
    batch_col, aligned = ("batch_id" if batches else None), None
    rows = encoded(df, config, coder, frame, padding, interp, tables).persist(StorageLevel.MEMORY_AND_DISK)
    if batch_col:
        rows = sequential_batches(rows, list(config.ids), DEFAULT_BATCH, batch_col)
        aligned = Aligned(batch_col)
    coded = decode(rows, coder, "z_mu" if decode_mean else "z")
    scored = score(coded, model, aligned=aligned).persist(StorageLevel.MEMORY_AND_DISK)
    height, width, channels = coder.frame
    return evaluate(
        scored,
        model,
        z_sigma="z_sigma",
        frame=(height, width),
        channels=channels,
        aligned=aligned,
        latent_scale=latent_scale,
        logits="xhat" if sigmoid else None,
        logit_range=logit_range,
    )
