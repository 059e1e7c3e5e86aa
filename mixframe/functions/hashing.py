"""Hash-derived buckets, sort keys and random numbers.

Everything here is a function of the row's own values and a seed, so a retried or repartitioned task produces the same
numbers again, which ``rand()`` does not promise.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from mixframe.config import MAX_HASH_BUCKETS
from mixframe.functions import arrow

# Increment and multipliers of the published SplitMix64 generator.
GOLDEN = 0x9E3779B97F4A7C15
MIX_1 = 0xBF58476D1CE4E5B9
MIX_2 = 0x94D049BB133111EB


def md5_long(*parts: str | Column, digits: int = 8) -> Column:
    """The first ``digits`` (at most 15) hex digits of the md5 of the parts joined by ``:``, as a bigint."""
    columns = [F.col(p) if isinstance(p, str) else p for p in parts]
    text = F.concat_ws(":", *[c.cast("string") for c in columns])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, digits), 16, 10).cast("bigint")


def hash_bucket(col: str | Column, size: int) -> Column:
    """Bucket of a value; more than 10,000 buckets (a fixed value of the declared tables) count as 10,000."""
    if size < 1:
        raise ValueError("a hash needs at least one bucket")
    return F.pmod(md5_long(col), F.lit(min(size, MAX_HASH_BUCKETS))).cast("int")


def _mixed(state: np.ndarray) -> np.ndarray:
    state = (state ^ (state >> np.uint64(30))) * np.uint64(MIX_1)
    state = (state ^ (state >> np.uint64(27))) * np.uint64(MIX_2)
    return state ^ (state >> np.uint64(31))


def normals(row_seeds: np.ndarray, width: int) -> np.ndarray:
    """Standard normal numbers, ``width`` for each row seed, by Box-Muller on two uniforms per position."""
    counters = np.arange(1, 2 * width + 1, dtype=np.uint64) * np.uint64(GOLDEN)
    raw = _mixed(row_seeds.astype(np.uint64)[:, None] + counters[None, :])
    uniforms = ((raw >> np.uint64(32)).astype(np.float64) + 0.5) / 2.0**32
    return np.sqrt(-2.0 * np.log(uniforms[:, 0::2])) * np.cos(2.0 * np.pi * uniforms[:, 1::2])


def row_seed(row_id: str | Column | list[str], seed: int) -> Column:
    """60-bit seed of a row, from its id or all columns of a composite id."""
    ids = row_id if isinstance(row_id, list) else [row_id]
    return md5_long(*ids, F.lit(seed), digits=15)


def add_noise(col: str, row_id: str, std: float, seed: int = 0) -> Column:
    """The vector plus independent N(0, std) noise for each element; for training inputs only."""

    def noisy(values: pa.Array, seeds: pa.Array) -> pa.Array:
        x = arrow.matrix(values)
        out = np.empty(x.shape)
        ids = seeds.to_numpy(zero_copy_only=False)
        for part in arrow.blocks(len(x), 2 * x.shape[1]):
            out[part] = x[part] + std * normals(ids[part], x.shape[1])
        return arrow.lists(out)

    return arrow.row_function(noisy, "array<double>")(F.col(col), row_seed(row_id, seed))


def reparameterize(z_mu: str, z_sigma: str, row_id: str | Column | list[str], seed: int = 0) -> Column:
    """A draw from N(z_mu, exp(z_sigma)); ``z_sigma`` is a log-variance."""

    def draw(mu: pa.Array, log_var: pa.Array, seeds: pa.Array) -> pa.Array:
        m = arrow.matrix(mu)
        s = arrow.matrix(log_var, m.shape[1])
        eps = normals(seeds.to_numpy(zero_copy_only=False), m.shape[1])
        return arrow.lists(m + np.exp(s / 2.0) * eps)

    return arrow.row_function(draw, "array<double>")(F.col(z_mu), F.col(z_sigma), row_seed(row_id, seed))
