"""Encoder, reparameterisation and decoder on the embeddings as 8 x 8 frames."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mixframe.catalog.base import ELEMENTS, Query, latent, long
from mixframe.catalog.features import normals_sql
from mixframe.functions import hashing
from mixframe.operators.network import Coder, CoderSpec, decode, encode

SPEC = CoderSpec(frame=(8, 8, 1), filters=(2,), kernels=(3,), strides=(2,), code=4)


def coder() -> Coder:
    """Weights from formulas that SQL can repeat."""
    a, b, f = np.meshgrid(np.arange(3), np.arange(3), np.arange(2), indexing="ij")
    unit, code = np.meshgrid(np.arange(32), np.arange(4), indexing="ij")
    return Coder(
        SPEC,
        {
            "conv0_kernel": np.sin(1 + 3 * a + b + 9 * f)[:, :, None, :],
            "conv0_bias": 0.1 * np.arange(2),
            "mu_kernel": np.cos(unit + code) / 4,
            "mu_bias": 0.05 * np.arange(4),
            "sigma_kernel": np.sin(2 * unit + code) / 4,
            "sigma_bias": -0.05 * np.arange(4),
            "dense_kernel": (np.cos(unit + 2 * code) / 4).T,
            "dense_bias": 0.01 * np.arange(32),
            "deconv0_kernel": np.sin(a + 2 * b + f)[:, :, None, :],
            "deconv0_bias": np.array([0.02]),
        },
    )


def _encode(column: str):
    def run(spark: SparkSession, folder: str) -> DataFrame:
        frames = latent(spark, folder).select("vec_id", F.col("z_mu").alias("x"))
        return long(encode(frames, coder()), ["vec_id"], column)

    return run


def _reparameterize(spark: SparkSession, folder: str) -> DataFrame:
    drawn = latent(spark, folder).withColumn("z", hashing.reparameterize("z_mu", "z_sigma", "vec_id", seed=11))
    return long(drawn, ["vec_id"], "z")


def _decode(spark: SparkSession, folder: str) -> DataFrame:
    codes = latent(spark, folder).select("vec_id", F.slice("z_mu", 1, 4).alias("z_mu"))
    return long(decode(codes, coder()), ["vec_id"], "xhat")


ENCODED = f"""{ELEMENTS},
taps AS (
  SELECT a, b, f, sin(1 + 3 * a + b + 9 * f) AS weight
  FROM (SELECT unnest(range(3)) AS a) CROSS JOIN (SELECT unnest(range(3)) AS b) CROSS JOIN (SELECT unnest(range(2)) AS f)),
conv AS (
  SELECT vec_id, h, w, f, greatest(sum(x * weight) + 0.1 * f, 0) AS value
  FROM (SELECT vec_id, (d // 8 - a) // 2 AS h, (d % 8 - b) // 2 AS w, f, x, weight
        FROM e JOIN taps ON d // 8 >= a AND (d // 8 - a) % 2 = 0 AND d % 8 >= b AND (d % 8 - b) % 2 = 0)
  GROUP BY vec_id, h, w, f),
flat AS (SELECT vec_id, (h * 4 + w) * 2 + f AS i, value FROM conv),
codes AS (SELECT unnest(range(4)) AS c)"""

QUERIES = [
    Query(
        "encode_z_mu",
        _encode("z_mu"),
        f"""WITH {ENCODED}
SELECT vec_id, c::INTEGER AS pos, round(sum(value * cos(i + c) / 4) + 0.05 * c, 6) + 0.0 AS value
FROM flat CROSS JOIN codes GROUP BY vec_id, c""",
    ),
    Query(
        "encode_z_sigma",
        _encode("z_sigma"),
        f"""WITH {ENCODED}
SELECT vec_id, c::INTEGER AS pos, round(sum(value * sin(2 * i + c) / 4) - 0.05 * c, 6) + 0.0 AS value
FROM flat CROSS JOIN codes GROUP BY vec_id, c""",
    ),
    Query(
        "reparameterize",
        _reparameterize,
        f"""WITH {ELEMENTS},
{normals_sql(11)}
SELECT vec_id, d::INTEGER AS pos, round(x + exp(ln(0.01 + x * x) / 2) * eps, 6) + 0.0 AS value
FROM e JOIN noise USING (vec_id, d)""",
    ),
    Query(
        "decode",
        _decode,
        f"""WITH {ELEMENTS},
dense AS (
  SELECT vec_id, i // 8 AS h, (i // 2) % 4 AS w, i % 2 AS f,
         greatest(sum(x * cos(i + 2 * d) / 4) + 0.01 * i, 0) AS value
  FROM e CROSS JOIN (SELECT unnest(range(32)) AS i) WHERE d < 4 GROUP BY vec_id, i),
pixels AS (
  SELECT vec_id, 2 * h + a AS y, 2 * w + b AS x, greatest(sum(value * sin(a + 2 * b + f)) + 0.02, 0) AS value
  FROM dense CROSS JOIN (SELECT unnest(range(3)) AS a) CROSS JOIN (SELECT unnest(range(3)) AS b) GROUP BY ALL)
SELECT vec_id, (y * 8 + x)::INTEGER AS pos, round(value, 6) + 0.0 AS value FROM pixels WHERE y < 8 AND x < 8""",
    ),
]
