"""Trained networks and mixtures in a folder of versions, each published as a whole.

A version's tables are written to a folder of their own; then one small manifest that names the folder and counts its rows is
renamed into place. Readers see manifests only, so a version that a lost writer left half done is never read, and two writers cannot
publish the same version. Weights are rows of blocks, so that a large matrix is no single row.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from mixframe.model import Mixture
from mixframe.operators.network import MAX_WEIGHTS

BLOCK_VALUES = 4096
WEIGHT_BLOCKS = "name string, shape array<int>, block int, vals array<double>"
MIXTURE_ROWS = "k int, pi double, mu array<double>, var array<double>"


@dataclass(frozen=True, eq=False)
class StoredModel:
    """A version: its settings (as they were given), the network's weights, and the mixture."""

    version: int
    settings: dict
    weights: dict[str, np.ndarray]
    mixture: Mixture


def weight_blocks(spark: SparkSession, weights: dict[str, np.ndarray]) -> DataFrame:
    """A network's weights as rows ``(name, shape, block, vals)``."""
    rows = []
    for name, w in weights.items():
        flat = np.asarray(w, dtype=np.float64).ravel()
        for block, start in enumerate(range(0, max(1, flat.size), BLOCK_VALUES)):
            rows.append((name, list(np.shape(w)), block, flat[start : start + BLOCK_VALUES].tolist()))
    return spark.createDataFrame(rows, WEIGHT_BLOCKS)


def weights_of(table: DataFrame, limit: int = MAX_WEIGHTS) -> dict[str, np.ndarray]:
    """Weights from their blocks; their number is checked before they reach the driver."""
    rows = table.count()
    if rows > 2 * limit // BLOCK_VALUES + 10_000:
        raise ValueError(f"more than {limit} weights")
    found: dict[str, list] = {}
    for r in sorted(table.collect(), key=lambda r: (r["name"], r["block"])):
        found.setdefault(r["name"], [r["shape"], []])[1].extend(r["vals"])
    return {name: np.array(vals).reshape(shape) for name, (shape, vals) in found.items()}


def _path(spark: SparkSession, name: str):  # noqa: ANN202
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def versions(spark: SparkSession, folder: str) -> list[int]:
    """Published versions, ascending."""
    path, system = _path(spark, f"{folder.rstrip('/')}/manifests")
    if not system.exists(path):
        return []
    names = [str(s.getPath().getName()) for s in system.listStatus(path)]
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


def save(spark: SparkSession, folder: str, weights: dict[str, np.ndarray], mixture: Mixture, settings: dict | None = None) -> int:
    """Write a model and publish it as the next version, which is returned."""
    folder = folder.rstrip("/")
    data = f"{folder}/data/{uuid.uuid4().hex}"
    blocks = weight_blocks(spark, weights)
    blocks.coalesce(1).write.parquet(f"{data}/weights")
    mixture.to_table(spark).select("k", "pi", "mu", "var").coalesce(1).write.parquet(f"{data}/mixture")
    manifest = {"data": data, "blocks": blocks.count(), "components": mixture.k, "settings": settings or {}}
    version = (versions(spark, folder) or [0])[-1]
    while True:
        version += 1
        if _publish(spark, f"{folder}/manifests/{version}.json", json.dumps(manifest)):
            return version


def _publish(spark: SparkSession, name: str, text: str) -> bool:
    """Rename a finished file into place; false if the name is taken."""
    target, system = _path(spark, name)
    made, _ = _path(spark, f"{name}.{uuid.uuid4().hex}.tmp")
    stream = system.create(made, True)
    stream.write(bytearray(text.encode()))
    stream.close()
    if system.exists(target):
        system.delete(made, False)
        return False
    return bool(system.rename(made, target))


def load(spark: SparkSession, folder: str, version: int | None = None) -> StoredModel:
    """A published version, the latest by default."""
    folder = folder.rstrip("/")
    known = versions(spark, folder)
    version = version if version is not None else (known or [0])[-1]
    if version not in known:
        raise ValueError(f"no published version {version} in {folder}")
    text = "".join(r[0] for r in spark.read.text(f"{folder}/manifests/{version}.json", wholetext=True).collect())
    manifest = json.loads(text)
    blocks = spark.read.schema(WEIGHT_BLOCKS).parquet(f"{manifest['data']}/weights")
    rows = spark.read.schema(MIXTURE_ROWS).parquet(f"{manifest['data']}/mixture")
    mixture = sorted(rows.limit(manifest["components"] + 1).collect(), key=lambda r: r["k"])
    if blocks.count() != manifest["blocks"] or len(mixture) != manifest["components"]:
        raise ValueError(f"version {version} does not hold what its manifest counts")
    model = Mixture(*(np.array([r[c] for r in mixture]) for c in ("pi", "mu", "var")))
    return StoredModel(version, manifest["settings"], weights_of(blocks), model)
