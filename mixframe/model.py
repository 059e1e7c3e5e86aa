"""The mixture model: K weights, K centres and K diagonal variances."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mixframe.functions.vectors import checked, doubles, exploded

# K * D is a parameter of the model and does not grow with the data. It is still checked before it is collected and
# shipped to the tasks: 8 million numbers are 64 MB for the centres and 64 MB for the variances.
MAX_PARAMETERS = 8_000_000


@dataclass(frozen=True, eq=False)
class Mixture:
    """Diagonal Gaussian mixture; row k of ``means`` and ``variances`` belongs to component k."""

    weights: np.ndarray
    means: np.ndarray
    variances: np.ndarray

    def __post_init__(self) -> None:
        for name in ("weights", "means", "variances"):
            object.__setattr__(self, name, np.asarray(getattr(self, name), dtype=np.float64))
        if self.means.ndim != 2 or self.means.shape != self.variances.shape:
            raise ValueError("means and variances must both be K x D")
        if self.weights.shape != (len(self.means),) or not len(self.weights):
            raise ValueError("one weight is needed for each component")
        if not np.all(self.weights > 0):
            raise ValueError("mixture weights must be positive")
        if not np.all(self.variances > 0):
            raise ValueError("mixture variances must be positive")
        if not np.all(np.isfinite(self.means)):
            raise ValueError("mixture centres must be finite")
        check_parameter_count(self.k, self.dim)

    @property
    def k(self) -> int:
        return self.means.shape[0]

    @property
    def dim(self) -> int:
        return self.means.shape[1]

    @classmethod
    def from_table(cls, table: DataFrame) -> Mixture:
        """Read a model table ``(k, pi, mu, var)``; its size is checked before its rows reach the driver."""
        size = table.agg(F.count(F.lit(1)).alias("k"), F.max(F.size("mu")).alias("d")).first()
        if not size["k"]:
            raise ValueError("the model table is empty")
        check_parameter_count(size["k"], size["d"])
        rows = table.select("k", "pi", "mu", "var").orderBy("k").collect()
        if [row["k"] for row in rows] != list(range(len(rows))):
            raise ValueError("components must be numbered 0 .. K-1")
        return cls([r["pi"] for r in rows], [r["mu"] for r in rows], [r["var"] for r in rows])

    def to_table(self, spark: SparkSession) -> DataFrame:
        """The model as K rows ``(k, pi, mu, var)``, a local relation whose size the optimizer knows."""
        columns = {
            "k": pa.array(range(self.k), pa.int32()),
            "pi": pa.array(self.weights),
            "mu": pa.array(self.means.tolist(), pa.list_(pa.float64())),
            "var": pa.array(self.variances.tolist(), pa.list_(pa.float64())),
        }
        return spark.createDataFrame(pa.table(columns))

    def centres(self) -> Column:
        """The centres as one literal ``array<array<double>>``."""
        return F.array(*[vector_literal(row) for row in self.means])

    def centre_of(self, label: str | Column) -> Column:
        """The centre of a component number."""
        return F.element_at(self.centres(), (F.col(label) if isinstance(label, str) else label) + 1)


ModelLike = Mixture | DataFrame


def as_mixture(model: ModelLike) -> Mixture:
    return model if isinstance(model, Mixture) else Mixture.from_table(model)


def vector_literal(values: np.ndarray) -> Column:
    return F.lit([float(v) for v in values]).cast("array<double>")


def vector_width(df: DataFrame, col: str) -> int:
    """Length of the first row's vector."""
    first = df.select(F.size(col)).first()
    if first is None:
        raise ValueError("no rows to fit on")
    return first[0]


def check_parameter_count(k: int, d: int) -> None:
    if k * d > MAX_PARAMETERS:
        raise ValueError(f"a model of {k} x {d} parameters exceeds the {MAX_PARAMETERS} that tasks may hold")


def grouped_model(df: DataFrame, vector: str, group: str) -> Mixture:
    """Mixture of the groups of ``df``: frequency, mean and population variance of every group.

    Groups are numbered 0 .. K-1 in the order of the group value. One exploded aggregate, combined on the map side to
    at most K * D rows in each task, so neither a hot group nor a long table reaches one task whole; only the K * D
    moments are collected, and no more than a model may have. Null vectors and elements, and vectors of another length than
    the rest, are errors.
    """
    first = df.select(F.size(vector).alias("n")).filter(F.col("n") > 0).first()
    if first is None:
        raise ValueError("no rows to build a mixture from")
    values = exploded(df, [F.col(group).alias("g")], doubles(checked(vector, first["n"], nulls=False)), "d", "x")
    moments = values.groupBy("g", "d").agg(
        F.count("x").alias("n"), F.avg("x").alias("m"), F.var_pop("x").alias("v")
    )
    found = moments.limit(MAX_PARAMETERS + 1).toArrow()
    if not found.num_rows:
        raise ValueError("no rows to build a mixture from")
    check_parameter_count(found.num_rows, 1)
    codes = found["g"].combine_chunks().dictionary_encode()
    groups = codes.dictionary.to_pylist()
    rank = np.empty(len(groups), dtype=np.int64)
    rank[sorted(range(len(groups)), key=groups.__getitem__)] = np.arange(len(groups))
    at = rank[codes.indices.to_numpy()], found["d"].to_numpy()
    count, mean, variance = np.zeros((3, len(groups), 1 + int(at[1].max())))
    for array, column in ((count, "n"), (mean, "m"), (variance, "v")):
        array[at] = found[column].to_numpy()
    return Mixture(count[:, 0] / count[:, 0].sum(), mean, variance)
