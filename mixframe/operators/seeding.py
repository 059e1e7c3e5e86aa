"""Seeding of k-means by oversampling, and rounds that skip distances by bounds.

Seeding (k-means||, Bahmani et al. 2012): from one first row, a few passes each draw rows with a chance in proportion to their squared
distance from the candidates so far; the candidates, weighted by the rows nearest to them, are then reduced to K. Draws are hashes
of the row's id, so a retried task draws the same rows. Restarts share every scan: a pass works on all of them at once.

Rounds with bounds (Hamerly 2010): a row keeps an upper bound of the distance to its centre and a lower bound of the distance to any other.
After the centres move, both change by at most the centres' moves; only a row whose bounds overlap is compared with all K again.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mixframe.functions import arrow
from mixframe.functions.hashing import md5_long
from mixframe.functions.vectors import doubles
from mixframe.model import check_parameter_count, vector_width
from mixframe.operators.fitting import Clustering, lloyd, nearest_centre, partition_sums
from mixframe.session import cut, scratch_path

#: Passes of the seeding, and candidates that a pass expects for each centre.
PASSES = 5
OVERSAMPLING = 2.0
HASH_DIGITS = 13
#: Rounding error that the bounds allow for, relative to the distances.
SLACK = 1e-9


def draw_of(id_col: str, turn: int, seed: int) -> Column:
    """A number in [0, 1) from the id, the pass and the seed."""
    return md5_long(id_col, F.lit(turn), F.lit(seed), digits=HASH_DIGITS) / F.lit(float(16**HASH_DIGITS))


def _squared_costs(centres: list[np.ndarray]):
    """Squared distance of every row to the nearest of each restart's candidates."""

    def costs(values: pa.Array) -> pa.Array:
        x = arrow.matrix(values, centres[0].shape[1])
        return arrow.lists(np.stack([nearest_centre(x, c)[1] for c in centres], axis=1))

    return arrow.row_function(costs, "array<double>", once=True)


def weighted_reduction(points: np.ndarray, weights: np.ndarray, k: int) -> np.ndarray:
    """K of the weighted candidates: the heaviest, then each time the one of the greatest weighted squared distance.

    The candidates are a few times K, whatever the table's size. Ties go to the first; fewer candidates than K are repeated.
    """
    chosen = [int(weights.argmax())]
    nearest = ((points - points[chosen[0]]) ** 2).sum(axis=1)
    while len(chosen) < k:
        pick = int((weights * nearest).argmax())
        chosen.append(pick)
        nearest = np.minimum(nearest, ((points - points[pick]) ** 2).sum(axis=1))
    return points[chosen]


def _first_rows(rows: DataFrame, seeds: list[int]) -> list[np.ndarray]:
    """Each restart's first candidate: the row of the least draw (then id), found by one aggregate."""
    least = [F.min_by("x", F.struct(draw_of("id", 0, s), F.col("id"))).alias(f"r{s}") for s in seeds]
    found = rows.agg(*least).first()
    if found is None or found[0] is None:
        raise ValueError("no rows to seed from")
    return [np.array([r], dtype=np.float64) for r in found]


def candidates(
    df: DataFrame, id_col: str, vector: str, k: int, seeds: list[int], passes: int = PASSES, oversampling: float = OVERSAMPLING
) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Candidates of each restart, in the order of pass and id, and the rows nearest to each.

    ``df`` has unique ids and vectors without nulls. A pass costs two aggregates over all rows: the summed cost, and the rows that
    were drawn, about ``oversampling`` times K for a restart and pass. Only these reach the driver, behind the check of their size.
    """
    width = vector_width(df, vector)
    check_parameter_count(int(k * (1 + passes * oversampling)) * len(seeds), width)
    rows = df.select(F.col(id_col).alias("id"), doubles(vector).alias("x")).persist(StorageLevel.MEMORY_AND_DISK)
    found = _first_rows(rows, seeds)
    for turn in range(1, passes + 1):
        costed = rows.select("id", "x", _squared_costs(found)("x").alias("cost"))
        sums = partition_sums(costed, ["cost"], lambda columns: {"cost": arrow.matrix(columns[0]).sum(axis=0)})["cost"]
        drawn = [
            F.struct(F.lit(i).alias("restart"), (draw_of("id", turn, s) * F.lit(float(sums[i])) < F.lit(oversampling * k) * F.col("cost")[i]).alias("in"))
            for i, s in enumerate(seeds)
        ]
        picked = costed.select("id", "x", F.explode(F.array(*drawn)).alias("d")).where("d.in").select("d.restart", "id", "x")
        for restart, _, x in sorted(picked.collect(), key=lambda r: (r[0], r[1])):
            found[restart] = np.vstack([found[restart], x])

    def counted(columns: list[pa.Array]) -> dict[str, np.ndarray]:
        x = arrow.matrix(columns[0], width)
        return {str(i): np.bincount(nearest_centre(x, c)[0], minlength=len(c)) for i, c in enumerate(found)}

    weights = partition_sums(rows, ["x"], counted)
    rows.unpersist()
    return found, [weights[str(i)] for i in range(len(seeds))]


def seeded_centres(
    df: DataFrame, id_col: str, vector: str, k: int, seed: int = 0, restarts: int = 1, passes: int = PASSES, oversampling: float = OVERSAMPLING
) -> list[np.ndarray]:
    """K starting centres for each restart; restart i draws with seed ``seed`` + i."""
    points, weights = candidates(df, id_col, vector, k, [seed + i for i in range(restarts)], passes, oversampling)
    return [weighted_reduction(p, w, k) for p, w in zip(points, weights, strict=True)]


@dataclass(frozen=True, eq=False)
class Bounded:
    """A clustering, and the distances between a row and a centre that its rounds computed."""

    clustering: Clustering
    distances: int


def _bounded_task(centres: np.ndarray, moves: np.ndarray | None):
    """A task of a round: rows with new label and bounds. ``moves`` are the centres' moves since the rows' bounds were made."""
    k, d = centres.shape
    # the greatest move of any centre but one: that of the farthest mover, or of the second for its own rows
    order = np.argsort(moves)[::-1] if moves is not None else None

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = arrow.matrix(batch.column("x"), d)
            n = len(x)
            if not n:
                continue
            if moves is None:
                label, upper, lower = np.zeros(n, np.int64), np.full(n, np.inf), np.zeros(n)
            else:
                label = batch.column("label").to_numpy(zero_copy_only=False).astype(np.int64)
                upper = batch.column("upper").to_numpy(zero_copy_only=False) + moves[label]
                others = np.where(label == order[0], moves[order[1]] if k > 1 else 0.0, moves[order[0]])
                lower = batch.column("lower").to_numpy(zero_copy_only=False) - others
            upper, lower = upper * (1.0 + SLACK), lower * (1.0 - SLACK)
            open_ = np.flatnonzero(~(upper < lower))
            count = 0
            if moves is not None and len(open_):
                upper[open_] = np.sqrt(((x[open_] - centres[label[open_]]) ** 2).sum(axis=1))
                count += len(open_)
                open_ = open_[~(upper[open_] * (1.0 + SLACK) < lower[open_])]
            if len(open_):
                squared = np.stack([((x[open_] - c) ** 2).sum(axis=1) for c in centres], axis=1)
                count += squared.size
                label[open_] = squared.argmin(axis=1)
                two = np.sqrt(np.partition(squared, min(1, k - 1), axis=1)[:, : min(2, k)])
                upper[open_], lower[open_] = two[:, 0], two[:, 1] if k > 1 else np.inf
            counts = np.zeros(n, np.int64)
            counts[0] = count
            columns = [batch.column("x"), pa.array(label.astype(np.int32)), pa.array(upper), pa.array(lower), pa.array(counts)]
            yield pa.RecordBatch.from_arrays(columns, names=["x", "label", "upper", "lower", "computed"])

    return bounded


def _offset_sums(centres: np.ndarray):
    def reduce(columns: list[pa.Array]) -> dict[str, np.ndarray]:
        x = arrow.matrix(columns[0], centres.shape[1])
        label = columns[1].to_numpy(zero_copy_only=False)
        sums = np.zeros(centres.shape)
        offsets = x - centres[label]
        np.add.at(sums, label, offsets)
        return {
            "n": np.bincount(label, minlength=len(centres)).astype(np.float64),
            "s1": sums,
            "cost": np.array([(offsets * offsets).sum()]),
            "computed": np.array([columns[2].to_numpy(zero_copy_only=False).sum()]),
        }

    return reduce


BOUNDED = "x array<double>, label int, upper double, lower double, computed bigint"


def lloyd_bounded(df: DataFrame, vector: str, centres: np.ndarray, rounds: int = 1, tolerance: float | None = None) -> Bounded:
    """The rounds of ``lloyd`` with bounds kept beside each row; the same centres, fewer distances.

    The rows with their bounds are written to the shared folder in each round and read by the next, so a lost executor costs a read.
    Worth it where K is large: a round without bounds reads a row once and computes K distances.
    """
    centres = np.array(centres, dtype=np.float64)
    check_parameter_count(*centres.shape)
    spark = df.sparkSession
    rows, moves, cost, computed = df.select(doubles(vector).alias("x")), None, float("nan"), 0
    for _ in range(rounds):
        path = scratch_path(spark, "bounds")
        rows.mapInArrow(_bounded_task(centres, moves), BOUNDED).write.parquet(path)
        rows = spark.read.schema(BOUNDED).parquet(path)
        sums = partition_sums(rows, ["x", "label", "computed"], _offset_sums(centres))
        if not sums:
            break
        n = sums["n"][:, None]
        step = sums["s1"].reshape(centres.shape) / np.where(n > 0, n, 1.0)
        moves, cost, computed = np.sqrt((step * step).sum(axis=1)), float(sums["cost"][0]), computed + int(sums["computed"][0])
        centres = centres + step
        if tolerance is not None and np.abs(step).max() <= tolerance:
            break
    return Bounded(Clustering(centres, cost), computed)


def kmeans_seeded(
    df: DataFrame, id_col: str, vector: str, k: int, seed: int = 0, restarts: int = 10, max_iter: int = 300, tolerance: float = 1e-4
) -> Clustering:
    """K-means with this seeding: all restarts are seeded by the same scans, and the cheapest clustering is kept.

    Reruns agree, whatever the partitions, up to the rounding of sums.
    """
    stored = cut(df.select(id_col, doubles(vector).alias(vector)))
    starts = seeded_centres(stored, id_col, vector, k, seed, restarts)
    found = [lloyd(stored, vector, start, max_iter, tolerance) for start in starts]
    return min(found, key=lambda clustering: clustering.cost)
