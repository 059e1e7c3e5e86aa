"""What several operators share: tables in the shared folder, order with offsets, forests and components."""

from __future__ import annotations

import ctypes
import sys
import types
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mixframe.session import scratch_path

#: White space of the contracts: space, and 0x09 to 0x0D.
WORD = r"[^\x20\x09-\x0D]+"
BROADCAST_BYTES = 64 << 20
#: Row groups of stored tables: a task that writes or reads whole texts holds one.
ROW_GROUP_BYTES = 16 << 20
PLACE_BITS = 33


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared checkpoint folder: computed once, with no lineage for a lost executor to redo."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("parquet.block.size", ROW_GROUP_BYTES).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_name(name: str, taken: list[str]) -> str:
    """``name``, or where a column has it already (in any case), ``name`` with as many underscores after it as it takes."""
    used = {c.lower() for c in taken}
    while name.lower() in used:
        name += "_"
    return name


def quoted(name: str) -> Column:
    """The column of exactly this name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def kept(keep: list[str]) -> list[Column]:
    """Columns to keep, under names that no operator uses; ``answer`` names them back."""
    return [quoted(c).alias(f"__k{i}") for i, c in enumerate(keep)]


def answer(rows: DataFrame, keep: list[str], results: dict[str, Column]) -> DataFrame:
    """The kept columns under their own names, then the results, under ``free_name`` where a kept column has the name."""
    own = [F.col(f"__k{i}").alias(c) for i, c in enumerate(keep)]
    return rows.select(*own, *[column.alias(free_name(name, keep)) for name, column in results.items()])


def small(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` marked for broadcast if its counted rows of ``row_bytes`` bytes fit; otherwise as it is, for a shuffle join."""
    return F.broadcast(df) if df.count() * row_bytes <= limit else df


def ordered(df: DataFrame, order: list[Column]) -> DataFrame:
    """``df`` range-sorted and stored, with ``__part`` and ``__place``, which rises along the order.

    Storing makes the places final: range bounds are sampled anew by every evaluation. Rows that are equal in all of
    ``order`` share a partition; end the order with a hash of the row where keys repeat.
    """
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = stored(rows.withColumn("__place", F.monotonically_increasing_id()), "ordered")
    return placed.withColumn("__part", F.shiftright("__place", PLACE_BITS))


def chunks(placed: DataFrame, group: str) -> DataFrame:
    """Per part and group of an ``ordered`` table: first place, rows, and the rows of the group in earlier parts.

    The table has a row for every group and part that meet, so the prefix sum over the parts of a group is short
    however many rows the group has.
    """
    counted = placed.groupBy("__part", group).agg(F.min("__place").alias("__first"), F.count(F.lit(1)).alias("__rows"))
    earlier = Window.partitionBy(group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    return counted.withColumn("__before", F.coalesce(F.sum("__rows").over(earlier), F.lit(0)))


def forest(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The smallest index that each of ``n`` nodes reaches over the given links."""
    label = np.arange(n)
    while True:
        a, b = label[left], label[right]
        open_ = a != b
        if not open_.any():
            return label
        a, b = a[open_], b[open_]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(jumped := label[label], label):
            label = jumped


def _forest_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            pairs = np.stack([batch.column(i).to_numpy() for i in (0, 1)])
            nodes, index = np.unique(pairs, return_inverse=True)
            index = index.reshape(2, -1)
            root = forest(len(nodes), index[0], index[1])
            moved = root != np.arange(len(nodes))
            yield pa.RecordBatch.from_arrays([pa.array(nodes[root[moved]]), pa.array(nodes[moved])], names=["u", "v"])


def components(edges: DataFrame) -> DataFrame:
    """Connected components of links ``u``, ``v`` (long): every linked node with a ``root`` common to its component.

    A round sends every node to the node of least priority within two steps; links between the images carry on until
    none is left. Priorities are hashes that change by the round, so chains shrink by a constant factor whatever their
    ids are, and a star is done in one round. Minima are combined before the shuffle; the joins have one row for each
    node on one side, so a hub's links can be split by the adaptive skew join. Every round is stored in the shared
    folder. No links give an empty table.
    """
    edges = edges.select("u", "v").where("u <> v").mapInArrow(_forest_batches, "u bigint, v bigint")
    edges = stored(edges.distinct(), "links")
    hops: list[DataFrame] = []
    while edges.head(1):
        rank = lambda c, r=len(hops): F.struct(F.xxhash64(c, F.lit(r)).alias("p"), F.col(c).alias("n"))
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = both.groupBy("u").agg(F.min(rank("v")).alias("m")).select("u", F.least("m", rank("u")).alias("m"))
        seen = both.join(near.select(F.col("u").alias("v"), "m"), "v").groupBy("u").agg(F.min("m").alias("m"))
        hop = stored(seen.select(F.col("u").alias("node"), F.col("m.n").alias("root")), "hop")
        hops.append(hop)
        moved = edges.join(hop.select(F.col("node").alias("u"), F.col("root").alias("a")), "u")
        moved = moved.join(hop.select(F.col("node").alias("v"), F.col("root").alias("b")), "v").where("a <> b")
        edges = stored(moved.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct(), "links")
    if not hops:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    found = hops[0]
    for hop in hops[1:]:
        step = hop.select(F.col("node").alias("root"), F.col("root").alias("__next"))
        found = found.join(step, "root", "left").select("node", F.coalesce("__next", "root").alias("root"))
    return found


def texts(column: pa.Array) -> list[str]:
    """A string column as Python strings; null is empty."""
    return [t or "" for t in column.to_pylist()]


def once(name: str, make: Callable[[], Any]) -> Any:
    """What ``make`` gives, kept by the worker process under ``name`` for later tasks and batches."""
    store = sys.modules.setdefault("_mixframe_once", types.ModuleType("_mixframe_once"))
    if name not in store.__dict__:
        store.__dict__[name] = make()
    return store.__dict__[name]


def release() -> None:
    """Give freed memory back to the system: a worker process outlives its task, beside the JVM of its executor."""
    pa.default_memory_pool().release_unused()
    trim = once("malloc_trim", lambda: getattr(ctypes.CDLL(None), "malloc_trim", None))
    if trim is not None:
        trim(0)


def spans_of(lengths: np.ndarray, limit: int) -> Iterator[slice]:
    """Consecutive rows whose lengths add up to at most ``limit``; a longer row comes alone."""
    start, total = 0, 0
    for i, n in enumerate(lengths):
        if i > start and total + n > limit:
            yield slice(start, i)
            start, total = i, 0
        total += int(n)
    if len(lengths) > start:
        yield slice(start, len(lengths))
