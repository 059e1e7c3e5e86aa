"""Embedding near-dedup: cross-polytope hashing after fast Hadamard rotations, multiprobe buckets, verified pairs.

A table of buckets draws random signs for three rounds of (signs, Hadamard transform), as often as the hash has parts;
a part is the largest coordinate of the rotated vector with its sign. A vector lies in its home bucket, and looks also
in the one where its least certain part is replaced by the second choice. Two vectors meet in a bucket if one of them is
at home there; pairs that meet are verified by their cosine in double precision.

Equal vectors are one row with a count, whatever their number. A bucket beyond ``block_rows`` is cut into blocks, every
pair of blocks a unit of its own, so that a bucket of any size is spread over tasks. Pairs never leave a task: it returns
how many links each vector has there, and a spanning forest of them. A pair that meets in several buckets counts in the
first one.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components link with nothing, not even
with their copies; vectors link only with those of their length. A null vec_id gives a row, and never names a component
unless the component has no other; repeated rows are copies. An empty table gives no row. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mixframe.llm.common import components, forest, small, stored

THRESHOLD = 0.95
#: Least number of tables, and the share of pairs at the threshold that may meet in none of them.
TABLES, MISS = 10, 0.005
BLOCK_ROWS = 512
SEED = 11
#: Rows that are hashed or compared at a time.
BATCH_ROWS = 4096
BUCKET_ROWS = 8
FOUND = "node bigint, root bigint, links bigint"


def _hadamard(rows: np.ndarray) -> np.ndarray:
    """The Hadamard transform of each row; the width is a power of two."""
    n, width = rows.shape
    step = 1
    while step < width:
        pairs = rows.reshape(n, width // (2 * step), 2, step)
        rows = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(n, width)
        step *= 2
    return rows / math.sqrt(width)


def bucket_keys(rows: np.ndarray, parts: int, tables: int = TABLES, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Home and second bucket of each row in each table."""
    n, width = rows.shape
    padded = 1 << max(0, (width - 1).bit_length())
    home, second = np.zeros((n, tables), np.uint64), np.zeros((n, tables), np.uint64)
    for start in range(0, n, BATCH_ROWS):
        block = rows[start : start + BATCH_ROWS]
        m = len(block)
        for table in range(tables):
            choice, other, margin = (np.zeros((m, parts), np.int64), np.zeros((m, parts), np.int64), np.zeros((m, parts)))
            for part in range(parts):
                turned = np.zeros((m, padded))
                turned[:, :width] = block
                signs = np.random.default_rng([seed, width, table, part]).choice([-1.0, 1.0], (3, padded))
                for sign in signs:
                    turned = _hadamard(turned * sign)
                size = np.abs(turned)
                at = np.arange(m)
                first = size.argmax(axis=1)
                top = size[at, first]
                choice[:, part] = 2 * first + (turned[at, first] < 0)
                size[at, first] = -1
                next_ = size.argmax(axis=1)
                # a row of one coordinate has no second choice but the other sign
                other[:, part] = 2 * next_ + (turned[at, next_] < 0) if padded > 1 else choice[:, part] ^ 1
                margin[:, part] = top - size[at, next_]
            weak = margin.argmin(axis=1)
            probe = choice.copy()
            probe[np.arange(m), weak] = other[np.arange(m), weak]
            for out, picked in ((home, choice), (second, probe)):
                key = np.full(m, table * 0x9E3779B97F4A7C15 % (1 << 64) + width, np.uint64)
                for part in range(parts):
                    key = (key ^ picked[:, part].astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
                    key ^= key >> np.uint64(32)
                out[start : start + m, table] = key
    return home, second


def tables_for(width: int, parts: int, threshold: float = THRESHOLD, seed: int = SEED, pairs: int = 1000) -> int:
    """Tables that it takes for pairs of cosine ``threshold`` to be missed at most as often as ``MISS`` says, ``TABLES`` at least.

    How often such a pair meets in one table is tried on random pairs, which rotations make alike to any others.
    """
    one, other = np.random.default_rng([seed, width]).normal(size=(2, pairs, max(2, width)))
    one /= np.linalg.norm(one, axis=1, keepdims=True)
    other -= (one * other).sum(axis=1, keepdims=True) * one
    other /= np.linalg.norm(other, axis=1, keepdims=True)
    near = threshold * one + math.sqrt(max(0.0, 1 - threshold**2)) * other
    (home, second), (home2, second2) = (bucket_keys(rows, parts, 2, seed) for rows in (one, near))
    met = ((home == home2) | (home == second2) | (second == home2)).mean()
    return TABLES if met >= 1 else max(TABLES, math.ceil(math.log(MISS) / math.log1p(-max(met, 1 / pairs))))


def _rows(column: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Indexes and double matrix of the vectors of each length."""
    lengths = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    starts = np.concatenate([[0], np.cumsum(lengths)])[:-1]
    for width in np.unique(lengths):
        index = np.flatnonzero(lengths == width)
        yield index, values[starts[index][:, None] + np.arange(width)]


def _bounded(rows: np.ndarray) -> np.ndarray:
    """Rows scaled by powers of two, which is exact, so that the largest component is about 1: no sum of squares over- or underflows."""
    _, exponent = np.frexp(np.abs(rows).max(axis=1))
    return np.ldexp(rows, -exponent[:, None])


def _hasher(parts: int, tables: int, seed: int):  # noqa: ANN202
    """Arrow function: the buckets of each vector, home ones first."""

    def hashed(column: pa.Array) -> pa.Array:
        out = np.zeros((len(column), 2 * tables), np.int64)
        for index, rows in _rows(column):
            home, second = bucket_keys(_bounded(rows), parts, tables, seed)
            out[index] = np.concatenate([home, second], axis=1).view(np.int64)
        offsets = np.arange(len(column) + 1, dtype=np.int32) * np.int32(2 * tables)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(out.ravel()))

    return F.arrow_udf(hashed, "array<bigint>")


def _meetings(unit: np.ndarray, block: np.ndarray, two: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of rows of one unit; with two blocks, one of each. Rows are sorted by unit."""
    starts = np.flatnonzero(np.concatenate([[True], unit[1:] != unit[:-1]]))
    sizes = np.diff(np.append(starts, len(unit)))
    begin, size = np.repeat(starts, sizes), np.repeat(sizes, sizes)
    offset = np.arange(len(unit)) - begin
    for gap in range(1, int(sizes.max())):
        i = np.flatnonzero(offset + gap < size)
        j = i + gap
        crossing = ~two[i] | (block[i] != block[j])
        yield i[crossing], j[crossing]


def _compare(parts: int, tables: int, seed: int, threshold: float):  # noqa: ANN202
    """Task function over rows sorted by unit: link counts and spanning forests of the verified pairs."""

    def unit_pairs(unit, home, block, two, nodes, copies, bucket, rows):  # noqa: ANN001, ANN202
        rows = _bounded(rows)
        length = np.sqrt(np.einsum("ij,ij->i", rows, rows))
        left, right = [], []
        for i, j in _meetings(unit, block, two):
            met = home[i] | home[j]
            i, j = i[met], j[met]
            for start in range(0, len(i), BATCH_ROWS):
                a, b = i[start : start + BATCH_ROWS], j[start : start + BATCH_ROWS]
                near = np.einsum("ij,ij->i", rows[a], rows[b]) / (length[a] * length[b]) >= threshold
                left.append(a[near])
                right.append(b[near])
        i, j = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (left, right))
        if not len(i):
            return None
        used, index = np.unique(np.concatenate([i, j]), return_inverse=True)
        at, keys = np.split(index, 2), bucket_keys(rows[used], parts, tables, seed)
        first = np.zeros(len(i), bool)
        for start in range(0, len(i), BATCH_ROWS):  # does the pair meet here first?
            part = slice(start, start + BATCH_ROWS)
            a, b = at[0][part], at[1][part]
            ways = [(keys[0][a] == keys[k][b], keys[0][a]) for k in (0, 1)] + [(keys[1][a] == keys[0][b], keys[1][a])]
            meets = np.stack([w[0] for w in ways], axis=2)
            where = np.stack([w[1] for w in ways], axis=2)
            # tables in order, and the smaller key where two buckets of a table are shared
            masked = np.where(meets, where, np.uint64(2**64 - 1)).min(axis=2)
            table = meets.any(axis=2).argmax(axis=1)
            first[part] = masked[np.arange(len(a)), table] == bucket[i[part]].view(np.uint64)
        i, j = i[first], j[first]
        if not len(i):
            return None
        links = np.zeros(len(rows), np.int64)
        np.add.at(links, i, copies[j])
        np.add.at(links, j, copies[i])
        root = forest(len(rows), i, j)
        # a vector appears in many units: sum by node before it leaves
        linked = np.flatnonzero(links)
        return nodes[linked], nodes[root[linked]], links[linked]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def work(table: pa.Table) -> Iterator[pa.RecordBatch]:
            batch = table.combine_chunks().to_batches()[0]
            column = lambda name: batch.column(batch.schema.get_field_index(name))
            plain = {n: column(n).to_numpy(zero_copy_only=False) for n in ("bucket", "one", "other", "home", "block", "node", "copies")}
            for index, rows in _rows(column("vector")):
                get = {n: v[index] for n, v in plain.items()}
                unit = np.unique(np.stack([get["bucket"], get["one"], get["other"]], axis=1), axis=0, return_inverse=True)[1].ravel()
                order = np.argsort(unit, kind="stable")
                get = {n: v[order] for n, v in get.items()}
                two = get["one"] != get["other"]
                found = unit_pairs(unit[order], get["home"], get["block"], two, get["node"], get["copies"], get["bucket"], rows[order])
                if found is not None:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["node", "root", "links"])

        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([held, table]) if held is not None else table
            keys = [table.column(n).to_numpy() for n in ("bucket", "one", "other")]
            same = (keys[0] == keys[0][-1]) & (keys[1] == keys[1][-1]) & (keys[2] == keys[2][-1])
            cut = int(np.argmax(same))  # the last unit may go on in the next batch
            if cut:
                yield from work(table.slice(0, cut))
            held = table.slice(cut)
        if held is not None:
            yield from work(held)

    return compare


def _usable(vector: str) -> F.Column:
    fine = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return F.col(vector).isNotNull() & fine & F.exists(vector, lambda v: v != 0)


def linked_vectors(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector: str = "embedding",
    threshold: float = THRESHOLD,
    tables: int | None = None,
    block_rows: int = BLOCK_ROWS,
    seed: int = SEED,
) -> DataFrame:
    """One row for each vector: its id, ``n_links`` (other vectors at ``threshold`` or above), ``component_id`` and ``kept``.

    ``kept`` marks the vector that names its component; one without an id is kept if no other of its component has one.
    """
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector).alias("vector"))
    usable = rows.where(F.coalesce(_usable("vector"), F.lit(False)))
    # -0.0 and 0.0 are one number
    usable = usable.withColumn("vector", F.transform("vector", lambda v: F.when(v == 0, F.abs(v)).otherwise(v)))
    classes = usable.groupBy("vector").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("copies"))
    classes = stored(classes.withColumn("node", F.monotonically_increasing_id()), "vectors")
    count, width = classes.agg(F.count(F.lit(1)), F.max(F.size("vector"))).first()
    # as many parts as it takes for unrelated vectors to be few in a bucket
    parts = max(1, round(math.log(max(2, count) / BUCKET_ROWS) / math.log(2 * (1 << max(1, (width or 1) - 1).bit_length()))))
    # the more parts, the more tables, so that recall does not fall as the table grows
    tables = tables or tables_for(width or 1, parts, threshold, seed)
    keys = _hasher(parts, tables, seed)("vector")
    placed = classes.withColumn("keys", keys).select("node", "copies", "vector", F.posexplode("keys").alias("k", "bucket"))
    # a second bucket equal to a home one would pair a vector with itself; pairs with others meet at home anyway
    placed = placed.withColumn("home", F.col("k") < tables).drop("k")
    sizes = placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block_rows)
    sizes = stored(sizes.select("bucket", F.ceil(F.col("n") / block_rows).cast("int").alias("blocks")), "buckets")
    split = placed.join(small(sizes, 32), "bucket", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    split = split.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    meets = split.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    units = meets.select("bucket", F.least("block", "with").alias("one"), F.greatest("block", "with").alias("other"),
                         "block", "home", "node", "copies", "vector")
    dealt = units.repartition("bucket", "one", "other").sortWithinPartitions("bucket", "one", "other")
    found = stored(dealt.mapInArrow(_compare(parts, tables, seed, threshold), FOUND), "found")
    groups = components(found.select(F.col("root").alias("u"), F.col("node").alias("v")))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    member = classes.select("node", "vector", "first", "copies").join(links, "node", "left").join(groups, "node", "left")
    member = stored(member.withColumn("root", F.coalesce("root", "node")), "members")
    names = member.groupBy("root").agg(F.min("first").alias("component_id"))
    answer = member.join(names, "root").select(
        "vector", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id"
    )
    same = F.transform("vector", lambda v: F.when(v == 0, F.abs(v)).otherwise(v))
    key = F.when(F.coalesce(_usable("vector"), F.lit(False)), same)
    joined = rows.select("id", key.alias("vector")).join(answer, "vector", "left")
    component = F.when(F.col("vector").isNotNull(), F.col("component_id")).otherwise(F.col("id"))
    return joined.select(
        F.col("id").alias(id_col),
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        component.alias("component_id"),
        F.col("id").eqNullSafe(component).alias("kept"),
    )
