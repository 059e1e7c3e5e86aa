"""SimHash near-dedup by a binary trie self-join.

Fingerprints are the paths of a binary trie. The join walks pairs of nodes together: a pair has as many differing bits as
its paths so far, its children are the four pairs of sub-tries, and a pair beyond the error budget is dropped. The upper
levels run as DataFrame joins of node tables; a pair of nodes that hold few fingerprints each is finished in a task, which
goes on bit by bit over the two sorted arrays. A node with too many fingerprints, as a large group of near copies has, is
opened further by more levels, down to single fingerprints if need be, so no task gets an unbounded group.

Defined results: a null text counts as empty; a text of no words has fingerprint zero, which links like any other; fewer
words than a shingle are one shingle. Rows are never merged: repeated rows and ids each give a row. A null doc_id never
names a component unless the component has no other; equal fingerprints are one component. An empty table gives no row.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mixframe.llm.common import answer, components, forest, kept, release, stored

BITS = 64
SHINGLE_WORDS = 3
MAX_BITS = 2
SEED = 42
NODE_ROWS = 1024
STEP = 8
LEAF = 1024
#: Shingles whose bits are counted at a time.
BLOCK = 1 << 16


def fingerprint(text: str | None, words: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """The fingerprint of one text, unsigned: a bit is set if more than half of the shingles' hashes set it."""
    said = (text or "").encode("utf-8", "replace").lower().split()  # bytes: lowers A-Z, splits at 0x20 and 0x09 to 0x0D
    if not said:
        return 0
    shingles = map(b" ".join, zip(*(said[i:] for i in range(words)), strict=False)) if len(said) >= words else [b" ".join(said)]
    counts, total = np.zeros(BITS, np.int64), 0
    hashes = np.fromiter((xxhash.xxh64_intdigest(s, seed) for s in shingles), np.uint64)
    for start in range(0, len(hashes), BLOCK):
        block = hashes[start : start + BLOCK]
        bits = np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
        total += len(block)
    return int(np.packbits(counts * 2 > total, bitorder="little").view(np.uint64)[0])


def with_fingerprint(docs: DataFrame, out: str, words: int = SHINGLE_WORDS, seed: int = SEED) -> DataFrame:
    """``docs`` with the fingerprint of ``text`` as a long of the same bits."""

    def prints(column: pa.Array) -> pa.Array:
        found = np.fromiter((fingerprint(t, words, seed) for t in column.to_pylist()), np.uint64, len(column))
        release()
        return pa.array(found.view(np.int64))

    return docs.withColumn(out, F.arrow_udf(prints, "bigint")(F.col("text")))


def _masks(bits: int, budget: int) -> list[int]:
    """Numbers of ``bits`` bits with at most ``budget`` ones."""
    return [sum(1 << i for i in ones) for k in range(min(budget, bits) + 1) for ones in combinations(range(bits), k)]


def _split(rows: np.ndarray, bit: int, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Where, in each sorted range that shares all higher bits, the rows with ``bit`` begin."""
    ones = np.concatenate(([0], np.cumsum((rows >> np.uint64(bit)) & np.uint64(1)))).astype(np.int64)
    return high - (ones[high] - ones[low])


def linked(a: np.ndarray, b: np.ndarray, depth: int, budget: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of two sorted arrays of fingerprints that differ in at most ``budget`` bits.

    All of ``a`` share their first ``depth`` bits, and so do all of ``b``. For ``a is b`` every pair comes once.
    """
    same = a is b
    if not len(a) or not len(b):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    spent = int(np.bitwise_count((a[0] ^ b[0]) >> np.uint64(BITS - depth))) if depth else 0
    front = np.array([[0, len(a), 0, len(b), spent]], np.int64)
    bit, found = BITS - 1 - depth, []
    while len(front):
        size = (front[:, 1] - front[:, 0]) * (front[:, 3] - front[:, 2])
        done = size <= LEAF if bit >= 0 else np.ones(len(front), bool)
        if done.any():
            node, n = front[done], size[done]
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            width = np.repeat(node[:, 3] - node[:, 2], n)
            i, j = np.repeat(node[:, 0], n) + at // width, np.repeat(node[:, 2], n) + at % width
            near = np.bitwise_count(a[i] ^ b[j]) <= budget
            found.append(np.stack([i[near & (i < j)], j[near & (i < j)]]) if same else np.stack([i[near], j[near]]))
        front = front[~done]
        if not len(front):
            break
        a0, a1, b0, b1, d = front.T
        am, bm = _split(a, bit, a0, a1), _split(b, bit, b0, b1)
        children = [(a0, am, b0, bm, d), (am, a1, bm, b1, d), (a0, am, bm, b1, d + 1), (am, a1, b0, bm, d + 1)]
        front = np.concatenate([np.stack(c, axis=1) for c in children])
        twin = np.concatenate([np.zeros(len(d) * 3, bool), (a0 == b0) & same])  # of the pair crossed the other way
        front = front[(front[:, 4] <= budget) & (front[:, 0] < front[:, 1]) & (front[:, 2] < front[:, 3]) & ~twin]
        bit -= 1
    i, j = np.concatenate(found, axis=1) if found else np.empty((2, 0), np.int64)
    return i, j


def _links(budget: int):  # noqa: ANN202
    """Arrow function: for each pair of nodes the links between their fingerprints, as a spanning forest."""

    def forests(left: pa.Array, right: pa.Array, depth: pa.Array) -> pa.Array:
        rows, us, vs = [0], [], []
        for one, other, level in zip(left, right, depth, strict=True):
            a = np.sort(one.values.to_numpy().view(np.uint64))
            b = a if other.values is None else np.sort(other.values.to_numpy().view(np.uint64))
            i, j = linked(a, b, level.as_py(), budget)
            nodes = a if b is a else np.concatenate([a, b])
            root = forest(len(nodes), i, j if b is a else j + len(a))
            moved = root != np.arange(len(nodes))
            us.append(nodes[root[moved]].view(np.int64))
            vs.append(nodes[moved].view(np.int64))
            rows.append(rows[-1] + int(moved.sum()))
        parts = [pa.array(np.concatenate(x) if x else np.empty(0, np.int64)) for x in (us, vs)]
        return pa.ListArray.from_arrays(pa.array(rows, pa.int32()), pa.StructArray.from_arrays(parts, names=["u", "v"]))

    return F.arrow_udf(forests, "array<struct<u:bigint,v:bigint>>")


def trie_links(prints: DataFrame, budget: int = MAX_BITS, node_rows: int = NODE_ROWS) -> DataFrame:
    """Links ``u``, ``v`` that connect all distinct fingerprints ``fp`` within ``budget`` bits of each other.

    The first level is as deep as evenly spread fingerprints need; every further round opens ``STEP`` more bits of the
    nodes that are still too large. Node tables hold one row for each node, pair tables one for each pair within the
    budget; the fingerprints of a node travel as one array of at most ``node_rows``.
    """
    spark = prints.sparkSession
    depth = max(0, math.ceil(math.log2(max(1, prints.count()) / (node_rows / 2))))
    prefix = lambda d: F.shiftrightunsigned("fp", BITS - d) if d else F.lit(0).cast("bigint")
    several = lambda masks: F.explode(F.array(*[F.lit(m).cast("bigint") for m in masks]))
    counted = stored(prints.groupBy(prefix(depth).alias("node")).agg(F.count(F.lit(1)).alias("n")), "nodes")
    other = counted.select(F.col("node").alias("b"), F.col("n").alias("nb"))
    pairs = counted.select(F.col("node").alias("a"), F.col("n").alias("na")).withColumn("mask", several(_masks(depth, budget)))
    pairs = pairs.withColumn("b", F.col("a").bitwiseXOR(F.col("mask"))).where("a <= b")
    pairs = pairs.join(other, "b").withColumn("d", F.bit_count("mask")).select("a", "b", "na", "nb", "d")
    out = None
    while True:
        pairs = stored(pairs, "pairs")
        done = pairs.where(F.greatest("na", "nb") <= node_rows) if depth < BITS else pairs
        used = done.select(F.col("a").alias("node")).unionAll(done.select(F.col("b").alias("node"))).distinct()
        arrays = prints.select("fp", prefix(depth).alias("node")).join(used, "node", "left_semi")
        arrays = stored(arrays.groupBy("node").agg(F.collect_list("fp").alias("fps")), "arrays")
        crossed = done.where("a <> b").join(arrays.select(F.col("node").alias("b"), F.col("fps").alias("right")), "b")
        inner = done.where("a = b").select("a", F.lit(None).cast("array<bigint>").alias("right"))
        rows = crossed.select("a", "right").unionAll(inner)
        rows = rows.join(arrays.select(F.col("node").alias("a"), F.col("fps").alias("left")), "a")
        links = rows.select(F.inline(_links(budget)("left", "right", F.lit(depth))))
        out = links if out is None else out.unionAll(links)
        if depth >= BITS:
            return out
        large = pairs.where(F.greatest("na", "nb") > node_rows)
        if not large.head(1):
            return out
        step = min(STEP, BITS - depth)
        nodes = large.select(F.col("a").alias("node")).unionAll(large.select(F.col("b").alias("node"))).distinct()
        inside = prints.select("fp", prefix(depth).alias("node")).join(nodes, "node", "left_semi")
        children = stored(inside.groupBy(prefix(depth + step).alias("child")).agg(F.count(F.lit(1)).alias("n")), "nodes")
        under = children.withColumn("node", F.shiftrightunsigned("child", step))
        one = under.select(F.col("node").alias("a"), F.col("child").alias("ca"), F.col("n").alias("cn"))
        masks = spark.createDataFrame([(m, m.bit_count()) for m in _masks(step, budget)], "mask bigint, ones int")
        opened = large.join(one, "a").join(F.broadcast(masks), F.col("d") + F.col("ones") <= budget)
        low = F.lit((1 << step) - 1).cast("bigint")
        crossing = F.call_function("shiftleft", F.col("b"), F.lit(step)).bitwiseOR(F.col("ca").bitwiseAND(low).bitwiseXOR(F.col("mask")))
        opened = opened.withColumn("cb", crossing).where("a <> b OR ca <= cb")
        two = children.select(F.col("child").alias("cb"), F.col("n").alias("nb2"))
        depth += step
        pairs = opened.join(two, "cb").select(
            F.col("ca").alias("a"), F.col("cb").alias("b"), F.col("cn").alias("na"), F.col("nb2").alias("nb"),
            (F.col("d") + F.col("ones")).alias("d"),
        )


def near_duplicates(docs: DataFrame, keep: list[str], budget: int = MAX_BITS, words: int = SHINGLE_WORDS) -> DataFrame:
    """``keep`` columns of ``docs``, ``fp`` (the fingerprint as a long), ``root`` (a fingerprint that names the component)
    and ``component_id`` (its smallest doc_id, which components of a repeated id may share).

    A result whose name a kept column has gets an underscore after it. ``docs`` has doc_id and text. Texts are read once; all joins are on fingerprints, equal ones combined.
    """
    slim = with_fingerprint(docs, "__fp", words).select(*kept(keep), F.col("doc_id").alias("__id"), F.col("__fp").alias("fp"))
    slim = stored(slim, "fingerprints")
    prints = stored(slim.groupBy("fp").agg(F.min("__id").alias("first")), "prints")
    groups = components(trie_links(prints.select("fp"), budget))
    member = stored(prints.join(groups.select(F.col("node").alias("fp"), "root"), "fp", "left"), "members")
    member = member.withColumn("root", F.coalesce("root", "fp"))
    smallest = member.groupBy("root").agg(F.min("first").alias("component_id"))
    named = member.join(smallest, "root").select("fp", "root", "component_id")
    return answer(slim.join(named, "fp"), keep, {c: F.col(c) for c in ("fp", "root", "component_id")})


def hex_print(fp: str) -> F.Column:
    """A fingerprint as 16 lowercase hex digits."""
    return F.lpad(F.lower(F.hex(F.col(fp))), 16, "0")
