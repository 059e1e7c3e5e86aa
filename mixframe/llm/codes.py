"""Vector code compression: product codes by exact integer k-means over Hilbert-sorted blocks.

Components become integers; a vector is cut into equal consecutive parts, and every part position has a codebook. The parts of a
position are sorted along a Hilbert curve over their components and cut into flat blocks of ``BLOCK_ROWS``. A block stores its parts
with the least and greatest of each component (its box) and their sums.

A round sends the codebooks to the blocks. The least distance from an entry to a box bounds the distances of all its
parts from below, the largest one from above; an entry whose lower bound is above another's upper bound serves no part
of the block. What is left is the block's shortlist. A shortlist of one needs the box and the sums alone; otherwise an integer
kernel compares the block's parts with the shortlist. All arithmetic is in 64-bit integers, so neither the order of the blocks nor
their bounds can change a result: the curve decides only how short the lists are.

Tasks add up their entries' counts and sums; the driver sees these, ``entries`` x width numbers a round, never a row.
The rows are numbered and stored, and so are the blocks, so a lost executor costs a read.

Defined results: vectors that are null, empty or hold null or non-finite components are dropped, and so are those of another length
than the vector with the smallest id. That length must be a multiple of the parts, and components must stay below 2**26 when scaled
(distances then fit 63 bits for up to 256 components a part): both are errors otherwise. Null ids come after all others; equal ids are
ordered by their vectors, and every row has its own code. Fewer rows than entries make a smaller codebook. Equal entries leave the higher
one unused. An empty table gives no row. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mixframe.llm import hilbert
from mixframe.llm.common import release, stored
from mixframe.operators.lookup import lookup_join

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
BLOCK_ROWS = 256
#: Bound of a scaled component.
LIMIT = 1 << 26
#: Most bits of a component in the curve's key.
CURVE_BITS = 8
PART_ROWS = "part int, curve bigint, row bigint, value array<int>"
BLOCKS = "part int, rows array<bigint>, value array<int>, low array<int>, high array<int>, total array<bigint>"
SUMS = "part int, entry int, component int, total bigint"
CODES = "row bigint, code bigint, error bigint"

Codebooks = list[np.ndarray]


def scaled(vector: Column, scale: int = SCALE) -> Column:
    """Integer components floor(scale x) of a vector; null if it is null, empty, or holds null or non-finite components."""

    def floors(column: pa.Array) -> pa.Array:
        offsets, flat = column.offsets.to_numpy(), column.values
        x = flat.to_numpy(zero_copy_only=False).astype(np.float64)  # null components become NaN
        good = np.isfinite(x)
        whole = np.floor(np.where(good, x, 0.0) * scale)
        sizes = np.diff(offsets)
        bad = np.concatenate([[0], np.cumsum(~good)])
        kept = (sizes > 0) & (bad[offsets[1:]] == bad[offsets[:-1]]) & column.is_valid().to_numpy(zero_copy_only=False)
        inside = np.repeat(kept, sizes)
        whole = whole[offsets[0] : offsets[-1]][inside]
        if len(whole) and np.abs(whole).max() >= LIMIT:
            raise ValueError(f"scaled components must stay below {LIMIT}")
        ends = np.concatenate([[0], np.cumsum(np.where(kept, sizes, 0))]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(whole.astype(np.int32)))
        return pc.if_else(pa.array(kept), lists, pa.scalar(None, lists.type))

    return F.arrow_udf(floors, "array<int>")(vector.cast("array<double>"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), width)


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    rows, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * np.int32(width)), pa.array(values.ravel(), kind))


def _component_sums(width: int):  # noqa: ANN202
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros((3, width))
        for batch in batches:
            x = _matrix(batch.column(0), width).astype(np.float64)
            found += [np.full(width, len(x)), x.sum(axis=0), (x * x).sum(axis=0)]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width, dtype=np.int32)), *map(pa.array, found)], names=["component", "n", "one", "two"])

    return sums


def _spread(vectors: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation of each component; they only place the cells of the curve."""
    found = vectors.select("value").mapInArrow(_component_sums(width), "component int, n double, one double, two double")
    table = found.groupBy("component").agg(F.sum("n").alias("n"), F.sum("one").alias("one"), F.sum("two").alias("two")).orderBy("component").toArrow()
    n, one, two = (table.column(c).to_numpy() for c in ("n", "one", "two"))
    return one / n, np.sqrt(np.maximum(two / n - (one / n) ** 2, 1.0))


def _cut_parts(parts: int, mean: np.ndarray, spread: np.ndarray):  # noqa: ANN202
    width = len(mean) // parts
    used = min(width, hilbert.KEY_BITS)
    bits = max(1, min(CURVE_BITS, hilbert.KEY_BITS // used))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1), parts * width)
            cells = np.clip((x - mean) / (4.0 * spread) + 0.5, 0.0, 1.0 - 1e-9) * (1 << bits)
            for part in range(parts):
                of = slice(part * width, part * width + used)
                curve = hilbert.index(cells[:, of].astype(np.int64), bits)
                value = np.ascontiguousarray(x[:, part * width : (part + 1) * width])
                columns = [pa.array(np.full(len(x), part, np.int32)), pa.array(curve), batch.column(0), _lists(value, pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, names=["part", "curve", "row", "value"])

    return cut


def _pack(width: int, block_rows: int):  # noqa: ANN202
    """Cut the sorted parts of a task into blocks."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def blocks(at_end: bool) -> Iterator[pa.RecordBatch]:
            part, rows, value = (np.concatenate(c) for c in zip(*held, strict=True))
            held.clear()
            # a block ends where the part does, and after so many rows of it
            begins = np.flatnonzero(np.diff(part, prepend=part[0] - 1))
            since = np.arange(len(part)) - np.repeat(begins, np.diff(begins, append=len(part)))
            starts = np.flatnonzero(since % block_rows == 0)
            ends = np.append(starts[1:], len(part))
            if not at_end and ends[-1] - starts[-1] < block_rows:  # the last block may go on
                held.append((part[starts[-1] :], rows[starts[-1] :], value[starts[-1] :]))
                starts, ends = starts[:-1], ends[:-1]
            if not len(starts):
                return
            stop = ends[-1]
            low, high = (f.reduceat(value[:stop], starts, axis=0) for f in (np.minimum, np.maximum))
            total = np.add.reduceat(value[:stop].astype(np.int64), starts, axis=0)
            cuts = np.append(starts, stop).astype(np.int32)
            columns = [
                pa.array(part[starts]),
                pa.ListArray.from_arrays(pa.array(cuts), pa.array(rows[:stop])),
                pa.ListArray.from_arrays(pa.array(cuts * np.int32(width)), pa.array(value[:stop].ravel())),
                _lists(low, pa.int32()), _lists(high, pa.int32()), _lists(total, pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in BLOCKS.split(", ")])

        for batch in batches:
            if batch.num_rows:
                held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy(), _matrix(batch.column(2), width)))
                if sum(len(h[0]) for h in held) >= block_rows:
                    yield from blocks(at_end=False)
        if held:
            yield from blocks(at_end=True)
        release()

    return pack


def blocks_of(vectors: DataFrame, width: int, parts: int = PARTS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Blocks of the parts of ``vectors`` (row, value), each part position sorted along its curve; stored."""
    cut = vectors.select("row", "value").mapInArrow(_cut_parts(parts, *_spread(vectors, width)), PART_ROWS)
    order = cut.repartitionByRange("part", "curve").sortWithinPartitions("part", "curve")
    return stored(order.select("part", "row", "value").mapInArrow(_pack(width // parts, block_rows), BLOCKS), "blocks")


def shortlists(low: np.ndarray, high: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Which entries may serve a part of each box: ``boxes`` x ``entries``."""
    low, high = low[:, None, :].astype(np.int64), high[:, None, :].astype(np.int64)
    gap = np.maximum(np.maximum(low - book, book - high), 0)
    far = np.maximum(np.abs(book - low), np.abs(high - book))
    nearest, farthest = (gap * gap).sum(axis=2), (far * far).sum(axis=2)
    return nearest <= farthest.min(axis=1, keepdims=True)


def nearest_entries(value: np.ndarray, book: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest of some entries (ascending) to each part, ties to the lower one, and the squared distance."""
    best, distance = np.full(len(value), -1), np.full(len(value), np.iinfo(np.int64).max)
    for entry in entries:
        d = value - book[entry]
        d = np.einsum("ij,ij->i", d, d)
        nearer = d < distance
        best[nearer], distance[nearer] = entry, d[nearer]
    return best, distance


def _boxes(batch: pa.RecordBatch, books: Codebooks) -> Iterator[tuple[int, int, np.ndarray]]:
    """Index, part and shortlist of each block of a batch."""
    parts = batch.column("part").to_numpy()
    width = books[0].shape[1]
    low, high = (_matrix(batch.column(c), width) for c in ("low", "high"))
    for part in np.unique(parts):
        of = np.flatnonzero(parts == part)
        for start in range(0, len(of), 256):
            some = of[start : start + 256]
            for i, listed in zip(some, shortlists(low[some], high[some], books[part]), strict=True):
                yield int(i), int(part), np.flatnonzero(listed)


def _values(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray]:
    """All parts of a batch of blocks, and where each block starts."""
    rows = batch.column("value").offsets.to_numpy() // width
    return batch.column("value").flatten().to_numpy().reshape(-1, width), rows - rows[0]


def _round(books: Codebooks):  # noqa: ANN202
    entries, width = books[0].shape

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(books), entries, width + 1), np.int64)  # the last column counts
        for batch in batches:
            total = _matrix(batch.column("total"), width)
            values, starts = _values(batch, width)
            for i, part, listed in _boxes(batch, books):
                size = starts[i + 1] - starts[i]
                if len(listed) == 1:
                    sums[part, listed[0], :width] += total[i]
                    sums[part, listed[0], width] += size
                    continue
                value = values[starts[i] : starts[i + 1]].astype(np.int64)
                best, _ = nearest_entries(value, books[part], listed)
                for entry in listed:
                    mine = best == entry
                    sums[part, entry, :width] += value[mine].sum(axis=0)
                    sums[part, entry, width] += mine.sum()
        part, entry = np.nonzero(sums[:, :, width])
        found = sums[part, entry]
        columns = [np.repeat(part, width + 1), np.repeat(entry, width + 1), np.tile(np.arange(width + 1), len(part))]
        yield pa.RecordBatch.from_arrays([*(pa.array(c.astype(np.int32)) for c in columns), pa.array(found.ravel())], names=["part", "entry", "component", "total"])
        release()

    return add


def trained(blocks: DataFrame, books: Codebooks, rounds: int = ROUNDS) -> Codebooks:
    """Codebooks after some rounds, each one job over the blocks; an entry that no part takes stays."""
    width = books[0].shape[1]
    for _ in range(rounds):
        found = blocks.select("part", "value", "low", "high", "total").mapInArrow(_round(books), SUMS)
        sums = np.zeros((len(books), *books[0].shape[:1], width + 1), object)
        for part, entry, component, total in found.groupBy("part", "entry", "component").agg(F.sum("total")).collect():
            sums[part, entry, component] = total
        new = []
        for book, said in zip(books, sums, strict=True):
            used = said[:, width] > 0
            book = book.copy()
            book[used] = said[used, :width] // said[used, width:]
            new.append(book)
        books = new
    return books


def _encode(books: Codebooks):  # noqa: ANN202
    width = books[0].shape[1]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            values, starts = _values(batch, width)
            code, error = np.empty(len(values), np.int64), np.empty(len(values), np.int64)
            for i, part, listed in _boxes(batch, books):
                of = slice(starts[i], starts[i + 1])
                best, error[of] = nearest_entries(values[of].astype(np.int64), books[part], listed)
                code[of] = best << (8 * (len(books) - 1 - part))
            yield pa.RecordBatch.from_arrays([batch.column("rows").flatten(), pa.array(code), pa.array(error)], names=["row", "code", "error"])
        release()

    return encode


def compress(
    vectors: DataFrame,
    keep: list[str],
    vector: str = "embedding",
    key: str = "vec_id",
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
    scale: int = SCALE,
    block_rows: int = BLOCK_ROWS,
) -> tuple[DataFrame, Codebooks]:
    """``keep`` columns of the rows with a code, with ``code`` (a byte for each part, the first part highest) and ``error``; and the codebooks.

    Parts are at most 8 and entries at most 256, so that a code is one long.
    """
    if not (1 <= parts <= 8 and 1 <= entries <= 256):
        raise ValueError("a code has 1 to 8 parts of 1 to 256 entries")
    named = [F.col(c).alias(f"__k{i}") for i, c in enumerate(keep)]
    rows = vectors.select(F.col(key).alias("__key"), *named, scaled(F.col(vector), scale).alias("value")).where("value is not null")
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()), "vectors")
    first = rows.orderBy(F.col("__key").asc_nulls_last(), "value").select("value").head(1)
    out = [F.col(f"__k{i}").alias(c) for i, c in enumerate(keep)]
    if not first:
        none = [F.lit(0).cast("bigint").alias(c) for c in ("code", "error")]
        return rows.select(*out, *none), []
    width = len(first[0].value)
    if width % parts:
        raise ValueError(f"vectors of {width} components have no {parts} equal parts")
    rows = rows.where(F.size("value") == width)
    start = rows.orderBy(F.col("__key").asc_nulls_last(), "value").select("value").head(entries)
    books = list(np.array([r.value for r in start], np.int64).reshape(len(start), parts, width // parts).transpose(1, 0, 2))
    blocks = blocks_of(rows, width, parts, block_rows)
    books = trained(blocks, books, rounds)
    coded = blocks.select("part", "rows", "value", "low", "high").mapInArrow(_encode(books), CODES)
    coded = stored(coded.groupBy("row").agg(F.sum("code").alias("__code"), F.sum("error").alias("__error")), "codes")
    met = rows.select("row", *[f"__k{i}" for i in range(len(keep))]).join(coded, "row")
    return met.select(*out, F.col("__code").alias("code"), F.col("__error").alias("error")), books


def code_text(code: Column, parts: int = PARTS) -> Column:
    """Two hexadecimal digits for each part."""
    return F.lower(F.lpad(F.hex(code), 2 * parts, "0"))


def books_digest(books: Codebooks) -> str:
    """SHA-256 of all components by part, entry and place, as decimal numbers joined by commas."""
    return hashlib.sha256(",".join(str(x) for book in books for x in book.ravel().tolist()).encode()).hexdigest()


def with_group_error(coded: DataFrame, group: str, out: str) -> DataFrame:
    """The errors added up over the rows of a group; nulls are one group."""
    sums = coded.groupBy(group).agg(F.sum("error").alias(out))
    return lookup_join(coded, sums, group, row_bytes=64)


def oracle(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> str:
    """The codes of the query in DuckDB."""

    def assigned(n: int) -> str:
        distance = "list_sum(list_transform(list_zip(x.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
        return f"""a{n} AS MATERIALIZED (
  SELECT x.row, x.p, min(struct_pack(d := {distance}, e := c.e)) AS best FROM cut x JOIN c{n} c ON c.p = x.p GROUP BY x.row, x.p)"""

    def moved(n: int) -> str:
        return f"""s{n} AS (
  SELECT p, e, i, sum(x)::BIGINT AS s, count(*)::BIGINT AS k FROM (
    SELECT x.p, a.best.e AS e, unnest(x.v) AS x, unnest(range(len(x.v))) AS i FROM cut x JOIN a{n} a ON a.row = x.row AND a.p = x.p)
  GROUP BY p, e, i),
m{n} AS (SELECT p, e, list((s - ((s % k) + k) % k) // k ORDER BY i) AS v FROM s{n} GROUP BY p, e),
c{n + 1} AS MATERIALIZED (SELECT c.p, c.e, coalesce(m.v, c.v) AS v FROM c{n} c LEFT JOIN m{n} m ON m.p = c.p AND m.e = c.e)"""

    steps = ",\n".join(f"{assigned(n)},\n{moved(n)}" for n in range(rounds))
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) AS row, vec_id, label, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
cut AS MATERIALIZED (
  SELECT row, p, v[p * (len(v) // {parts}) + 1:(p + 1) * (len(v) // {parts})] AS v FROM kept CROSS JOIN range({parts}) AS places(p)),
c0 AS MATERIALIZED (SELECT p, row - 1 AS e, v FROM cut WHERE row <= {entries}),
{steps},
{assigned(rounds)},
coded AS (
  SELECT row, string_agg(printf('%02x', best.e), '' ORDER BY p) AS code, sum(best.d)::BIGINT AS error FROM a{rounds} GROUP BY row),
digest AS (
  SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY p, e, i)) AS h
  FROM (SELECT p, e, unnest(v) AS x, unnest(range(len(v))) AS i FROM c{rounds}))
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, (SELECT h FROM digest) AS codebooks_sha256
FROM kept JOIN coded USING (row)"""
