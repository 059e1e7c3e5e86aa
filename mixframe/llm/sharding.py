"""Sharding along a Hilbert curve over metadata, with a manifest that prunes files in several dimensions.

Each dimension is cut into cells of about equal numbers of rows; the cells of a row make it a point of a cube, and rows are
sorted by the index of that point on a Hilbert curve. The order is cut into runs: shard s of S holds the ranks with floor(rank S / rows)
= s, so the shards' counts differ by one at most. Points that are near on the curve are near in every dimension, so a
file holds a narrow range of each; the manifest lists these ranges, and a reader opens only the files whose ranges meet its box.

Whole rows move once, in the range sort that writes them; what moves before is counted values, one row for each combination of
the dimensions' values and task. A value that a third of all rows have spans several cells and is split over files by the order
of texts and ids. Everything is DataFrame functions.

Defined results: null values of a dimension are its least cell; a null text has no bytes and comes first in its cell; then
come equal texts together, by id. Rows that are equal in dimensions, text and id may change places. An empty table writes
a table without rows. Columns may have any names but ``__layout``, in which the place of a row is stored; that name is refused.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mixframe.llm import hilbert
from mixframe.llm.common import PLACE_BITS, ROW_GROUP_BYTES, ordered, small, stored
from mixframe.operators.lookup import lookup_join

SHARDS = 8
BITS = 4
LAYOUT = "__layout"
#: Bytes of a row of the tables that are joined back: values and cells, and the first rank of a part.
VALUE_BYTES, PART_BYTES = 160, 32


def size_of(text: Column) -> Column:
    """UTF-8 bytes of a text, plus 1."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("bigint")


def size_class(size: Column) -> Column:
    """Sizes by their five leading binary digits: 16 classes for each power of two."""
    digits = F.length(F.bin(size))
    return digits * 32 + F.call_function("shiftright", size, F.greatest(digits - 5, F.lit(0))).cast("int")


def document_dimensions() -> dict[str, Column]:
    """Language, source and size class of a document."""
    return {"lang": F.col("lang"), "source": F.col("source"), "size": size_class(size_of(F.col("text")))}


def _running(counted: DataFrame, group: str) -> DataFrame:
    """``group`` (one row each, few) with the rows before it."""
    earlier = Window.orderBy(group).rowsBetween(Window.unboundedPreceding, -1)
    return counted.withColumn("before", F.coalesce(F.sum("rows").over(earlier), F.lit(0)))


def cells_of(counted: DataFrame, name: str, rows: int, bits: int) -> DataFrame:
    """Values of one dimension of a counted table (``rows`` for each combination) with their cell.

    A value's cell is the share of rows before it. The values are range-sorted; a task adds up its own, and the parts' sums
    give the rest, so a dimension may have any number of values.
    """
    values = counted.groupBy(F.col(name).alias("value")).agg(F.sum("rows").alias("rows"))
    placed = ordered(values, [F.col("value").asc_nulls_first()])
    parts = _running(placed.groupBy("__part").agg(F.sum("rows").alias("rows")), "__part").select("__part", F.col("before").alias("__before"))
    inside = Window.partitionBy("__part").orderBy("__place").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("rows").over(inside), F.lit(0)) + F.col("__before")
    cell = F.floor(before * F.lit(1 << bits) / F.lit(max(1, rows))).cast("int")
    return placed.join(small(parts, PART_BYTES), "__part").select("value", cell.alias(f"cell_{name}"))


def curve_of(rows: DataFrame, dimensions: dict[str, Column], bits: int = BITS) -> DataFrame:
    """Combinations of the dimensions' values in ``rows`` as ``values`` (a struct), with the ``curve`` index of their cells."""
    counted = stored(rows.groupBy(*[c.alias(n) for n, c in dimensions.items()]).agg(F.count(F.lit(1)).alias("rows")), "values")
    total = counted.agg(F.sum("rows")).first()[0] or 0
    names = list(dimensions)
    table = counted.select(F.struct(*names).alias("values"), *names)
    for name in names:
        table = lookup_join(table, cells_of(counted, name, total, bits).withColumnRenamed("value", name), name, VALUE_BYTES)
    # the index is worked out once for each point of the cube, not once for each combination
    cells = [f"cell_{name}" for name in names]
    points = table.select(*cells).distinct().withColumn("curve", hilbert.index_column([F.col(c) for c in cells], bits))
    return stored(table.join(small(points, VALUE_BYTES), cells).select("values", "curve"), "curve")


def _packed(names: list[str]) -> Column:
    """A row's columns as one, whatever they are called."""
    return F.struct(*[F.col("`" + name.replace("`", "``") + "`").alias(name) for name in names]).alias("row")


def write_shards(
    docs: DataFrame, folder: str, dimensions: dict[str, Column], text: str = "text", key: str = "doc_id", shards: int = SHARDS, bits: int = BITS
) -> None:
    """Sort ``docs`` along the curve of ``dimensions`` (at most five) and write them to ``folder`` with their manifest.

    ``folder/rows`` has the rows, one file for each range of the curve; ``folder/runs`` has a row for each file and shard that meet:
    ``part``, ``path``, ``shard``, ``slot`` (its first in the shard), ``rows`` they share, the file's first rank ``before``, ``low`` and
    ``high`` of each dimension in the file, and ``shards`` and ``total`` of the whole.
    """
    if LAYOUT in docs.columns:
        raise ValueError(f"the name {LAYOUT} is reserved")
    curve = curve_of(docs, dimensions, bits)
    # the row is packed, so that its columns may have any names
    packed = docs.select(_packed(docs.columns), F.struct(*[c.alias(n) for n, c in dimensions.items()]).alias("values"))
    located = lookup_join(packed, curve, "values", VALUE_BYTES)
    said = F.substring(F.md5(F.col("row")[text]), 1, 16)
    order = [F.col("curve"), said.asc_nulls_first(), F.col("row")[key].asc_nulls_first()]
    placed = located.repartitionByRange(*order).sortWithinPartitions(*order)
    layout = F.struct(F.monotonically_increasing_id().alias("place"), "curve", "values")
    placed.select("row.*", layout.alias(LAYOUT)).write.option("parquet.block.size", ROW_GROUP_BYTES).parquet(f"{folder}/rows")
    _write_runs(docs.sparkSession, folder, list(dimensions), shards)


def _div(a: Column, b: Column) -> Column:
    """Quotient of longs, rounded down."""
    return F.call_function("div", a, b)


def _write_runs(spark: SparkSession, folder: str, names: list[str], shards: int) -> None:
    rows = spark.read.parquet(f"{folder}/rows")
    part = F.shiftright(F.col(LAYOUT)["place"], PLACE_BITS).alias("part")
    values = rows.select(part, F.col("_metadata.file_path").alias("path"), *[F.col(LAYOUT)["values"][n].alias(f"v{i}") for i, n in enumerate(names)])
    ends = [f(f"v{i}").alias(f"{end}{i}") for i in range(len(names)) for f, end in ((F.min, "low"), (F.max, "high"))]
    files = stored(_running(values.groupBy("part").agg(F.min("path").alias("path"), F.count(F.lit(1)).alias("rows"), *ends), "part"), "files")
    total = F.lit(files.agg(F.sum("rows")).first()[0] or 1).cast("bigint")
    count = F.lit(shards).cast("bigint")
    shard_at = lambda rank: _div(rank * count, total)
    start = lambda shard: _div(shard * total + count - 1, count)
    shard = F.explode(F.sequence(shard_at(F.col("before")), shard_at(F.col("before") + F.col("rows") - 1))).alias("shard")
    met = files.select("*", shard)
    first = F.greatest("before", start(F.col("shard")))
    boxes = [F.struct(*[F.col(f"{end}{i}").alias(n) for i, n in enumerate(names)]).alias(end) for end in ("low", "high")]
    shared = F.least(F.col("before") + F.col("rows"), start(F.col("shard") + 1)) - first
    runs = met.select("part", "path", F.col("shard").cast("int").alias("shard"), (first - start(F.col("shard"))).alias("slot"),
                      shared.alias("rows"), "before", *boxes, count.cast("int").alias("shards"), total.alias("total"))
    runs.where("rows > 0").write.parquet(f"{folder}/runs")


def read_shards(spark: SparkSession, folder: str, shard: int | None = None) -> DataFrame:
    """The rows that were written, with ``__layout``: shard, slot (from 0 in each shard), curve and the dimensions' values.

    ``shard`` reads the files of one shard alone.
    """
    runs = spark.read.parquet(f"{folder}/runs")
    rows = spark.read.parquet(f"{folder}/rows") if shard is None else _files(spark, folder, runs.where(F.col("shard") == shard))
    parts = small(runs.select("part", "before", "shards", "total").distinct(), PART_BYTES)
    place = F.col(LAYOUT)["place"]
    packed = rows.select(_packed([c for c in rows.columns if c != LAYOUT]), LAYOUT, F.shiftright(place, PLACE_BITS).alias("part"))
    met = packed.join(parts, "part")
    rank = F.col("before") + place.bitwiseAND(F.lit((1 << PLACE_BITS) - 1))
    count = F.col("shards").cast("bigint")
    number = _div(rank * count, F.col("total"))
    met = met.withColumn("rank", rank).withColumn("shard", number)
    slot = F.col("rank") - _div(F.col("shard") * F.col("total") + count - 1, count)
    layout = F.struct(F.col("shard").cast("int").alias("shard"), slot.alias("slot"), F.col(LAYOUT)["curve"].alias("curve"), F.col(LAYOUT)["values"].alias("values"))
    out = met if shard is None else met.where(F.col("shard") == shard)
    return out.select("row.*", layout.alias(LAYOUT))


def _files(spark: SparkSession, folder: str, runs: DataFrame) -> DataFrame:
    """Rows of the files of some runs; the driver sees the files' names."""
    paths = sorted(r.path for r in runs.select("path").distinct().collect())
    whole = spark.read.parquet(f"{folder}/rows")
    return spark.read.schema(whole.schema).parquet(*paths) if paths else whole.where(F.lit(False))


def read_box(spark: SparkSession, folder: str, box: dict[str, tuple]) -> DataFrame:
    """The rows whose dimensions lie in ``box`` (name to least and greatest value); files whose ranges miss it are not read."""
    runs = spark.read.parquet(f"{folder}/runs")
    met, inside = F.lit(True), F.lit(True)
    for name, (low, high) in box.items():
        value = F.col(LAYOUT)["values"][name]
        met = met & (F.col("low")[name] <= high) & (F.col("high")[name] >= low)
        inside = inside & value.between(low, high)
    return _files(spark, folder, runs.where(met)).where(inside).drop(LAYOUT)


def oracle(bits: int = BITS, shards: int = SHARDS) -> str:
    """The shards of the query in DuckDB; the curve's turns and the remainders of crc32 are tables made by their rules."""
    positions, inside = hilbert.turns(3)
    size = "(coalesce(strlen(text), 0) + 1)"
    corner = " + ".join(f"((({name} >> ({bits} - level)) & 1) << {i})" for i, name in enumerate(("cl", "cs", "cz")))
    cell = lambda value: f"SELECT {value}, floor((sum(count(*)) OVER (ORDER BY {value} NULLS FIRST) - count(*)) * {1 << bits} / (SELECT count(*) FROM sized))::INT AS cell FROM sized GROUP BY {value}"
    return f"""
WITH RECURSIVE sized AS (
  SELECT *, {size}::BIGINT AS size, length(bin({size})) * 32 + ({size} >> greatest(length(bin({size})) - 5, 0)) AS class FROM documents),
langs AS ({cell("lang")}), sources AS ({cell("source")}), classes AS ({cell("class")}),
points AS (
  SELECT DISTINCT l.cell AS cl, s.cell AS cs, z.cell AS cz FROM sized d JOIN langs l ON l.lang IS NOT DISTINCT FROM d.lang
  JOIN sources s ON s.source IS NOT DISTINCT FROM d.source JOIN classes z ON z.class = d.class),
walk AS (
  SELECT cl, cs, cz, 0 AS level, 0::BIGINT AS curve, 0 AS turn FROM points
  UNION ALL
  SELECT cl, cs, cz, level + 1, (curve << 3) + list_extract({positions}, spot), list_extract({inside}, spot)
  FROM (SELECT *, turn * 8 + {corner.replace("level", "(level + 1)")} + 1 AS spot FROM walk WHERE level < {bits})),
ranked AS (
  SELECT d.doc_id, d.size, d.text, (row_number() OVER (
    ORDER BY w.curve, substr(md5(d.text), 1, 16) NULLS FIRST, d.doc_id NULLS FIRST) - 1)::BIGINT AS rank, (count(*) OVER ())::BIGINT AS total
  FROM sized d JOIN langs l ON l.lang IS NOT DISTINCT FROM d.lang JOIN sources s ON s.source IS NOT DISTINCT FROM d.source
  JOIN classes z ON z.class = d.class JOIN walk w ON w.level = {bits} AND w.cl = l.cell AND w.cs = s.cell AND w.cz = z.cell),
remainders AS (
  SELECT list_transform(range(256), lambda x: list_reduce([x, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
summed AS (
  SELECT doc_id, size, rank, total, xor(list_reduce(list_prepend(4294967295, list_transform(
    regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS crc FROM ranked, remainders)
SELECT doc_id, size, crc AS text_crc32, 'rows' AS law, (rank * {shards} // total)::INT AS shard,
  rank - (rank * {shards} // total * total + {shards - 1}) // {shards} AS slot, NULL::INT AS grown_shard FROM summed"""
