"""Mixing sources to target weights by systematic sampling.

Sources, by code point and null last, weigh 1, 2, 3, 1, ... (or as the caller says) and share the mix; a source's target
stops at ``max_copies`` times its size, and the excess is shared by weight again until none is above. Every document of a
source expects target / size copies. Their prefix sums, shifted by one random offset for each source, cross an integer
once for each copy that is emitted. Documents come in the order of size, so that small and large ones are taken alike
and the words taken come close to the target. Numbers are fixed point with 32 binary digits, so reruns agree.

Defined results: a null text has size 0; a document of size 0 is sampled like any other and adds nothing. A source of
size 0 has target 0 and no copies. Rows that agree in source, size, id and text are told apart by their place only, so it
does not matter which of them is copied. An empty table gives no row. Columns may have any names but the helper's, which
begin with two underscores; a result whose name a kept column has gets an underscore after it.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mixframe.llm.common import answer, chunks, free_name, kept, ordered, quoted, small, stored

WEIGHTS = (1, 2, 3)
MAX_COPIES = 3
SEED = 7
ONE = 1 << 32
#: Parts of a source that one row of the offset table describes, in bytes.
OFFSET_BYTES = 80


def words_of(text: Column) -> Column:
    """Words of a text as a long; null: 0. White space is 0x20 and 0x09 to 0x0D."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t\n\x0B\f\r]+")), F.lit(0)).cast("bigint")


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_copies: int = MAX_COPIES) -> DataFrame:
    """One row for each source of ``sized`` (``__source``, ``__size``): its size, weight and target.

    The level is what a unit of weight gets. Raising it until no further source is capped takes as many rounds as there
    are layers of caps, each an aggregate over the table of sources.
    """
    totals = sized.groupBy("__source").agg(F.sum("__size").alias("source_size"))
    ranked = ordered(totals, [F.col("__source").asc_nulls_last()]).withColumn("__all", F.lit(0))
    ranked = ranked.join(chunks(ranked, "__all").select("__part", "__first", "__before"), "__part")
    rank = F.col("__place") - F.col("__first") + F.col("__before")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(rank, F.lit(len(weights))) + 1).cast("int"))
    table = stored(ranked.select("__source", "source_size", weight.cast("bigint").alias("weight")), "sources")
    cap, level, capped = F.col("source_size") * max_copies, 0.0, -1
    while True:
        over = F.col("weight") * F.lit(level) >= cap
        row = table.agg(
            F.sum("source_size"), F.sum(F.when(over, cap)), F.sum(F.when(~over, F.col("weight"))), F.sum(over.cast("int"))
        ).first()
        if row is None or not row[2] or row[3] == capped:
            break
        capped, level = row[3], ((row[0] or 0) - (row[1] or 0)) / row[2]
    return table.withColumn("target", F.least(F.col("weight") * F.lit(level), cap.cast("double")))


def offset_of(seed: int, source: Column) -> Column:
    """The random offset of a source, in units of 2**-32."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.concat(F.lit("s"), source), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def copies_at(position: Column, share: Column, offset: Column) -> Column:
    """Integers that the prefix sum crosses at a position (from 0) when every document adds ``share`` in units of 2**-32.

    Whole copies are apart, and the prefix sum is kept modulo 2**32 with the position in two halves, so that no product
    passes 49 bits however many documents a source has.
    """
    low = lambda x, bits: x.bitwiseAND(F.lit((1 << bits) - 1).cast("bigint"))
    part = low(share, 32)
    upper = F.shiftleft(low(low(F.shiftright(position, 16), 16) * part, 16), 16)
    before = low(upper + low(position, 16) * part + offset, 32)
    return F.shiftright(share, 32) + F.shiftright(before + part, 32)


def mix(
    docs: DataFrame,
    keep: list[str],
    weights: tuple[int, ...] = WEIGHTS,
    max_copies: int = MAX_COPIES,
    seed: int = SEED,
) -> DataFrame:
    """``keep`` columns of ``docs`` with ``size``, ``source_size``, ``target``, ``copies`` and ``taken`` (words).

    ``docs`` has doc_id, text and source. Every row comes back once; ``repeated`` makes the copies. Rows are shuffled
    once, by a range sort that cuts a source of any size into parts. All documents of a source expect the same number
    of copies, so a prefix sum is that number times the position in the source, which the parts' counts give.
    """
    sized = docs.select(
        F.col("source").alias("__source"),
        words_of(F.col("text")).alias("__size"),
        F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).alias("__tie"),
        F.xxhash64("doc_id", "text").alias("__text"),
        *kept(keep),
    )
    table = targets(sized.select("__source", "__size"), weights, max_copies)
    order = [F.col("__source").asc_nulls_last(), F.col("__size"), F.col("__tie"), F.col("__text")]
    # a null source is a source: keys are never null
    key = F.coalesce(F.concat(F.lit("s"), F.col("__source")), F.lit("")).alias("__key")
    placed = ordered(sized, order).select("*", key)
    share = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") * F.lit(float(ONE))))
    plan = table.select(key, "source_size", "target", F.coalesce(share, F.lit(0)).cast("bigint").alias("__share"),
                        offset_of(seed, F.col("__source")).alias("__offset"))
    offsets = stored(chunks(placed, "__key").join(plan, "__key"), "offsets")
    located = placed.join(small(offsets, OFFSET_BYTES), ["__part", "__key"])
    copies = copies_at(F.col("__place") - F.col("__first") + F.col("__before"), F.col("__share"), F.col("__offset"))
    size = F.col("__size")
    found = {"size": size, "source_size": F.col("source_size"), "target": F.col("target"), "copies": copies, "taken": copies * size}
    return answer(located, keep, found)


def repeated(mixed: DataFrame, keep: list[str]) -> DataFrame:
    """The ``keep`` columns that ``mix`` was given, every row as often as its copies."""
    copies = F.col(free_name("copies", keep))
    times = F.explode(F.sequence(F.lit(1).cast("bigint"), copies)).alias("__copy")
    return mixed.where(copies > 0).select(*[quoted(c) for c in keep], times).drop("__copy")


def oracle(seed: int = SEED) -> str:
    """The mix of the query in DuckDB."""
    tie = f"md5('{seed}:' || coalesce(doc_id::VARCHAR, ''))"
    start = hashlib.md5(f"{seed}:".encode()).hexdigest()[:8]
    return f"""
WITH sized AS (
  SELECT doc_id, source, {tie} AS tie,
    coalesce(len(regexp_extract_all(text, '[^ \\t\\n\\x0B\\f\\r]+')), 0)::BIGINT AS size FROM documents),
totals AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    [1, 2, 3][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3) + 1] AS weight FROM sized GROUP BY source),
layers AS (
  SELECT *, sum(3 * source_size) OVER o AS caps, sum(weight) OVER o AS weights, row_number() OVER o AS k
  FROM totals WINDOW o AS (ORDER BY 3 * source_size / weight, source NULLS LAST)),
levels AS (
  SELECT l.k, (s.t - coalesce(p.caps, 0)) / (s.w - coalesce(p.weights, 0)) AS level, 3 * l.source_size / l.weight AS top
  FROM layers l CROSS JOIN (SELECT sum(source_size)::DOUBLE AS t, sum(weight)::DOUBLE AS w FROM totals) s
  LEFT JOIN layers p ON p.k = l.k - 1),
level AS (SELECT level FROM levels WHERE level <= top ORDER BY k LIMIT 1),
plan AS (
  SELECT source, source_size, least(weight * (SELECT level FROM level), 3.0::DOUBLE * source_size) AS target FROM totals),
shares AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size * {float(ONE)})::BIGINT ELSE 0 END AS share,
    CASE WHEN source IS NULL THEN ('0x' || '{start}')::BIGINT
         ELSE ('0x' || substr(md5('{seed}:s' || source), 1, 8))::BIGINT END AS start FROM plan),
placed AS (
  SELECT doc_id, size, source_size, target, share,
    row_number() OVER (PARTITION BY s.source ORDER BY size, tie) * share + start AS upto
  FROM sized s JOIN shares p ON s.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target, (((upto >> 32) - ((upto - share) >> 32)) * size)::BIGINT AS taken FROM placed"""
