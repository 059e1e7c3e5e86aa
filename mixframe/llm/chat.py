"""Chat formatting: collapse cumulative snapshots of conversations, render what remains. DataFrame functions only.

A service that logs the whole conversation after every turn leaves snapshots that are prefixes of longer ones. Rolling
hashes of turn prefixes identify them; an anti-join leaves the maximal conversations, which are then rendered.

Defined results: rows that repeat another in conversation, turn, role and text count once. Rows of a conversation that
share a turn number come in the order of role (null first) and of the MD5 of the text; a null turn comes last. Rows
without a conversation id form one conversation with a null id. A null role or text differs from an empty one but renders
as empty. Conversations of the same turns are one, under the smallest id, with their number as ``copies``. An empty table
gives no row. Other columns are ignored. The markers cannot be forged: their opening in a text gets a space.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mixframe.llm.common import chunks, ordered

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
TURNS_PER_PART = 512


def _keyed(turns: DataFrame) -> DataFrame:
    """Conversation key, content key of the turn, and key of the row, none of them null."""
    tagged = lambda tag, c: F.coalesce(F.concat(F.lit(tag), F.col(c).cast("string")), F.lit(""))
    rows = turns.select("conv_id", "turn", "role", "text", F.coalesce(F.md5(F.col("text")), F.lit("")).alias("text_md5"))
    rows = rows.withColumns({
        "conv": F.coalesce(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.lit("n")),
        "content": F.concat_ws("\u0001", tagged("r", "role"), F.col("text_md5")),
    })
    return rows.withColumn("row", F.concat_ws("\u0001", "conv", tagged("t", "turn"), "content"))


def prefixes(turns: DataFrame) -> DataFrame:
    """One row for each distinct turn: its ``position`` from 0, the conversation's ``n_turns``, and ``h1``, ``h2``, the
    rolling hash of all turns up to it.

    The rolling hash is the exclusive or of hashes of (position, content), so it is put together from pieces: a
    conversation that holds a third of all rows is spread over as many tasks as its rows need.
    """
    slim = _keyed(turns).select("conv", "conv_id", "turn", "role", "text_md5", "content", "row").distinct()
    order = [F.col("conv"), F.col("turn").asc_nulls_last(), F.col("role").asc_nulls_first(), F.col("text_md5")]
    placed = ordered(slim, order).drop("text_md5", "role", "turn")
    pieces = chunks(placed, "conv").withColumn("n_turns", F.sum("__rows").over(Window.partitionBy("conv")))
    located = placed.join(pieces, ["__part", "conv"]).withColumn("position", F.col("__place") - F.col("__first") + F.col("__before"))
    piece = Window.partitionBy("__part", "conv").orderBy("__place").rowsBetween(Window.unboundedPreceding, 0)
    hashed = {f"h{i}": F.bit_xor(F.xxhash64(F.lit(i), "position", "content")).over(piece) for i in (1, 2)}
    rolled = located.withColumns(hashed)
    # a conversation that goes on from an earlier part takes over the hash of what went before
    last = rolled.where(F.col("__place") == F.col("__first") + F.col("__rows") - 1).where(F.col("n_turns") > F.col("__rows"))
    earlier = Window.partitionBy("conv").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select("__part", "conv", *[F.bit_xor(f"h{i}").over(earlier).alias(f"c{i}") for i in (1, 2)])
    whole = rolled.join(carried, ["__part", "conv"], "left")
    both = lambda i: F.col(f"h{i}").bitwiseXOR(F.coalesce(f"c{i}", F.lit(0))).alias(f"h{i}")
    return whole.select("conv", "conv_id", "row", "position", "n_turns", both(1), both(2))


def maximal(prefix: DataFrame) -> DataFrame:
    """The conversations that no other one continues, copies collapsed: conv, conv_id, n_turns, copies."""
    length = (F.col("position") + 1).alias("length")
    whole = prefix.where(F.col("position") + 1 == F.col("n_turns")).select("conv", "conv_id", length, "h1", "h2")
    first = F.min(F.struct(F.col("conv_id").isNull(), F.col("conv_id"), F.col("conv"))).alias("first")
    kinds = whole.groupBy("length", "h1", "h2").agg(first, F.count(F.lit(1)).alias("copies"))
    begun = prefix.where(F.col("position") + 1 < F.col("n_turns")).select(length, "h1", "h2").distinct()
    kept = kinds.join(begun, ["length", "h1", "h2"], "left_anti")
    return kept.select(F.col("first.conv").alias("conv"), F.col("first.conv_id"), F.col("length").alias("n_turns"), "copies")


def _turn_text(role: Column, text: Column, open_: str, close: str) -> Column:
    safe = lambda c: F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit(open_), F.lit(f"{open_[:1]} {open_[1:]}")), F.lit(close), F.lit(f"{close[:1]} {close[1:]}"))  # noqa: E731, E501
    return F.concat(F.lit(open_), safe(role), F.lit("\n"), safe(text), F.lit(f"{close}\n"))


def format_chats(
    turns: DataFrame, turns_per_part: int = TURNS_PER_PART, open_: str = OPEN, close: str = CLOSE
) -> DataFrame:
    """Maximal conversations as text: conv_id, part, n_turns, copies, rendered.

    ``turns`` has conv_id, turn, role and text. A conversation of up to ``turns_per_part`` turns is one row; a longer
    one goes on in parts 1, 2, ..., whose texts concatenate, so that no row grows without bound.
    """
    prefix = prefixes(turns)
    kept = maximal(prefix).drop("conv_id")
    part = F.floor(F.col("position") / turns_per_part)
    # by part, so that the turns of one long conversation do not meet in one task
    parts = kept.withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n_turns") - 1) / turns_per_part))))
    wanted = prefix.drop("n_turns", "h1", "h2").withColumn("part", part).join(parts, ["conv", "part"])
    full = _keyed(turns).select("row", "role", "text").join(wanted, "row")
    grouped = full.groupBy("conv", "part").agg(
        F.first("conv_id").alias("conv_id"),
        F.first("n_turns").alias("n_turns"),
        F.first("copies").alias("copies"),
        F.array_sort(F.collect_set(F.struct("position", "role", "text"))).alias("said"),
    )
    lines = F.transform("said", lambda t: _turn_text(t["role"], t["text"], open_, close))
    return grouped.select("conv_id", "part", "n_turns", "copies", F.array_join(lines, "").alias("rendered"))


def oracle(turns_per_part: int = TURNS_PER_PART, open_: str = OPEN, close: str = CLOSE) -> str:
    """The same in DuckDB, with whole turn prefixes instead of hashes of them."""
    safe = lambda c: f"replace(replace(coalesce({c}, ''), '{open_}', '{open_[:1]} {open_[1:]}'), '{close}', '{close[:1]} {close[1:]}')"  # noqa: E731, E501
    return f"""
WITH rows AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
ranked AS (
  SELECT *, coalesce('r' || role, '') || chr(1) || coalesce(md5(text), '') || chr(2) AS content,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, role NULLS FIRST, coalesce(md5(text), '')) - 1 AS k,
    count(*) OVER (PARTITION BY conv_id) AS n FROM rows),
grown AS (SELECT conv_id, k, n, string_agg(content, '') OVER (PARTITION BY conv_id ORDER BY k) AS said FROM ranked),
kinds AS (SELECT min(conv_id) AS conv_id, said, count(*) AS copies FROM grown WHERE k = n - 1 GROUP BY said),
kept AS (SELECT * FROM kinds WHERE said NOT IN (SELECT said FROM grown WHERE k < n - 1))
SELECT r.conv_id, r.k // {turns_per_part} AS part, r.n AS n_turns, kept.copies,
  string_agg('{open_}' || {safe('r.role')} || chr(10) || {safe('r.text')} || '{close}' || chr(10), '' ORDER BY r.k) AS rendered
FROM ranked r JOIN kept ON r.conv_id IS NOT DISTINCT FROM kept.conv_id GROUP BY ALL"""
