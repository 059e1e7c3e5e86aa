"""Benchmark decontamination: rare n-gram seeds, then local alignment.

Every benchmark item is cut into overlapping n-grams of words. One scan of the texts keeps the n-grams that may be some
item's, by a filter of bounded size, and a join on the n-gram's hash tells which items they are of. An n-gram's rarity is
the number of distinct texts that hold it; the rarest one of every stretch of an item is a seed by itself. The others
make a pair of text and item only where these share two or more n-grams, so that copies are found however many there are
and however often their words occur elsewhere. Each pair is aligned around the shared places (Smith-Waterman over words:
match 2, mismatch -1, gap -1), so that edited and paraphrased copies score by how much of the item they keep. The score is
a share of the item's best possible score. A window is aligned only if an upper bound of its score reaches the threshold.

Nothing of the benchmark is collected but the filter, of at most ``FILTER_BITS`` bits: a larger benchmark passes more
n-grams on to the join. Equal texts are joined and aligned once. Of the texts only those of pairs move, and documents are
not moved unless the list of texts with matches is too large to broadcast. Texts are told apart by two 64-bit hashes.

Words are runs of letters, digits and underscores in lower case. Defined results: a null or empty text on either side
matches nothing; an item of fewer words than a seed has none and matches nothing. A null item_id is kept. Equal items
each match; repeated documents each give their rows. An empty table or benchmark gives no row. Hits are in the order of
item_id, null first.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mixframe.llm.common import BROADCAST_BYTES, free_name, once, quoted, release, small, stored

SEED_WORDS = 3
THRESHOLD = 0.5
MATCH, MISMATCH, GAP = 2, -1, -1
#: Neighbouring n-grams of an item of which the rarest is a seed by itself.
STRETCH = 4
#: Most bits of the filter of n-grams, and bits for each n-gram below that.
FILTER_BITS = 1 << 26
BITS_EACH = 32
#: Words whose hashes a worker process remembers.
WORDS_HELD = 1 << 19
#: Cells of one row of the alignment matrices that are worked on together.
CELLS = 1 << 18
_WORD = re.compile(r"\w+")
_ODD = np.uint64(0x9E3779B97F4A7C15)


class _Hashes(dict):
    """Hashes of words, computed when first asked for."""

    def __missing__(self, word: str) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "replace"))
        return value


def grams_of(text: str | None, hashes: dict[str, int]) -> np.ndarray:
    """Hashes of all n-grams of a text, in order."""
    words = _WORD.findall((text or "").lower())
    n = len(words) - SEED_WORDS + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    said = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    code = np.zeros(n, np.uint64)
    for i in range(SEED_WORDS):
        code = (code ^ said[i : i + n]) * _ODD
        code ^= code >> np.uint64(29)
    return code


def _scan(bits: int, filled: np.ndarray | None):  # noqa: ANN202
    """Task function: (one, two, text) rows give (one, two, gram, place) for n-grams that pass the filter (all without one)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = once("decontaminate_words", _Hashes)
        mask = np.uint64(bits - 1)
        for batch in batches:
            row, gram, place = [], [], []
            for i, text in enumerate(batch.column(2).to_pylist()):
                codes = grams_of(text, hashes)
                at = np.arange(len(codes))
                for shift in (0, 32) if filled is not None else ():
                    bit = (codes[at] >> np.uint64(shift)) & mask
                    at = at[(filled[bit >> np.uint64(6)] >> (bit & np.uint64(63))) & np.uint64(1) > 0]
                row.append(np.full(len(at), i))
                gram.append(codes[at])
                place.append(at)
                if len(hashes) > WORDS_HELD:
                    hashes.clear()
            if row:
                rows = pa.array(np.concatenate(row))
                found = [batch.column(0).take(rows), batch.column(1).take(rows), np.concatenate(gram).view(np.int64), np.concatenate(place).astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], names=["one", "two", "gram", "place"])
        release()

    return scan


def _grams(rows: DataFrame, bits: int = 64, filled: np.ndarray | None = None) -> DataFrame:
    return rows.select("one", "two", "text").mapInArrow(_scan(bits, filled), "one bigint, two bigint, gram bigint, place int")


def filter_of(grams: DataFrame, most_bits: int = FILTER_BITS) -> tuple[int, np.ndarray]:
    """Bits (a power of two) of a filter of the column ``gram``, and its words of 64 bits; ``most_bits`` bounds what is collected."""
    wanted = BITS_EACH * grams.count()
    bits = min(most_bits, max(64, 1 << (wanted - 1).bit_length() if wanted else 64))
    low = F.lit(bits - 1)
    both = grams.select(F.explode(F.array(F.col("gram").bitwiseAND(low), F.shiftrightunsigned("gram", 32).bitwiseAND(low))).alias("bit"))
    words = both.select(F.shiftright("bit", 6).alias("at"), F.expr("shiftleft(1L, cast(bit & 63 as int))").alias("mask"))
    filled = np.zeros(bits // 64, np.int64)
    for r in words.groupBy("at").agg(F.bit_or("mask").alias("mask")).collect():
        filled[r["at"]] = r["mask"]
    return bits, filled.view(np.uint64)


def with_rarity(seeds: DataFrame, frequency: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """``seeds`` (one, two, gram, place) that have a ``frequency`` (gram, n), with ``rare``: none of the stretch is rarer.

    A window is a stretch of one item.
    """
    held = seeds.join(small(frequency, 16), "gram")
    near = Window.partitionBy("one", "two", F.floor(F.col("place") / stretch))
    return held.select("one", "two", "gram", "place", (F.col("n") == F.min("n").over(near)).alias("rare"))


def most(item: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """A score that the alignment of ``item`` with each row of ``windows`` cannot exceed.

    Every word of an aligned span is a match, which needs a word of the item, or costs a mismatch or a gap; so the score is
    at most the best sum over a run of words, and at most that of the whole item.
    """
    gain = np.where(np.isin(windows, item), np.int32(MATCH), np.int32(max(MISMATCH, GAP)))
    total = np.concatenate([np.zeros((len(windows), 1), np.int32), np.cumsum(gain, axis=1, dtype=np.int32)], axis=1)
    return np.minimum((total - np.minimum.accumulate(total, axis=1)).max(axis=1), MATCH * len(item))


def align(item: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best local score of ``item`` in each row of ``windows`` and the column after its last word."""
    rows, width = windows.shape
    above = np.zeros((rows, width + 1), np.int32)
    ramp = np.arange(width, dtype=np.int32) * -GAP
    best, end = np.zeros(rows, np.int32), np.zeros(rows, np.int64)
    for word in item:
        here = np.maximum(above[:, :-1] + np.where(windows == word, np.int32(MATCH), np.int32(MISMATCH)), above[:, 1:] + GAP)
        np.maximum(here, 0, out=here)
        here = np.maximum.accumulate(here + ramp, axis=1) - ramp  # gaps in the item
        top = here.argmax(axis=1)
        score = here[np.arange(rows), top]
        better = score > best
        best, end = np.where(better, score, best), np.where(better, top + 1, end)
        above[:, 1:] = here
    return best, end


def best_alignments(item: np.ndarray, text: np.ndarray, starts: np.ndarray, least: float = 1) -> tuple[int, int, int]:
    """Best score over windows of ``text`` around the item's expected ``starts``, with the span of words that reach it.

    Zero if no window can reach ``least``.
    """
    slack = len(item) // 4 + 2
    width = len(item) + 4 * slack
    starts = np.unique(np.maximum(starts - 2 * slack, 0) // slack * slack)
    best = (0, 0, 0)
    step = max(1, CELLS // width)
    for at in range(0, len(starts), step):
        place = starts[at : at + step, None] + np.arange(width)
        windows = np.where(place < len(text), text[np.minimum(place, len(text) - 1)], -1)
        able = most(item, windows) >= least
        if not able.any():
            continue
        score, end = np.zeros(len(windows), np.int32), np.zeros(len(windows), np.int64)
        score[able], end[able] = align(item, windows[able])
        top = int(score.argmax())
        if score[top] > best[0]:
            reach = int(end[top])
            back, first = align(item[::-1], windows[top : top + 1, :reach][:, ::-1])
            assert back[0] == score[top]
            best = (int(score[top]), int(starts[at + top]) + reach - int(first[0]), int(starts[at + top]) + reach)
    return best


def _aligner(threshold: float):  # noqa: ANN202
    """Arrow function of texts, items and expected starts: the best alignment, null below ``threshold``."""
    entry = pa.struct([("score", pa.float64()), ("start", pa.int32()), ("end", pa.int32())])

    def aligned(texts: pa.Array, items: pa.Array, starts: pa.Array) -> pa.Array:
        out = []
        for text, item, at in zip(texts, items, starts, strict=True):
            asked = _WORD.findall(item.as_py().lower())
            number = {w: i for i, w in enumerate(dict.fromkeys(asked), 1)}
            words = np.array([number[w] for w in asked], np.int64)
            said = np.fromiter(map(number.get, _WORD.findall(text.as_py().lower()), repeat(0)), np.int64)
            score, start, end = best_alignments(words, said, at.values.to_numpy().astype(np.int64), threshold * MATCH * len(words))
            share = score / (MATCH * len(words))
            out.append({"score": share, "start": start, "end": end} if share >= threshold else None)
        release()
        return pa.array(out, entry)

    # once: a filter on the alignments must not align a second time
    return F.arrow_udf(aligned, "struct<score:double,start:int,end:int>").asNondeterministic()


def _hashed(rows: DataFrame, *columns: Column) -> DataFrame:
    return rows.select(*columns, F.xxhash64("text").alias("one"), F.xxhash64(F.lit(1), "text").alias("two"))


def shared_places(docs: DataFrame, items: DataFrame, filter_bits: int = FILTER_BITS, stretch: int = STRETCH) -> DataFrame:
    """Pairs of text (one, two) and item (item_one, item_two) to align, with ``starts`` where the item would begin.

    ``docs`` and ``items`` have one, two and text; rows of ``items`` differ in these.
    """
    seeds = stored(_grams(items), "seeds")
    bits, filled = filter_of(seeds.select("gram").distinct(), filter_bits)
    # copies of a text are one; their rows meet before the shuffle where they are in one task
    hits = stored(_grams(docs, bits, filled).distinct(), "hits")
    frequency = hits.dropDuplicates(["one", "two", "gram"]).groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    held = stored(with_rarity(seeds, frequency, stretch), "rarity")
    held = held.select("gram", "rare", F.col("place").alias("at"), F.col("one").alias("item_one"), F.col("two").alias("item_two"))
    pairs = hits.join(small(held, 40), "gram").groupBy("one", "two", "item_one", "item_two").agg(
        F.max("rare").alias("rare"),
        F.min("gram").alias("least"),
        F.max("gram").alias("most"),
        F.collect_set(F.col("place") - F.col("at")).alias("starts"),  # no more than the text has words times the item's repeats
    )
    return pairs.where("rare OR least <> most").drop("rare", "least", "most")


def with_matches(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, out: str = "leaks",
                 filter_bits: int = FILTER_BITS) -> DataFrame:
    """``docs`` with an array ``out`` of the benchmark items that ``text`` holds: item_id, score, start, end, places.

    start and end are word positions of the best alignment, end exclusive; places counts the starts that shared n-grams
    give. ``docs`` is read three times, so it should be a table or cheap to compute. Where it has a column of the name
    ``out``, an underscore comes after it.
    """
    id_type = benchmark.schema["item_id"].dataType.simpleString()
    columns = docs.columns
    out = free_name(out, columns)
    named = stored(_hashed(benchmark.where("text IS NOT NULL"), F.col("item_id"), F.col("text")), "items")
    items = named.groupBy("one", "two").agg(F.first("text").alias("text"))
    texts = _hashed(docs.where("text IS NOT NULL"), F.col("text"))
    pairs = stored(shared_places(texts, items, filter_bits), "pairs")
    asked = small(pairs.select("one", "two").distinct(), 16)
    told = texts.join(asked, ["one", "two"], "left_semi").groupBy("one", "two").agg(F.first("text").alias("text"))
    items = items.select(F.col("one").alias("item_one"), F.col("two").alias("item_two"), F.col("text").alias("item"))
    both = pairs.join(items, ["item_one", "item_two"]).join(told, ["one", "two"])
    hit = both.withColumn("hit", _aligner(threshold)("text", "item", "starts")).where("hit IS NOT NULL")
    hit = stored(hit.select("one", "two", "item_one", "item_two", "hit", F.size("starts").alias("places")), "alignments")
    ids = named.select(F.col("one").alias("item_one"), F.col("two").alias("item_two"), "item_id")
    entry = F.struct("item_id", "hit.score", "hit.start", "hit.end", "places")
    found = hit.join(ids, ["item_one", "item_two"]).groupBy("one", "two").agg(F.sort_array(F.collect_list(entry)).alias("__hits"), F.count(F.lit(1)).alias("n"))
    found = stored(found.select(F.col("one").alias("__one"), F.col("two").alias("__two"), "__hits", "n"), "leaks")
    size = found.agg(F.count(F.lit(1)) * 16 + F.coalesce(F.sum("n"), F.lit(0)) * 64).first()[0]
    found = found.drop("n")
    if size <= BROADCAST_BYTES:
        found = F.broadcast(found)
    none = F.array().cast(f"array<struct<item_id:{id_type},score:double,start:int,end:int,places:int>>")
    own = [quoted(c).alias(f"__k{i}") for i, c in enumerate(columns)]
    rows = docs.select(*own, F.xxhash64("text").alias("__one"), F.xxhash64(F.lit(1), "text").alias("__two")).join(found, ["__one", "__two"], "left")
    return rows.select(*[F.col(f"__k{i}").alias(c) for i, c in enumerate(columns)], F.coalesce("__hits", none).alias(out))
