"""Phrase collocation mining over sorted count streams.

Texts are lower-cased in A-Z, cut at ``[.,;:!?\\x0A-\\x0D]`` into pieces and these into words ``[^\\x20\\x09]+``. Everything
is counted per language, in three passes over the texts:

1. ``word_counts``: occurrences of every word, and of all words of a language.
2. ``pair_counts``: occurrences of every pair of words that are frequent themselves.
3. ``phrase_counts``: one window for each place where a longer phrase may start, with up to ``order`` words. A pair below
   the threshold is in no candidate, so it ends a window. The windows are put in prefix order. Phrases of every length
   are runs of equal prefixes in that one stream, so lengths 3 to ``order`` are counted in one scan that holds one open
   run for each length. Only a run that touches the edge of a part is added up with its neighbour's.

Each task adds up equal words, pairs and windows before they are shuffled. Frequent words and pairs are told by a bit
filter of bounded size, whose false positives only make more rows and never change a count.

The counts are then laid out twice, in prefix order (words from the first) and in suffix order (words from the last). In
such an order a phrase comes right after the shorter phrases that begin it, so a walk that keeps one open phrase for each
length merges the streams of all lengths: it reads the counts of the left (or right) parts off the open phrases and hands
its own count down as their extension. Nothing is hashed, and a part in the middle of a hot first word starts with the
open phrases of its first row (four counts a part at most).

A phrase is inside a longer one of nearly its count only if it is inside one that is one word longer, because counts fall
as phrases grow; so the largest extension to the left and to the right decides.

Defined results: a null text is empty, a null language is ``und``; repeated rows count again; a text without words, or an
empty table, gives nothing. Equal scores are ordered by count and phrase. Other columns are ignored, whatever their names.
Inside, words are joined by byte 0 and bytes 0 of a word stand as spaces, so that the joint is below every other byte.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mixframe.llm.common import ordered, release, stored
from mixframe.operators.lookup import lookup_join

MIN_COUNT = 100
ORDER = 5
TOP = 2000
NO_LANG = "und"
#: Words that a task counts, and window places that it adds up, before it hands them on.
WORD_LIMIT = 400_000
PLACE_LIMIT = 2_000_000
#: Bits of the filter for each frequent word, and the most bits it may have (8 MB).
BITS_PER_WORD = 16
FILTER_BITS = 1 << 26
#: Rows that a task hands on at a time.
OUT_ROWS = 50_000
JOINT, END = b"\x00", b"\n"
#: A-Z to lower case; space and tab to the joint, byte 0 to space; what ends a piece to a line feed.
BYTES = bytes.maketrans(
    bytes(range(65, 91)) + b" \t\x00" + b".,;:!?\x0a\x0b\x0c\x0d", bytes(range(97, 123)) + b"\x00\x00 " + END * 10
)
COUNTS = "lang string, phrase string, n bigint"


def _pieces(text: bytes) -> list[bytes]:
    """Words of a text, a line feed for each end of a piece, and empty words where blanks meet."""
    return text.translate(BYTES).replace(END, JOINT + END + JOINT).split(JOINT)


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[str, bytes]]:
    yield from zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True)


def _rows(langs: list[str], phrases: list[bytes], counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    for start in range(0, len(counts), OUT_ROWS):
        cut = slice(start, start + OUT_ROWS)
        said = pa.array(phrases[cut], pa.binary()).cast(pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(langs[cut], pa.string()), said, pa.array(counts[cut])], names=["lang", "phrase", "n"])


class _Numbers(dict):
    """Numbers of words from 1 on; an empty word is -1, the end of a piece 0."""

    def __init__(self) -> None:
        super().__init__({b"": -1, END: 0})
        self.words: list[bytes | None] = [None]

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self.words)
        self.words.append(word)
        return number


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of the task's texts with their counts; the null phrase has the number of all words."""
    known: dict[str, _Numbers] = {}
    said: dict[str, list[np.ndarray]] = {}
    counts: dict[str, np.ndarray] = {}
    places, kept = 0, 0

    def added() -> None:
        for lang, arrays in said.items():
            found = np.concatenate(arrays)
            n = np.bincount(found[found > 0], minlength=len(known[lang].words))
            old = counts.get(lang, n[:0])
            n[: len(old)] += old
            counts[lang] = n
        said.clear()

    def counted() -> Iterator[pa.RecordBatch]:
        added()
        for lang, n in counts.items():
            yield from _rows([lang] * len(n), known[lang].words, np.concatenate([[n[1:].sum()], n[1:]]))
        known.clear()
        counts.clear()

    for batch in batches:
        for lang, text in _texts(batch):
            numbers = known.setdefault(lang, _Numbers())
            words, before = _pieces(text), len(numbers)
            said.setdefault(lang, []).append(np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)))
            places, kept = places + len(words), kept + len(numbers) - before
            if kept > WORD_LIMIT:
                yield from counted()
                places, kept = 0, 0
            elif places > PLACE_LIMIT:
                added()
                places = 0
    yield from counted()
    release()


def _enough(counted: DataFrame, min_count: int, name: str) -> DataFrame:
    """The sums of a task's counts that are large enough, and those of no phrase, stored."""
    found = counted.groupBy("lang", "phrase").agg(F.sum("n").alias("n"))
    return stored(found.where(F.col("phrase").isNull() | (F.col("n") >= min_count)), name)


def word_counts(texts: DataFrame, min_count: int = MIN_COUNT) -> DataFrame:
    """Words of ``texts`` (lang, text) that occur often enough, and with a null phrase the number of all words of a language."""
    return _enough(texts.mapInArrow(_count_words, COUNTS), min_count, "words")


def _hash(lang: str) -> Callable[[bytes], int]:
    """64-bit hash of the words of a language."""
    from xxhash import xxh64_intdigest

    seed = xxh64_intdigest(lang.encode())
    return lambda word: xxh64_intdigest(word, seed)


def _pair_hash(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Hash of a pair from those of its words."""
    h = one * np.uint64(0x9E3779B97F4A7C15) + two  # an odd factor: the golden ratio's digits
    return (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)


def _bits(h: np.ndarray, bits: int) -> np.ndarray:
    """The two places of each hash in a filter of ``bits`` bits, a power of two."""
    return np.stack([h & np.uint64(bits - 1), (h >> np.uint64(32)) & np.uint64(bits - 1)]).astype(np.int64)


def _in_filter(held: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = _bits(h, 8 * len(held))
    return ((held[at >> 3] >> (at & 7)) & 1).all(axis=0)


def frequent_filter(counts: DataFrame) -> np.ndarray:
    """Bytes of a bit filter that holds every phrase of ``counts``, of at most ``FILTER_BITS`` bits however many they are."""
    frequent = counts.where("phrase is not null").select("lang", "phrase")
    bits, wanted = 1 << 10, min(FILTER_BITS, frequent.count() * BITS_PER_WORD)
    while bits < wanted:
        bits *= 2

    def set_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = {lang: _hash(lang) for lang in batch.column(0).unique().to_pylist()}
            parts = [[hashes[lang](w) for w in phrase.split(JOINT)] for lang, phrase in _texts(batch)]
            one = np.array([p[0] for p in parts], np.uint64)
            two = np.array([p[-1] for p in parts], np.uint64)
            h = np.where([len(p) == 1 for p in parts], one, _pair_hash(one, two))
            at = _bits(h, bits).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(at >> 5), pa.array(np.int64(1) << (at & 31))], names=["place", "mask"])

    masks = frequent.mapInArrow(set_bits, "place bigint, mask bigint").groupBy("place").agg(F.bit_or("mask").alias("mask"))
    found = masks.toArrow()  # at most FILTER_BITS / 32 rows
    table = np.zeros(bits // 32, "<u4")
    table[found.column("place").to_numpy()] = found.column("mask").to_numpy()
    return table.view(np.uint8)


def _added_windows(lang: str, numbers: _Frequent, said: list[np.ndarray], order: int) -> Iterator[pa.RecordBatch]:
    """Distinct windows of two words or more (three or more of a longer ``order``), joined and sorted, with their counts."""
    seq = np.concatenate([*said, np.zeros(order, np.int64)])
    meets = (seq[:-1] > 0) & (seq[1:] > 0)
    if order > 2:
        h = np.array(numbers.hashes, np.uint64)
        both = np.flatnonzero(meets)
        meets[both] = _in_filter(numbers.held, _pair_hash(h[seq[both]], h[seq[both + 1]]))
    size = len(seq) - order
    goes_on = meets[:size].copy()
    columns = [seq[:size]]
    for i in range(1, order):
        columns.append(np.where(goes_on, seq[i : i + size], 0))
        goes_on &= meets[i : i + size]
    starts = np.flatnonzero(columns[min(2, order - 1)] > 0)
    if not len(starts):
        return
    words = pa.array(numbers.words, pa.binary())
    rank = np.empty(len(words), np.int64)  # numbers in the order of the words; none first
    rank[pc.sort_indices(words, null_placement="at_start").to_numpy()] = np.arange(len(words))
    columns = [c[starts] for c in columns]
    by = np.lexsort([rank[c] for c in reversed(columns)])
    columns = [c[by] for c in columns]
    first = np.ones(len(by), bool)
    first[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    place = np.flatnonzero(first)
    counts = np.diff(place, append=len(by))
    joint = pa.scalar(JOINT, pa.binary())
    for start in range(0, len(place), OUT_ROWS):
        cut = place[start : start + OUT_ROWS]
        parts = [words.take(pa.array(c[cut])) for c in columns]
        phrase = pc.binary_join_element_wise(*parts, joint, null_handling="skip").cast(pa.string())
        langs = pa.array([lang] * len(cut), pa.string())
        yield pa.RecordBatch.from_arrays([langs, phrase, pa.array(counts[start : start + OUT_ROWS])], names=["lang", "phrase", "n"])


class _Frequent(_Numbers):
    """Numbers of the words that the filter ``held`` has, with their hashes."""

    def __init__(self, lang: str, held: np.ndarray) -> None:
        super().__init__()
        self.hash, self.held, self.bytes, self.mask = _hash(lang), held, held.tobytes(), 8 * len(held) - 1
        self.hashes = [0]

    def __missing__(self, word: bytes) -> int:
        h = self.hash(word)
        one, two = h & self.mask, h >> 32 & self.mask
        if not self.bytes[one >> 3] >> (one & 7) & self.bytes[two >> 3] >> (two & 7) & 1:
            self[word] = 0
            return 0
        self.hashes.append(h)
        return super().__missing__(word)


def _windows(held: np.ndarray, order: int):  # noqa: ANN202
    """Windows of the task's texts, equal ones added up; ``held`` is the filter of frequent words and pairs."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, _Frequent] = {}
        said: dict[str, list[np.ndarray]] = {}
        places, kept = 0, 0
        for batch in batches:
            for lang, text in _texts(batch):
                if lang not in known:
                    known[lang] = _Frequent(lang, held)
                numbers = known[lang]
                words, before = [*_pieces(text), END], len(numbers)
                found = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
                said.setdefault(lang, []).append(found[found >= 0])
                places, kept = places + len(words), kept + len(numbers) - before
                if places > PLACE_LIMIT:
                    for one, arrays in said.items():
                        yield from _added_windows(one, known[one], arrays, order)
                    said.clear()
                    places = 0
                    if kept > WORD_LIMIT:
                        known.clear()
                        kept = 0
        for one, arrays in said.items():
            yield from _added_windows(one, known[one], arrays, order)
        release()

    return windows


def pair_counts(texts: DataFrame, words: DataFrame, min_count: int = MIN_COUNT) -> DataFrame:
    """Pairs of words that occur often enough: lang, phrase, n."""
    return _enough(texts.mapInArrow(_windows(frequent_filter(words), 2), COUNTS), min_count, "pairs")


class _Runs:
    """Sums of runs of equal prefixes of one length, over the batches of a sorted stream."""

    def __init__(self, length: int, least: int) -> None:
        self.length, self.least = length, least
        self.open: tuple[str, bytes] | None = None
        self.sum, self.edge = 0, True

    def close(self, rows: list[tuple[str, bytes, int]], at_end: bool = False) -> None:
        """Hand on the open run: always at an edge of the part, elsewhere if it is large enough."""
        if self.open is not None and (self.edge or at_end or self.sum >= self.least):
            rows.append((*self.open, self.sum))
        if self.open is not None:
            self.edge = False
        self.open, self.sum = None, 0

    def add(self, key: tuple[str, bytes], n: int, rows: list[tuple[str, bytes, int]]) -> None:
        if key != self.open:
            self.close(rows)
            self.open = key
        self.sum += n


def _prefix_runs(order: int, least: int):  # noqa: ANN202
    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = [_Runs(k, least) for k in range(3, order + 1)]
        for batch in batches:
            rows: list[tuple[str, bytes, int]] = []
            size = batch.num_rows
            if not size:
                continue
            langs = batch.column(0)
            parts = pc.split_pattern(batch.column(1).cast(pa.binary()), JOINT)
            flat, offsets = parts.flatten(), parts.offsets.to_numpy()
            offsets = offsets - offsets[0]
            words = np.diff(offsets)
            codes = np.full((size, order + 1), -1, np.int64)
            codes[:, 0] = langs.dictionary_encode().indices.to_numpy()
            row = np.repeat(np.arange(size), words)
            codes[row, 1 + np.arange(len(row)) - offsets[:-1][row]] = flat.dictionary_encode().indices.to_numpy()
            change = np.ones((size, order + 1), bool)
            change[1:] = np.logical_or.accumulate(codes[1:] != codes[:-1], axis=1)
            n = batch.column(2).to_numpy()

            def key(i: int, k: int) -> tuple[str, bytes]:
                return langs[i].as_py(), JOINT.join(w.as_py() for w in flat[offsets[i] : offsets[i] + k])  # noqa: B023

            for run in lengths:
                k = run.length
                starts = np.flatnonzero(change[:, k])
                sums = np.add.reduceat(n, starts)
                real = words[starts] >= k
                starts, sums = starts[real], sums[real]
                # the first run may go on from the batch before, the last one into the next
                inner = np.flatnonzero(sums[1:-1] >= least) + 1
                for i in dict.fromkeys([0, *inner.tolist(), len(starts) - 1]) if len(starts) else ():
                    run.add(key(starts[i], k), int(sums[i]), rows)
                    if i == 0 and len(starts) > 1:
                        run.close(rows)
            yield from _rows([r[0] for r in rows], [r[1] for r in rows], np.array([r[2] for r in rows], np.int64))
        rows = []
        for run in lengths:
            run.close(rows, at_end=True)
        yield from _rows([r[0] for r in rows], [r[1] for r in rows], np.array([r[2] for r in rows], np.int64))
        release()

    return runs


def phrase_counts(texts: DataFrame, words: DataFrame, min_count: int = MIN_COUNT, order: int = ORDER) -> DataFrame:
    """All phrases of 1 to ``order`` words that occur often enough: lang, phrase, n; every phrase once."""
    short = words.where("phrase is not null")
    if order > 1:
        short = short.unionByName(pair_counts(texts, words, min_count))
    if order < 3:
        return short
    added = stored(texts.mapInArrow(_windows(frequent_filter(short), order), COUNTS), "windows")
    stream = added.repartitionByRange("lang", "phrase").sortWithinPartitions("lang", "phrase")
    runs = stream.mapInArrow(_prefix_runs(order, min_count), COUNTS)
    return short.unionByName(_enough(runs, min_count, "longer"))


def turned(phrase: Column) -> Column:
    """The words of a phrase from the last to the first."""
    return F.array_join(F.reverse(F.split(phrase, "\\x00")), "\0")


WALKED = "lang string, phrase string, n bigint, parts array<bigint>, grown bigint"


def _walk(heads: dict[int, list[tuple[str, str, int]]]):  # noqa: ANN202
    """A walk over parts of a stream in which every phrase follows those that begin it.

    Gives each phrase with the counts of its shorter beginnings and the largest count of a phrase that is one word
    longer. ``heads`` has the beginnings of the first phrase of each part; theirs is a row without counts.
    """

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = None
        path: list[list] = []  # open phrases by length: [lang, phrase, count, largest extension, of this part]
        done: list[tuple] = []

        def close(keep: int) -> None:
            while len(path) > keep:
                lang, phrase, n, grown, own = path.pop()
                if own:
                    done.append((lang, phrase, n, [p[2] for p in path], grown))
                elif grown:
                    done.append((lang, phrase, None, None, grown))

        def batch_of() -> pa.RecordBatch:
            types = [pa.string(), pa.string(), pa.int64(), pa.list_(pa.int64()), pa.int64()]
            columns = zip(*done, strict=True) if done else [[]] * 5
            made = pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=["lang", "phrase", "n", "parts", "grown"])
            done.clear()
            return made

        for batch in batches:
            for lang, phrase, n, at in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at != part:
                    close(0)
                    part = at
                    path.extend([*head, 0, False] for head in heads.get(at, ()))
                keep = phrase.count("\0")
                while len(path) > keep or (path and (path[-1][0] != lang or not phrase.startswith(path[-1][1] + "\0"))):
                    close(len(path) - 1)
                if path:
                    path[-1][3] = max(path[-1][3], n)
                path.append([lang, phrase, n, 0, True])
            if len(done) > OUT_ROWS:
                yield batch_of()
        close(0)
        yield batch_of()

    return walk


def walked(counts: DataFrame) -> DataFrame:
    """Counts of the beginnings of every phrase of ``counts``, and its largest extension at the end.

    ``counts`` is laid out in the order of its phrases and stored. The driver sees the first phrase of each part and the
    counts of its beginnings: a few rows a part.
    """
    placed = ordered(counts.select("lang", "phrase", "n"), [F.col("lang"), F.col("phrase")])
    first = placed.groupBy("__part").agg(F.min_by(F.struct("lang", "phrase"), "__place").alias("head"))
    words = F.split("head.phrase", "\\x00")
    lengths = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda k: k > 0)
    begun = first.select("__part", "head.lang", words.alias("words"), F.explode(lengths).alias("k"))
    begun = begun.select("__part", "lang", F.array_join(F.slice("words", F.lit(1), F.col("k")), "\0").alias("phrase"), "k")
    open_ = counts.join(F.broadcast(begun), ["lang", "phrase"]).select("__part", "k", "lang", "phrase", "n").collect()
    heads: dict[int, list[tuple[str, str, int]]] = {}
    for part, _, *head in sorted(map(tuple, open_)):
        heads.setdefault(part, []).append(tuple(head))
    parts = placed.repartition("__part").sortWithinPartitions("__place").select("lang", "phrase", "n", "__part")
    return parts.mapInArrow(_walk(heads), WALKED)


def spoken(phrase: Column) -> Column:
    """A phrase as text: words joined by spaces, and with the bytes they had."""
    return F.array_join(F.transform(F.split(phrase, "\\x00"), lambda w: F.replace(w, F.lit(" "), F.lit("\0"))), " ")


def _exact(number: str | Column) -> Column:
    """A long as a decimal: products of up to 38 digits are exact, and larger ones an error."""
    return (F.col(number) if isinstance(number, str) else number).cast("decimal(19,0)")


def scored(counts: DataFrame, totals: DataFrame, share: int = 100) -> DataFrame:
    """Candidates of two words or more with a, l, r, n and score; none inside a longer one with ``share`` percent of its count."""
    none = F.lit(None).cast("array<bigint>")
    ahead = walked(counts).select("lang", "phrase", "n", F.col("parts").alias("lefts"), none.alias("rights"), "grown")
    back = walked(counts.select("lang", turned(F.col("phrase")).alias("phrase"), "n"))
    back = back.select("lang", turned(F.col("phrase")).alias("phrase"), "n", none.alias("lefts"), F.col("parts").alias("rights"), "grown")
    met = ahead.unionByName(back).groupBy("lang", "phrase").agg(*[F.max(c).alias(c) for c in ("n", "lefts", "rights", "grown")])
    met = met.where(F.size("lefts") > 0).where(100 * F.col("grown") < share * F.col("n"))
    known = lookup_join(met.withColumnRenamed("n", "a"), totals, "lang", row_bytes=64)

    def cut(k: Column) -> Column:
        left, right = F.element_at("lefts", k), F.element_at("rights", F.size("lefts") + 1 - k)
        over = _exact(F.lit(1000)) * _exact("a") * _exact("n")
        score = F.call_function("div", over, _exact(left) * _exact(right))
        return F.struct(score.alias("score"), k.alias("k"), left.alias("l"), right.alias("r"))

    best = F.array_min(F.transform(F.sequence(F.lit(1), F.size("lefts")), cut))
    return known.withColumn("best", best).select("lang", "phrase", "a", "best.l", "best.r", "n", "best.score")


def collocations(
    docs: DataFrame, min_count: int = MIN_COUNT, order: int = ORDER, share: int = 100, top: int = TOP
) -> DataFrame:
    """Per language the ``top`` phrases of ``docs`` (text, lang) by score: lang, rank, phrase, a, l, r, n, score.

    Ranks are cut to ``top`` rows of a language in every task before the shuffle, so no task sees all its phrases.
    """
    texts = docs.select(F.coalesce("lang", F.lit(NO_LANG)).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    words = word_counts(texts, min_count)
    totals = words.where("phrase is null").select("lang", "n")
    found = scored(phrase_counts(texts, words, min_count, order), totals, share).withColumn("phrase", spoken(F.col("phrase")))
    by = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def oracle(min_count: int = MIN_COUNT, order: int = ORDER, top: int = TOP) -> str:
    """The phrases of the query in DuckDB."""
    return f"""
WITH texts AS (
  SELECT coalesce(lang, '{NO_LANG}') AS lang,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
pieces AS (SELECT lang, unnest(string_split_regex(text, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM texts),
said AS (SELECT lang, list_filter(string_split_regex(piece, '[ \\t]+'), lambda w: w <> '') AS ws FROM pieces),
totals AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM said GROUP BY lang),
starts AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM said),
counts AS (
  SELECT lang, ws[i:i + m - 1] AS p, count(*)::BIGINT AS f FROM starts CROSS JOIN range(1, {order + 1}) AS lengths(m)
  WHERE i + m - 1 <= len(ws) GROUP BY ALL HAVING count(*) >= {min_count}),
inner_parts AS (
  SELECT DISTINCT q.lang, q.p[i:i + m - 1] AS p, q.f FROM counts q, range(1, {order}) AS lengths(m), range(1, {order + 1}) AS places(i)
  WHERE m < len(q.p) AND i + m - 1 <= len(q.p)),
kept AS (
  SELECT lang, p, f FROM counts c WHERE len(p) > 1
  AND NOT EXISTS (SELECT 1 FROM inner_parts q WHERE q.lang = c.lang AND q.p = c.p AND 100 * q.f >= 100 * c.f)),
cuts AS (SELECT lang, p, f, k FROM kept, range(1, {order}) AS places(k) WHERE k < len(p)),
scores AS (
  SELECT c.lang, c.p, c.f AS a, c.k, x.f AS l, y.f AS r, t.n, (1000::HUGEINT * c.f * t.n) // (x.f::HUGEINT * y.f) AS score
  FROM cuts c JOIN counts x ON x.lang = c.lang AND x.p = c.p[1:k] JOIN counts y ON y.lang = c.lang AND y.p = c.p[k + 1:]
  JOIN totals t ON t.lang = c.lang),
best AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
named AS (SELECT lang, array_to_string(p, ' ') AS phrase, a, l, r, n, score::BIGINT AS score FROM best)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM named QUALIFY rank <= {top}"""
