"""Language ID: nearest of several clustered centroids per language, by cosine of normalised TF-IDF n-gram vectors.

A text becomes counts of its letter n-grams (one to three letters, words set off by spaces) in hashed dimensions, damped,
weighted by inverse document frequency and scaled to length one. Frequencies come from all training texts. The centroids
of a language are spherical k-means clusters of its ``SAMPLE`` distinct training texts of the smallest hashes, however often
each is repeated. A text belongs to the language of the nearest centroid, and is rejected if its cosine is below a limit for
that language and the text's length. Limits come from training texts that the k-means did not see, whole and cut to windows
of many lengths, as short texts score lower.

Defined results: a null text, and a text without a letter, is ``und`` with score 0 and rejected. Rows with a null language
or id teach nothing. Without training rows every text is ``und``. The same text always gets the same answer: nothing but
the text counts. Languages that tie go to the first by code point. An empty table gives no row; other columns stay as
they are.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mixframe.llm.common import once, release, stored

DIMENSION_BITS = 13
DIMENSIONS = 1 << DIMENSION_BITS
GRAMS = (1, 2, 3)
CENTROIDS = 3
#: Distinct training texts of a language whose vectors the k-means sees, and further ones that give the limits (at most a
#: third of the language's texts).
SAMPLE, UNSEEN = 300, 500
#: A text is rejected below this share of the cosine that the given quantile of unseen texts of its length reaches. A low
#: quantile would be that of the junk among few texts.
REJECT_SHARE, REJECT_QUANTILE = 0.5, 0.25
#: The share where a language has too few texts to leave one out, so that its limits come from the texts it was learnt from.
SEEN_SHARE = 0.3
#: Characters of the windows that unseen texts are cut to, and the number of lengths (powers of two of n-grams) with limits;
#: longer texts share the last.
WINDOWS = tuple(16 << i for i in range(10))
LEVELS = 14
UNKNOWN = "und"
SPACE = 0x20
#: Odd multipliers of the n-gram hash: one for each place, and the last to mix.
_MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint32)


@dataclass(frozen=True)
class LanguageModel:
    """Inverse document frequencies, centroids (columns of length one), the language of each, and the least cosine by language
    and level of length."""

    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray
    of: np.ndarray
    least: np.ndarray


def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    every = range(sys.maxunicode + 1)
    return once("letters", lambda: np.fromiter((chr(c).isalpha() for c in every), bool, len(every)))


def grams(text: str | None, letter: np.ndarray) -> np.ndarray:
    """Dimensions of all n-grams of a text, with repeats; none if it has no letter. ``letter`` is ``letters()``."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "replace"), np.uint32)
    if not len(codes):
        return np.empty(0, np.int64)
    known = letter[codes]
    if not known.any():
        return np.empty(0, np.int64)
    # every run of other characters becomes one space, also before the first and after the last word
    begins = np.concatenate([[True], known[:-1]])
    kept = known | begins
    said = np.where(known, codes, np.uint32(SPACE))[kept]
    said = np.concatenate([[SPACE] * int(known[0]), said, [SPACE] * int(known[-1])]).astype(np.uint32)
    found = []
    for n in GRAMS:
        if len(said) >= n:
            hashed = np.full(len(said) - n + 1, n, np.uint32)
            for i in range(n):
                hashed += said[i : len(said) - n + 1 + i] * _MULTIPLIERS[i]
            hashed ^= hashed >> np.uint32(15)
            found.append(hashed * _MULTIPLIERS[-1] >> np.uint32(32 - DIMENSION_BITS))
    return np.concatenate(found).astype(np.int64)


def weighted(found: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Dimensions and values of the TF-IDF vector of length one of a text with the given n-grams."""
    times = np.bincount(found, minlength=len(idf))
    at = np.flatnonzero(times)
    values = np.log1p(times[at]) * idf[at]
    return at, values / np.linalg.norm(values)


def _frequencies(batches):  # noqa: ANN001, ANN202
    total, seen, letter = np.zeros(DIMENSIONS, np.int64), 0, letters()
    for batch in batches:
        for text in batch.column(0).to_pylist():
            total += np.bincount(grams(text, letter), minlength=DIMENSIONS) > 0
            seen += 1
        release()
    if seen:
        at = np.flatnonzero(total)
        # dimension -1 holds the number of texts
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(total[at], seen))], names=["d", "n"])


def _listed(column: pa.Array) -> pa.Array:
    letter = letters()
    return pa.array([grams(t, letter) for t in column.to_pylist()], pa.list_(pa.int32()))


def spherical_kmeans(rows: np.ndarray, clusters: int, rounds: int = 50) -> np.ndarray:
    """Centroids of length one; starts from the row farthest from the mean and then from the chosen ones."""
    chosen = [int(np.argmin(rows @ rows.mean(axis=0)))]
    while len(chosen) < min(clusters, len(rows)):
        chosen.append(int(np.argmin((rows @ rows[chosen].T).max(axis=1))))
    centre, label = rows[chosen], None
    for _ in range(rounds):
        now = np.argmax(rows @ centre.T, axis=1)
        if label is not None and np.array_equal(now, label):
            break
        label = now
        sums = np.stack([rows[label == k].sum(axis=0) if (label == k).any() else centre[k] for k in range(len(centre))])
        centre = sums / np.linalg.norm(sums, axis=1, keepdims=True)
    return centre


def chosen(rows: DataFrame, most: int) -> dict[str, list[int]]:
    """The ``most`` smallest hashes of the distinct texts of each language, in order.

    Distinct hashes below a bound that lets through a little more than that are collected; a bound that proves too low for
    a language is raised.
    """
    hashed = rows.select("lang", F.xxhash64("text").alias("hash"))
    counted = hashed.groupBy("lang").agg(F.approx_count_distinct("hash", 0.02).alias("n")).collect()
    room = 1.2 * most + 10 * math.sqrt(most)
    share = {r["lang"]: min(1.0, room / max(1, r["n"])) for r in counted}
    found: dict[str, list[int]] = {lang: [] for lang in share}
    left = list(share)
    while left:
        bound = F.lit(None).cast("bigint")
        for lang in left:
            bound = F.when(F.col("lang") == lang, F.lit(min((1 << 63) - 1, int(share[lang] * (1 << 64)) - (1 << 63)))).otherwise(bound)
        for lang in left:
            found[lang] = []
        for r in hashed.where(F.col("hash") <= bound).distinct().collect():
            found[r["lang"]].append(r["hash"])
        left = [lang for lang in left if len(found[lang]) < most and share[lang] < 1]
        share |= {lang: min(1.0, share[lang] * 4) for lang in left}
    return {lang: sorted(hashes)[:most] for lang, hashes in found.items()}


def _first_of_each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose first two columns no earlier row of the task has."""
    seen = set()
    for batch in batches:
        keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        new = [i for i, k in enumerate(keys) if k not in seen and not seen.add(k)]
        yield batch.take(pa.array(new, pa.int64()))


def level(found: np.ndarray) -> int:
    """The level of length of a text with the given n-grams."""
    return min(len(found).bit_length(), LEVELS) - 1


def _cosines(idf: np.ndarray, centres: dict[str, np.ndarray]):  # noqa: ANN202
    """Arrow function: level and cosine of a text and of windows of it, with the nearest centroid of its own language."""

    def measure(text: pa.Array, lang: pa.Array) -> pa.Array:
        letter, out = letters(), []
        for said, name in zip(text.to_pylist(), lang.to_pylist(), strict=True):
            cuts = [said] + [said[(len(said) - n) // 2 :][:n] for n in WINDOWS if n < len(said)]
            cut = [g for g in (grams(c, letter) for c in cuts) if len(g)]
            near = []
            for g in cut if name in centres else []:
                at, values = weighted(g, idf)
                near.append({"level": level(g), "cosine": float((centres[name][:, at] @ values).max())})
            out.append(near)
        release()
        return pa.array(out, pa.list_(pa.struct([("level", pa.int32()), ("cosine", pa.float64())])))

    return F.arrow_udf(measure, "array<struct<level:int,cosine:double>>")


def limits(cosines: list[tuple[int, float]], share: float) -> np.ndarray:
    """The least cosine by level; a level without cosines takes the limit of the one below, the first ones none."""
    least = np.zeros(LEVELS)
    for k in range(LEVELS):
        here = [c for at, c in cosines if at == k]
        least[k] = share * np.quantile(here, REJECT_QUANTILE) if here else least[k - 1] if k else 0
    return least


def fit(training: DataFrame, centroids: int = CENTROIDS, sample: int = SAMPLE, unseen: int = UNSEEN) -> LanguageModel:
    """Learn from ``text`` and ``lang`` of ``training``; rows without a language are left out.

    Document frequencies are counted over all texts. ``sample`` distinct texts of each language, those of the smallest
    hashes, give the centroids: the driver sees that many sparse vectors, a language at a time, and no texts. The next
    ``unseen`` hashes, or a third of the language's texts if that is less, give the limits.
    """
    rows = training.select("text", "lang").where("lang IS NOT NULL")
    found = rows.select("text").mapInArrow(_frequencies, "d bigint, n bigint").groupBy("d").agg(F.sum("n").alias("n")).collect()
    frequency = np.zeros(DIMENSIONS)
    total = sum(r["n"] for r in found if r["d"] < 0)
    for r in found:
        if r["d"] >= 0:
            frequency[r["d"]] = r["n"]
    idf = (np.log((1 + total) / (1 + frequency)) + 1).astype(np.float32)
    lettered = rows.where(F.col("text").rlike(r"\p{L}"))
    hashes = chosen(lettered, sample + unseen)
    parts = []
    for lang, some in hashes.items():
        fitted = min(sample, len(some) - min(unseen, len(some) // 3))
        parts += [(lang, h, i < fitted) for i, h in enumerate(some)]
    languages = sorted(hashes)
    keys = F.broadcast(training.sparkSession.createDataFrame(parts, "lang string, hash bigint, fitted boolean"))
    picked = lettered.withColumn("hash", F.xxhash64("text")).join(keys, ["lang", "hash"])
    picked = picked.select("lang", "hash", "text", "fitted").mapInArrow(_first_of_each, "lang string, hash bigint, text string, fitted boolean")
    picked = stored(picked.dropDuplicates(["lang", "hash"]), "language_sample")
    centres: dict[str, np.ndarray] = {}
    for lang in languages:
        known = []
        for r in picked.where(F.col("fitted") & (F.col("lang") == lang)).select(F.arrow_udf(_listed, "array<int>")("text").alias("grams")).collect():
            if r["grams"]:
                at, values = weighted(np.array(r["grams"]), idf)
                known.append(np.zeros(DIMENSIONS, np.float32))
                known[-1][at] = values
        if known:
            centres[lang] = spherical_kmeans(np.stack(sorted(known, key=lambda v: v.tobytes())), centroids)
    measured = picked.select("lang", "fitted", F.inline(_cosines(idf, centres)("text", "lang")))
    near: dict[str, list[tuple[int, float]]] = {}
    alone = [lang for lang in languages if all(f for of, _, f in parts if of == lang)]
    for r in measured.where(~F.col("fitted") | F.col("lang").isin(alone)).toLocalIterator():
        near.setdefault(r["lang"], []).append((r["level"], r["cosine"]))
    least = [limits(near.get(lang, []), SEEN_SHARE if lang in alone else REJECT_SHARE) for lang in languages]
    of = [k for k, lang in enumerate(languages) for _ in centres.get(lang, ())]
    stack = np.concatenate([centres[x] for x in languages if x in centres]) if centres else np.empty((0, DIMENSIONS))
    return LanguageModel(languages, idf, np.ascontiguousarray(stack.T, np.float64), np.array(of, np.int64), np.reshape(least, (-1, LEVELS)))


def nearest(text: str | None, model: LanguageModel, letter: np.ndarray) -> tuple[int, float, bool]:
    """The nearest centroid of a text (-1: it has no letter), the cosine, and whether it is rejected."""
    found = grams(text, letter)
    if not len(found) or not len(model.of):
        return -1, 0.0, True
    at, values = weighted(found, model.idf)
    near = values @ model.centroids[at]
    best = int(np.argmax(near))
    score = min(max(float(near[best]), 0.0), 1.0)
    return best, score, score < model.least[model.of[best], level(found)]


def predict(docs: DataFrame, model: LanguageModel, out: str = "language") -> DataFrame:
    """``docs`` with a struct ``out`` of lang_pred, score (the cosine) and rejected, from ``text`` alone."""

    def answer(column: pa.Array) -> pa.Array:
        letter = letters()
        rows = [nearest(t, model, letter) for t in column.to_pylist()]
        best, score, rejected = zip(*rows, strict=True) if rows else ((), (), ())
        named = [model.languages[model.of[b]] if b >= 0 else UNKNOWN for b in best]
        columns = [pa.array(named, pa.string()), pa.array(score, pa.float64()), pa.array([bool(r) for r in rejected], pa.bool_())]
        release()
        return pa.StructArray.from_arrays(columns, names=["lang_pred", "score", "rejected"])

    kind = "struct<lang_pred:string,score:double,rejected:boolean>"
    # once: a filter on the answer must not predict a second time
    return docs.withColumn(out, F.arrow_udf(answer, kind).asNondeterministic()(F.col("text")))


def held_out(doc_id: str = "doc_id", folds: int = 5) -> F.Column:
    """Whether crc32 of the id as text leaves remainder 0; false for a null id, which is not learnt from either."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds == 0, F.lit(False))


def training_rows(docs: DataFrame) -> DataFrame:
    """Rows that may be learnt from: an id outside the held-out fold, and a language."""
    return docs.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull()).where(~held_out())
