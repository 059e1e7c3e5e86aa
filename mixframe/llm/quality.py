"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model of trusted text.

The model is over the bytes of the text, four at a time (``ORDER``): every n-gram is then a number, none is unknown, and
all scripts are covered. Counts, continuation counts, discounts and back-off weights are DataFrame aggregates and joins
over all trusted texts. Scoring joins counts with the model shard by shard: tasks reduce blocks of documents to their
distinct n-grams with the documents and times that hold them, each n-gram goes to the shard of its two middle bytes, meets
the model's rows there, and comes back as a sum for each document. An n-gram's context and its shorter form share those
bytes, so a shard can also back off. There are as many shards as the model needs at ``SHARD_ROWS`` rows each, and copies
of each shard for as many tasks as there are partitions, so neither a large model nor a large corpus meets in one task.
Orders one and two are at most 65,792 rows whatever the corpus, so they are broadcast.

A document passes if its perplexity is at most a quantile, for its language, of the perplexities of trusted documents
that were held out of training. A language without any takes the quantile over all languages.

Defined results: a null or empty text has no perplexity and does not pass. A null language is a language. Without held-out
trusted text there is no threshold and everything with a text passes; without training text every byte is equally
likely. Repeated rows each give a row. An empty table gives no row; extra columns are ignored. Quantiles are exact to
``BIN`` of log-perplexity.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mixframe.llm.common import answer, kept, small, stored

ORDER = 4
#: Bytes put before a text, so that its first bytes have a context; it does not occur in UTF-8.
START = 0xFF
BLOCK_BYTES = 1 << 21
QUANTILE = 0.99
BIN = 1e-3
SHORT = 1 << 16
#: A discount is no smaller, so that every back-off weight has a logarithm.
LEAST_DISCOUNT = 0.01
BLOBS = "kind string, cell int, block string, docs binary, data binary"
SHARD_ROWS = 1 << 20
#: Kinds of rows: pieces of the model, the list of a block's documents, n-grams to look up, sums.
MODEL, DOCS, GRAMS, SUMS = "0model", "docs", "grams", "sums"


def _pieces(data: bytes, limit: int) -> Iterator[bytes]:
    """A long text in pieces of at most ``limit`` n-grams; neighbours share the bytes that no n-gram may lose."""
    for start in range(0, max(1, len(data) - ORDER + 1), limit):
        yield data[start : start + limit + ORDER - 1]


def _blocks(said: list[str | None], limit: int) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """Documents in blocks of about ``limit`` bytes: their places in ``said``, and n-grams as (n-gram, document) pairs."""
    rows: list[int] = []
    pieces: list[bytes] = []
    size = 0

    def flush():  # noqa: ANN202
        lengths = np.array([len(p) for p in pieces])
        data = np.frombuffer(b"".join(pieces), np.uint8).astype(np.uint32)
        n = len(data) - ORDER + 1
        gram = np.zeros(max(0, n), np.uint32)
        for i in range(ORDER if n > 0 else 0):
            gram = (gram << np.uint32(8)) | data[i : i + n]
        owner = np.repeat(np.arange(len(pieces)), lengths)[: max(0, n)]
        ends = np.cumsum(lengths)
        whole = np.arange(max(0, n)) + ORDER <= ends[owner] if n > 0 else np.empty(0, bool)
        return rows, gram[whole], owner[whole]

    for i, text in enumerate(said):
        data = (text or "").encode("utf-8", "replace")
        if not data:
            continue
        for piece in _pieces(bytes([START]) * (ORDER - 1) + data, limit):
            if pieces and size + len(piece) > limit:
                yield flush()
                rows, pieces, size = [], [], 0
            rows.append(i)
            pieces.append(piece)
            size += len(piece)
    if pieces:
        yield flush()


# --- model -------------------------------------------------------------------------------------------------------


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, gram, _ in _blocks(batch.column(0).to_pylist(), BLOCK_BYTES):
            keys, n = np.unique(gram, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(n)], names=["gram", "n"])


def discounts(counts: DataFrame) -> list[float]:
    """The three modified Kneser-Ney discounts of ``n``; 0.5, 1 and 1.5 where counts of counts do not define them."""
    row = counts.agg(*[F.sum(F.when(F.col("n") == i, 1)) for i in (1, 2, 3, 4)]).first()
    n1, n2, n3, n4 = (float(v or 0) for v in row)
    if not (n1 and n2 and n3 and n4):
        return [0.5, 1.0, 1.5]
    y = n1 / (n1 + 2 * n2)
    found = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
    return [min(max(d, LEAST_DISCOUNT), float(i)) for i, d in enumerate(found, 1)]


def _discount(n: Column, d: list[float]) -> Column:
    return F.when(n == 1, d[0]).when(n == 2, d[1]).otherwise(d[2])


def train(texts: DataFrame) -> dict[int, DataFrame]:
    """Tables by order from ``text``: gram, ``logp`` (interpolated, null if only a context) and ``logb`` (its back-off
    weight as a context of the next order, 0 if it is none).

    The highest order counts occurrences, the lower ones distinct left neighbours. Every context has at most 256
    n-grams, so none of the groups or joins can be hot.
    """
    counted = texts.select("text").mapInArrow(_counter, "gram bigint, n bigint")
    counts = {ORDER: stored(counted.groupBy("gram").agg(F.sum("n").alias("n")), "grams")}
    for order in range(ORDER - 1, 0, -1):
        shorter = F.col("gram").bitwiseAND(F.lit((1 << 8 * order) - 1)).alias("gram")
        counts[order] = stored(counts[order + 1].select(shorter).groupBy("gram").agg(F.count(F.lit(1)).alias("n")), "grams")
    models: dict[int, DataFrame] = {}
    for order in range(1, ORDER + 1):
        d = discounts(counts[order])
        rows = counts[order].withColumn("context", F.shiftright("gram", 8))
        left = _discount(F.col("n"), d)
        contexts = rows.groupBy("context").agg(F.sum("n").alias("total"), F.sum(F.least(left, F.col("n"))).alias("freed"))
        rows = rows.join(contexts, "context")
        own = F.greatest(F.col("n") - left, F.lit(0.0)) / F.col("total")
        weight = F.col("freed") / F.col("total")
        if order == 1:
            p = rows.select("gram", F.log(own + weight / 256).alias("logp"))
            rest = contexts.select(F.log(F.col("freed") / F.col("total")).alias("logb"))
            found = rest.first()
            models[0] = counts[1].sparkSession.createDataFrame([(0, -math.log(256), found[0] if found else 0.0)], "gram bigint, logp double, logb double")
        else:
            shorter = F.col("gram").bitwiseAND(F.lit((1 << 8 * (order - 1)) - 1))
            lower = models[order - 1].where("logp IS NOT NULL").select(F.col("gram").alias("shorter"), F.exp("logp").alias("q"))
            joined = rows.withColumn("shorter", shorter).join(lower, "shorter")
            p = joined.select("gram", F.log(own + weight * F.col("q")).alias("logp"))
            backed = contexts.select(F.col("context").alias("gram"), F.log(weight).alias("logb"))
            full = models[order - 1].drop("logb").join(backed, "gram", "full")
            models[order - 1] = stored(full.select("gram", "logp", F.coalesce("logb", F.lit(0.0)).alias("logb")), "model")
        models[order] = p.withColumn("logb", F.lit(0.0)) if order < ORDER else stored(p.withColumn("logb", F.lit(0.0)), "model")
    return models


def short_model(models: dict[int, DataFrame]) -> tuple[np.ndarray, np.ndarray]:
    """Log-probability of all pairs of bytes and back-off weight of pairs as contexts: two arrays of 65,536."""
    one, two = (models[k].collect() for k in (1, 2))  # at most 256 and 65,536 rows
    base = models[0].first()
    single, weight = np.full(256, base["logb"] + base["logp"]), np.zeros(256)
    for r in one:
        weight[r["gram"]] = r["logb"]
        if r["logp"] is not None:
            single[r["gram"]] = r["logp"]
    pairs, context = (weight[:, None] + single[None, :]).ravel(), np.zeros(SHORT)
    for r in two:
        context[r["gram"]] = r["logb"]
        if r["logp"] is not None:
            pairs[r["gram"]] = r["logp"]
    return pairs, context


# --- scoring -----------------------------------------------------------------------------------------------------


def _pack(*arrays: np.ndarray) -> bytes:
    """Integer arrays as one compressed blob."""
    parts = [np.array([len(a) for a in arrays], "<i8").tobytes(), *(a.tobytes() for a in arrays)]
    raw = b"".join(parts)
    return np.int64(len(raw)).tobytes() + pa.compress(raw, "zstd", asbytes=True)


def _unpack(blob: bytes, *kinds: str) -> list[np.ndarray]:
    raw = pa.decompress(blob[8:], int(np.frombuffer(blob[:8], "<i8")[0]), "zstd", asbytes=True)
    lengths, at, out = np.frombuffer(raw, "<i8", len(kinds)), 8 * len(kinds), []
    for n, kind in zip(lengths, kinds, strict=True):
        out.append(np.frombuffer(raw, kind, int(n), at))
        at += int(n) * np.dtype(kind).itemsize
    return out


def _postings(gram: np.ndarray, doc: np.ndarray, times: np.ndarray) -> bytes:
    """Rows sorted by n-gram, then document: distinct n-grams as differences, documents of each, documents, times."""
    first = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]])) if len(gram) else np.empty(0, np.int64)
    keys = gram[first].astype(np.int64)
    many = np.diff(np.append(first, len(gram)))
    start = np.zeros(len(gram), bool)
    start[first] = True
    # documents of one n-gram as differences; widths as small as the block allows
    step = np.where(start, doc, doc - np.concatenate([[0], doc[:-1]])) if len(doc) else doc
    narrow = "<u2" if not len(doc) or doc.max() < 1 << 16 else "<u4"
    low, high = step.astype(narrow), np.minimum(times, 255).astype("<u1")
    over = np.flatnonzero(times >= 255)
    planes = low.view("<u1").reshape(len(low), low.itemsize).T.ravel()  # byte planes compress better
    width = np.array([low.itemsize], "<u1")
    return _pack(np.diff(keys, prepend=0).astype("<i8"), many.astype("<u4"), planes.copy(), high, over.astype("<u4"), times[over].astype("<i8"), width)


def _postings_of(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct n-grams, the number of rows of each, and document and times of the rows."""
    steps, many, planes, high, over, large, width = _unpack(blob, "<i8", "<u4", "<u1", "<u1", "<u4", "<i8", "<u1")
    times = high.astype(np.int64)
    times[over] = large
    size = int(width[0])
    step = planes.reshape(size, -1).T.copy().view(f"<u{size}").ravel().astype(np.int64)
    many = many.astype(np.int64)
    run = np.cumsum(step)
    start = np.cumsum(many) - many
    doc = run - np.repeat(run[start] - step[start], many) if len(step) else step
    return np.cumsum(steps), many, doc, times


#: Odd, and small enough for the product with two bytes to be a positive int.
SPREAD = 0x5BD1


def _shard(pair: np.ndarray, shards: int) -> np.ndarray:
    return ((pair.astype(np.int64) * SPREAD) >> 5) % shards


def _shard_column(pair: Column, shards: int) -> Column:
    return F.pmod(F.shiftright(pair * F.lit(SPREAD), 5), F.lit(shards)).cast("int")


def _blob_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int32(), pa.string(), pa.binary(), pa.binary()]
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["kind", "cell", "block", "docs", "data"])


def _packed_model(shards: int, copies: int):  # noqa: ANN202
    """Task function: rows (shard, role, gram, value) in any order become pieces of the model for all copies of a shard."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shard, role, gram, value = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            for s in np.unique(shard):
                for r in np.unique(role[shard == s]):
                    at = np.flatnonzero((shard == s) & (role == r))
                    at = at[np.argsort(gram[at])]
                    blob = _pack(np.diff(gram[at], prepend=0).astype("<i8"), value[at].astype("<f8"))
                    yield _blob_batch([(MODEL, int(s) * copies + k, str(r), None, blob) for k in range(copies)])

    return pack


#: What a row of the model answers for: a whole n-gram, the shorter form of one, the context of one.
WHOLE, SHORTER, CONTEXT = "whole", "shorter", "context"


def _model_rows(models: dict[int, DataFrame], shards: int, copies: int) -> DataFrame:
    whole, less = models[ORDER].where("logp IS NOT NULL"), models[ORDER - 1]
    low = F.lit(SHORT - 1)
    middle = {WHOLE: F.shiftright("gram", 8).bitwiseAND(low), SHORTER: F.shiftright("gram", 8), CONTEXT: F.col("gram").bitwiseAND(low)}
    parts = [
        table.select(_shard_column(middle[role], shards).alias("shard"), F.lit(role).alias("role"), "gram", F.col(value).alias("value"))
        for role, table, value in ((WHOLE, whole, "logp"), (SHORTER, less.where("logp IS NOT NULL"), "logp"), (CONTEXT, less.where("logb <> 0"), "logb"))
    ]
    rows = parts[0].unionAll(parts[1]).unionAll(parts[2])
    # one piece of a shard and role, or a few of a batch each, so that copies are cheap
    return rows.repartition("shard", "role", F.pmod("gram", F.lit(8))).mapInArrow(_packed_model(shards, copies), BLOBS)


def _requests(shards: int, copies: int):  # noqa: ANN202
    """Task function: (key, text) rows become lists of documents and postings of their n-grams, by shard."""

    def request(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            for rows, gram, doc in _blocks(batch.column(1).to_pylist(), BLOCK_BYTES):
                block, copy, number = f"{part}-{number}", (part * 7919 + number) % copies, number + 1
                both, times = np.unique((gram.astype(np.uint64) << np.uint64(32)) | doc.astype(np.uint64), return_counts=True)
                known = np.bincount(doc, minlength=len(rows))
                out = [(DOCS, copy, block, _pack(keys[rows].astype("<i8"), known.astype("<i8")), None)]
                gram, doc = (both >> np.uint64(32)).astype(np.int64), (both & np.uint64(0xFFFFFFFF)).astype(np.int64)
                shard = _shard((gram >> 8) & (SHORT - 1), shards)
                order = np.argsort(shard, kind="stable")  # n-grams stay sorted within a shard
                cuts = np.searchsorted(shard[order], np.arange(shards + 1))
                for s in np.flatnonzero(np.diff(cuts)):
                    at = order[cuts[s] : cuts[s + 1]]
                    out.append((GRAMS, int(s) * copies + copy, block, None, _postings(gram[at], doc[at], times[at])))
                yield _blob_batch(out)

    return request


def _sums(values: np.ndarray, doc: np.ndarray, times: np.ndarray) -> bytes:
    total = np.bincount(doc, values * times)
    some = np.flatnonzero(total)
    return _pack(some.astype("<u4"), total[some].astype("<f8"))


def _find(keys: np.ndarray, grams: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys are in the sorted ``grams``, and the value of each (0 where it is not)."""
    if not len(grams):
        return np.zeros(len(keys), bool), np.zeros(len(keys))
    at = np.minimum(np.searchsorted(grams, keys), len(grams) - 1)
    known = grams[at] == keys
    return known, np.where(known, values[at], 0.0)


def _lookup(short: tuple[np.ndarray, np.ndarray]):  # noqa: ANN202
    """Task function over rows sorted by cell, the model's first: the log-probability of each block's documents there."""
    pairs, weights = short

    def logp(keys: np.ndarray, model: dict[str, tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        known, value = _find(keys, *model[WHOLE])
        rest = keys[~known]
        tail = rest & ((1 << 8 * (ORDER - 1)) - 1)
        seen, shorter = _find(tail, *model[SHORTER])
        shorter = np.where(seen, shorter, pairs[tail & (SHORT - 1)] + weights[tail >> 8])
        value[~known] = _find(rest >> 8, *model[CONTEXT])[1] + shorter  # an unseen context weighs 1
        return value

    def lookup(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, pieces, model = None, {}, None
        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(n)) for n in ("kind", "cell", "block", "docs", "data")]
            for i in range(batch.num_rows):
                kind, at, block, docs, data = (c[i].as_py() for c in columns)
                if at != cell:
                    cell, pieces, model = at, {WHOLE: [], SHORTER: [], CONTEXT: []}, None
                if kind == MODEL:
                    steps, values = _unpack(data, "<i8", "<f8")
                    pieces[block].append((np.cumsum(steps), values))
                elif kind == DOCS:
                    yield _blob_batch([(kind, 0, block, docs, None)])
                else:
                    if model is None:
                        model = {role: _merged(parts) for role, parts in pieces.items()}
                    keys, many, doc, times = _postings_of(data)
                    yield _blob_batch([(SUMS, 0, block, None, _sums(np.repeat(logp(keys, model), many), doc, times))])

    return lookup


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    if not parts:
        return np.empty(0, np.int64), np.empty(0)
    grams, values = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(grams, kind="stable")
    return grams[order], values[order]


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by block, the list of documents first: one row for each document (or piece of a long one)."""
    block, docs, total = None, None, None

    def rows() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(docs[0]), pa.array(docs[1]), pa.array(total)], names=["key", "bytes", "logp"])

    for batch in batches:
        for name, listed, data in zip(*(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("block", "docs", "data")), strict=True):
            if name != block:
                if block is not None:
                    yield rows()
                block, docs = name, _unpack(listed, "<i8", "<i8")
                total = np.zeros(len(docs[0]))
            else:
                some, value = _unpack(data, "<u4", "<f8")
                total[some] += value
    if block is not None:
        yield rows()


def log_perplexity(docs: DataFrame, models: dict[int, DataFrame], shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``key``, ``bytes`` and ``logp`` (natural, of the whole text) for each distinct ``key`` (long) of ``docs`` with a text.

    Rows of one key must have one text; each of them adds to the sums, so divide ``logp`` by ``bytes``. A task holds one
    shard of the model and one block's postings at a time.
    """
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = models[ORDER].count() + 2 * models[ORDER - 1].count()
    shards = max(1, math.ceil(rows / shard_rows))
    copies = max(1, partitions // shards)
    asked = docs.select("key", "text").mapInArrow(_requests(shards, copies), BLOBS)
    cells = _model_rows(models, shards, copies).unionAll(asked)
    cells = cells.repartition(partitions, "cell").sortWithinPartitions("cell", "kind")
    found = cells.mapInArrow(_lookup(short_model(models)), BLOBS)
    blocks = found.repartition(partitions, "block").sortWithinPartitions("block", "kind")
    sums = blocks.mapInArrow(_totals, "key bigint, bytes bigint, logp double")
    return sums.groupBy("key").agg(F.sum("bytes").alias("bytes"), F.sum("logp").alias("logp"))


# --- classifier --------------------------------------------------------------------------------------------------


def thresholds(scores: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """Per ``lang`` the least bin of log-perplexity up to which ``quantile`` of the rows of ``scores`` lie.

    Rows are counted by bin first, so a language's window has a row for each bin and not for each document.
    """
    binned = scores.withColumn("bin", F.ceil(F.col("log_perplexity") / BIN)).groupBy("lang", "bin").agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy("lang").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("lang")
    placed = binned.withColumns({"upto": F.sum("n").over(upto), "all": F.sum("n").over(whole)})
    return placed.where(F.col("upto") >= F.col("all") * quantile).groupBy("lang").agg((F.min("bin") * BIN).alias("threshold"))


def classify(docs: DataFrame, trusted: DataFrame, held_out: Column, keep: list[str], quantile: float = QUANTILE,
             shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``keep`` columns of ``docs`` with n_bytes, perplexity, threshold (a perplexity) and ``passes``.

    ``docs`` has doc_id, text and lang; ``trusted`` has the distinct doc_id of texts to trust; ``held_out`` is a condition
    on doc_id that keeps trusted rows for the thresholds. Texts are read where they are, twice, and never shuffled, but
    for a list of trusted ids that is too large to broadcast. A result whose name a kept column has gets an underscore after it.
    """
    ids = small(trusted.select(F.col("doc_id").alias("__trusted")).where("__trusted IS NOT NULL").distinct(), 16)
    texts = docs.join(ids, F.col("doc_id") == F.col("__trusted"), "left_semi")
    models = train(texts.where(~held_out).select("text"))
    key = F.xxhash64("doc_id", "text").alias("key")
    scores = stored(log_perplexity(docs.select(key, "text"), models, shard_rows), "scores")
    scores = scores.withColumn("log_perplexity", -F.col("logp") / F.col("bytes"))
    lang = F.coalesce(F.concat(F.lit("l"), F.col("lang")), F.lit("")).alias("lang")  # null is a language
    length = F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes")
    rows = stored(docs.select(*kept(keep), F.col("doc_id").alias("__id"), held_out.alias("__held"), lang, key, length), "rows")
    rows = rows.join(scores, "key", "left")
    held = rows.where("__held").join(ids, F.col("__id") == F.col("__trusted"), "left_semi").where("log_perplexity IS NOT NULL")
    held = stored(held.select("lang", "log_perplexity"), "held")
    by_lang = thresholds(held, quantile)
    overall = thresholds(held.withColumn("lang", F.lit("")), quantile).first()
    common = F.lit(overall["threshold"] if overall else None).cast("double")
    judged = rows.join(small(stored(by_lang, "thresholds"), 64), "lang", "left")
    judged = judged.withColumn("threshold", F.coalesce("threshold", common))
    under = F.col("threshold").isNull() | (F.ceil(F.col("log_perplexity") / BIN) * BIN <= F.col("threshold"))
    passes = F.col("log_perplexity").isNotNull() & under
    results = {"n_bytes": F.col("n_bytes"), "perplexity": F.exp("log_perplexity"), "threshold": F.exp("threshold"), "passes": passes}
    return answer(judged, keep, results)
