"""Product codes against plain k-means with Python integers."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from mixframe.llm import codes, hilbert

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def brute(rows, parts, entries, rounds, scale):
    kept = [(i, [math.floor(scale * float(x)) for x in v], g) for i, v, g in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1]) // parts
    kept = [r for r in kept if len(r[1]) == width * parts]
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(v, p) for _, v, _ in kept[:entries]] for p in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), e) for e, c in enumerate(book))

    for _ in range(rounds):
        for p, book in enumerate(books):
            groups = {}
            for _, v, _ in kept:
                groups.setdefault(nearest(cut(v, p), book)[1], []).append(cut(v, p))
            books[p] = [[sum(c) // len(groups[e]) for c in zip(*groups[e], strict=True)] if e in groups else book[e] for e in range(len(book))]
    out, sums = [], {}
    for i, v, g in kept:
        found = [nearest(cut(v, p), books[p]) for p in range(parts)]
        error = sum(d for d, _ in found)
        out.append((i, "".join(f"{e:02x}" for _, e in found), error, g))
        sums[g] = sums.get(g, 0) + error
    digest = hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()
    return sorted((*r[:3], sums[r[3]]) for r in out), digest


def made(rng, n, width):
    centres = [[rng.gauss(0, 0.3) for _ in range(width)] for _ in range(7)]
    rows = [(i, [c + rng.gauss(0, 0.1) for c in rng.choice(centres)], rng.choice([0, 1, None])) for i in range(n)]
    rows += [(i + n, rows[3][1], 1) for i in range(n)]  # half of all rows are copies
    odd = [None, [], [None] * width, [float("nan")] * width, [float("inf")] + [0.0] * (width - 1), [0.0] * (width + 8), [-0.0] * width]
    return [(r[0], r[1] if r[1] is None else [x if x is None else float(np.float32(x)) for x in r[1]], r[2]) for r in rows + [(5000 + i, v, 2) for i, v in enumerate(odd)]]


@pytest.mark.parametrize(("width", "parts", "entries", "n"), [(16, 8, 16, 150), (24, 4, 5, 60), (8, 8, 3, 40), (128, 2, 4, 20)])
def test_codes_match_plain_k_means(spark, width, parts, entries, n):
    rows = made(random.Random(width), n, width) + [(3, [0.25] * width, None), (3, [0.5] * width, None), (3, [0.25] * width, None)]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    coded, books = codes.compress(frame, ["vec_id", "label"], parts=parts, entries=entries, rounds=4, block_rows=8)
    coded = codes.with_group_error(coded, "label", "label_error")
    got = coded.select("vec_id", codes.code_text(F.col("code"), parts), "error", "label_error").collect()
    assert (sorted(map(tuple, got)), codes.books_digest(books)) == brute(rows, parts, entries, 4, codes.SCALE)


def test_shortlists_keep_every_nearest_entry():
    rng = np.random.default_rng(2)
    book = rng.integers(-50, 50, (9, 4))
    book[7] = book[2]
    lengths = []
    for size in (1, 3, 200):
        value = rng.integers(-50, 50, (size, 4)) // (1 if size > 1 else 2)
        listed = np.flatnonzero(codes.shortlists(value.min(axis=0)[None], value.max(axis=0)[None], book)[0])
        lengths.append(len(listed))
        best, distance = codes.nearest_entries(value, book, listed)
        all_ = ((value[:, None] - book) ** 2).sum(axis=2)
        assert (best == all_.argmin(axis=1)).all() and (distance == all_.min(axis=1)).all()
    assert lengths[0] < 9


@pytest.mark.parametrize(("n", "bits"), [(1, 5), (2, 4), (3, 3), (4, 2), (5, 2)])
def test_the_curve_visits_every_cell_once_and_moves_by_one(spark, n, bits):
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * n, indexing="ij")).reshape(n, -1).T
    found = hilbert.index(cells, bits)
    assert sorted(found.tolist()) == list(range(len(cells)))
    assert (np.abs(np.diff(cells[np.argsort(found)], axis=0)).sum(axis=1) == 1).all()
    frame = spark.createDataFrame([tuple(map(int, c)) for c in cells], ", ".join(f"c{i} int" for i in range(n)))
    native = frame.select(*frame.columns, hilbert.index_column([F.col(c) for c in frame.columns], bits).alias("h"))
    assert {tuple(r[:-1]): r.h for r in native.collect()} == {tuple(map(int, c)): int(h) for c, h in zip(cells, found, strict=True)}


def test_empty_tables_few_rows_clashing_names_and_errors(spark):
    coded, books = codes.compress(spark.createDataFrame([], SCHEMA), ["vec_id", "label"])
    assert coded.columns == ["vec_id", "label", "code", "error"] and coded.count() == 0 and books == []
    assert codes.with_group_error(coded, "label", "label_error").count() == 0
    names = "vec_id bigint, embedding array<double>, label int, code int, error int, row int, value int, part int, __k0 int"
    rows = [(1, [0.1] * 8, 1, 1, 1, 1, 1, 1, 1), (None, [0.2] * 8, 1, 1, 1, 1, 1, 1, 1), (None, [0.2] * 8, 1, 2, 2, 2, 2, 2, 2)]
    coded, books = codes.compress(spark.createDataFrame(rows, names), ["vec_id", "label"])
    assert [len(b) for b in books] == [3] * 8 and sorted(r.error for r in coded.collect()) == [0, 0, 0]
    with pytest.raises(ValueError, match="equal parts"):
        codes.compress(spark.createDataFrame([(1, [0.5] * 9, 1)], SCHEMA), ["vec_id"])
    with pytest.raises(Exception, match="must stay below"):
        codes.compress(spark.createDataFrame([(1, [1e30] * 8, 1)], SCHEMA), ["vec_id"])


def test_a_hot_vector_does_not_change_the_codes(spark):
    rows = [(i, [0.125] * 8 if i % 3 else [float(np.float32(math.sin(i + j))) for j in range(8)], i % 2) for i in range(600)]
    coded, books = codes.compress(spark.createDataFrame(rows, SCHEMA), ["vec_id", "label"])
    coded = codes.with_group_error(coded, "label", "label_error")
    got = coded.select("vec_id", codes.code_text(F.col("code")), "error", "label_error").collect()
    assert (sorted(map(tuple, got)), codes.books_digest(books)) == brute(rows, 8, 16, 6, codes.SCALE)
