"""Links and components of vectors, against all pairs."""

import numpy as np
from brute import groups

from mixframe.llm import embeddings


def plain(rows):
    usable = {}
    for i, v in enumerate(rows):
        if v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            unit = np.array(v, float) / np.abs(v).max()
            usable[i] = unit / np.linalg.norm(unit)
    links = [(i, j) for i in usable for j in usable if i < j and len(usable[i]) == len(usable[j]) and usable[i] @ usable[j] >= 0.95]
    root, degree = groups(list(range(len(rows))), links), np.zeros(len(rows), int)
    for i, j in links:
        degree[[i, j]] += 1
    return [(i, int(degree[i]), root[i], root[i] == i) for i in range(len(rows))]


def test_links_match_all_pairs(spark):
    rng = np.random.default_rng(4)
    rows = [rng.normal(size=32).tolist() for _ in range(150)]
    for base in range(0, 100, 5):  # near ones, to and fro over the threshold
        for noise in (0.1, 0.25, 0.3):
            rows.append((np.array(rows[base]) + noise * rng.normal(size=32)).tolist())
    hot = rng.normal(size=32)
    rows += [(hot + 0.02 * rng.normal(size=32)).tolist() for _ in range(150)]  # a crowd, cut into blocks
    rows += [rows[3], rows[3], [2 * x for x in rows[3]], None, [], [0.0] * 32, [-0.0] * 32, [float("nan")] * 32, [None] * 32]
    rows += [[float("inf")] + [1.0] * 31, [1.0, 2.0], [1.0, 2.01], [3.0], [-3.0], [5.0]]
    rows += [[1e200, 1e200, 0.0], [2e200, 2e200, 0.0], [1e-200, 0.0, 0.0], [1.0, 1.0, 0.0], [1e308, -1e308, 1e308], [1.0, -1.0, 1.0]]
    table = spark.createDataFrame([(i, v, "x", 0) for i, v in enumerate(rows)], "vec_id bigint, embedding array<double>, n_links string, node int")
    found = embeddings.linked_vectors(table, block_rows=32).collect()
    assert sorted(map(tuple, found)) == plain(rows)


def test_unnamed_and_empty(spark):
    kind = "vec_id bigint, embedding array<float>"
    rows = [(None, [1.0, 0.0]), (4, [1.0, 0.0]), (None, None), (7, None), (None, [0.0, 1.0])]
    found = {tuple(r) for r in embeddings.linked_vectors(spark.createDataFrame(rows, kind)).collect()}
    assert found == {(None, 1, 4, False), (4, 1, 4, True), (None, 0, None, True), (7, 0, 7, True)}
    assert embeddings.linked_vectors(spark.createDataFrame([], kind)).collect() == []


def test_recall_on_the_supplied_vectors_with_noise(spark, folder):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    rng = np.random.default_rng(0)
    rows += [(10_000 + i, (np.array(v) + rng.normal(size=len(v)) * 0.02).tolist()) for i, v in rows]
    found = embeddings.linked_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()
    total = sum(r[1] for r in plain([v for _, v in rows]))
    assert 0.999 * total <= sum(r.n_links for r in found) <= total and total > 0


def test_tables_rise_with_parts():
    for width, parts in ((64, 1), (64, 2), (64, 4), (256, 3)):
        tables = embeddings.tables_for(width, parts)
        rng = np.random.default_rng(9)
        one, other = rng.normal(size=(2, 400, width))
        one /= np.linalg.norm(one, axis=1, keepdims=True)
        other -= (one * other).sum(axis=1, keepdims=True) * one
        near = 0.951 * one + np.sqrt(1 - 0.951**2) * other / np.linalg.norm(other, axis=1, keepdims=True)
        (home, second), (home2, second2) = (embeddings.bucket_keys(x, parts, tables) for x in (one, near))
        assert ((home == home2) | (home == second2) | (second == home2)).any(axis=1).mean() >= 0.985
        assert (tables == embeddings.TABLES) == (parts <= 2)
