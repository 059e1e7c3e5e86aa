"""Batches in file order and by permutation."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from mixframe.functions.permutation import half_bits, number_at, permuted, place_of, restored
from mixframe.operators import file_batches as fb
from mixframe.session import scratch_path


@pytest.mark.parametrize("rows", [1, 2, 3, 5, 16, 17, 255, 256, 257, 4097, 10_007])
def test_permutation_is_a_bijection_with_an_inverse(rows):
    numbers = np.arange(rows)
    orders = [permuted(numbers, rows, seed=3, epoch=e) for e in range(3)]
    for epoch, places in enumerate(orders):
        assert sorted(places.tolist()) == numbers.tolist()
        assert (restored(places, rows, 3, epoch) == numbers).all()
    if rows > 100:
        assert not (orders[0] == orders[1]).all() and not (orders[0] == permuted(numbers, rows, 4, 0)).all()
        # places are spread: a run of numbers does not stay together
        assert abs(np.corrcoef(numbers, orders[0])[0, 1]) < 0.2
        assert abs(orders[0][: rows // 4].mean() / rows - 0.5) < 0.1


def test_permutation_of_a_large_table_and_of_wrong_numbers():
    rows = 10**12 + 39
    numbers = np.random.default_rng(0).integers(0, rows, 10_000)
    places = permuted(numbers, rows, 1, 2)
    assert (restored(places, rows, 1, 2) == numbers).all() and places.min() >= 0 and places.max() < rows
    assert 1 << (2 * half_bits(rows)) <= 4 * rows
    with pytest.raises(ValueError, match="row numbers"):
        permuted(np.array([5]), 5, 0, 0)
    with pytest.raises(ValueError, match="below"):
        half_bits(1 << 61)


def test_columns_agree_with_arrays(spark):
    frame = spark.range(1000).select("id", (F.col("id") % 3).cast("int").alias("e"))
    out = frame.withColumn("p", place_of("id", "e", 1000, 9)).withColumn("n", number_at("p", "e", 1000, 9)).toPandas()
    assert (out.n == out.id).all()
    for e in range(3):
        mine = out[out.e == e]
        assert (permuted(mine.id.to_numpy(), 1000, 9, e) == mine.p.to_numpy()).all()


@pytest.fixture
def scan(spark):
    """1,003 rows in files of unequal size, one of them empty."""
    path = scratch_path(spark, "scan")
    sizes = [400, 1, 0, 350, 252]
    start = 0
    for i, n in enumerate(sizes):
        rows = spark.range(start, start + n, 1, 1).select(F.col("id"), (F.col("id") * 7 % 11).alias("x"))
        rows.write.parquet(f"{path}/f={i}")
        start += n
    return spark.read.parquet(path)


def test_file_order_counts_rows_of_files(scan):
    out = fb.sequential_batches_file_order(scan.select("id", "x"), 100)
    assert out.columns == ["id", "x", "batch_id"]
    assert all(r.batch_id == r.id // 100 for r in out.collect()) and out.count() == 1003
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan
    # the long side goes from the scan to the join: every exchange is on the side of the table of files
    long_side = plan.split("InMemoryTableScan")[0]
    assert "Exchange hashpartitioning" not in long_side and "rangepartitioning" not in long_side and "SortMergeJoin" not in long_side


def test_shuffled_passes_hold_every_row_once_and_straddle(scan):
    out = fb.shuffled_file_batches(scan.select("id"), 100, epochs=2, seed=5).toPandas()
    assert len(out) == 2006
    for epoch in (0, 1):
        assert sorted(out[out.epoch == epoch].id) == list(range(1003))
    sizes = out.groupby("batch_id").size()
    assert (sizes[:-1] == 100).all() and sizes.iloc[-1] == 6 and set(out[out.batch_id == 10].epoch) == {0, 1}


@pytest.mark.parametrize("limit", [1 << 26, 0])
def test_first_batches_are_those_of_all_passes(scan, limit):
    whole = fb.shuffled_file_batches(scan, 100, epochs=2, seed=5)
    for n in (0, 1, 11, 50):
        some = fb.first_shuffled_file_batches(scan, n, 100, epochs=2, seed=5, limit=limit)
        key = lambda df: sorted((r.epoch, r.batch_id, r.id, r.x) for r in df.collect())
        assert key(some) == key(whole.where(F.col("batch_id") < n))


def test_first_batches_open_only_their_files(spark):
    path = scratch_path(spark, "many")
    spark.range(0, 4000, 1, 40).write.parquet(path)
    scan = spark.read.parquet(path)
    some = fb.first_shuffled_file_batches(scan, 1, 5, seed=1)
    assert some.count() == 5
    plan = some._jdf.queryExecution().optimizedPlan().toString()
    wanted = [line for line in plan.splitlines() if "file_path IN" in line]
    assert wanted and wanted[0].count("part-") <= 5


def test_permuted_batches_of_ranks(spark):
    ranked = spark.range(50).select(F.col("id").alias("rank"))
    whole = {tuple(r) for r in fb.permuted_batches(ranked, "rank", 50, 8, 3, 2).collect()}
    assert len(whole) == 150
    some = {tuple(r) for r in fb.permuted_batches(ranked, "rank", 50, 8, 3, 2, first=9).collect()}
    assert some == {r for r in whole if r[2] < 9} and max(r[1] for r in some) == 1
    assert fb.permuted_batches(ranked, "rank", 50, 8, 3, 2, first=0).count() == 0
    assert fb.permuted_batches(ranked.limit(0), "rank", 0, 8, 2).count() == 0
