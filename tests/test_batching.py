import math

import pytest
from pyspark.sql import functions as F

from mixframe.operators import batching
from mixframe.operators.fitting import init_sample
from mixframe.operators.lookup import lookup_join, salted_join


def ids(spark, values):
    return spark.createDataFrame([(int(v),) for v in values], "id long")


@pytest.mark.parametrize("per_bucket", [None, 7, 50])
def test_sequential_matches_brute_force_on_uneven_ids(spark, per_bucket):
    # a third of the ids crowd into one narrow range, the rest are spread over many orders of magnitude
    values = [*range(100, 140), *[3**i for i in range(36)], *[-(5**i) for i in range(27)]]
    values = sorted(set(values))
    out = batching.sequential_batches(ids(spark, values).repartition(5), "id", 8, rows_per_bucket=per_bucket)
    expected = {v: i // 8 for i, v in enumerate(values)}
    assert {r.id: r.batch_id for r in out.collect()} == expected


def test_only_the_last_batch_is_short(spark):
    out = batching.sequential_batches(spark.range(1000), "id", 128, rows_per_bucket=90)
    sizes = [r["count"] for r in out.groupBy("batch_id").count().orderBy("batch_id").collect()]
    assert sizes == [128] * 7 + [104]


def test_ids_beyond_double_precision_stay_ordered(spark):
    values = [2**60 + i for i in range(50)]
    out = batching.global_rank(ids(spark, values), "id", rows_per_bucket=5)
    assert {r.id: r.rank for r in out.collect()} == {v: i for i, v in enumerate(values)}


def test_text_composite_and_no_ids(spark):
    rows = [(w, i) for w in ("b", "a", "ab", "") for i in range(9)]
    df = spark.createDataFrame([*rows, (None, 1)], "w string, i int").repartition(5)
    out = batching.sequential_batches(df, ["w", "i"], 4).collect()
    ordered = [(None, 1), *sorted(rows)]
    assert {(r.w, r.i): r.batch_id for r in out} == {row: n // 4 for n, row in enumerate(ordered)}
    by_text = batching.id_rank(df.dropDuplicates(["w"]), ["w"]).collect()
    assert [r.w for r in sorted(by_text, key=lambda r: r["rank"])] == [None, "", "a", "ab", "b"]
    assert sorted(r["rank"] for r in batching.id_rank(df, []).collect()) == list(range(37))
    with pytest.raises(TypeError):
        batching.global_rank(df, "w")


def test_ranks_of_many_epochs(spark):
    out = batching.shuffled_batches(spark.range(50), "id", 1, epochs=7, seed=3, rows_per_bucket=4).collect()
    assert sorted(r.batch_id for r in out) == list(range(350))
    assert all(r.batch_id // 50 == r.epoch for r in out)


def test_empty_table(spark):
    assert batching.sequential_batches(spark.range(0), "id").count() == 0
    assert init_sample(spark.range(0), "id", 2, 8).count() == 0


def test_shuffled_does_not_depend_on_partitions_or_buckets(spark):
    def run(df, per_bucket):
        out = batching.shuffled_batches(df, "id", 16, epochs=3, seed=2, rows_per_bucket=per_bucket)
        return sorted((r.epoch, r.batch_id, r.id) for r in out.collect())

    first = run(spark.range(100), None)
    assert first == run(spark.range(100).repartition(7), 9)
    assert len(first) == 300 and max(b for _, b, _ in first) == math.ceil(300 / 16) - 1
    by_epoch = [[i for e, _, i in first if e == epoch] for epoch in range(3)]
    assert all(sorted(epoch) == list(range(100)) for epoch in by_epoch) and by_epoch[0] != by_epoch[1]


def test_a_batch_may_straddle_epochs(spark):
    out = batching.shuffled_batches(spark.range(10), "id", 8, epochs=2)
    assert {r.epoch for r in out.filter("batch_id = 1").collect()} == {0, 1}


@pytest.mark.parametrize("n", [1, 17, 99, 100])
def test_first_rows_equal_the_ranked_prefix(spark, n):
    wanted = {r.id for r in batching.shuffled_batches(spark.range(100), "id", n, seed=4).filter("batch_id = 0").collect()}
    assert {r.id for r in batching.first_shuffled_rows(spark.range(100), "id", n, seed=4).collect()} == wanted


def test_init_sample_sizes(spark):
    rows = spark.range(3000)
    assert init_sample(rows, "id", 3, 100).count() == 300
    assert init_sample(rows, "id", 1.5, 100).count() == 200
    assert init_sample(rows, "id", 0.25, 1024).count() == 64
    assert init_sample(rows, "id", 0.001, 1024).count() == 1
    assert init_sample(rows, "id", 0.5, 32).count() == 32


def test_init_sample_may_need_several_epochs(spark):
    pool = init_sample(spark.range(10), "id", 3, 8)
    assert pool.columns == ["id"] and pool.count() == 24


def test_salted_and_broadcast_joins_agree_on_a_hot_key(spark):
    long = spark.range(300).withColumn("k", F.when(F.col("id") < 100, 0).otherwise(F.col("id") % 50))
    lookup = spark.range(40).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    for how in ("inner", "left"):
        plain = sorted(long.join(lookup, "k", how).select("id", "v").collect(), key=str)
        assert sorted(salted_join(long, lookup, "k", how).select("id", "v").collect(), key=str) == plain
        assert sorted(lookup_join(long, lookup, "k", 16, how).select("id", "v").collect(), key=str) == plain
        assert sorted(lookup_join(long, lookup, "k", 16, how, limit=0).select("id", "v").collect(), key=str) == plain


def test_salting_spreads_the_hot_key(spark):
    long = spark.range(4000).withColumn("k", F.lit(1))
    joined = salted_join(long, spark.range(3).withColumnRenamed("id", "k"), "k", salts=8)
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    assert "xxhash64" in plan and joined.count() == 4000


def test_a_repeated_key_falls_back_to_the_sort(spark, monkeypatch):
    monkeypatch.setattr(batching, "BUCKET_ROWS", 4)
    values = sorted([*range(60), *[25] * 300])
    df = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "id long, row long").repartition(6)
    out = batching.sequential_batches(df, "id", 16)
    assert out.columns == ["id", "row", "batch_id"]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "ExistingRDD" in plan
    batch_of = sorted((r.id, r.batch_id) for r in out.collect())
    assert batch_of == [(v, i // 16) for i, v in enumerate(values)]
    shuffled = batching.shuffled_batches(df, "id", 16, epochs=2).collect()
    sizes = {b: sum(r.batch_id == b for r in shuffled) for b in {r.batch_id for r in shuffled}}
    assert len(shuffled) == 720 and set(sizes.values()) == {16}


def test_sorted_rank_spreads_copies(spark):
    df = spark.range(4000).select(F.lit(7).alias("id"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    out = batching.sorted_rank(df, ["id"], "rank")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted(r["rank"] for r in out.collect()) == list(range(4000))
    sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) > 1 and max(sizes) < 3000


def test_only_needed_rows_are_encoded(spark):
    from mixframe.functions import hashing

    df = spark.range(100).withColumn("v", F.array(F.lit(1.0)))
    noisy = df.withColumn("n", hashing.add_noise("v", "id", 1.0)).filter("id < 3")
    plan = noisy._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("ArrowEvalPython") < plan.index("Filter")


def test_cuts_from_a_sample_give_the_same_ranks(spark, monkeypatch):
    monkeypatch.setattr(batching, "KEYS_PER_BUCKET", 5)
    out = batching.global_rank(spark.range(3000).withColumn("id", F.col("id") * 7 - 400), "id", rows_per_bucket=100)
    assert all(r.id == r["rank"] * 7 - 400 for r in out.collect())


@pytest.mark.parametrize("per_bucket", [None, 4])
def test_rows_without_an_id_are_kept(spark, per_bucket):
    df = spark.createDataFrame([(None,), (None,), *[(i,) for i in range(20)]], "id long")
    out = batching.global_rank(df, "id", rows_per_bucket=per_bucket).collect()
    assert sorted(r["rank"] for r in out) == list(range(22))
    assert {r["rank"] for r in out if r.id is None} == {0, 1}


@pytest.mark.parametrize("per_bucket", [None, 10, 1])
def test_odd_keys_rank_alike_in_few_and_many_buckets(spark, per_bucket):
    keys = [None, float("nan"), float("inf"), float("-inf"), 2.0, 2.0, float("nan")] + [float(i) for i in range(30)]
    df = spark.createDataFrame([(k,) for k in keys], "k double").repartition(3)
    found = batching.global_rank(df, "k", rows_per_bucket=per_bucket).collect()
    key = lambda k: (k is not None, k is not None and k != k, 0.0 if k is None or k != k else k)
    assert [str(r.k) for r in sorted(found, key=lambda r: r["rank"])] == [str(k) for k in sorted(keys, key=key)]
    assert sorted(r["rank"] for r in found) == list(range(len(keys)))
