"""Histograms with fixed bins."""

import math

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mixframe.model import Mixture
from mixframe.operators import histograms as h


@given(st.floats(allow_nan=False))
def test_every_number_lies_in_its_bin(x):
    b = h.bins_of(np.array([x]))
    low, high = (float(v[0]) for v in h.edges_of(b))
    if b[0] > 0:
        assert low <= x < high or (math.isinf(x) and math.isinf(high))
    elif b[0] < 0:
        assert low < x <= high or (math.isinf(x) and math.isinf(low))
    else:
        assert low < x < high


def test_bins_meet_without_gaps():
    low, high = h.edges_of(np.arange(-h.SIDE, h.SIDE + 1))
    assert np.array_equal(high[:-1], low[1:]) and low[0] == -np.inf and high[-1] == np.inf


def test_one_query_for_all_columns(spark):
    rows = spark.createDataFrame(
        [(1, [1.0, None, -2.5], 3.0), (2, [], float("nan")), (3, None, None), (4, [float("inf")], -0.0)], "i int, v array<double>, s double"
    )
    model = Mixture(np.array([0.5, 0.5]), np.array([[0.0], [4.0]]), np.array([[1.0], [1.5]]))
    jobs = {}
    for columns in (["v"], ["v", "s", "i"]):
        group = f"histograms-{len(columns)}"
        spark.sparkContext.setJobGroup(group, "")
        found = h.histograms(rows, columns, model)
        jobs[group] = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    spark.sparkContext._jsc.clearJobGroup()
    # the adaptive planner runs the shuffle of the one query as a job of its own
    assert jobs["histograms-3"] == jobs["histograms-1"] <= 2
    got = {(r["name"], r["bin"]): r["n"] for r in found.collect() if r["n"]}
    expected = {}
    for name, values in {
        "v": [1.0, -2.5, math.inf], "s": [3.0, 0.0], "i": [1, 2, 3, 4], "pi": [0.5, 0.5], "mu": [0.0, 4.0], "var": [1.0, 1.5]
    }.items():
        for v in values:
            key = (name, int(h.bins_of(np.array([float(v)]))[0]))
            expected[key] = expected.get(key, 0) + 1
    assert got == expected
    bins = [r["bin"] for r in found.where("name = 'v'").orderBy("bin").collect()]
    assert bins == list(range(bins[0], bins[-1] + 1))


def test_counts_add_up(spark):
    rows = spark.range(500).select((F.col("id") - 200).alias("x"))
    parts = h.merged(h.column_counts(rows.where("x < 17"), ["x"]), h.column_counts(rows.where("x >= 17"), ["x"]))
    assert np.array_equal(parts["x"], h.column_counts(rows, ["x"])["x"])


def test_empty_clash_and_log(spark, tmp_path):
    none = spark.createDataFrame([], "mu double, x array<double>")
    assert h.histograms(none, ["mu", "x"]).count() == 0
    with pytest.raises(ValueError, match="mu"):
        h.histograms(none, ["mu"], Mixture(np.ones(1), np.zeros((1, 1)), np.ones((1, 1))))
    rows = spark.range(9).select(F.col("id").alias("x"))
    for _ in range(2):
        h.histogram_log("a", 3, h.histograms(rows, ["x"]), str(tmp_path / "log"))
    logged = spark.read.parquet(str(tmp_path / "log"))
    assert logged.agg(F.sum("n")).first()[0] == 9 and logged.select("run", "step").distinct().collect() == [("a", 3)]
