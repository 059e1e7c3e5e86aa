"""Schedules over a step column: order keys as steps of the series schedule, 13 times as many for the image one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mixframe.catalog.base import Query, rounded, table
from mixframe.functions import schedule
from mixframe.functions.schedule import Schedule

SERIES = Schedule(gamma_steps=6000, init_steps=5, beta_steps=3900, static_steps=100, max_steps=10100, gamma=2e-6)
IMAGES = Schedule(gamma_steps=100000, init_steps=200, beta_steps=9000, static_steps=1000, max_steps=195000, gamma=5e-4)


def _steps(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").select("o_orderkey", (F.col("o_orderkey") * 13).alias("step"))


def _phase(spark: SparkSession, folder: str) -> DataFrame:
    return _steps(spark, folder).select(
        "o_orderkey",
        SERIES.phase("o_orderkey").alias("series_phase"),
        SERIES.cycle("o_orderkey").alias("series_cycle"),
        IMAGES.phase("step").alias("image_phase"),
        IMAGES.cycle("step").alias("image_cycle"),
    )


def _anneal(spark: SparkSession, folder: str) -> DataFrame:
    return _steps(spark, folder).select(
        "o_orderkey",
        rounded(SERIES.anneal_factor("o_orderkey"), 9).alias("series_factor"),
        rounded(IMAGES.anneal_factor("step"), 9).alias("image_factor"),
    )


def _momentum(spark: SparkSession, folder: str) -> DataFrame:
    return _steps(spark, folder).select(
        "o_orderkey", rounded(schedule.momentum(IMAGES.anneal_factor("step")), 9).alias("momentum")
    )


def _rate(spark: SparkSession, folder: str) -> DataFrame:
    return _steps(spark, folder).select(
        "o_orderkey",
        rounded(schedule.learning_rate("step", 0.002, "Exponential", (1000, 0.96), 1e-6), 9).alias("image_rate"),
        rounded(schedule.learning_rate("o_orderkey", 0.0015, "Exponential", (150, 0.9), 1.2e-6), 9).alias("series_rate"),
        rounded(schedule.learning_rate("step"), 9).alias("default_rate"),
        rounded(schedule.learning_rate("step", 1e-7, "Constant", minimum=1e-6), 9).alias("floored_rate"),
        rounded(schedule.learning_rate("step", 1e-7, "Other", minimum=1e-6), 9).alias("other_rate"),
    )


def _phase_sql(step: str, s: Schedule, name: str) -> str:
    offset = f"({step} - {s.warmup})"
    within = f"((({offset}) % {s.period} + {s.period}) % {s.period})"
    return f"""CASE WHEN {step} = 0 THEN 'start' WHEN {offset} <= -{s.init_steps} THEN 'gamma'
    WHEN {offset} <= 0 THEN 'gmm_init' WHEN {within} BETWEEN 1 AND {s.beta_steps} THEN 'beta' ELSE 'static' END AS {name}_phase,
  CASE WHEN {offset} > 0 THEN {offset} // {s.period} + 1 END::BIGINT AS {name}_cycle"""


def _anneal_sql(step: str, s: Schedule) -> str:
    offset = f"least(greatest({step} - {s.warmup}, 0), {s.max_steps})"
    return f"pow(least({offset} % {s.period}, {s.beta_steps})::DOUBLE / {s.beta_steps}, 3) + {s.gamma}"


STEP = "(o_orderkey * 13)"
QUERIES = [
    Query(
        "schedule_phase",
        _phase,
        f"SELECT o_orderkey, {_phase_sql('o_orderkey', SERIES, 'series')}, {_phase_sql(STEP, IMAGES, 'image')} FROM orders",
    ),
    Query(
        "anneal_factor",
        _anneal,
        f"""SELECT o_orderkey, round({_anneal_sql("o_orderkey", SERIES)}, 9) + 0.0 AS series_factor,
       round({_anneal_sql(STEP, IMAGES)}, 9) + 0.0 AS image_factor
FROM orders""",
    ),
    Query(
        "momentum",
        _momentum,
        f"SELECT o_orderkey, round(pow(1 - ({_anneal_sql(STEP, IMAGES)}), 3), 9) + 0.0 AS momentum FROM orders",
    ),
    Query(
        "learning_rate",
        _rate,
        f"""SELECT o_orderkey, round(greatest(0.002 * pow(0.96, {STEP} / 1000.0), 1e-6), 9) + 0.0 AS image_rate,
       round(greatest(0.0015 * pow(0.9, o_orderkey / 150.0), 1.2e-6), 9) + 0.0 AS series_rate,
       0.01::DOUBLE AS default_rate, 1e-6::DOUBLE AS floored_rate, 1e-7::DOUBLE AS other_rate
FROM orders""",
    ),
]
