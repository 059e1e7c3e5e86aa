"""Mini-batch ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from mixframe.catalog.base import Query, table
from mixframe.functions.permutation import place_sql
from mixframe.operators import batching, file_batches
from mixframe.operators.fitting import init_sample
from mixframe.session import scratch_path

FILES = 8


def _sequential(spark: SparkSession, folder: str) -> DataFrame:
    return batching.sequential_batches(table(spark, folder, "orders").select("o_orderkey"), "o_orderkey")


def _composite(spark: SparkSession, folder: str) -> DataFrame:
    """Batches in the order of a text and a number."""
    customers = table(spark, folder, "customer").select("c_mktsegment", "c_custkey")
    return batching.sequential_batches(customers, ["c_mktsegment", "c_custkey"], 128)


def _shuffled(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events").select("event_id")
    return batching.shuffled_batches(events, "event_id", 512, epochs=2, seed=7)


def _taken(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events").select("event_id", "event_type")
    return batching.take_batches(batching.sequential_batches(events, "event_id", 256), 5)


def _pool(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    return init_sample(orders, "o_orderkey", 5, 100, seed=3)


def _fraction(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    return init_sample(orders, "o_orderkey", 0.5, 1024, seed=3)


def _files(spark: SparkSession, folder: str) -> DataFrame:
    """A copy of the orders in several files, sorted by key, so that SQL can tell the order of the files."""
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    path = scratch_path(spark, "orders")
    orders.repartitionByRange(FILES, "o_orderkey").sortWithinPartitions("o_orderkey").write.parquet(path)
    return spark.read.parquet(path)


def _file_order(spark: SparkSession, folder: str) -> DataFrame:
    return file_batches.sequential_batches_file_order(_files(spark, folder).select("o_orderkey", "o_custkey"))


def _permuted(spark: SparkSession, folder: str) -> DataFrame:
    return file_batches.shuffled_file_batches(_files(spark, folder).select("o_orderkey"), 512, epochs=3, seed=7)


def _permuted_ranks(spark: SparkSession, folder: str) -> DataFrame:
    """The same for a table without files of its own: ranked once by its id."""
    events = table(spark, folder, "events").select("event_id")
    ranked = batching.global_rank(events, "event_id", "rank")
    return file_batches.permuted_batches(ranked, "rank", events.count(), 512, epochs=2, seed=1).drop("rank")


def _first_permuted(spark: SparkSession, folder: str) -> DataFrame:
    return file_batches.first_shuffled_file_batches(_files(spark, folder), 3, 100, epochs=2, seed=7)


def permuted_sql(source: str, key: str, epochs: int, seed: int) -> str:
    """CTE ``placed``: the rows of every epoch with their place in it."""
    numbered = f"numbered AS (SELECT *, (row_number() OVER (ORDER BY {key}) - 1)::BIGINT AS rank FROM {source})"
    return f"{numbered},\n{place_sql('numbered', 'rank', seed, epochs)}"


def shuffled_sql(source: str, key: str, epochs: int, seed: int) -> str:
    digest = f"md5({key}::VARCHAR || ':' || epoch::VARCHAR || ':{seed}')"
    return f"""shuffled AS (
  SELECT *, row_number() OVER (ORDER BY epoch, ('0x' || substr({digest}, 1, 15))::BIGINT, {key}) - 1 AS rank
  FROM {source} CROSS JOIN (SELECT unnest(range({epochs}))::INTEGER AS epoch))"""


QUERIES = [
    Query(
        "sequential_batches",
        _sequential,
        """SELECT o_orderkey, floor((row_number() OVER (ORDER BY o_orderkey) - 1) / 512)::BIGINT AS batch_id
FROM orders""",
    ),
    Query(
        "sequential_batches_composite",
        _composite,
        """SELECT c_mktsegment, c_custkey,
       floor((row_number() OVER (ORDER BY c_mktsegment, c_custkey) - 1) / 128)::BIGINT AS batch_id
FROM customer""",
    ),
    Query(
        "shuffled_batches",
        _shuffled,
        f"""WITH {shuffled_sql("events", "event_id", 2, 7)}
SELECT event_id, epoch, floor(rank / 512)::BIGINT AS batch_id FROM shuffled""",
    ),
    Query(
        "sequential_batches_file_order",
        _file_order,
        """SELECT o_orderkey, o_custkey, floor((row_number() OVER (ORDER BY o_orderkey) - 1) / 512)::BIGINT AS batch_id
FROM orders""",
    ),
    Query(
        "shuffled_file_batches",
        _permuted,
        f"""WITH RECURSIVE {permuted_sql("orders", "o_orderkey", 3, 7)}
SELECT o_orderkey, epoch, ((epoch * rows + place) // 512)::BIGINT AS batch_id FROM placed""",
    ),
    Query(
        "permuted_batches",
        _permuted_ranks,
        f"""WITH RECURSIVE {permuted_sql("events", "event_id", 2, 1)}
SELECT event_id, epoch, ((epoch * rows + place) // 512)::BIGINT AS batch_id FROM placed""",
    ),
    Query(
        "first_shuffled_file_batches",
        _first_permuted,
        f"""WITH RECURSIVE {permuted_sql("orders", "o_orderkey", 2, 7)}
SELECT o_orderkey, o_custkey, o_totalprice, epoch, ((epoch * rows + place) // 100)::BIGINT AS batch_id FROM placed
WHERE (epoch * rows + place) < 300""",
    ),
    Query(
        "take_batches",
        _taken,
        """WITH b AS (
  SELECT event_id, event_type, floor((row_number() OVER (ORDER BY event_id) - 1) / 256)::BIGINT AS batch_id FROM events)
SELECT * FROM b WHERE batch_id < 5""",
    ),
    Query(
        "init_sample",
        _pool,
        f"""WITH {shuffled_sql("orders", "o_orderkey", 1, 3)}
SELECT o_orderkey, o_custkey FROM shuffled WHERE rank < 500""",
    ),
    Query(
        "init_sample_fraction",
        _fraction,
        f"""WITH {shuffled_sql("orders", "o_orderkey", 1, 3)}
SELECT o_orderkey, o_custkey FROM shuffled WHERE rank < 128""",
    ),
]
