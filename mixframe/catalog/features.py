"""Feature transforms on events, conversations, documents and embeddings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mixframe.catalog.base import ELEMENTS, Query, Run, latent, long, table
from mixframe.catalog.tables import column, embeddings_config, events_config
from mixframe.config import TableConfig
from mixframe.functions import features, hashing
from mixframe.operators import frames

VOCABULARY = ["click", "error", "purchase", "signup"]
ROLES = ["assistant", "system"]
EMBEDDING_SIZE = 8
BUCKET = "('0x' || substr(md5({0}::VARCHAR), 1, 8))::BIGINT % {1}"
USER_BUCKET = BUCKET.format("user_id", 100)


def bucket_vectors(buckets: DataFrame) -> DataFrame:
    """Embedding table of the buckets that occur: position d of bucket b holds sin(b + d)."""
    positions = F.sequence(F.lit(0), F.lit(EMBEDDING_SIZE - 1))
    return buckets.select("bucket", F.transform(positions, lambda d: F.sin(F.col("bucket") + d)).alias("vec"))


def _user_vectors(spark: SparkSession, folder: str) -> DataFrame:
    users = table(spark, folder, "events").select(hashing.hash_bucket("user_id", 100).alias("bucket"))
    return bucket_vectors(users.distinct())


def _numeric(spark: SparkSession, folder: str) -> DataFrame:
    spec = embeddings_config(folder).columns["embedding"]
    checked = table(spark, folder, "embeddings").select("vec_id", features.numeric(spec))
    return long(checked, ["vec_id"], "embedding")


def _vocab(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events")
    return long(events.select("event_id", features.vocab_indicator("event_type", VOCABULARY).alias("v")), ["event_id"], "v")


def _vocab_list(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations").groupBy("conv_id").agg(F.collect_list("role").alias("roles"))
    counted = turns.select("conv_id", features.vocab_indicator("roles", ROLES, many=True).alias("v"))
    return long(counted, ["conv_id"], "v")


def _hash(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select(
        "doc_id",
        hashing.hash_bucket("source", 16).alias("source_bucket"),
        hashing.hash_bucket("text", 20000).alias("text_bucket"),
    )


def _lookup(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events").select("event_id", hashing.hash_bucket("user_id", 100).alias("bucket"))
    out = frames.bucket_embedding(events, "bucket", _user_vectors(spark, folder), EMBEDDING_SIZE, "vec")
    return long(out, ["event_id"], "vec")


def _lookup_mean(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations").select("conv_id", hashing.hash_bucket("text", 50).alias("bucket"))
    vectors = bucket_vectors(turns.select("bucket").distinct())
    rows = turns.groupBy("conv_id").agg(F.collect_list("bucket").alias("buckets"))
    out = frames.bucket_embedding_mean(rows, "buckets", vectors, EMBEDDING_SIZE, "vec")
    return long(out, ["conv_id"], "vec")


def _assemble(spark: SparkSession, folder: str) -> DataFrame:
    tables = {"user_id": _user_vectors(spark, folder)}
    out = frames.assemble_features(table(spark, folder, "events"), events_config(folder), "x", tables)
    return long(out, ["event_id"], "x", digits=5)


def roles_config() -> TableConfig:
    return TableConfig.from_dict(
        {
            "idCols": ["conv_id"],
            "featureColumns": [
                column("conv_id", "INTEGER"),
                column("roles", "STRING", [2], kind="fcHashEmbedding", hashSize=50, embeddingSize=EMBEDDING_SIZE),
            ],
        }
    )


def _roles(spark: SparkSession, folder: str) -> tuple[DataFrame, dict[str, DataFrame]]:
    """All roles of every conversation, and the vectors of their buckets."""
    turns = table(spark, folder, "conversations")
    said = F.array_sort(F.collect_list(F.struct("turn", "role")).alias("t"))
    whole = turns.groupBy("conv_id").agg(said.alias("t")).select("conv_id", F.col("t.role").alias("roles"))
    return whole, {"roles": bucket_vectors(turns.select(hashing.hash_bucket("role", 50).alias("bucket")).distinct())}


def _assemble_list(spark: SparkSession, folder: str) -> DataFrame:
    rows, tables = _roles(spark, folder)
    return long(frames.assemble_features(rows, roles_config(), "x", tables), ["conv_id"], "x", digits=5)


def _cube_list(spark: SparkSession, folder: str) -> DataFrame:
    rows, tables = _roles(spark, folder)
    return long(frames.to_cube(rows, roles_config(), (2, 2), tables=tables), ["conv_id"], "x", digits=5)


ROLE_MEANS = f"""SELECT conv_id, d, round(avg(sin({BUCKET.format("role", 50)} + d)), 5) + 0.0 AS value
FROM conversations CROSS JOIN (SELECT unnest(range(8)) AS d) GROUP BY conv_id, d"""


def cube_config() -> TableConfig:
    return TableConfig.from_dict(
        {
            "idCols": ["event_id"],
            "featureColumns": [
                column("event_id", "INTEGER"),
                column("embedding", "FLOAT", [64]),
                column("event_type", "STRING", kind="fcVocabIndicator", vocabulary=VOCABULARY),
                column("value", "FLOAT"),
            ],
        }
    )


def _cube(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings").select("vec_id", "embedding")
    events = table(spark, folder, "events").select("event_id", "event_type", "value")
    rows = events.withColumn("vec_id", F.pmod("event_id", F.lit(vectors.count()))).join(vectors, "vec_id")
    out = frames.to_cube(rows, cube_config(), (12, 12), (40, 40), (6, 9))
    return long(out, ["event_id"], "x", digits=5)


def _vector(make: Callable[[], Column]) -> Run:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return long(latent(spark, folder).withColumn("v", make()), ["vec_id"], "v")

    return run


def _frame(spark: SparkSession, folder: str) -> DataFrame:
    framed = latent(spark, folder).select("vec_id", F.posexplode(features.frame_rows("z_mu", 8, 8)).alias("r", "cells"))
    return long(framed, ["vec_id", "r"], "cells", pos="c")


def _scalar_plane(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events")
    return long(events.select("event_id", features.scalar_plane("value", 2, 3).alias("v")), ["event_id"], "v")


def _categorical(spark: SparkSession, folder: str) -> DataFrame:
    vector = features.vocab_indicator("event_type", VOCABULARY)
    planes = features.categorical_planes(vector, len(VOCABULARY), 2, 2)
    stacked = table(spark, folder, "events").select("event_id", F.concat(*planes).alias("v"))
    return long(stacked, ["event_id"], "v")


def _stack() -> Column:
    halves = [F.slice("z_mu", 1, 32), F.slice("z_mu", 33, 32)]
    return features.stack_channels(halves)


def _cast(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", features.cast_float(F.array("l_extendedprice", "l_tax")).alias("v")
    )
    return lines.select("l_orderkey", "l_linenumber", "l_partkey", F.posexplode("v").alias("pos", "value"))


# Normal numbers of SplitMix64 for each element: ``noise`` has vec_id, d and eps.
def normals_sql(seed: int) -> str:
    def mixed(expr: str, shift: int, factor: int) -> str:
        return f"((xor({expr}, {expr} >> {shift})::UHUGEINT * {factor}::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT"

    return f"""seeds AS (
  SELECT vec_id, d, side, ((('0x' || substr(md5(vec_id::VARCHAR || ':{seed}'), 1, 15))::BIGINT::UHUGEINT
         + (2 * d + side)::UHUGEINT * {hashing.GOLDEN}::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT AS s0
  FROM e CROSS JOIN (SELECT unnest([1, 2]) AS side)),
m1 AS (SELECT *, {mixed("s0", 30, hashing.MIX_1)} AS s1 FROM seeds),
m2 AS (SELECT *, {mixed("s1", 27, hashing.MIX_2)} AS s2 FROM m1),
u AS (SELECT vec_id, d, side, ((xor(s2, s2 >> 31) >> 32)::DOUBLE + 0.5) / 4294967296 AS u FROM m2),
noise AS (
  SELECT a.vec_id, a.d, sqrt(-2 * ln(a.u)) * cos(2 * pi() * b.u) AS eps
  FROM u a JOIN u b ON a.vec_id = b.vec_id AND a.d = b.d AND a.side = 1 AND b.side = 2)"""


def resize_sql(source: str, frame: tuple[int, int], target: tuple[int, int], ids: str) -> str:
    """Bilinear resampling of a CTE (ids, ch, y, x, value) as CTE ``resized`` (ids, ch, y, x, value)."""
    (h, w), (h2, w2) = frame, target
    axis = """SELECT i, least(floor(i * {n}::DOUBLE / {m})::INTEGER, {n} - 1) AS lo,
      least(least(floor(i * {n}::DOUBLE / {m})::INTEGER, {n} - 1) + 1, {n} - 1) AS hi,
      i * ({n}::DOUBLE / {m}) - least(floor(i * {n}::DOUBLE / {m})::INTEGER, {n} - 1) AS f
    FROM (SELECT unnest(range({m})) AS i)"""
    return f"""ys AS ({axis.format(n=h, m=h2)}),
xs AS ({axis.format(n=w, m=w2)}),
tap AS (
  SELECT ys.i AS y, xs.i AS x, unnest([lo_y, lo_y, hi_y, hi_y]) AS sy, unnest([lo_x, hi_x, lo_x, hi_x]) AS sx,
         unnest([(1 - fy) * (1 - fx), (1 - fy) * fx, fy * (1 - fx), fy * fx]) AS weight
  FROM (SELECT i, lo AS lo_y, hi AS hi_y, f AS fy FROM ys) ys CROSS JOIN (SELECT i, lo AS lo_x, hi AS hi_x, f AS fx FROM xs) xs),
resized AS (
  SELECT {ids}, ch, tap.y, tap.x, sum(weight * value) AS value
  FROM {source} s JOIN tap ON s.y = tap.sy AND s.x = tap.sx GROUP BY {ids}, ch, tap.y, tap.x)"""


INDICATOR = "unnest([" + ", ".join(f"(event_type = '{v}')::DOUBLE" for v in VOCABULARY) + "])"

QUERIES = [
    Query("numeric", _numeric, f"WITH {ELEMENTS}\nSELECT vec_id, d::INTEGER AS pos, round(x, 6) + 0.0 AS value FROM e"),
    Query(
        "vocab_indicator",
        _vocab,
        f"SELECT event_id, unnest(range(4))::INTEGER AS pos, {INDICATOR} AS value FROM events",
    ),
    Query(
        "vocab_indicator_list",
        _vocab_list,
        """SELECT conv_id, unnest([0, 1])::INTEGER AS pos,
       unnest([count_if(role = 'assistant')::DOUBLE, count_if(role = 'system')::DOUBLE]) AS value
FROM conversations GROUP BY conv_id""",
    ),
    Query(
        "hash_bucket",
        _hash,
        f"""SELECT doc_id, ({BUCKET.format("source", 16)})::INTEGER AS source_bucket,
       ({BUCKET.format("text", 10000)})::INTEGER AS text_bucket
FROM documents""",
    ),
    Query(
        "bucket_embedding",
        _lookup,
        f"""SELECT event_id, d::INTEGER AS pos, round(sin({USER_BUCKET} + d), 6) + 0.0 AS value
FROM events CROSS JOIN (SELECT unnest(range(8)) AS d)""",
    ),
    Query(
        "bucket_embedding_mean",
        _lookup_mean,
        f"""SELECT conv_id, d::INTEGER AS pos, round(avg(sin({BUCKET.format("text", 50)} + d)), 6) + 0.0 AS value
FROM conversations CROSS JOIN (SELECT unnest(range(8)) AS d) GROUP BY conv_id, d""",
    ),
    Query(
        "assemble",
        _assemble,
        f"""SELECT event_id, unnest(range(4))::INTEGER AS pos, {INDICATOR} AS value FROM events
UNION ALL SELECT event_id, (4 + d)::INTEGER, round(sin({USER_BUCKET} + d), 5) + 0.0
FROM events CROSS JOIN (SELECT unnest(range(8)) AS d)
UNION ALL SELECT event_id, 12, round(value::FLOAT::DOUBLE, 5) + 0.0 FROM events""",
    ),
    Query("assemble_list_embedding", _assemble_list, f"SELECT conv_id, d::INTEGER AS pos, value FROM ({ROLE_MEANS})"),
    Query(
        "to_cube_list_embedding",
        _cube_list,
        f"""SELECT conv_id, (cell * 8 + d)::INTEGER AS pos, value
FROM ({ROLE_MEANS}) CROSS JOIN (SELECT unnest(range(4)) AS cell)""",
    ),
    Query(
        "to_cube",
        _cube,
        f"""WITH rows AS (SELECT event_id, embedding, event_type, value::FLOAT::DOUBLE AS value
  FROM events JOIN embeddings ON vec_id = event_id % (SELECT count(*) FROM embeddings)),
cells AS (SELECT unnest(range(144)) AS cell),
planes AS (
  SELECT event_id, 0 AS ch, cell // 12 AS y, cell % 12 AS x,
         CASE WHEN cell BETWEEN 40 AND 103 THEN embedding[cell - 39]::DOUBLE ELSE 0 END AS value FROM rows, cells
  UNION ALL SELECT event_id, 1 + v.i, cell // 12, cell % 12, (event_type = v.name)::INTEGER::DOUBLE
  FROM rows, cells, (SELECT unnest({VOCABULARY}) AS name, unnest(range(4)) AS i) v
  UNION ALL SELECT event_id, 5, cell // 12, cell % 12, value FROM rows, cells),
{resize_sql("planes", (12, 12), (6, 9), "event_id")}
SELECT event_id, ((y * 9 + x) * 6 + ch)::INTEGER AS pos, round(value, 5) + 0.0 AS value FROM resized""",
    ),
    Query(
        "pad",
        _vector(lambda: features.pad("z_mu", 40, 40)),
        """SELECT vec_id, i::INTEGER AS pos,
       round(CASE WHEN i BETWEEN 40 AND 103 THEN embedding[i - 39]::DOUBLE ELSE 0 END, 6) + 0.0 AS value
FROM embeddings CROSS JOIN (SELECT unnest(range(144)) AS i)""",
    ),
    Query(
        "to_frame",
        _frame,
        f"""WITH {ELEMENTS}
SELECT vec_id, (d // 8)::INTEGER AS r, (d % 8)::INTEGER AS c, round(x, 6) + 0.0 AS value FROM e""",
    ),
    Query(
        "scalar_plane",
        _scalar_plane,
        """SELECT event_id, i::INTEGER AS pos, round(value, 6) + 0.0 AS value
FROM events CROSS JOIN (SELECT unnest(range(6)) AS i)""",
    ),
    Query(
        "categorical_planes",
        _categorical,
        f"""SELECT event_id, (v.i * 4 + p)::INTEGER AS pos, (event_type = v.name)::INTEGER::DOUBLE AS value
FROM events CROSS JOIN (SELECT unnest({VOCABULARY}) AS name, unnest(range(4)) AS i) v
CROSS JOIN (SELECT unnest(range(4)) AS p)""",
    ),
    Query(
        "stack_channels",
        _vector(_stack),
        f"""WITH {ELEMENTS}
SELECT vec_id, ((d % 32) * 2 + d // 32)::INTEGER AS pos, round(x, 6) + 0.0 AS value FROM e""",
    ),
    Query(
        "resize_bilinear",
        _vector(lambda: features.resize_bilinear("z_mu", (8, 8), (12, 5))),
        f"""WITH {ELEMENTS},
f AS (SELECT vec_id, 0 AS ch, d // 8 AS y, d % 8 AS x, x AS value FROM e),
{resize_sql("f", (8, 8), (12, 5), "vec_id")}
SELECT vec_id, (y * 5 + x)::INTEGER AS pos, round(value, 6) + 0.0 AS value FROM resized""",
    ),
    Query(
        "cast_float",
        _cast,
        """SELECT l_orderkey, l_linenumber, l_partkey, unnest([0, 1])::INTEGER AS pos,
       unnest([l_extendedprice::FLOAT, l_tax::FLOAT]) AS value
FROM lineitem""",
    ),
    Query(
        "add_noise",
        _vector(lambda: hashing.add_noise("z_mu", "vec_id", 0.1, seed=5)),
        f"""WITH {ELEMENTS},
{normals_sql(5)}
SELECT vec_id, d::INTEGER AS pos, round(x + 0.1 * eps, 6) + 0.0 AS value FROM e JOIN noise USING (vec_id, d)""",
    ),
]
