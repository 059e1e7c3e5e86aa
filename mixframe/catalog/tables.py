"""Sources, schemas, roles and embedding tables on the supplied tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mixframe.catalog.base import Query, rounded, table
from mixframe.config import TableConfig
from mixframe.sources import dataset, dataset_or_fallback, densify, select_roles, split_labels


def column(name: str, dtype: str, shape: list[int] | None = None, kind: str = "fcNumeric", **params: object) -> dict:
    return {"name": name, "shape": shape or [], "fcType": kind, "fcParam": {kind: {"dtype": dtype, **params}}}


def events_config(folder: str) -> TableConfig:
    return TableConfig.from_dict(
        {
            "idCols": ["event_id"],
            "featureColumns": [
                column("event_id", "INTEGER"),
                column("value", "FLOAT"),
                column("user_id", "INTEGER", kind="fcHashEmbedding", hashSize=100, embeddingSize=8),
                column(
                    "event_type", "STRING", kind="fcVocabIndicator", vocabulary=["click", "error", "purchase", "signup"]
                ),
            ],
            "dataSource": {"train": f"{folder}/events.parquet"},
        }
    )


def lines_config(folder: str) -> TableConfig:
    return TableConfig.from_dict(
        {
            "idCols": ["l_partkey", "l_orderkey"],
            "labelCols": ["l_returnflag"],
            "exceptCols": ["l_tax"],
            "noExportCols": ["l_discount"],
            "featureColumns": [
                column("l_orderkey", "INTEGER"),
                column("l_partkey", "INTEGER"),
                column("l_quantity", "FLOAT"),
                column("l_extendedprice", "FLOAT"),
                column("l_discount", "FLOAT"),
                column("l_tax", "FLOAT"),
                column("l_returnflag", "STRING", kind="fcVocabIndicator", vocabulary=["A", "N"]),
            ],
            "dataSource": {"train": f"{folder}/lineitem.parquet"},
        }
    )


def embeddings_config(folder: str) -> TableConfig:
    return TableConfig.from_dict(
        {
            "idCols": ["vec_id"],
            "labelCols": ["label"],
            "featureColumns": [
                column("vec_id", "INTEGER"),
                column("label", "INTEGER"),
                column("embedding", "FLOAT", [64]),
            ],
            "dataSource": {"train": f"{folder}/embeddings.parquet"},
        }
    )


def _dataset(spark: SparkSession, folder: str) -> DataFrame:
    return dataset(spark, events_config(folder), "train").select("event_id", "event_type", "user_id", "value")


def _fallback(spark: SparkSession, folder: str) -> DataFrame:
    found = dataset_or_fallback(spark, events_config(folder), "eval")
    return found.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id")
    )


def _schema(spark: SparkSession, folder: str) -> DataFrame:
    declared = dataset(spark, lines_config(folder), "train")
    kinds = [F.lit(f"{f.name}:{f.dataType.simpleString()}") for f in sorted(declared.schema.fields, key=lambda f: f.name)]
    filled = [F.count(f.name).alias(f.name) for f in declared.schema.fields]
    counted = declared.agg(*filled)
    pairs = [
        F.struct(kind.alias("declared"), F.col(f.name).alias("n"))
        for kind, f in zip(kinds, sorted(declared.schema.fields, key=lambda f: f.name), strict=True)
    ]
    return counted.select(F.inline(F.array(*pairs)))


def _roles(spark: SparkSession, folder: str) -> DataFrame:
    config = lines_config(folder)
    exported = select_roles(dataset(spark, config, "train"), config, "export")
    return exported.select(*[F.col(c).cast("double") if c.startswith("l_ext") else c for c in exported.columns])


def _no_export(spark: SparkSession, folder: str) -> DataFrame:
    config = lines_config(folder)
    kept = select_roles(dataset(spark, config, "train"), config, "no_export", "labels")
    return kept.groupBy("l_returnflag").agg(rounded(F.avg(F.col("l_discount").cast("double"))).alias("mean_discount"))


def _labels(spark: SparkSession, folder: str) -> DataFrame:
    config = embeddings_config(folder)
    features, labels = split_labels(dataset(spark, config, "train"), config)
    widths = features.select("vec_id", F.size("embedding").alias("width"))
    return widths.join(labels, "vec_id")


def _densify(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", F.nullif("lang", F.lit("en")).alias("lang"))
    joined = documents.join(table(spark, folder, "labels"), "doc_id", "left")
    return densify(joined, ["lang", "quality", "toxic"])


QUERIES = [
    Query(
        "dataset_events",
        _dataset,
        "SELECT event_id, event_type, user_id, value::FLOAT AS value FROM events",
    ),
    Query(
        "dataset_fallback",
        _fallback,
        "SELECT event_type, count(*) AS n, min(event_id) AS first_id, max(event_id) AS last_id FROM events GROUP BY 1",
    ),
    Query(
        "schema_from_config",
        _schema,
        """SELECT 'l_discount:float' AS declared, count(l_discount) AS n FROM lineitem
UNION ALL SELECT 'l_extendedprice:float', count(l_extendedprice) FROM lineitem
UNION ALL SELECT 'l_orderkey:bigint', count(l_orderkey) FROM lineitem
UNION ALL SELECT 'l_partkey:bigint', count(l_partkey) FROM lineitem
UNION ALL SELECT 'l_quantity:float', count(l_quantity) FROM lineitem
UNION ALL SELECT 'l_returnflag:string', count(l_returnflag) FROM lineitem""",
    ),
    Query(
        "select_roles_export",
        _roles,
        """SELECT l_extendedprice::FLOAT::DOUBLE AS l_extendedprice, l_quantity::FLOAT AS l_quantity, l_orderkey, l_partkey
FROM lineitem""",
    ),
    Query(
        "select_roles_no_export",
        _no_export,
        """SELECT l_returnflag, round(avg(l_discount::FLOAT::DOUBLE), 6) + 0.0 AS mean_discount
FROM lineitem GROUP BY 1""",
    ),
    Query("split_labels", _labels, "SELECT vec_id, len(embedding)::INTEGER AS width, label::BIGINT AS label FROM embeddings"),
    Query(
        "densify",
        _densify,
        """SELECT doc_id, coalesce(nullif(lang, 'en'), '__unknown__') AS lang, coalesce(quality, 0) AS quality,
       coalesce(toxic, 0) AS toxic
FROM documents LEFT JOIN labels USING (doc_id)""",
    ),
]
