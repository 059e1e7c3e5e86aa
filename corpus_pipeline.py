"""The corpus pipeline: documents in, token files out, each stage written as Parquet and read again by the next.

1. language: documents whose language the classifier rejects go. 2. simhash: of each group of near copies the document of
the smallest id stays. 3. decontaminate: documents that hold benchmark items go. 4. mix: documents are repeated or left
out so that sources meet their target weights. 5. tokens: what is left is encoded and written as flat files; the last
stage returns a row for each written document.

Every stage takes (spark, docs, sf_dir) and works on all of ``docs``. All but the last return the columns of documents.
Nulls, ties and empty tables are treated as the operators' modules say: a null or letterless text has no language and goes
in the first stage; of rows that share an id as well as a group, one stays, and groups without an id keep one too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mixframe.llm import catalog, decontaminate, language, mixing, simhash, tokens
from mixframe.llm.common import quoted, stored
from mixframe.session import scratch_path


#: Rows of an Arrow batch. Rows hold whole texts, and executors keep their Python workers from stage to stage.
BATCH_ROWS = "1000"
#: Bytes of an Arrow batch, which a few very long texts would else exceed.
BATCH_BYTES = "8m"
#: Rows that a task decodes from Parquet at a time.
READ_ROWS = "512"
#: Size to which small shuffle partitions are merged; the last two stages sort whole texts.
SHUFFLE_BYTES = "16m"


def _session(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", READ_ROWS)
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", SHUFFLE_BYTES)
    return spark


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised."""
    _session(spark)
    model = language.fit(language.training_rows(docs))
    return language.predict(docs, model, "__language").where(~F.col("__language.rejected")).select(*[quoted(c) for c in docs.columns])


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one whose id names the component.

    Rows that repeat an id are told apart by a hash of the text and, if that is equal too, merged. A null id is the last of
    its group. Texts are moved only by the join with the kept rows, or not at all if those are few; only rows of
    repeated id and text are grouped.
    """
    _session(spark)
    found = simhash.near_duplicates(docs.select("doc_id", "text", F.xxhash64("text").alias("hash")), ["doc_id", "hash"])
    counted = found.groupBy("root", "doc_id", "hash").agg(F.count(F.lit(1)).alias("n"))
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "hash", "n")).alias("f")
    kept = counted.groupBy("root").agg(first).select(F.col("f.doc_id").alias("__id"), F.col("f.hash").alias("__hash"), "f.n")
    kept = stored(kept, "kept")
    rows = docs.withColumn("__row", F.xxhash64("text"))
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__row") == F.col("__hash"))
    out = rows.join(kept.where("n = 1"), same, "left_semi")
    repeated = kept.where("n > 1")
    if repeated.head(1):
        out = out.unionAll(rows.join(repeated, same, "left_semi").dropDuplicates(["doc_id", "__row"]))
    return out.drop("__row")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    benchmark = catalog.table(_session(spark), sf_dir, "benchmark")
    return decontaminate.with_matches(docs, benchmark, out="__leaks").where(F.size("__leaks") == 0).select(*[quoted(c) for c in docs.columns])


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    _session(spark)
    return mixing.repeated(mixing.mix(docs, docs.columns), docs.columns)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each document in the token files: doc_id, start, n_tokens, ids_crc32."""
    _session(spark)
    return tokens.digests(spark, tokens.write_tokens(docs, scratch_path(spark, "tokens"), catalog.token_file()))


STAGES = [
    ("language", language_id),
    ("simhash", simhash_dedup),
    ("decontaminate", decontamination),
    ("mix", mix),
    ("tokens", token_output),
]

#: Fingerprints, alignments and byte-pair encoding are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``."""
    docs = catalog.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
