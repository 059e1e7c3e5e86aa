"""Queries of the operators on the supplied tables, with SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mixframe.llm import chat, codes, decontaminate, embeddings, language, mixing, phrases, quality, secrets, sharding, simhash, tokens, urls
from mixframe.session import scratch_path

#: Rules of the URL query, and hosts whose pages make up its list of blocked URLs.
URL_RULES = [
    urls.Rule("allow", "com", "/"),
    urls.Rule("block", "example.com", "/en/"),
    urls.Rule("allow", "www.example.com", "/en/"),
    urls.Rule("block", "net", "/es/"),
    urls.Rule("block", "net", "/fr/"),
]
LISTED_HOSTS = r"(ads-track|spam-farm|casino-win|adult-x|cheap-pills|free-bets)"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_chat(spark: SparkSession, folder: str) -> DataFrame:
    """Maximal conversations, rendered."""
    return chat.format_chats(table(spark, folder, "conversations"))


def op2_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold benchmark items, with the items and how well they align."""
    found = decontaminate.with_matches(table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "benchmark"))
    return found.select("doc_id", F.inline("leaks"))


def op3_embedding_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Links and components of all vectors."""
    return embeddings.linked_vectors(table(spark, folder, "embeddings"))


def op4_language(spark: SparkSession, folder: str) -> DataFrame:
    """The language of every document."""
    docs = table(spark, folder, "documents")
    model = language.fit(language.training_rows(docs))
    answer = language.predict(docs.select("doc_id", "text"), model)
    return answer.select("doc_id", language.held_out().alias("held_out"), "language.lang_pred", "language.score", "language.rejected")


def op5_mix(spark: SparkSession, folder: str) -> DataFrame:
    """What a mix of all sources takes of every document."""
    mixed = mixing.mix(table(spark, folder, "documents"), ["doc_id"])
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op6_simhash(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = simhash.near_duplicates(table(spark, folder, "documents"), ["doc_id"])
    return found.select("doc_id", simhash.hex_print("fp").alias("fingerprint"), "component_id")


def token_file() -> str:
    """The tokenizer of the queries."""
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op7_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """Write the ids of all documents, read the files back, digest them."""
    parts = tokens.write_tokens(table(spark, folder, "documents"), scratch_path(spark, "tokens"), token_file())
    return tokens.digests(spark, parts)


def op8_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Perplexity of every document under a model of the documents that are labelled good."""
    trusted = table(spark, folder, "labels").where("quality = 1")
    return quality.classify(table(spark, folder, "documents"), trusted, language.held_out(), ["doc_id", "lang"])


def op9_urls(spark: SparkSession, folder: str) -> DataFrame:
    """The verdict on every page's URL."""
    pages = table(spark, folder, "pages").select("page_id", "url")
    part = urls.parts_of(F.col("url"))
    listed = pages.where(part["host"].rlike(LISTED_HOSTS)).select(urls.canonical(part["host"], part["path"], part["query"]).alias("canonical"))
    return urls.judge(pages, listed, URL_RULES, ["page_id"]).select("page_id", "host", "path", "rule", "verdict")


def op10_secrets(spark: SparkSession, folder: str) -> DataFrame:
    """Spans of secrets in every document, through a new ledger."""
    docs, ledger = table(spark, folder, "documents"), scratch_path(spark, "ledger")
    secrets.scan_new(docs, ledger)
    found = secrets.findings(docs, ledger, ["doc_id"])
    base = [r.kind for r in secrets.RULES if r.base]
    count = lambda kind: F.coalesce(F.size(kind), F.lit(0)).cast("bigint").alias(f"n_{kind}")
    digest = F.sha2(secrets.span_list(base), 256).alias("base_sha256")
    return found.select("doc_id", *[count(k) for k in base], digest, secrets.span_list([r.kind for r in secrets.RULES]).alias("spans"))


def op11_phrases(spark: SparkSession, folder: str) -> DataFrame:
    """The first collocations of each language."""
    return phrases.collocations(table(spark, folder, "documents"))


def op12_shards(spark: SparkSession, folder: str) -> DataFrame:
    """Write all documents as shards along the curve, read the files back, digest them."""
    place = scratch_path(spark, "shards")
    sharding.write_shards(table(spark, folder, "documents"), place, sharding.document_dimensions())
    rows = sharding.read_shards(spark, place)
    digest = F.crc32(F.coalesce("text", F.lit(""))).cast("bigint").alias("text_crc32")
    layout, none = F.col(sharding.LAYOUT), F.lit(None).cast("int").alias("grown_shard")
    size = sharding.size_of(F.col("text")).alias("size")
    return rows.select("doc_id", size, digest, F.lit("rows").alias("law"), layout["shard"].alias("shard"), layout["slot"].alias("slot"), none)


def op13_codes(spark: SparkSession, folder: str) -> DataFrame:
    """The code of every vector, its error, and the codebooks' digest."""
    coded, books = codes.compress(table(spark, folder, "embeddings"), ["vec_id", "label"])
    summed = codes.with_group_error(coded, "label", "label_error")
    digest = F.lit(codes.books_digest(books)).alias("codebooks_sha256")
    return summed.select("vec_id", codes.code_text(F.col("code")).alias("code"), "error", "label_error", digest)


QUERIES = {
    f.__name__: f
    for f in (
        op1_chat, op2_decontaminate, op3_embedding_dedup, op4_language, op5_mix, op6_simhash, op7_tokens, op8_quality, op9_urls,
        op10_secrets, op11_phrases, op12_shards, op13_codes,
    )
}

_HOST = f"translate(regexp_extract(rest, '^[^/?#]*'), '{urls.UPPER}', '{urls.LOWER}')"
_FITS = " ".join(
    f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{{{r.verdict}}}{r.name}'"
    for r in sorted(URL_RULES, key=lambda r: (-len(r.name), r.name))
).replace("{allow}", "allow ").replace("{block}", "block ")
URL_SQL = f"""
WITH cut AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
hosts AS (
  SELECT page_id, {_HOST} AS host, substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1) AS after FROM cut),
paths AS (
  SELECT page_id, host, regexp_extract(after, '^[^?#]*') AS path,
    regexp_extract(substr(after, length(regexp_extract(after, '^[^?#]*')) + 1), '^[^#]*') AS query FROM hosts),
canon AS (
  SELECT *, regexp_replace(host, '^www\\.', '') || regexp_replace(path, '/+$', '') ||
    regexp_replace(regexp_replace(regexp_replace(regexp_replace(query, '([?&])utm_[^&]*', '\\1', 'g'), '&&+', '&', 'g'),
      '^\\?&+', '?'), '[?&]+$', '') AS canonical,
    CASE {_FITS} END AS ruled FROM paths),
listed AS (SELECT DISTINCT canonical FROM canon WHERE regexp_matches(host, '{LISTED_HOSTS}') AND canonical <> '')
SELECT page_id, host, path, substr(ruled, 7) AS rule,
  coalesce(substr(ruled, 1, 5), CASE WHEN canonical IN (SELECT canonical FROM listed) THEN 'block' ELSE 'allow' END) AS verdict
FROM canon"""

SQL = {"op1_chat": chat.oracle(), "op5_mix": mixing.oracle(), "op9_urls": URL_SQL, "op11_phrases": phrases.oracle(), "op12_shards": sharding.oracle(), "op13_codes": codes.oracle()}
