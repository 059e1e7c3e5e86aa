"""URL filters: rules on hosts and paths, and a list of URLs behind a blocked Bloom filter. DataFrame functions only.

A URL is judged by the longest rule that fits. Where none does, it is blocked if its canonical form is in the list. The
list is condensed to a blocked Bloom filter; URLs that pass it are joined exactly, by hash and text, with the list, which
removes the false positives.

Defined results: a null URL or one without ``://`` has an empty host and path and an empty canonical form; no rule fits it
and no list holds it, so it is allowed. Nulls and repeats in the list are ignored; an empty list blocks nothing. An empty
table gives no row. Rows of ``urls`` are never merged, and columns not asked for are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mixframe.llm.common import BROADCAST_BYTES, answer, kept

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORDS = 4  # a block is four words of 63 bits
WORD_BITS = 63
BITS_PER_URL = 16
PROBES = 6


@dataclass(frozen=True)
class Rule:
    """``host`` and all its subdomains, where the path starts with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def parts_of(url: Column) -> dict[str, Column]:
    """Host, path and query (with its ``?``) as columns, by name."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + F.lit(3))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    after = F.substr(rest, F.length(host) + F.lit(1))
    path = F.regexp_extract(after, r"^[^?#]*", 0)
    query = F.regexp_extract(F.substr(after, F.length(path) + F.lit(1)), r"^[^#]*", 0)
    return {"host": F.translate(host, UPPER, LOWER), "path": path, "query": query}


def canonical(host: Column, path: Column, query: Column) -> Column:
    """Without scheme, ``www.``, a slash at the end, campaign parameters and fragment."""
    asked = F.regexp_replace(query, r"([?&])utm_[^&]*", "$1")
    asked = F.regexp_replace(F.regexp_replace(asked, r"&&+", "&"), r"^\?&+", "?")
    asked = F.regexp_replace(asked, r"[?&]+$", "")
    return F.concat(F.regexp_replace(host, r"^www\.", ""), F.regexp_replace(path, r"/+$", ""), asked)


def fitting_rule(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, null if none does; the rules are a short list of the caller's."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        name, verdict = F.when(fits, rule.name).otherwise(name), F.when(fits, rule.verdict).otherwise(verdict)
    return name, verdict


def _bits(url: Column, blocks: int) -> tuple[Column, list[Column]]:
    """Block of a URL and, for each word of the block, the bits that it sets."""
    block = F.pmod(F.xxhash64(url, F.lit(0)), F.lit(blocks))
    probes = F.xxhash64(url, F.lit(1))
    words = [F.lit(0).cast("bigint")] * WORDS
    for i in range(PROBES):
        bit = F.pmod(F.shiftrightunsigned(probes, 10 * i).bitwiseAND(F.lit(1023)), F.lit(WORDS * WORD_BITS)).cast("int")
        for w in range(WORDS):
            mine = (bit >= w * WORD_BITS) & (bit < (w + 1) * WORD_BITS)
            mask = F.when(mine, F.call_function("shiftleft", F.lit(1).cast("bigint"), bit - w * WORD_BITS))
            words[w] = words[w].bitwiseOR(F.coalesce(mask, F.lit(0).cast("bigint")))
    return block, words


def bloom_filter(listed: DataFrame) -> tuple[DataFrame, int]:
    """Blocks of the filter of distinct URLs ``canonical``, one row each, and how many blocks there can be."""
    blocks = max(1, math.ceil(listed.count() * BITS_PER_URL / (WORDS * WORD_BITS)))
    block, words = _bits(F.col("canonical"), blocks)
    bits = listed.select(block.alias("__block"), *[w.alias(f"__w{i}") for i, w in enumerate(words)])
    return bits.groupBy("__block").agg(*[F.bit_or(f"__w{i}").alias(f"__w{i}") for i in range(WORDS)]), blocks


def judge(urls: DataFrame, listed: DataFrame, rules: list[Rule], keep: list[str], limit: int = BROADCAST_BYTES) -> DataFrame:
    """``keep`` columns of ``urls`` with host, path, canonical, rule, possible (the filter's word) and verdict.

    ``urls`` has ``url``; ``listed`` has the blocked URLs as ``canonical``. The filter is broadcast if its counted size
    allows it, else its blocks, which hash evenly, are joined by shuffle. Only possible hits are joined with the list;
    a URL that many rows share is split there by the adaptive skew join. A result whose name a kept column has gets an
    underscore after it.
    """
    listed = listed.select("canonical").where(F.length("canonical") > 0).distinct()
    blocks_table, blocks = bloom_filter(listed)
    part = parts_of(F.col("url"))
    rows = urls.select(*kept(keep), *[c.alias(n) for n, c in part.items()])
    name, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"canonical": canonical(F.col("host"), F.col("path"), F.col("query")), "rule": name, "__rule": verdict})
    block, words = _bits(F.col("canonical"), blocks)
    probed = rows.withColumn("__block", block)
    table = F.broadcast(blocks_table) if blocks * 8 * (WORDS + 1) <= limit else blocks_table
    probed = probed.join(table, "__block", "left")
    hit = F.lit(True)
    for i, bits in enumerate(words):
        hit = hit & (F.col(f"__w{i}").bitwiseAND(bits) == bits)
    probed = probed.withColumn("possible", F.coalesce(hit, F.lit(False)))
    exact = listed.withColumns({"__listed": F.lit(True), "__hash": F.xxhash64("canonical")})
    found = probed.where("possible").withColumn("__hash", F.xxhash64("canonical")).join(exact, ["__hash", "canonical"], "left")
    found = found.withColumn("listed", F.coalesce("__listed", F.lit(False)))
    out = found.select(*rows.columns, "possible", "listed").unionAll(
        probed.where(~F.col("possible")).select(*rows.columns, "possible", F.lit(False).alias("listed"))
    )
    judged = F.coalesce("__rule", F.when(F.col("listed"), "block").otherwise("allow"))
    results = {c: F.col(c) for c in ("host", "path", "canonical", "rule", "possible", "listed")}
    return answer(out, keep, {**results, "verdict": judged})
