"""Secret scans with an incremental ledger of blobs.

Every version of every text is content-addressed by its SHA-256. The ledger is a table of (blob, rule version) pairs with
what each scan found; only pairs that it lacks are scanned, each blob once however many paths hold it, and the findings
are joined back to all paths. A new version of one rule scans all blobs again for that rule alone.

Defined results: a null text is the empty blob. Paths are rows: repeated rows each keep theirs. A text without findings
has empty arrays. Spans are code points from 0, end exclusive. An empty table gives no row, and columns other than those
asked for and ``text`` are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mixframe.llm.common import answer, kept

SCANS = "array<struct<kind:string,version:int,spans:array<struct<start:bigint,end:bigint>>>>"
#: A row for each blob and run that scanned it, with the pairs of that run; nested, a blob's address is moved once.
LEDGER = f"blob string, scans {SCANS}"
SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of ``pattern``; those whose ``group`` is shorter than ``least`` are dropped after."""

    kind: str
    pattern: str
    least: int
    group: int = 0
    version: int = 1
    base: bool = False

    def spans(self, text: str) -> list[tuple[int, int]]:
        return [m.span() for m in _compiled(self.pattern).finditer(text) if len(m[self.group]) >= self.least]


def _compiled(pattern: str) -> re.Pattern:
    return re.compile(pattern, re.ASCII)  # re keeps its own cache


_ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Base rules first, in the order in which spans that start together are listed.
RULES = (
    Rule("assign", _ASSIGN, 12, 2, base=True),
    Rule("access", r"AKIA[A-Z0-9]+", 18, base=True),
    Rule("hex", r"[0-9a-f]{16,}", 16, base=True),  # runs are maximal either way
    Rule("pem", r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----", 1),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 1),
    Rule("hosting", r"gh[pousr]_[A-Za-z0-9]{36}", 1),
)


def blobs(docs: DataFrame) -> Column:
    """Address of the text: SHA-256 of its UTF-8."""
    return F.sha2(F.coalesce(docs["text"], F.lit("")), 256)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger at ``path``; empty if nothing has been written there yet."""
    try:
        return spark.read.schema(LEDGER).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LEDGER)


def _scanner(rules: list[Rule]):  # noqa: ANN202
    def scan(column: pa.Array, todo: pa.Array) -> pa.Array:
        """Per text, for each rule that ``todo`` names by position, its spans."""
        found = []
        for text, due in zip(column, todo, strict=True):
            said = text.as_py() or ""
            rows = [(rules[k], rules[k].spans(said)) for k in due.as_py()]
            found.append([{"kind": r.kind, "version": r.version, "spans": [{"start": a, "end": b} for a, b in s]} for r, s in rows])
        entry = pa.struct([("kind", pa.string()), ("version", pa.int32()), ("spans", SPANS)])
        return pa.array(found, pa.list_(entry))

    return F.arrow_udf(scan, SCANS)


def pairs(ledger: DataFrame) -> DataFrame:
    """The ledger as (blob, kind, version, spans)."""
    return ledger.select("blob", F.inline("scans"))


def _scan_of(rule: Rule) -> Column:
    """The ledger row's scans for one version of a rule."""
    return F.filter("scans", lambda s: (s["kind"] == rule.kind) & (s["version"] == rule.version))


def scan_new(docs: DataFrame, ledger_path: str, rules: tuple[Rule, ...] = RULES) -> None:
    """Add to the ledger what it lacks for the blobs of ``docs`` (doc_id, text) and the versions of ``rules``.

    One document of each blob stands for it: the one of the smallest id. Texts are shuffled once, by (blob, id), so that
    a blob that a third of all documents share is spread over tasks, and only where something is left to scan.
    """
    spark, rules = docs.sparkSession, list(rules)
    done = [F.max(F.size(_scan_of(r)) > 0).alias(f"__done{k}") for k, r in enumerate(rules)]
    scanned = read_ledger(spark, ledger_path).groupBy("blob").agg(*done)
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("__name")
    rows = docs.select(name, blobs(docs).alias("blob"), "text")
    first = rows.groupBy("blob").agg(F.min("__name").alias("__name"))
    due = [F.when(F.coalesce(f"__done{k}", F.lit(False)), None).otherwise(F.lit(k)) for k in range(len(rules))]
    todo = first.join(scanned, "blob", "left").select("blob", "__name", F.array_compact(F.array(*due)).alias("todo"))
    found = rows.join(todo.where(F.size("todo") > 0), ["blob", "__name"]).select("blob", _scanner(rules)("text", "todo").alias("scans"))
    # an id may repeat with the same text: one row of each blob is kept
    found = found.dropDuplicates(["blob"])
    found.write.mode("append").parquet(ledger_path)


def findings(docs: DataFrame, ledger_path: str, keep: list[str], rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``keep`` columns of ``docs`` with ``blob`` and, for each rule, its spans in a column named after its kind.

    A result whose name a kept column has gets an underscore after it.
    """
    ledger = read_ledger(docs.sparkSession, ledger_path)
    whole = ledger.groupBy("blob").agg(F.flatten(F.collect_list("scans")).alias("scans"))
    by_blob = whole.select("blob", *[F.get(_scan_of(r), F.lit(0))["spans"].alias(r.kind) for r in rules])
    paths = docs.select(*kept(keep), blobs(docs).alias("blob"))
    # rows of one blob may be a third of the table: the adaptive skew join splits them
    joined = paths.join(by_blob, "blob", "left")
    return answer(joined, keep, {c: F.col(c) for c in ("blob", *[r.kind for r in rules])})


def span_list(kinds: list[str]) -> Column:
    """``kind:start:end`` of all kinds, by start and then in the order of ``kinds``, joined by commas."""
    def tagged(place: int, kind: str) -> Column:
        spans = F.coalesce(F.col(kind), F.array().cast("array<struct<start:bigint,end:bigint>>"))
        return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(place).alias("place"), s["end"].alias("end"), F.lit(kind).alias("kind")))

    listed = F.transform(F.array_sort(F.concat(*[tagged(place, kind) for place, kind in enumerate(kinds)])), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"]))
    return F.array_join(listed, ",")
