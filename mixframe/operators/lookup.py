"""Joins of a long table with a lookup table."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BROADCAST_BYTES = 64 << 20
SALTS = 16


def salted_join(long: DataFrame, lookup: DataFrame, key: str, how: str = "inner", salts: int = SALTS) -> DataFrame:
    """Equi join whose hot keys are spread: every lookup row is repeated ``salts`` times, long rows pick one copy.

    The salt is a hash of the row, so a retried task sends a row to the same place. What is still uneven afterwards is
    split by the adaptive skew join.
    """
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in long.columns]), F.lit(salts)).cast("int")
    copies = lookup.withColumn("__copy", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = long.withColumn("__salt", salt)
    return _keyed(salted, copies, key, how, F.col("__salt") == F.col("__copy")).drop("__salt", "__copy")


def _keyed(long: DataFrame, lookup: DataFrame, key: str, how: str, also: Column | None = None) -> DataFrame:
    """Equi join on a key of the same name, in which null meets null: a group without a key keeps its rows."""
    on = F.col(key).eqNullSafe(F.col("__lookup_key"))
    renamed = lookup.withColumnRenamed(key, "__lookup_key")
    return long.join(renamed, on if also is None else on & also, how).drop("__lookup_key")


def lookup_join(
    long: DataFrame,
    lookup: DataFrame,
    key: str,
    row_bytes: int,
    how: str = "inner",
    limit: int = BROADCAST_BYTES,
) -> DataFrame:
    """Join with a derived lookup table: broadcast when its counted size allows it, salted shuffle join otherwise.

    ``row_bytes`` is the width of a lookup row. The table is persisted, because counting it would otherwise compute
    it twice; a lost block is computed again from its lineage.
    """
    lookup = lookup.persist(StorageLevel.MEMORY_AND_DISK)
    if lookup.count() * row_bytes <= limit:
        return _keyed(long, F.broadcast(lookup), key, how)
    return salted_join(long, lookup, key, how)
