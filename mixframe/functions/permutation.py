"""Pseudo-random permutations of row numbers: a Feistel network with cycle walking.

A network of a few rounds permutes the numbers of an even number of bits; walking on from numbers beyond the last row until one
below it comes up makes it a permutation of exactly ``rows`` numbers. Nothing is stored and nothing is sorted: the place
of a row in the order of an epoch is a function of its number, and the row at a place is the inverse function of the place.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from mixframe.functions import arrow

ROUNDS = 6
#: Round keys and multipliers are hashes below 2**31, so that their product with a half stays below 2**62.
KEY_MASK = (1 << 31) - 1
MAX_ROWS = 1 << 60


def half_bits(rows: int) -> int:
    """Bits of each half of the network that permutes at least ``rows`` numbers, and at most four times as many."""
    if not 0 <= rows <= MAX_ROWS:
        raise ValueError(f"row numbers must be below {MAX_ROWS}")
    return max(1, ((max(1, rows - 1)).bit_length() + 1) // 2)


def round_keys(seed: int, epoch: int) -> list[tuple[int, int]]:
    """Added key and odd multiplier of each round of an epoch: a linear congruential sequence from both."""
    state = (seed * 1_000_003 + epoch * 7_919 + 12_345) & ((1 << 64) - 1)
    keys = []
    for _ in range(ROUNDS):
        pair = []
        for _ in range(2):
            # fixed values: multiplier and increment of the 64-bit generator of Knuth's MMIX
            state = (state * 6364136223846793005 + 1442695040888963407) & ((1 << 64) - 1)
            pair.append((state >> 33) & KEY_MASK)
        keys.append((pair[0], pair[1] | 1))
    return keys


def _scrambled(half: np.ndarray, key: tuple[int, int], bits: int) -> np.ndarray:
    mixed = ((half + key[0]) & KEY_MASK) * key[1]
    return ((mixed >> 13) ^ (mixed >> 31)) & ((1 << bits) - 1)


def _walk(numbers: np.ndarray, rows: int, once: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """``once`` applied until every number is below ``rows``; numbers that start there end there."""
    out = once(numbers)
    while len(beyond := np.flatnonzero(out >= rows)):
        out[beyond] = once(out[beyond])
    return out


def permuted(numbers: np.ndarray, rows: int, seed: int, epoch: int) -> np.ndarray:
    """The place of each row number in the order of an epoch."""
    bits, keys = half_bits(rows), round_keys(seed, epoch)

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> bits, x & ((1 << bits) - 1)
        for key in keys:
            left, right = right, left ^ _scrambled(right, key, bits)
        return (left << bits) | right

    return _walk(_checked(numbers, rows), rows, once)


def restored(places: np.ndarray, rows: int, seed: int, epoch: int) -> np.ndarray:
    """The row number at each place: the inverse of ``permuted``."""
    bits, keys = half_bits(rows), round_keys(seed, epoch)

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> bits, x & ((1 << bits) - 1)
        for key in reversed(keys):
            left, right = right ^ _scrambled(left, key, bits), left
        return (left << bits) | right

    return _walk(_checked(places, rows), rows, once)


def _checked(numbers: np.ndarray, rows: int) -> np.ndarray:
    numbers = np.asarray(numbers, np.int64)
    if len(numbers) and not (0 <= numbers.min() and numbers.max() < rows):
        raise ValueError(f"row numbers must be from 0 to {rows - 1}")
    return numbers


def _by_epoch(fn: Callable[[np.ndarray, int, int, int], np.ndarray], rows: int, seed: int) -> Callable:
    def both(numbers: pa.Array, epochs: pa.Array) -> pa.Array:
        n, e = numbers.to_numpy(zero_copy_only=False), epochs.to_numpy(zero_copy_only=False)
        out = np.empty(len(n), np.int64)
        for epoch in np.unique(e):
            mine = e == epoch
            out[mine] = fn(n[mine], rows, seed, int(epoch))
        return pa.array(out)

    return arrow.row_function(both, "bigint")


def place_of(number: str | Column, epoch: str | Column, rows: int, seed: int = 0) -> Column:
    """The place of a row number (0 to ``rows`` - 1) in the order of an epoch; narrow."""
    return _by_epoch(permuted, rows, seed)(number, epoch)


def number_at(place: str | Column, epoch: str | Column, rows: int, seed: int = 0) -> Column:
    """The row number at a place of the order of an epoch; narrow."""
    return _by_epoch(restored, rows, seed)(place, epoch)


def place_sql(source: str, number: str, seed: int, epochs: int) -> str:
    """CTEs ``walked`` and ``placed`` (all columns of ``source``, epoch, place, rows) of a recursive DuckDB query."""

    def key(i: int, part: int) -> str:
        cases = " ".join(f"WHEN {e} THEN {round_keys(seed, e)[i][part]}" for e in range(epochs))
        return f"(CASE epoch {cases} END)::BIGINT"

    def once(x: str, source: str) -> str:
        same = f"{number}, epoch, rows, bits"
        inner = f"SELECT {same}, ({x}) >> bits AS l, ({x}) & ((1::BIGINT << bits) - 1) AS r FROM {source}"
        for i in range(ROUNDS):
            mixed = f"(((r + {key(i, 0)}) & {KEY_MASK}) * {key(i, 1)})"
            scrambled = f"xor({mixed} >> 13, {mixed} >> 31) & ((1::BIGINT << bits) - 1)"
            inner = f"SELECT {same}, r AS l, xor(l, {scrambled}) AS r FROM ({inner})"
        return f"SELECT {same}, (l << bits) | r AS place FROM ({inner})"

    return f"""counted AS (
  SELECT count(*)::BIGINT AS rows, greatest(1, (length(bin(greatest(1, count(*) - 1))) + 1) // 2)::INTEGER AS bits FROM {source}),
walked AS (
  {once(number, f"(SELECT {number}, rows, bits, unnest(range({epochs}))::INTEGER AS epoch FROM {source} CROSS JOIN counted)")}
  UNION ALL
  {once("place", "(SELECT * FROM walked WHERE place >= rows)")}),
placed AS (SELECT s.*, w.epoch, w.place, w.rows FROM walked w JOIN {source} s USING ({number}) WHERE w.place < w.rows)"""
