"""Hilbert curve indices of cells in any number of dimensions, as numpy arrays and as DataFrame columns.

The curve visits the corners of a cube in Gray-code order; inside each corner runs the same curve, turned so that it starts
where the last one ended. ``entry`` and ``axis`` describe the turn: the corner at which it starts and the direction in which it leaves.
"""

from __future__ import annotations

from functools import cache

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Dimensions and bits of a key that fits a signed long.
KEY_BITS = 63


def _turned(b: np.ndarray, by: np.ndarray, n: int, left: bool) -> np.ndarray:
    """The ``n`` bits of ``b`` rotated by 1 to ``n`` places."""
    right = np.uint64(n) - by if left else by
    mask = np.uint64((1 << n) - 1)
    return ((b >> right) | (b << (np.uint64(n) - right))) & mask


def _step(entry: np.ndarray, axis: np.ndarray, corner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Position of a corner along a turned curve, and the turn of the curve inside that corner."""
    one = np.uint64(1)
    position = _turned(corner ^ entry, axis + one, n, left=False)
    shift = 1
    while shift < n:  # from Gray code to number
        position = position ^ (position >> np.uint64(shift))
        shift *= 2
    even = np.where(position > 0, (position - (position > 0)) & ~one, np.uint64(0)).astype(np.uint64)
    start = even ^ (even >> one)
    ones = np.where(position & one > 0, position, np.where(position > 0, position - (position > 0), np.uint64(0))).astype(np.uint64)
    run = np.log2((~ones & (ones + one)).astype(np.float64)).astype(np.uint64)  # trailing set bits
    entry = entry ^ _turned(start, axis + one, n, left=True)
    return position, entry, (axis + run + one) % np.uint64(n)


def index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Curve index of each row of ``cells``, whose columns are numbers of ``bits`` bits; all bits fit a long."""
    rows, n = cells.shape
    if n * bits > KEY_BITS:
        raise ValueError(f"{n} dimensions of {bits} bits do not fit a key of {KEY_BITS} bits")
    cells = cells.astype(np.uint64)
    found, entry, axis = (np.zeros(rows, np.uint64) for _ in range(3))
    places = np.arange(n, dtype=np.uint64)
    for level in reversed(range(bits)):
        corner = np.bitwise_or.reduce(((cells >> np.uint64(level)) & np.uint64(1)) << places, axis=1)
        position, entry, axis = _step(entry, axis, corner, n)
        found = (found << np.uint64(n)) | position
    return found.astype(np.int64)


@cache
def turns(n: int) -> tuple[list[int], list[int]]:
    """For each turn and corner, at ``turn * 2**n + corner``: the position of the corner and the turn inside it.

    A turn is ``axis * 2**n + entry``; the whole curve has turn 0.
    """
    corners = 1 << n
    turn, corner = (x.ravel().astype(np.uint64) for x in np.meshgrid(np.arange(n * corners), np.arange(corners), indexing="ij"))
    position, entry, axis = _step(turn % np.uint64(corners), turn // np.uint64(corners), corner, n)
    return position.tolist(), (axis * np.uint64(corners) + entry).tolist()


def index_column(cells: list[Column], bits: int) -> Column:
    """Curve index of integer columns of ``bits`` bits; up to five dimensions, for few rows."""
    n = len(cells)
    if not 1 <= n <= 5 or n * bits > KEY_BITS:
        raise ValueError("one to five dimensions that fit a long")
    corners = []
    for level in reversed(range(bits)):
        corner = F.lit(0)
        for place, cell in enumerate(cells):
            bit = F.shiftright(cell.cast("int"), level).bitwiseAND(F.lit(1))
            corner = corner.bitwiseOR(F.shiftleft(bit, place))
        corners.append(corner)
    positions, inside = (F.array(*[F.lit(v) for v in table]) for table in turns(n))

    def step(state: Column, corner: Column) -> Column:
        at = (state["turn"] * F.lit(1 << n) + corner + F.lit(1)).cast("int")
        found = F.shiftleft(state["found"], n).bitwiseOR(F.element_at(positions, at).cast("bigint"))
        return F.struct(found.alias("found"), F.element_at(inside, at).cast("int").alias("turn"))

    start = F.struct(F.lit(0).cast("bigint").alias("found"), F.lit(0).cast("int").alias("turn"))
    return F.aggregate(F.array(*corners), start, step, lambda state: state["found"])
