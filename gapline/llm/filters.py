"""A bit filter of fixed size over 64-bit hashes: what is sent to every task does not grow with the data.

A bit that is set by accident lets rows through that an exact join or count removes later; none is lost.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

FILTER_BITS = 1 << 24


def bit_filter(rows: DataFrame, hashes: Column) -> np.ndarray:
    """The bits of all hashes: at most FILTER_BITS / 64 numbers reach the driver."""
    at = rows.select(hashes.bitwiseAND(FILTER_BITS - 1).alias("at"))
    bit = F.expr("bit_or(shiftleft(1L, cast(at & 63 as int)))")
    cells = at.groupBy(F.shiftright("at", 6).alias("cell")).agg(bit.alias("bits")).toArrow()
    bits = np.zeros(FILTER_BITS // 64, dtype=np.uint64)
    bits[cells.column("cell").to_numpy()] = cells.column("bits").to_numpy().view(np.uint64)
    return bits


def passes(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes.view(np.uint64) & np.uint64(FILTER_BITS - 1)
    return (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) != 0
