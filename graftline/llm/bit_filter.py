"""A filter of fixed size for 64-bit keys: it lets all of them through and little else."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits that tasks carry; with more keys the filter only lets more through.
FILTER_BITS = 2**25


def lets_through(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = keys >> np.uint64(64 - FILTER_BITS.bit_length() + 1)
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def bit_filter(keys: DataFrame) -> np.ndarray:
    """The column `key` as FILTER_BITS bits, put together by an aggregation: what comes to the driver is bounded."""
    at = F.shiftrightunsigned("key", 64 - FILTER_BITS.bit_length() + 1)
    longs = keys.select(at.alias("b")).groupBy(F.expr("cast(b div 64 as int)").alias("at")).agg(F.expr("bit_or(shiftleft(1L, cast(b & 63 as int)))").alias("bits"))
    out = np.zeros(FILTER_BITS // 64, np.int64)
    got = longs.toArrow()
    out[got["at"].to_numpy()] = got["bits"].to_numpy()
    return out.view(np.uint8)
