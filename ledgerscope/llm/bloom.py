"""Bloom filters of hashed keys, built by Spark and asked with numpy.

A filter only keeps rows out of a shuffle: what passes it wrongly costs rows and never changes a result.
"""
from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

MIN_BITS, MAX_BITS = 20, 27  # 128 KB to 16 MB: the bound of what goes to the driver and to a task
_PAGE = 1 << 15


def bits_for(keys: int) -> int:
    """log2 of the filter's size: 16 bits a key (about 2 % pass wrongly with two places a key), within the bounds."""
    return int(min(MAX_BITS, max(MIN_BITS, np.ceil(np.log2(max(1, keys) * 16)))))


def build(keys: DataFrame, count: int) -> np.ndarray:
    """A filter over the ``long`` column ``key`` of a table of ``count`` rows."""
    log = bits_for(count)
    mask = (1 << log) - 1
    at = keys.select(F.explode(F.array(F.col("key").bitwiseAND(mask), F.shiftrightunsigned("key", 32).bitwiseAND(mask))).alias("at"))
    bits = np.zeros(1 << (log - 3), np.uint8)
    for row in at.groupBy(F.floor(F.col("at") / _PAGE).alias("page")).agg(F.bitmap_construct_agg(F.col("at") % _PAGE).alias("bits")).collect():
        part = np.frombuffer(row["bits"], np.uint8)
        bits[row["page"] * (_PAGE // 8):][:len(part)] = part
    return bits


def may_hold(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """False only for keys that are not in the filter."""
    h, mask = keys.view(np.uint64), np.uint64(len(bits) * 8 - 1)
    found = np.ones(len(h), bool)
    for at in (h & mask, (h >> np.uint64(32)) & mask):
        found &= (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
    return found
