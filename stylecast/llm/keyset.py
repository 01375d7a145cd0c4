"""A filter of 64-bit keys that tasks look into: what it lets through is counted exactly later.

One bit a key, in a map of 16 bits a key, or as many as asked for, and at most 2^``MOST`` bits (32 MB), however many
keys there are.  The map is put together by Spark and only its words that aren't zero come
to the driver.  A key that was put in is always found; others are let through at a rate of
one in sixteen, more if there are over 2^24 keys, which costs time and changes no result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

LEAST, MOST = 16, 28


def key_filter(keys: DataFrame, col: str = "h", per_key: int = 16):
    """A Spark broadcast of the map of the keys (a long column, well mixed), for ``found``."""
    bits = int(np.clip(np.ceil(np.log2(per_key * max(1, keys.count()))), LEAST, MOST))
    slot = F.shiftrightunsigned(F.col(col), 64 - bits)
    words = keys.groupBy(F.shiftright(slot, 6).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned({col}, {64 - bits}) & 63 AS int))")).alias("bits"))
    got = words.toArrow()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[got.column("word").to_numpy()] = got.column("bits").to_numpy()
    return keys.sparkSession.sparkContext.broadcast(out.view(np.uint64))


def found(words: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which of the keys (uint64) the filter lets through."""
    bits = len(words).bit_length() - 1 + 6
    slot = keys >> np.uint64(64 - bits)
    return words[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63)) & np.uint64(1) == 1
