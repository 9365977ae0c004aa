"""Bitmaps over 64-bit hashes: a filter that lets too much through, never too little."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A bitmap has 16 to 32 bits for each entry until this many bits (64 MB).
MAX_BITS_LOG2 = 29


def bitmap(keys: DataFrame, max_log2: int = MAX_BITS_LOG2) -> tuple[np.ndarray, int]:
    """(bytes, log2 of bits) with the bit of every ``key`` set. Never larger than the bound."""
    n = keys.count()
    k = min(max_log2, max(16, (16 * max(n, 1) - 1).bit_length()))
    place = F.shiftrightunsigned("key", 64 - k)
    words = keys.select(F.shiftright(place, 6).alias("w"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(key, {64 - k}) & 63 as int))").alias("b"))
    got = words.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(1 << (k - 6), dtype=np.int64)
    out[got.column("w").to_numpy()] = got.column("b").to_numpy()
    return out.view(np.uint8), k


def member(bits: np.ndarray, k: int, h: np.ndarray) -> np.ndarray:
    place = h >> np.uint64(64 - k)
    return (bits[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1
