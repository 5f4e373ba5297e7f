"""Bit tables of fixed size that tell which keys cannot be in a set.

A table has ``2^18`` words of 64 bits (2 MB) unless another size is given, whatever the size of the set: with very
large sets it lets more keys through, but never holds one back. It is gathered as at most
a row for each word and shared with all tasks; an exact join always follows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORDS = 1 << 18


def bit_table(keys: DataFrame, key: Column, size: int = WORDS) -> np.ndarray:
    """The table, of ``size`` words, of a column of 64-bit hashes."""
    hashed = keys.select(key.alias("h"))
    words = hashed.select(F.expr(f"h & {size - 1}").alias("word"), F.expr("shiftleft(1L, cast(shiftright(h, 40) & 63 as int))").alias("bit"))
    bits = np.zeros(size, np.int64)
    rows = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    bits[rows["word"].to_numpy()] = rows["bits"].to_numpy()
    return bits


def maybe(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    h = hashes.view(np.int64)
    return ((bits[h & (len(bits) - 1)] >> ((h >> 40) & 63)) & 1) == 1
