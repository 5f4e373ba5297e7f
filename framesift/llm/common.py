"""What the operators share: tables, keys of rows, and words of Arrow text batches.

Conventions of all operators here:

* Only the columns an operator needs are read; further columns never meet its own
  names, since rows are handed on as one struct or joined back by key.
* A null text counts as an empty one, and a null ``doc_id`` sorts after all others.
* A document is a pair of ``doc_id`` and text. Rows that agree in both are the same
  document, and each of them gets the same result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Records and bytes that one Arrow batch holds at most, so that a batch of long texts, and
#: the hashes of all its bytes, stay within a Python worker's memory. Whole texts are never
#: cut: a longer one is a batch of its own.
BATCH_RECORDS = 1000
BATCH_BYTES = 2 * 2**20

_BATCH_LIMITS = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": (("10000",), str(BATCH_RECORDS)),
    "spark.sql.execution.arrow.maxBytesPerBatch": (("64MB", "67108864", "67108864b"), str(BATCH_BYTES)),
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    for setting, (usual, ours) in _BATCH_LIMITS.items():
        if spark.conf.get(setting) in usual:
            spark.conf.set(setting, ours)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def text_key(column: str = "text") -> Column:
    """Second half of a document's key beside its ``doc_id``."""
    return F.xxhash64(F.lit(1), text_of(column))


def keyed(docs: DataFrame) -> DataFrame:
    """``doc_id, key, text`` of a document table, texts without nulls."""
    return docs.select("doc_id", text_key().alias("key"), text_of().alias("text"))


def same_document(left: DataFrame, right: DataFrame) -> Column:
    return left["doc_id"].eqNullSafe(right["doc_id"]) & (left["key"] == right["key"])


# --- Arrow text columns as bytes -------------------------------------------------


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column, and where each row starts (one entry more than rows)."""
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        kind = np.int32
    _, offsets, data = column.buffers()
    starts = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None or len(starts) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[starts[0] : starts[-1]], starts - starts[0]


def mix64(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly (a published finaliser of multiplications and shifts)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTE_VALUES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = 0xD6E8FEB86659FD93


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
        np.multiply.accumulate(out, out=out)
    return out


class Powers:
    """Powers of the hash base and of its inverse, kept as long as a task lives."""

    def __init__(self):
        self.up = self.down = np.zeros(0, np.uint64)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            self.up, self.down = _powers(_BASE, size), _powers(pow(_BASE, -1, 2**64), size)
        return self.up[:n], self.down[:n]


def running_hash(data: np.ndarray, powers: Powers) -> np.ndarray:
    """Prefix sums from which the hash of any byte range follows, one entry more than bytes."""
    up, _ = powers.of(len(data))
    out = np.empty(len(data) + 1, np.uint64)
    out[0] = 0
    np.cumsum(BYTE_VALUES[data] * up, out=out[1:])
    return out


def range_hash(running: np.ndarray, starts: np.ndarray, ends: np.ndarray, powers: Powers) -> np.ndarray:
    """64-bit hash of each byte range, independent of where the range lies."""
    _, down = powers.of(len(running))
    return mix64((running[ends] - running[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def word_table(separators: bytes) -> np.ndarray:
    """For each byte: 0 if it separates words, else the byte with A-Z lower-cased."""
    out = np.arange(256, dtype=np.uint8)
    out[ord("A") : ord("Z") + 1] += 32
    out[list(separators)] = 0
    return out


#: Separators of the two word rules: white space, and all ASCII but letters and digits.
BLANKS = word_table(bytes([0x20, *range(0x09, 0x0E)]))
NON_WORDS = word_table(bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))


def word_places(data: np.ndarray, offsets: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The folded bytes, where each word of all rows starts and ends, and the first word of each row.

    A NUL byte separates words under both rules only if the table says so; it is
    told apart from separators by the table of the byte itself.
    """
    folded = lower[data]
    inside = folded != 0
    if lower is BLANKS:
        inside |= data == 0
    edge = np.empty(len(data) + 1, bool)
    edge[0] = edge[-1] = True
    np.not_equal(inside[1:], inside[:-1], out=edge[1:-1])
    edge[offsets] = True
    cuts = np.flatnonzero(edge)
    if len(data) == 0:
        return folded, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    starts, ends = cuts[:-1], cuts[1:]
    is_word = inside[starts]
    starts, ends = starts[is_word], ends[is_word]
    return folded, starts, ends, np.searchsorted(starts, offsets)


def words_of(data: np.ndarray, offsets: np.ndarray, lower: np.ndarray, powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all rows in order, and the first word of each row."""
    folded, starts, ends, first = word_places(data, offsets, lower)
    if len(data) == 0:
        return np.zeros(0, np.uint64), first
    return range_hash(running_hash(folded, powers), starts, ends, powers), first


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n words; entry i starts at word i."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    out = words[: len(words) - n + 1].copy()
    for k in range(1, n):
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + words[k : len(words) - n + 1 + k])
    return out


def drop_folder(spark: SparkSession, path: str) -> None:
    """Remove an intermediate table that a later one has replaced."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
