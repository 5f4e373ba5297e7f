"""Where each function is called: stored lists of lines, in blocks that lookups can skip.

A block holds up to ``BLOCK_LINES`` calls of one function in one log: its first and last
line and, in order, how far each call lies behind the first. Blocks are sorted by name, log
and line and written in small row groups, whose ranges of names and lines Parquet notes, so a
lookup reads only the row groups that may hold what it asks for. The distances rise within a
block and are stored as gaps by Parquet's delta encoding.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framesift.operators.scan import CHUNK
from framesift.session import store

BLOCK_LINES = 128
ROW_GROUP_BYTES = 256 * 2**10
SORTED_BY = ["api_name", "log_id", "first_line"]
_LAYOUT = {
    "parquet.block.size": str(ROW_GROUP_BYTES),
    "parquet.writer.version": "PARQUET_2_0",
    # Distances are delta-encoded; names and logs repeat from row to row.
    "parquet.enable.dictionary": "false",
    "parquet.enable.dictionary#api_name": "true",
    "parquet.enable.dictionary#log_id": "true",
}


def blocks(calls: DataFrame) -> DataFrame:
    """``api_name, log_id, first_line, last_line, n_calls, distances`` of ``calls(chunk_id, ...)``.

    Blocks never cross a chunk, so a function on most lines of a large log is blocked by
    many tasks.
    """
    keys = ["api_name", "log_id", CHUNK]
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("line_num")) - 1
    numbered = calls.select(*keys, "line_num").withColumn("block", F.floor(place / BLOCK_LINES))
    lines = F.array_sort(F.collect_list("line_num"))
    found = numbered.groupBy(*keys, "block").agg(lines.alias("lines"))
    first, last = F.element_at("lines", 1), F.element_at("lines", -1)
    return found.select(
        "api_name", "log_id", first.alias("first_line"), last.alias("last_line"), F.size("lines").alias("n_calls"),
        F.transform("lines", lambda at: (at - first).cast("int")).alias("distances"),
    )


def save_postings(calls: DataFrame, path: str) -> None:
    """Write the blocks of all functions to ``path``."""
    # Stored first, as bounds of ranges are sampled from all rows: calls are numbered and gathered once.
    made = store(blocks(calls), "blocks").repartitionByRange(*SORTED_BY).sortWithinPartitions(*SORTED_BY)
    made.write.mode("errorifexists").options(**_LAYOUT).parquet(path)


def open_postings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def lines_of(
    postings: DataFrame, api_name: str, log_id=None, first_line: int | None = None, last_line: int | None = None
) -> DataFrame:
    """``api_name, log_id, line_num`` of a function, exactly named, of one log or of all,
    within a range of lines with both ends; no rows for an unknown name."""
    found = postings.filter(F.col("api_name") == api_name)
    if log_id is not None:
        found = found.filter(F.col("log_id") == log_id)
    # Both ends of a block are tested, so whole row groups drop out by their ranges.
    if first_line is not None:
        found = found.filter(F.col("last_line") >= first_line)
    if last_line is not None:
        found = found.filter(F.col("first_line") <= last_line)
    line = F.col("first_line") + F.col("distance")
    rows = found.select("api_name", "log_id", "first_line", F.explode("distances").alias("distance"))
    rows = rows.select("api_name", "log_id", line.alias("line_num"))
    low, high = F.lit(first_line if first_line is not None else 1), F.lit(last_line if last_line is not None else 2**63 - 1)
    return rows.filter(F.col("line_num").between(low, high))


def calls_of_functions(postings: DataFrame) -> DataFrame:
    """Functions with the number of their blocks and calls per log, without reading any line."""
    return postings.groupBy("api_name", "log_id").agg(
        F.sum("n_calls").alias("n_calls"), F.min("first_line").alias("first_line"), F.max("last_line").alias("last_line")
    )


def has_postings(postings: DataFrame, api_name: str | None = None) -> bool:
    """Whether there is a call at all, or one of the named function."""
    found = postings if api_name is None else postings.filter(F.col("api_name") == api_name)
    return not found.isEmpty()
