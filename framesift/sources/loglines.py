"""Numbered lines together with one row of facts per chunk."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framesift.functions.lines import is_fps, is_noise, is_shader_fence, is_shader_header
from framesift.operators.scan import CHUNK
from framesift.session import small_side

def content_facts(content: Column) -> list[Column]:
    """What the order-dependent steps must know of a chunk before they start:
    whether it may hold shader lines, and whether it holds anything but noise."""
    return [
        F.bool_or(is_shader_fence(content) | is_shader_header(content)).alias("fenced"),
        F.bool_or(~is_noise(content) & ~is_fps(content)).alias("has_text"),
    ]


def keyed(chunks: DataFrame, name: str) -> DataFrame:
    """Give chunks ``(log_id, place, ...)`` ids that are unique and rise along each log.

    Stored, so that every later use sees the same ids.
    """
    ids = chunks.orderBy("log_id", "place").withColumn(CHUNK, F.monotonically_increasing_id())
    return small_side(ids, name)


@dataclass(frozen=True)
class LogLines:
    """``lines(log_id, chunk_id, line_num, content, ...)`` and
    ``chunks(log_id, chunk_id, chunk_end, fenced, has_text)``.

    Line numbers are physical, from 1. A chunk is a run of consecutive lines of one
    log; chunk ids are unique in the corpus and rise along each log.
    """

    lines: DataFrame
    chunks: DataFrame
    # What the first chunk of each log tells of its kind, if the source noted it.
    heads: DataFrame | None = None

    @staticmethod
    def of(lines: DataFrame) -> LogLines:
        """Any table ``(log_id, chunk_id, line_num, content)`` whose chunk ids rise along each log."""
        placed = lines.withColumnRenamed(CHUNK, "place")
        facts = placed.groupBy("log_id", "place").agg(
            F.max("line_num").alias("chunk_end"), *content_facts(F.col("content"))
        )
        chunks = keyed(facts, "chunks")
        ids = chunks.select("log_id", "place", CHUNK)
        return LogLines(placed.join(ids, ["log_id", "place"]).drop("place"), chunks.drop("place"))

    def only(self, logs: DataFrame) -> LogLines:
        """The logs named by a table of ``log_id``.

        Lines are matched by chunk, so a large log stays spread over the cluster
        when there are too many logs for a broadcast.
        """
        chunks = small_side(self.chunks.join(logs.select("log_id"), "log_id", "left_semi"), "chunks")
        return LogLines(self.lines.join(chunks.select(CHUNK), CHUNK, "left_semi"), chunks)

    def log_ends(self) -> DataFrame:
        return self.chunks.groupBy("log_id").agg(F.max("chunk_end").alias("last_line"))
