"""Frame assembly for raw traces: one call per line, no times."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framesift.functions.lines import is_raw_frame_end, listed_ids, program_id, raw_calls
from framesift.operators.scan import CHUNK, before, earlier_chunks, in_chunk
from framesift.sources.loglines import LogLines


def mark(lines: DataFrame) -> DataFrame:
    """Calls with the number of frame ends before them in their chunk; other lines are
    dropped before the one shuffle, on the chunk."""
    w = in_chunk()
    ends = is_raw_frame_end(F.col("api_name"))
    return (
        raw_calls(lines)
        .withColumns({"ends_frame": ends, "is_call": ~ends})
        .select(
            "*",
            F.coalesce(F.sum(F.col("ends_frame").cast("int")).over(before(w)), F.lit(0)).alias("ended_here"),
        )
    )


def carry(marks: DataFrame, log: LogLines) -> DataFrame:
    """One row per chunk: frames ended in the chunks before it."""
    totals = marks.groupBy(CHUNK).agg(
        F.sum(F.col("ends_frame").cast("int")).alias("n_ended")
    )
    prior = earlier_chunks()
    return (
        totals.join(log.chunks.select("log_id", CHUNK), CHUNK)
        .select(
            "log_id", CHUNK,
            F.coalesce(F.sum("n_ended").over(prior), F.lit(0)).alias("frame_base"),
        )
        .join(log.log_ends(), "log_id")
    )


def attribute(marks: DataFrame, carried: DataFrame) -> DataFrame:
    """Calls and frame ends with the frame they belong to; a join and a projection."""
    return marks.join(carried, CHUNK).select(
        "log_id", CHUNK, "line_num", "api_name", "raw_params", "is_call", "ends_frame", "last_line",
        (F.col("frame_base") + F.col("ended_here")).alias("frame_num"),
    )


def api_calls(rows: DataFrame) -> DataFrame:
    return rows.filter("is_call").select(
        "log_id", "chunk_id", "frame_num", "line_num", "api_name",
        F.lit(1).cast("bigint").alias("call_count"), F.lit(0).cast("bigint").alias("time_us"),
        "raw_params",
    )


def frames(rows: DataFrame) -> DataFrame:
    """One row per frame that holds a call; it ends on the line before the next frame end."""
    zero = F.lit(0).cast("bigint")
    return (
        rows.filter(F.col("is_call") | F.col("ends_frame"))
        .groupBy("log_id", "frame_num")
        .agg(
            F.min(F.when(F.col("is_call"), F.col("line_num"))).alias("start_line"),
            F.max(F.when(F.col("ends_frame"), F.col("line_num"))).alias("boundary"),
            F.max("last_line").alias("last_line"),
            F.count(F.when(F.col("is_call"), 1)).alias("api_call_count"),
        )
        .filter(F.col("api_call_count") > 0)
        .select(
            "log_id", "frame_num", "start_line",
            F.coalesce(F.col("boundary") - 1, F.col("last_line")).alias("end_line"),
            zero.alias("total_time_us"), zero.alias("swap_time_us"), zero.alias("api_total_time_us"),
            "api_call_count",
        )
    )


def log_facts(log_ends: DataFrame) -> DataFrame:
    return log_ends.select(
        "log_id", F.lit(None).cast("double").alias("fps_line"), F.col("last_line").alias("line_count"),
        F.lit(0).cast("bigint").alias("rejects"),
    )


def programs(calls: DataFrame) -> DataFrame:
    """Programs made current, in call order; repeated use is kept."""
    return (
        calls.filter(F.col("api_name") == "glUseProgram")
        .select("log_id", "frame_num", "line_num", program_id(F.col("raw_params")).alias("program_id"))
        .filter(F.col("program_id") > 0)
    )


def buffer_creations(calls: DataFrame) -> DataFrame:
    """Ids named by generating and creating calls, by position in the call."""
    return calls.filter(F.col("api_name").isin("glGenBuffers", "glCreateBuffers")).select(
        "log_id", "frame_num", "line_num",
        F.posexplode(listed_ids(F.col("raw_params"))).alias("pos", "buffer_id"),
        F.lit("GL_ARRAY_BUFFER").alias("target"),
        F.lit(0).cast("bigint").alias("size"),
        F.lit("").alias("usage"),
    )
