"""Statistics of calls and frames, and rankings of frames.

A total that does not fit 64 bits is NULL, and so are means of it; other groups keep theirs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FRAME_LIST_COLUMNS = [
    "log_id", "frame_num", "start_line", "end_line", "total_time_us", "swap_time_us", "api_total_time_us",
]
TOP_FRAMES = 20


def whole_part(total: str, n: str) -> Column:
    """Integer mean; NULL where there is nothing to divide by."""
    return F.when(F.col(n) != 0, F.expr(f"{total} div {n}"))


def total_of_frames() -> Column:
    """Summed frame time; NULL if a frame's time or the sum does not fit 64 bits."""
    known = F.count("total_time_us") == F.count(F.lit(1))
    return F.when(known, F.try_sum("total_time_us")).alias("total_time_us")


def func_stats(calls: DataFrame) -> DataFrame:
    """Per function over all frames: entries (log lines), time and mean time per entry."""
    return (
        calls.groupBy("log_id", "api_name")
        .agg(F.count("*").alias("call_count"), F.try_sum("time_us").alias("total_time_us"))
        .withColumn("avg_time_us", whole_part("total_time_us", "call_count"))
    )


def by_time(stats: DataFrame, key: str = "api_name", time: str = "total_time_us") -> DataFrame:
    """Sort for presentation: most time first, ties by name."""
    return stats.orderBy(F.desc(time), "log_id", key)


def func_stats_with_prefix(calls: DataFrame, prefix: str) -> DataFrame:
    """Function statistics of names with a case-sensitive prefix; filtered before grouping."""
    return func_stats(calls.filter(F.col("api_name").startswith(prefix)) if prefix else calls)


def frame_api_summary(calls: DataFrame) -> DataFrame:
    """Counts and time per function in each frame."""
    return calls.groupBy("log_id", "frame_num", "api_name").agg(
        F.try_sum("call_count").alias("call_count"), F.try_sum("time_us").alias("time_us")
    )


def frame_func_stats(calls: DataFrame, frame_num: int | None = None) -> DataFrame:
    """Function statistics of one frame (or of each): calls are summed counts here."""
    chosen = calls if frame_num is None else calls.filter(F.col("frame_num") == frame_num)
    return (
        frame_api_summary(chosen)
        .withColumnRenamed("time_us", "total_time_us")
        .withColumn("avg_time_us", whole_part("total_time_us", "call_count"))
    )


def frame_summary(frames: DataFrame) -> DataFrame:
    """Number of frames and their mean, longest, shortest and summed time, per log."""
    return (
        frames.groupBy("log_id")
        .agg(
            F.count("*").alias("total_frames"),
            F.max("total_time_us").alias("max_time_us"),
            F.min("total_time_us").alias("min_time_us"),
            total_of_frames(),
        )
        .withColumn("avg_time_us", whole_part("total_time_us", "total_frames"))
    )


def parse_summary(logs: DataFrame, frames: DataFrame) -> DataFrame:
    """What a parse reports: frames, rate, longest frame in ms, first and last frame time.

    ``format_label`` is told from the frame rate only; ``kind`` is the detected grammar.
    """
    per_log = frames.groupBy("log_id").agg(
        F.max("total_time_us").alias("max_us"),
        F.min_by("total_time_us", "frame_num").alias("first_frame_us"),
        F.max_by("total_time_us", "frame_num").alias("last_frame_us"),
    )
    return logs.join(per_log, "log_id", "left").select(
        "log_id", "kind",
        F.when(F.col("fps") > 0, "profile").otherwise("rawtrace").alias("format_label"),
        "frame_count", "fps", "total_time_us",
        F.coalesce(F.col("max_us") / 1000.0, F.lit(0.0)).alias("max_frame_time"),
        "first_frame_us", "last_frame_us",
    )


def slowest_call_per_frame(calls: DataFrame) -> DataFrame:
    """The call with most time of each frame (the first on ties) and the number of entries."""
    rank = F.struct("time_us", -F.col("line_num"))
    return (
        calls.groupBy("log_id", "frame_num")
        .agg(
            F.max_by(F.struct("api_name", "time_us", "line_num"), rank).alias("top"),
            F.count("*").alias("api_call_count"),
        )
        .select("log_id", "frame_num", "top.api_name", "top.time_us", "top.line_num", "api_call_count")
    )


def call_postings(calls: DataFrame) -> DataFrame:
    """Line numbers of every function, one row per line.

    A flat table rather than lists, as one function may be called on most lines.
    """
    return calls.select("api_name", "log_id", "line_num")


def save_postings(postings: DataFrame, path: str) -> None:
    """Write postings so that a lookup reads only the files and row groups of its name."""
    order = ["api_name", "log_id", "line_num"]
    postings.repartitionByRange(*order).sortWithinPartitions(*order).write.parquet(path)


def lookup(postings: DataFrame, api_name: str) -> DataFrame:
    """Lines of one function, exactly named; no rows for an unknown one."""
    return postings.filter(F.col("api_name") == api_name).orderBy("log_id", "line_num")


def has_postings(postings: DataFrame) -> bool:
    return not postings.isEmpty()


def top_frames(frames: DataFrame, n: int = TOP_FRAMES) -> DataFrame:
    """The n longest frames of each log. Spark keeps n rows per log in every task before shuffling."""
    w = Window.partitionBy("log_id").orderBy(F.desc("total_time_us"), "frame_num")
    return frames.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n)


def top_frames_of_all(frames: DataFrame, n: int = TOP_FRAMES) -> DataFrame:
    """The n longest frames over all logs."""
    return frames.orderBy(F.desc("total_time_us"), "log_id", "frame_num").limit(max(n, 0))


def longest_frame(frames: DataFrame) -> DataFrame:
    """The longest frame of each log, the first on ties; grouped without a sort of all frames."""
    rank = F.struct("total_time_us", -F.col("frame_num"))
    rest = [c for c in frames.columns if c != "log_id"]
    return frames.groupBy("log_id").agg(F.max_by(F.struct(*rest), rank).alias("f")).select("log_id", "f.*")


def top_with_summary(frames: DataFrame, n: int = TOP_FRAMES) -> DataFrame:
    """Top frames, each with the frame summary of its log."""
    summary = frame_summary(frames).withColumnsRenamed({"total_time_us": "all_time_us"})
    return top_frames(frame_list(frames), n).join(summary, "log_id")


def frame_list(frames: DataFrame) -> DataFrame:
    return frames.select(*FRAME_LIST_COLUMNS)


def frame_ms(frames: DataFrame) -> DataFrame:
    """Frame times in milliseconds to three decimals."""
    return frames.select(
        "log_id", "frame_num",
        *[F.round(F.col(f"{c}_us") / 1000, 3).alias(f"{c}_ms") for c in ("total_time", "swap_time", "api_total_time")],
    )
