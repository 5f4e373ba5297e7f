"""Searching lines, calls and frames, and paging through results."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framesift.operators.scan import rank_in_log
from framesift.session import store

LINES_PER_PAGE = 1000
PAGE_SIZE = 50
PREVIEW_ROWS = 100
FRAMES_PER_CHUNK = 65536


def has_all(text: Column, keywords: list[str]) -> Column:
    """Every keyword occurs, in any case. True for no keywords."""
    low = F.lower(text)
    return reduce(lambda a, b: a & b, [low.contains(F.lower(F.lit(k))) for k in keywords], F.lit(True))


def keyword_search(lines: DataFrame, keywords: list[str], match_all_when_empty: bool = False) -> DataFrame:
    """Lines that hold every keyword. Empty keywords are ignored; with none left nothing
    matches, unless asked otherwise."""
    words = [k for k in keywords if k]
    if not words and not match_all_when_empty:
        return lines.filter(F.lit(False))
    return lines.filter(has_all(F.col("content"), words))


def raw_search(lines: DataFrame, query: str) -> DataFrame:
    """Search by one query text, split on white space. A blank query matches every line."""
    if query == "":
        raise ValueError("missing query")
    return keyword_search(lines, query.split(), match_all_when_empty=True)


def pattern_search(lines: DataFrame, pattern: str) -> DataFrame:
    """Positions, counted from 0, of lines that match a regular expression."""
    return lines.filter(F.col("content").rlike(pattern)).withColumn("position", F.col("line_num") - 1)


def kept(matches: DataFrame) -> DataFrame:
    """Matches written once, for results that are paged.

    Pages, totals and previews need the matches and their number in each chunk. Asked of kept
    matches, none of them reads the text again.
    """
    return store(matches, "matches")


def with_page_numbers(matches: DataFrame, per_page: int = LINES_PER_PAGE) -> DataFrame:
    """Page of each match within its log, from 0."""
    ranked = rank_in_log(matches, "rank")
    return ranked.withColumn("page_num", F.expr(f"(rank - 1) div {per_page}")).drop("rank")


def match_counts(matches: DataFrame) -> DataFrame:
    return matches.groupBy("log_id").agg(F.count("*").alias("total"))


def page_from_zero(matches: DataFrame, page: int, size: int) -> DataFrame:
    """One page of each log's matches, pages from 0; sizes below 1 mean 1000."""
    page, size = max(page, 0), size if size > 0 else LINES_PER_PAGE
    return rank_in_log(matches, "rank", skip=page * size, take=size).drop("rank")


def page_from_one(matches: DataFrame, page: int | None = None, size: int | None = None) -> DataFrame:
    """One page of each log's matches, pages from 1; missing or unusable values mean 1 and 50."""
    page, size = _page_values(page, size)
    return rank_in_log(matches, "rank", skip=(page - 1) * size, take=size).drop("rank")


def page_info(
    rows: DataFrame, page: int | None = None, size: int | None = None, logs: DataFrame | None = None
) -> DataFrame:
    """Total, page and size per log as reported with a page: 1 for a page past the end.

    Each of ``logs`` (a table with a ``log_id`` per log) gets a row, with a total of 0 if it has
    no rows; without ``logs`` only those that have some are known.
    """
    page, size = _page_values(page, size)
    counts = match_counts(rows)
    if logs is not None:
        counts = logs.select("log_id").join(counts, "log_id", "left")
    total = F.coalesce(F.col("total"), F.lit(0)).alias("total")
    past = F.lit((page - 1) * size) >= total
    return counts.select("log_id", total, F.when(past, 1).otherwise(page).alias("page"), F.lit(size).alias("page_size"))


def frame_page(frames: DataFrame, page: int | None = None, size: int | None = None) -> DataFrame:
    """One page of each log's frame list, pages from 1."""
    page, size = _page_values(page, size)
    chunked = frames.withColumn("chunk_id", F.expr(f"frame_num div {FRAMES_PER_CHUNK}"))
    return rank_in_log(chunked, "rank", "frame_num", (page - 1) * size, size).drop("rank", "chunk_id")


def preview(matches: DataFrame, n: int = PREVIEW_ROWS) -> DataFrame:
    """The first n matches of each log, with the number of those left out."""
    left_out = match_counts(matches).select("log_id", F.greatest(F.col("total") - n, F.lit(0)).alias("left_out"))
    return rank_in_log(matches, "rank", take=n).drop("rank").join(left_out, "log_id")


def _page_values(page: int | None, size: int | None) -> tuple[int, int]:
    return (page if page and page > 0 else 1), (size if size and size > 0 else PAGE_SIZE)


def calls_in_duration_range(calls: DataFrame, frames: DataFrame, low_us: int, high_us: int) -> DataFrame:
    """Calls of the frames whose total time lies in the range, ends included."""
    chosen = frames.filter(F.col("total_time_us").between(low_us, high_us)).select("log_id", "frame_num")
    return calls.join(chosen, ["log_id", "frame_num"], "left_semi")


def frame_range(frames: DataFrame, first: int, last: int) -> DataFrame:
    return frames.filter(F.col("frame_num").between(first, last))


def rendered_calls(calls: DataFrame) -> DataFrame:
    """Call lines written anew, numbered by their place among the calls of the log."""
    return rank_in_log(calls, "ordinal").select(
        "log_id", "chunk_id", F.col("ordinal").alias("line_num"),
        F.concat("api_name", F.lit(": count="), "call_count", F.lit(", time="), "time_us").alias("content"),
    )


def export_search(calls: DataFrame, query: str) -> DataFrame:
    """Search over the rendered calls, as exported; a blank query matches nothing."""
    return keyword_search(rendered_calls(calls), query.split())
