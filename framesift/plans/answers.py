"""The questions a user asks of a parsed corpus, each as one call."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framesift.operators import export, search, stats
from framesift.operators.shaders import shader_call_stats
from framesift.plans.parse import ParsedLogs


def summary(parsed: ParsedLogs) -> DataFrame:
    """What a parse reports, per log."""
    return stats.parse_summary(parsed.logs(), parsed.frames)


def frame_detail(parsed: ParsedLogs, frame_num: int) -> export.Document:
    """One frame of each log with calls, summary, shaders, programs and buffers, as JSON lines."""
    return export.frames_json(parsed, parsed.frames.filter(F.col("frame_num") == frame_num))


def longest_or_zero(parsed: ParsedLogs) -> DataFrame:
    """The longest frame of each log; a row of zeros for a log without frames."""
    longest = stats.longest_frame(parsed.frames)
    rest = [c for c in longest.columns if c != "log_id"]
    return parsed.facts.select("log_id").join(longest, "log_id", "left").select(
        "log_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in rest]
    )


def export_answer(
    parsed: ParsedLogs, path: str, kind: str = "frames", fmt: str = "json", query: str = "", by_log: bool = False
) -> None:
    """Export by question: frames, funcs, shader, search, top or longest.

    An unknown question means frames; ``query`` holds the keywords of a search or the
    number of top frames. With ``by_log`` each log gets a folder of its own.
    """
    fmt = fmt or "json"
    if fmt not in export.FORMATS:
        raise ValueError(f"unsupported format: {fmt}")
    calls = parsed.api_calls
    if kind == "funcs":
        export.export(stats.func_stats(calls), "funcs", fmt, path, by_log=by_log)
    elif kind == "shader":
        export.export(parsed.shaders, "shaders", fmt, path, by_log=by_log)
    elif kind == "search":
        found = search.with_page_numbers(search.kept(search.export_search(parsed.calls, query)))
        export.export(found, "search", fmt, path, by_log=by_log)
    else:
        shape = "frame" if kind == "longest" else "frames"
        if kind == "top":
            n = int(query) if query.isdigit() and int(query) > 0 else stats.TOP_FRAMES
            frames = stats.top_frames(parsed.frames, n)
        elif kind == "longest":
            frames = longest_or_zero(parsed)
        else:
            frames = parsed.frames
        export.export(frames, shape, fmt, path, calls, by_log, parsed)


def shader_calls(parsed: ParsedLogs) -> DataFrame:
    return shader_call_stats(parsed.api_calls)
