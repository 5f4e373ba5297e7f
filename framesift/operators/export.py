"""Results as text, CSV and JSON files.

Every text result is a table of lines with the columns that order them. It is
sorted by range and written by many tasks; the parts in order are the document.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framesift.operators.stats import frame_api_summary
from framesift.session import ranged_for_files, store
from framesift.sources.folders import local_folder, write_folders

# Column headings of the result kinds, each with the column it shows.
HEADINGS = {
    "search": {"LineNum": "line_num", "Content": "content", "PageNum": "page_num"},
    "funcs": {
        "FuncName": "api_name", "CallCount": "call_count", "TotalTimeUs": "total_time_us", "AvgTimeUs": "avg_time_us",
    },
    "frames": {
        "FrameNum": "frame_num", "StartLine": "start_line", "EndLine": "end_line", "TotalTimeUs": "total_time_us",
        "APICallCount": "api_call_count",
    },
    "shader_stats": {
        "Type": "type", "CompileCount": "compile_count", "TotalCompileTimeUs": "total_compile_time_us",
    },
    "shaders": {"ID": "shader_id", "Source": "source"},
    "frame": {
        "FrameNum": "frame_num", "StartLine": "start_line", "EndLine": "end_line", "TotalTimeUs": "total_time_us",
        "SwapBufferTimeUs": "swap_time_us", "APITotalTimeUs": "api_total_time_us", "APICallCount": "api_call_count",
    },
}
# JSON shows a command line beside these, where a shader has one.
JSON_HEADINGS = HEADINGS | {"shaders": {"ID": "shader_id", "CommandLine": "command_line", "Source": "source"}}
# Order of the rows of each kind within a log.
ORDERS = {
    "search": ["line_num"],
    "funcs": ["-total_time_us", "api_name"],
    "frames": ["frame_num"],
    "shader_stats": ["-total_compile_time_us", "type"],
    "shaders": ["frame_num", "block_num"],
    "frame": ["frame_num"],
}
FORMATS = ("txt", "csv", "json")
# Stands in text results for a source that was not put together, if a longest one was set.
SOURCE_IN_LINES = "[Source in the table of shader lines]"
# Rules drawn in text results.
RULE = "-" * 50
BETWEEN_SHADERS = "=" * 50


@dataclass(frozen=True)
class Document:
    """Text lines and the columns that put them in order."""

    lines: DataFrame
    order: list[str]

    def sorted(self) -> DataFrame:
        return self.lines.orderBy(*self.order)


def _order(kind: str) -> list[Column]:
    return [F.desc(c[1:]) if c.startswith("-") else F.asc(c) for c in ORDERS[kind]]


def headed(df: DataFrame, kind: str, headings: dict[str, dict[str, str]] = HEADINGS) -> DataFrame:
    """The columns of a result kind under their headings, in order of log and row."""
    return df.orderBy("log_id", *_order(kind)).select(*_headings(kind, headings))


def headed_by_log(df: DataFrame, kind: str, headings: dict[str, dict[str, str]] = HEADINGS) -> DataFrame:
    """The same with a leading column ``log``, each log in order in neighbouring partitions."""
    order = ["log", *_order(kind)]
    return ranged_for_files(df.withColumnRenamed("log_id", "log"), *order).select("log", *_headings(kind, headings))


def _headings(kind: str, headings: dict[str, dict[str, str]]) -> list[Column]:
    if kind not in headings:
        raise ValueError(f"unsupported data type for export: {kind}")
    return [F.col(column).alias(name) for name, column in headings[kind].items()]


def two_decimals(value: Column) -> Column:
    """Two decimals of the exact binary value, ties to even (``format_string`` rounds its
    shortest decimal form up instead)."""
    return F.call_function("format_number", value, F.lit("0.00"))


def search_text(results: DataFrame) -> Document:
    return Document(
        results.select("log_id", "line_num", F.format_string("[%d] %s", "line_num", "content").alias("value")),
        ["log_id", "line_num"],
    )


def _table_text(df: DataFrame, kind: str, head: list[str], row: Column) -> Document:
    """A heading and a rule per log, then one line per row."""
    key, name = ORDERS[kind][0][1:], ORDERS[kind][1]
    body = df.select(
        "log_id", F.lit(2).alias("part"), (-F.col(key)).alias("rank"), F.col(name).alias("name"), row.alias("value")
    )
    top = df.select("log_id").distinct().select(
        "log_id", F.posexplode(F.array(*[F.lit(h) for h in head])).alias("part", "value")
    ).select("log_id", "part", F.lit(0).cast("bigint").alias("rank"), F.lit("").alias("name"), "value")
    return Document(top.unionByName(body), ["log_id", "part", "rank", "name"])


def func_stats_text(stats: DataFrame) -> Document:
    head = ["%-30s %10s %15s %15s" % ("Function", "CallCount", "TotalTime(us)", "AvgTime(us)"), RULE]
    row = F.format_string("%-30s %10d %15d %15d", "api_name", "call_count", "total_time_us", "avg_time_us")
    return _table_text(stats, "funcs", head, row)


def shader_stats_text(stats: DataFrame) -> Document:
    head = ["%-20s %15s %20s" % ("Type", "CompileCount", "TotalCompileTime(us)"), RULE]
    row = F.format_string("%-20s %15d %20d", "type", "compile_count", "total_compile_time_us")
    return _table_text(stats, "shader_stats", head, row)


def shader_text(shaders: DataFrame) -> Document:
    """Id, rule and source of every shader, with a double rule before all but the first of a log."""
    first = shaders.groupBy("log_id").agg(F.min(F.struct("frame_num", "block_num")).alias("first"))
    is_first = F.struct("frame_num", "block_num") == F.col("first")
    entry = [F.format_string("Shader ID: %d", "shader_id"), F.lit(RULE), F.coalesce("source", F.lit(SOURCE_IN_LINES))]
    gap = [F.lit(""), F.lit(BETWEEN_SHADERS), F.lit("")]
    lines = shaders.join(first, "log_id").select(
        "log_id", "frame_num", "block_num",
        F.posexplode(F.when(is_first, F.array(*entry)).otherwise(F.array(*gap, *entry))).alias("part", "value"),
    )
    return Document(lines, ["log_id", "frame_num", "block_num", "part"])


def frame_text(frames: DataFrame, calls: DataFrame) -> Document:
    """A heading block per frame, then its calls in order."""
    total = F.col("total_time_us")
    head = F.array(
        F.format_string("Frame #%d", "frame_num"),
        F.format_string("Lines: %d - %d", "start_line", "end_line"),
        F.format_string("Total Time: %d us (%s ms)", total, two_decimals(total / 1000.0)),
        F.format_string("API Calls: %d", "api_call_count"),
        F.lit(""),
        F.lit("%-30s %10s %10s" % ("API Name", "Count", "Time(us)")),
        F.lit(RULE),
    )
    no_line = F.lit(0).cast("bigint").alias("line_num")
    top = frames.select("log_id", "frame_num", F.posexplode(head).alias("part", "value")).withColumn("line_num", no_line)
    bottom = frames.select("log_id", "frame_num", F.lit(8).alias("part"), F.lit("").alias("value"), no_line)
    body = calls.join(frames.select("log_id", "frame_num"), ["log_id", "frame_num"], "left_semi").select(
        "log_id", "frame_num", F.lit(7).alias("part"),
        F.format_string("%-30s %10d %10d", "api_name", "call_count", "time_us").alias("value"), "line_num",
    )
    return Document(top.unionByName(body).unionByName(bottom), ["log_id", "frame_num", "part", "line_num"])


# Parts of a frame object in the order they are written.
_HEAD, _CALLS, _SUMMARY_HEAD, _SUMMARY, _SHADER_HEAD, _SHADERS, _PROGRAM_HEAD, _PROGRAMS, _BUFFER_HEAD, _BUFFERS, _TAIL = range(11)
_FRAME_KEYS = ["log_id", "frame_num", "part", "k1", "k2"]


def frames_json(parsed, frames: DataFrame | None = None) -> Document:
    """Whole frames as JSON: one object per frame, one text line per element of it.

    Commas lead an element, so each line needs to know only whether it is the first
    of its list; a frame of any size is written without gathering it.
    """
    frames = parsed.frames if frames is None else frames
    keys = ["log_id", "frame_num"]
    # Joins with the frames narrow these to the chosen ones.
    calls, summary = parsed.api_calls, _aggregated_only(parsed)
    shaders, programs, creations = parsed.shaders, parsed.programs, parsed.buffer_creations
    firsts = (
        frames.join(programs.groupBy(*keys).agg(F.min("line_num").alias("first_program")), keys, "left")
        .join(
            creations.groupBy(*keys).agg(F.min(F.struct("line_num", "pos")).alias("first_buffer")), keys, "left"
        )
        .join(shaders.groupBy(*keys).agg(F.min("block_num").alias("first_shader")), keys, "left")
        .join(summary.groupBy(*keys).agg(F.min("api_name").alias("first_name")), keys, "left")
    )
    # One row for each frame, asked by every kind of element.
    firsts = store(firsts, "frame_heads")

    def fixed(parts: dict[int, Column]) -> DataFrame:
        """The lines that every frame has, all from one pass over the frames."""
        rows = F.array(*[F.struct(F.lit(part).alias("part"), value.alias("value")) for part, value in parts.items()])
        return firsts.select(*keys, F.inline(rows)).select(
            *keys, "part", F.lit(0).cast("bigint").alias("k1"), F.lit("").alias("k2"), "value"
        )

    def element(df: DataFrame, part: int, first: Column, body: Column, k1=F.lit(0), k2=F.lit("")) -> DataFrame:
        comma = F.when(first, "").otherwise(",")
        return df.join(firsts.drop(*[c for c in firsts.columns if c in df.columns and c not in keys]), keys).select(
            *keys, F.lit(part).alias("part"), k1.cast("bigint").alias("k1"), k2.cast("string").alias("k2"),
            F.concat(comma, body).alias("value"),
        )

    def opened(name: str, first: str, empty: str) -> Column:
        return F.when(F.col(first).isNull(), f'"{name}":{empty}').otherwise(f'"{name}":[')

    head = F.format_string(
        '{"FrameNum":%d,"StartLine":%d,"EndLine":%d,"TotalTimeUs":%d,"SwapBufferTimeUs":%d,"APITotalTimeUs":%d,"APICalls":[',
        "frame_num", "start_line", "end_line", "total_time_us", "swap_time_us", "api_total_time_us",
    )
    pieces = [
        fixed({
            _HEAD: head,
            _SUMMARY_HEAD: F.lit('],"APISummary":{'),
            _SHADER_HEAD: F.lit('},"Shaders":['),
            _PROGRAM_HEAD: F.concat(F.lit("],"), opened("Programs", "first_program", "null")),
            _BUFFER_HEAD: F.concat(
                F.when(F.col("first_program").isNull(), ",").otherwise("],"),
                opened("BufferCreations", "first_buffer", "null"),
            ),
            _TAIL: F.when(F.col("first_buffer").isNull(), "}").otherwise("]}"),
        }),
        element(
            calls, _CALLS, F.col("line_num") == F.col("start_line"),
            F.to_json(F.struct(
                F.col("api_name").alias("APIName"), F.col("call_count").alias("Count"),
                F.col("time_us").alias("TimeUs"), F.col("line_num").alias("LineNum"),
                F.col("raw_params").alias("RawParams"),
            )),
            F.col("line_num"),
        ),
        element(
            summary, _SUMMARY, F.col("api_name") == F.col("first_name"),
            F.concat(
                _json_text(F.col("api_name")), F.lit(":"),
                F.to_json(F.struct(
                    F.col("api_name").alias("APIName"), F.col("call_count").alias("Count"),
                    F.col("time_us").alias("TimeUs"),
                )),
            ),
            k2=F.col("api_name"),
        ),
        element(
            shaders, _SHADERS, F.col("block_num") == F.col("first_shader"),
            F.to_json(F.struct(
                F.col("shader_id").alias("ID"),
                F.when(F.col("command_line") != "", F.col("command_line")).alias("CommandLine"),
                F.col("source").alias("Source"),
            )),
            F.col("block_num"),
        ),
        element(
            programs, _PROGRAMS, F.col("line_num") == F.col("first_program"), F.col("program_id").cast("string"),
            F.col("line_num"),
        ),
        element(
            creations, _BUFFERS, F.struct("line_num", "pos") == F.col("first_buffer"),
            F.to_json(F.struct(
                F.col("buffer_id").alias("ID"), F.col("target").alias("Target"), F.col("size").alias("Size"),
                F.col("usage").alias("Usage"),
            )),
            F.col("line_num"), F.lpad(F.col("pos").cast("string"), 10, "0"),
        ),
    ]
    lines = pieces[0]
    for p in pieces[1:]:
        lines = lines.unionByName(p)
    return Document(lines, _FRAME_KEYS)


def _json_text(c: Column) -> Column:
    return F.regexp_replace(F.to_json(F.array(c)), r"^\[|\]\z", "")


def _aggregated_only(parsed) -> DataFrame:
    """Summaries per function; raw traces have none."""
    raw = parsed.kinds.filter(F.col("kind") == "rawtrace").select("log_id")
    summary = frame_api_summary(parsed.calls)
    return summary if raw.isEmpty() else summary.join(raw, "log_id", "left_anti")


def log_json(parsed) -> Document:
    """Whole parsed logs as JSON, one object per log, in text lines like ``frames_json``."""
    body = frames_json(parsed)
    first = parsed.frames.groupBy("log_id").agg(F.min("frame_num").alias("first_frame"))
    logs = parsed.logs().join(first, "log_id", "left")
    comma = (F.col("part") == _HEAD) & (F.col("frame_num") > F.col("first_frame"))
    middle = body.lines.join(first, "log_id").select(
        "log_id", "frame_num", "part", "k1", "k2",
        F.when(comma, F.concat(F.lit(","), "value")).otherwise(F.col("value")).alias("value"),
    )

    def edge(frame_num: int, value: Column) -> DataFrame:
        return logs.select(
            "log_id", F.lit(frame_num).cast("bigint").alias("frame_num"), F.lit(0).alias("part"),
            F.lit(0).cast("bigint").alias("k1"), F.lit("").alias("k2"), value.alias("value"),
        )

    none = F.col("frame_count") == 0
    start = edge(-1, F.when(none, '{"Frames":null').otherwise('{"Frames":['))
    rest = F.to_json(F.struct(F.col("total_time_us").alias("TotalTimeUs"), F.col("fps").alias("FPS")))
    end = edge(2**63 - 1, F.concat(F.when(none, ",").otherwise("],"), F.substring(rest, F.lit(2), F.length(rest))))
    return Document(start.unionByName(middle).unionByName(end), _FRAME_KEYS)


def write_document(doc: Document, path: str, by_log: bool = False) -> None:
    """Write a text result; with ``by_log`` each log gets a folder of its own."""
    if by_log:
        # The folder column must lead the order, else the writer sorts by it anew.
        order = ["log", *doc.order[1:]]
        ranged = ranged_for_files(doc.lines.withColumnRenamed("log_id", "log"), *order).select("log", "value")
        if folder := local_folder(ranged.sparkSession, path):
            write_folders(ranged, "log", F.coalesce("value", F.lit("")), folder, ".txt")
        else:
            ranged.write.partitionBy("log").text(path)
    else:
        doc.sorted().select("value").write.text(path)


def _writer(rows: DataFrame, by_log: bool):
    return rows.write.partitionBy("log") if by_log else rows.write


def export(
    df: DataFrame, kind: str, fmt: str, path: str, calls: DataFrame | None = None, by_log: bool = False, parsed=None
) -> None:
    """Write a result of one kind as txt, csv or json; with ``by_log`` each log in a folder of its own.

    Frames as json are whole trees with calls, shaders, programs and buffers if the parsed logs
    are given, else rows of their numbers.
    """
    if df is None:
        raise ValueError("nothing to export")
    if fmt not in FORMATS:
        raise ValueError(f"unsupported format: {fmt}")
    if kind not in HEADINGS:
        raise ValueError(f"unsupported data type for export: {kind}")

    def rows(headings: dict[str, dict[str, str]]) -> tuple[DataFrame, str | None]:
        """Sorted rows, and the folder where folders of logs are written by plain file calls."""
        if not by_log:
            return headed(df, kind, headings), None
        return headed_by_log(df, kind, headings), local_folder(df.sparkSession, path)

    if fmt == "csv":
        # Blanks at both ends belong to the texts.
        options = {"escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
        found, folder = rows(HEADINGS)
        if folder:
            write_folders(found, "log", F.to_csv(F.struct(*HEADINGS[kind]), options), folder, ".csv", ",".join(HEADINGS[kind]))
        else:
            _writer(found, by_log).options(header=True, **options).csv(path)
    elif fmt == "json" and kind in ("frames", "frame") and parsed is not None:
        write_document(frames_json(parsed, df), path, by_log)
    elif fmt == "json":
        if kind == "shaders":
            # Fields without a value are left out.
            df = df.withColumn("command_line", F.when(F.col("command_line") != "", F.col("command_line")))
        found, folder = rows(JSON_HEADINGS)
        if folder:
            write_folders(found, "log", F.to_json(F.struct(*JSON_HEADINGS[kind])), folder, ".json")
        else:
            _writer(found, by_log).json(path)
    else:
        write_document(text_of(df, kind, calls), path, by_log)


def text_of(df: DataFrame, kind: str, calls: DataFrame | None = None) -> Document:
    if kind in ("frames", "frame"):
        if calls is None:
            raise ValueError("a frame text needs the calls")
        return frame_text(df, calls)
    return {
        "search": search_text, "funcs": func_stats_text, "shader_stats": shader_stats_text, "shaders": shader_text,
    }[kind](df)
