"""Shader sources found between fences, and statistics of shader calls."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framesift.functions.lines import FENCE, FPS, HEADER, NOISE
from framesift.operators.aggregated import ShaderState, placed_states, survivors
from framesift.operators.scan import CHUNK
from framesift.session import small_side
from framesift.sources.loglines import LogLines

# Fixed values of the shader list: length after which a source is cut, and the note put there.
LIST_SOURCE_CHARS = 2000
CUT_NOTE = "\n[Source truncated]"
PREVIEW_CHARS = 50
#: Sources are put together whatever their length; each is one value, which its task must have room for.
#: Who sets a number of bytes here gets NULL for longer ones, and reads these from the table of body lines.
LONGEST_SOURCE_BYTES: int | None = None
# Fixed values of the expanded view.
VIEW_SOURCE_CHARS = 50000
VIEW_CUT_NOTE = "...[truncated]"


def body_lines(log: LogLines, shader: ShaderState) -> DataFrame:
    """``log_id, chunk_id, line_num, block, content`` of the lines inside shader blocks.

    Line text is read only from chunks that hold shader lines or start inside a block; a block
    of any length is as many rows as it has lines.
    """
    klass, columns = F.col("line_class"), ["log_id", CHUNK, "line_num", "block", "content"]
    here = placed_states(shader).filter(F.col("masked") & ~klass.isin(FENCE, HEADER, NOISE, FPS)).select(*columns)
    inside = shader.starts.filter("starts_inside and not fenced").select(CHUNK, F.col("block_base").alias("block"))
    if inside.isEmpty():
        return here
    return here.unionByName(survivors(log.lines.join(inside, CHUNK)).select(*columns))


def lines_of_shaders(body: DataFrame, shaders: DataFrame) -> DataFrame:
    """``log_id, frame_num, block_num, chunk_id, line_num, content`` of the kept blocks."""
    blocks = small_side(shaders.select("log_id", "frame_num", "block_num"), "shader_blocks")
    return body.withColumnRenamed("block", "block_num").join(blocks, ["log_id", "block_num"]).select(
        "log_id", "frame_num", "block_num", CHUNK, "line_num", "content"
    )


def _sources(body: DataFrame, shader: ShaderState) -> list[DataFrame]:
    """``log_id, block, source`` in tables that share no block, of all blocks and whole sources.

    A block that no chunk starts inside of lies in one chunk and is joined at once. The
    others are joined within each chunk, then over their chunks.
    """
    keys, longest = ["log_id", "block"], LONGEST_SOURCE_BYTES
    size = [] if longest is None else [F.sum(F.octet_length("content").cast("bigint") + 1).alias("bytes")]

    def fitting(text: str) -> Column:
        return F.col(text) if longest is None else F.when(F.col("bytes") <= longest, F.col(text)).alias(text)

    def in_one_chunk(lines: DataFrame) -> DataFrame:
        joined = lines.groupBy(*keys).agg(*size, _in_order("line_num", "content").alias("source"))
        return joined.select(*keys, fitting("source"))

    carried = small_side(shader.starts.filter("starts_inside").select("log_id", F.col("block_base").alias("block")).distinct(), "carried")
    if carried.isEmpty():
        return [in_one_chunk(body)]
    # A chunk is one split of the input, which bounds a piece.
    pieces = body.join(carried, keys, "left_semi").groupBy("log_id", CHUNK, "block").agg(*size, _in_order("line_num", "content").alias("piece"))
    sized = []
    if longest is not None:
        # Pieces of a block that does not fit are NULL and hence never gathered.
        pieces = pieces.withColumn("bytes", F.sum("bytes").over(Window.partitionBy(*keys))).withColumn("piece", fitting("piece"))
        sized = [F.first("bytes").alias("bytes")]
    joined = pieces.groupBy(*keys).agg(*sized, _in_order("chunk_id", "piece").alias("source"))
    return [in_one_chunk(body.join(carried, keys, "left_anti")), joined.select(*keys, fitting("source"))]


def shaders(body: DataFrame, shader: ShaderState, rows: DataFrame, frames: DataFrame) -> DataFrame:
    """One row per kept shader block: frame, id, command line and source.

    A block closed by a fence is kept if it has text and a frame is open there; one
    restarted by a new header is lost; one open at the end goes to the last frame.
    """
    klass = F.col("line_class")
    placed = placed_states(shader)
    fences = placed.filter(klass == FENCE)
    opens = fences.filter("masked").select("log_id", "block", F.col("last_header").alias("header"))
    closes = (
        fences.filter("not masked")
        .select("log_id", CHUNK, "line_num", "block")
        .join(rows.filter(klass == FENCE).select(CHUNK, "line_num", "in_frame", "frame_num"), [CHUNK, "line_num"])
        .select(
            "log_id", "block", F.lit(True).alias("is_closed"),
            F.when(F.col("in_frame"), F.col("frame_num")).alias("close_frame"),
        )
    )
    headers = placed.filter(klass == HEADER).select(
        "log_id", F.col("line_num").alias("header"), F.col("value").alias("shader_id"),
        F.col("content").alias("command_line"),
    )
    ends = opens.groupBy("log_id").agg(F.max("block").alias("last_block")).join(
        frames.groupBy("log_id").agg(F.max("frame_num").alias("last_frame")), "log_id"
    ).select("log_id", F.col("last_block").alias("block"), "last_frame")
    blocks = (
        opens.join(closes, ["log_id", "block"], "left")
        .join(ends, ["log_id", "block"], "left")
        .withColumn(
            "frame_num",
            F.when(F.col("is_closed"), F.col("close_frame")).otherwise(F.col("last_frame")),
        )
        .filter(F.col("frame_num").isNotNull())
        .join(headers, ["log_id", "header"], "left")
        .select(
            "log_id", "block", "frame_num",
            F.coalesce("shader_id", F.lit(0)).alias("shader_id"),
            F.coalesce("command_line", F.lit("")).alias("command_line"),
        )
    )
    # Sources are shuffled once, by block; what else is known of a block comes to them.
    parts = [sources.join(blocks, ["log_id", "block"]) for sources in _sources(body, shader)]
    return reduce(DataFrame.unionByName, parts).select("log_id", "frame_num", F.col("block").alias("block_num"), "shader_id", "command_line", "source")


def _in_order(order: str, text: str) -> Column:
    ordered = F.array_sort(F.collect_list(F.when(F.col(text).isNotNull(), F.struct(order, text))))
    return F.array_join(F.transform(ordered, lambda s: s[text]), "\n")


def _cut(text: Column, n: int, note: str) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit(note))).otherwise(text)


def shader_list(shaders: DataFrame) -> DataFrame:
    """Shaders with sources cut to the length of the list view (in characters)."""
    return shaders.withColumn("source", _cut(F.col("source"), LIST_SOURCE_CHARS, CUT_NOTE))


def shader_view(shaders: DataFrame) -> DataFrame:
    """Shaders with sources cut to the length of the expanded view."""
    return shaders.withColumn("source", _cut(F.col("source"), VIEW_SOURCE_CHARS, VIEW_CUT_NOTE))


def shader_previews(shaders: DataFrame) -> DataFrame:
    """First characters of each source."""
    return shaders.withColumn("preview", _cut(F.col("source"), PREVIEW_CHARS, "..."))


def shader_call_class(name: Column) -> Column:
    return (
        F.when(name.contains("glCreateShader"), "Create")
        .when(name.contains("glCompileShader"), "Compile")
        .when(name.contains("glShaderSource"), "Source")
    )


def shader_call_stats(calls: DataFrame) -> DataFrame:
    """Entries and time of creating, compiling and source-setting calls, per log."""
    return (
        calls.select("log_id", shader_call_class(F.col("api_name")).alias("type"), "time_us")
        .filter(F.col("type").isNotNull())
        .groupBy("log_id", "type")
        .agg(F.count("*").alias("compile_count"), F.try_sum("time_us").alias("total_compile_time_us"))
    )


def shader_summary(stats: DataFrame) -> DataFrame:
    return stats.groupBy("log_id").agg(
        F.count("*").alias("shader_types"),
        F.sum("compile_count").alias("total_compile"),
        F.try_sum("total_compile_time_us").alias("total_time_us"),
    )
