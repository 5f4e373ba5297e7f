"""Frame assembly for aggregated logs.

Two pieces of state run along a log: whether a line lies inside a shader block
(its text is then source, not log), and whether a frame is open. Each is found in
two steps: inside every chunk, then over one summary row per chunk. The first
needs the text of chunks that hold shader lines only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framesift.functions.lines import (
    CALL, COST, FENCE, FPS, HEADER, NOISE, OTHER, REJECT, SWAP, classify, is_fps, is_noise,
)
from framesift.operators.scan import CHUNK, before, earlier_chunks, in_chunk, over_chunks, upto
from framesift.session import small_side, store
from framesift.sources.loglines import LogLines

CLOSES, OPENS = 0, 1
USED = [CALL, SWAP, COST, REJECT, FPS, FENCE]


@dataclass(frozen=True)
class ShaderState:
    """Block state: per line of the chunks with shader lines, and per chunk at its start."""

    states: DataFrame
    starts: DataFrame


def shader_state(log: LogLines) -> ShaderState | None:
    """State of the shader blocks; None if the corpus has no shader lines at all."""
    fenced = log.chunks.filter("fenced").select(CHUNK)
    if fenced.isEmpty():
        return None
    fenced = small_side(fenced, "fenced")
    states = store(_states_in_chunk(log.lines.join(fenced, CHUNK, "left_semi")), "shader_states", "zstd")
    return ShaderState(states, small_side(_starts(log.chunks, states), "shader_starts"))


def _states_in_chunk(lines: DataFrame) -> DataFrame:
    """Block state of each line for a chunk that starts outside of one (``inside``).

    A fence right after a shader header opens a block in any case (and anchors the
    state from there on); any other fence toggles it.
    """
    w = in_chunk()
    klass, line = F.col("line_class"), F.col("line_num")
    fence = klass == FENCE
    df = classify(lines.filter(~is_noise(F.col("content"))), "content")
    df = df.select(
        "*",
        F.last(F.when(~klass.isin(NOISE, FPS), klass), ignorenulls=True).over(before(w)).alias("class_before"),
        F.max(F.when(klass == HEADER, line)).over(upto(w)).alias("header"),
    )
    paired = fence & F.coalesce(F.col("class_before") == HEADER, F.lit(False))
    df = df.select(
        "*", paired.alias("paired"), F.sum(F.when(fence & ~paired, 1).otherwise(0)).over(upto(w)).alias("toggles")
    )
    df = df.select("*", F.max(F.when(F.col("paired"), F.col("toggles"))).over(upto(w)).alias("at_pair"))
    anchored = F.col("at_pair").isNotNull()
    since = F.when(anchored, F.col("toggles") - F.col("at_pair") + 1).otherwise(F.col("toggles"))
    df = df.select("*", anchored.alias("anchored"), (since % 2 == 1).alias("inside"))
    opening = [
        F.max(F.when(fence & _masked(F.lit(b)), line)).over(upto(w)).alias(f"block{int(b)}")
        for b in (False, True)
    ]
    return df.select("*", *opening).drop("class_before", "paired", "toggles", "at_pair")


def _masked(starts_inside: Column) -> Column:
    return F.when(F.col("anchored"), F.col("inside")).otherwise(F.col("inside") != starts_inside)


def _starts(chunks: DataFrame, states: DataFrame) -> DataFrame:
    """For every chunk: does it start inside a block, in which one, after which header."""
    line, klass = F.col("line_num"), F.col("line_class")
    other = F.when(klass != FPS, line)
    summary = states.groupBy(CHUNK).agg(
        F.min_by(klass == FENCE, other).alias("starts_with_fence"),
        F.max_by(klass == HEADER, other).alias("ends_with_header"),
        F.max_by(F.col("inside").cast("int"), line).alias("inside_end"),
        F.bool_or("anchored").alias("anchored"),
        F.max("header").alias("last_header"),
        F.max("block0").alias("last_block0"),
        F.max("block1").alias("last_block1"),
    )
    w, prior = over_chunks(), earlier_chunks()
    c = chunks.join(summary, CHUNK, "left").withColumn(
        "ends_with_header", F.coalesce("ends_with_header", F.when(F.col("has_text"), F.lit(False)))
    )
    after_header = F.coalesce(F.last("ends_with_header", ignorenulls=True).over(prior), F.lit(False))
    # A fence at the start of a chunk may be paired with a header at the end of an earlier one.
    # It then opens a block, as it does for a chunk that starts outside.
    c = c.withColumn("pairs_first", after_header & F.coalesce(F.col("starts_with_fence"), F.lit(False)))
    adds = F.coalesce("inside_end", F.lit(0))
    known = F.coalesce("anchored", F.lit(False)) | F.col("pairs_first")
    c = c.withColumn("flips", F.sum(adds).over(upto(w)))
    c = c.withColumn("flips_base", F.max(F.when(known, F.col("flips") - adds)).over(prior))
    flips_in = F.coalesce(F.lag("flips").over(w), F.lit(0)) - F.coalesce("flips_base", F.lit(0))
    c = c.withColumn("starts_inside", (flips_in % 2 == 1) & ~F.col("pairs_first"))
    last_block = F.when(F.col("starts_inside"), F.col("last_block1")).otherwise(F.col("last_block0"))
    return c.select(
        "log_id", CHUNK, "fenced", "starts_inside",
        F.max(last_block).over(prior).alias("block_base"),
        F.max("last_header").over(prior).alias("header_base"),
    )


def placed_states(shader: ShaderState) -> DataFrame:
    """Lines of the chunks with shader lines: inside a block or not (for a fence: after it),
    the block (line of its opening fence) and the last header."""
    block = F.when(F.col("starts_inside"), F.col("block1")).otherwise(F.col("block0"))
    return shader.states.join(shader.starts, CHUNK).select(
        "log_id", *shader.states.columns,
        _masked(F.col("starts_inside")).alias("masked"),
        F.greatest(block, "block_base").alias("block"),
        F.greatest("header", "header_base").alias("last_header"),
    )


def survivors(lines: DataFrame) -> DataFrame:
    """Lines that are neither noise nor a frame rate."""
    c = F.col("content")
    return lines.filter(~is_noise(c) & ~is_fps(c))


def log_rows(log: LogLines, shader: ShaderState | None) -> DataFrame:
    """Typed rows, of which those of the classes in ``USED`` matter for frames.

    Lines are first narrowed by their endings. The exact class is not filtered here:
    such a filter would be pushed below the classification and repeat its patterns.
    """
    c, klass = F.col("content"), F.col("line_class")
    lines = log.lines.filter(c.endswith("us") | c.endswith("ms") | c.contains("libGL:"))
    if shader is None:
        return classify(lines)
    starts = shader.starts.select(CHUNK, "fenced", "starts_inside")
    hidden = F.when(F.col("starts_inside") & (klass != FPS), OTHER).otherwise(klass)
    plain = starts.filter("not fenced")
    in_fenced = placed_states(shader).filter(
        (klass.isin(CALL, SWAP, COST, REJECT) & ~F.col("masked")) | klass.isin(FENCE, FPS)
    )
    in_plain = (
        classify(lines.join(plain, CHUNK), "starts_inside")
        .withColumn("line_class", hidden)
        .drop("starts_inside")
    )
    in_fenced = in_fenced.select(*in_plain.columns)
    # Where all chunks hold shader lines, the text is not read once more for the others.
    return in_fenced if plain.isEmpty() else in_plain.unionByName(in_fenced)


def _step() -> Column:
    """What a line does to the frame: calls open it, swaps close it."""
    klass = F.col("line_class")
    return F.when(klass == CALL, OPENS).when(klass == SWAP, CLOSES)


# Times are summed as two whole numbers, of their upper and lower bits: sums of rows then stay
# plain 64-bit additions and never overflow. Decimals are used for rows of frames and chunks only.
LOW_BITS = 31


def _halves(value: Column) -> tuple[Column, Column]:
    return F.shiftright(value, LOW_BITS), value.bitwiseAND(2**LOW_BITS - 1)


def _whole(high: Column, low: Column) -> Column:
    return high.cast("decimal(38,0)") * F.lit(2**LOW_BITS).cast("decimal(11,0)") + low.cast("decimal(20,0)")


def mark(rows: DataFrame) -> DataFrame:
    """Rows with the frame state reached inside their own chunk: one shuffle, on
    chunk, of typed fields without text or file name, and one sort."""
    w = in_chunk()
    klass, step, opened = F.col("line_class"), F.col("step"), F.col("open")
    df = rows.withColumn("step", _step())
    high, low = _halves(F.when(step == OPENS, F.col("value")).otherwise(0))
    return (
        df.select(
            "*",
            F.last("step", ignorenulls=True).over(before(w)).alias("open"),
            F.sum(high).over(upto(w)).alias("high_here"),
            F.sum(low).over(upto(w)).alias("low_here"),
        )
        .select(
            "*",
            F.coalesce(
                F.sum(F.when((step == CLOSES) & (opened == OPENS), 1).otherwise(0)).over(before(w)), F.lit(0)
            ).alias("closed_here"),
        )
        .filter(klass.isin(USED))
        .drop("step")
    )


def carry(marks: DataFrame, log: LogLines) -> DataFrame:
    """One row per chunk: the frame state in which it starts. Its size grows with the
    number of chunks only."""
    line, step = F.col("line_num"), _step()
    stepped = F.when(step.isNotNull(), line)
    chunks = marks.groupBy(CHUNK).agg(
        F.min_by(step, stepped).alias("first_step"),
        F.max_by(step, stepped).alias("last_step"),
        F.sum(F.when((step == CLOSES) & (F.col("open") == OPENS), 1).otherwise(0)).alias("n_closed"),
        _whole(F.max("high_here"), F.max("low_here")).alias("n_time"),
    ).join(log.chunks.select("log_id", CHUNK), CHUNK)
    prior = earlier_chunks()
    open_in = F.coalesce(F.last("last_step", ignorenulls=True).over(prior), F.lit(CLOSES))
    chunks = chunks.withColumn("open_in", open_in)
    # A swap before any call of the chunk ends a frame left open by an earlier chunk.
    joins_open = (F.col("open_in") == OPENS) & F.coalesce(F.col("first_step") == CLOSES, F.lit(False))
    chunks = chunks.withColumn("ends_carried", joins_open.cast("int"))

    def total_before(c: Column) -> Column:
        return F.coalesce(F.sum(c).over(prior), F.lit(0))

    time = total_before(F.col("n_time"))
    return chunks.select(
        "log_id", CHUNK, "open_in", "ends_carried",
        total_before(F.col("n_closed") + F.col("ends_carried")).alias("frame_base"),
        # NULL beyond 94 bits, and so are the totals of the frames that need it.
        F.floor(time / F.lit(2**LOW_BITS)).try_cast("bigint").alias("high_base"),
        (time % F.lit(2**LOW_BITS)).cast("bigint").alias("low_base"),
    ).join(log.log_ends(), "log_id")


def attribute(marks: DataFrame, carried: DataFrame) -> DataFrame:
    """Every row with its frame and running time in the whole log.

    Join and projection only: the window results of ``mark`` are shifted by the
    start values of the chunk.
    """
    opened = F.coalesce("open", "open_in") == OPENS
    carried_end = F.when(F.col("open").isNotNull(), F.col("ends_carried")).otherwise(0)
    return marks.join(carried, CHUNK).select(
        "log_id", CHUNK, "line_num", "line_class", "api_name", "call_count", "value", "fps", "last_line",
        (F.col("line_class") == CALL).alias("is_call"),
        opened.alias("in_frame"),
        ((F.col("line_class") == SWAP) & opened).alias("ends_frame"),
        (F.col("frame_base") + F.col("closed_here") + carried_end).alias("frame_num"),
        (F.col("high_base") + F.col("high_here")).alias("high_so_far"),
        (F.col("low_base") + F.col("low_here")).alias("low_so_far"),
    )


def api_calls(rows: DataFrame) -> DataFrame:
    """Calls of aggregated logs, one row per log line."""
    return rows.filter("is_call").select(
        "log_id", "chunk_id", "frame_num", "line_num", "api_name", "call_count",
        F.col("value").alias("time_us"), F.lit("").alias("raw_params"),
    )


def frames(rows: DataFrame) -> DataFrame:
    """One row per frame of aggregated logs.

    Only mergeable aggregates are used, so a frame may be as large as a log: sums
    of call time after a given line come from differences of the running total.
    A frame time that does not fit 64 bits is NULL.
    """
    line, value = F.col("line_num"), F.col("value")
    high, low = _halves(value)
    is_call, ends = F.col("is_call"), F.col("ends_frame")
    cost = F.col("line_class") == COST
    gap_cost, frame_cost = cost & ~F.col("in_frame"), cost & F.col("in_frame")
    f = (
        rows.filter(is_call | cost | ends)
        .groupBy("log_id", "frame_num")
        .agg(
            F.min(F.when(is_call, line)).alias("start_line"),
            F.max(F.when(ends, line)).alias("swap_line"),
            F.max(F.when(ends, value)).alias("swap_us"),
            F.max("last_line").alias("last_line"),
            F.sum(F.when(is_call, high)).alias("call_high"),
            F.sum(F.when(is_call, low)).alias("call_low"),
            F.count(F.when(is_call, 1)).alias("api_call_count"),
            # Both halves of a running total rise along the lines, so they peak together.
            *[F.max(F.when(is_call, F.col(f"{h}_so_far"))).alias(f"{h}_at_end") for h in ("high", "low")],
            F.max_by(value, F.when(gap_cost, line)).alias("gap_last"),
            F.max_by(value, F.when(gap_cost & (value > 0), line)).alias("gap_positive"),
            F.max_by(value, F.when(frame_cost & (value > 0), line)).alias("cost_positive"),
            *[F.max(F.when(frame_cost & (value > 0), F.col(f"{h}_so_far"))).alias(f"{h}_at_positive") for h in ("high", "low")],
            *[F.min(F.when(frame_cost, F.col(f"{h}_so_far"))).alias(f"{h}_at_first") for h in ("high", "low")],
            F.bool_or(frame_cost).alias("has_cost"),
        )
        .filter(F.col("api_call_count") > 0)
    )
    gap = F.coalesce(F.col("gap_positive"), F.lit(0))

    def time_after(place: str) -> Column:
        """Call time between a cost line and the end of the frame; NULL if no such line is there."""
        return _whole(F.col("high_at_end") - F.col(f"high_{place}"), F.col("low_at_end") - F.col(f"low_{place}"))

    total = (
        F.when(F.col("cost_positive").isNotNull(), F.col("cost_positive") + time_after("at_positive"))
        .when(F.coalesce(F.col("gap_last"), F.lit(0)) == 0, gap + _whole(F.col("call_high"), F.col("call_low")))
        .when(F.col("has_cost"), gap + time_after("at_first"))
        .otherwise(gap)
    )
    swapped = F.col("swap_line").isNotNull()
    return f.withColumn("total_time_us", total).select(
        "log_id", "frame_num", "start_line",
        F.coalesce("swap_line", "last_line").alias("end_line"),
        F.col("total_time_us").try_cast("bigint").alias("total_time_us"),
        F.coalesce("swap_us", F.lit(0)).alias("swap_time_us"),
        F.when(swapped, F.greatest(F.lit(0), F.col("total_time_us") - F.col("swap_us")))
        .otherwise(0)
        .try_cast("bigint")
        .alias("api_total_time_us"),
        "api_call_count",
    )


def log_facts(rows: DataFrame, log_ends: DataFrame) -> DataFrame:
    """Per log: last readable frame rate, number of lines, lines with unreadable numbers."""
    seen = (
        rows.filter(F.col("line_class").isin(FPS, REJECT))
        .groupBy("log_id")
        .agg(
            F.max_by("fps", F.when(F.col("fps").isNotNull(), F.col("line_num"))).alias("fps_line"),
            F.count(F.when(F.col("line_class") == REJECT, 1)).alias("rejects"),
        )
    )
    return log_ends.join(seen, "log_id", "left").select(
        "log_id", "fps_line", F.col("last_line").alias("line_count"),
        F.coalesce("rejects", F.lit(0)).alias("rejects"),
    )
