"""Classification and field extraction of single log lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framesift.functions import patterns as p
from framesift.functions.text import (
    as_long, capture, starts_with_any, strip_sequence_prefix, strip_space,
)

# Classes of a line of an aggregated log.
CALL, SWAP, COST = "call", "swap", "cost"
FPS, HEADER, FENCE = "fps", "header", "fence"
NOISE, REJECT, OTHER = "noise", "reject", "other"

LONG_MAX = 2**63 - 1


def is_noise(c: Column) -> Column:
    """Lines that an aggregated log never uses: blank, browser, warning, error, gc, vendor."""
    # Calls and shader text begin with other characters, which spares them the pattern.
    return (c == "") | (F.substring(c, 1, 1).isin(*p.NOISE_STARTS) & c.rlike(p.NOISE_LINE))


def is_fps(c: Column) -> Column:
    return c.contains("libGL:") & c.rlike(p.FPS_TEXT)


def is_shader_header(c: Column) -> Column:
    return c.contains("glShaderSource") & c.rlike(p.SHADER_HEADER)


def is_shader_fence(c: Column) -> Column:
    return c.contains("####") & c.rlike(p.SHADER_FENCE)


def is_frame_boundary(c: Column) -> Column:
    """True for a swap line and for a frame-cost line."""
    return c.rlike(p.SWAP_LINE) | c.rlike(p.COST_LINE)


def fps_value(c: Column) -> Column:
    """Frames per second named anywhere in the line; NULL if it is no number."""
    return capture(c, p.FPS_TEXT).try_cast("double")


def classify(lines: DataFrame, *keep: str) -> DataFrame:
    """Class and typed fields of every line of an aggregated log; the text is dropped,
    other columns only on request.

    Calls, swaps and costs are tried first: no noise pattern can match them, and
    they are nearly all lines of a real log. Calls in the usual form are split at
    blanks, which takes half the time of capturing their three fields by pattern.
    """
    c, words = F.col("content"), F.col("words")
    plain = F.when(c.endswith(" us") & c.rlike(p.PLAIN_API_LINE), F.split(c, " "))
    shape = (
        F.when(words.isNotNull() | (c.endswith("us") & c.rlike(p.API_LINE)), CALL)
        .when(c.endswith("us") & c.rlike(p.SWAP_LINE), SWAP)
        .when(c.endswith("ms") & c.rlike(p.COST_LINE), COST)
        .when(is_noise(c), NOISE)
        .when(is_fps(c), FPS)
        .when(is_shader_header(c), HEADER)
        .when(is_shader_fence(c), FENCE)
        .otherwise(OTHER)
    )
    s = F.col("shape")

    def word(i: int, start: int, end: int) -> Column:
        """Characters of a word without ``start`` leading and ``end`` trailing ones."""
        w = F.get(words, F.lit(i))
        return F.substring(w, F.lit(start + 1), F.length(w) - start - end)

    shaped = lines.select("*", plain.alias("words")).select("*", shape.alias("shape"))
    fields = shaped.select(
        "chunk_id", "line_num", *keep, "shape",
        F.when(words.isNotNull(), word(0, 0, len(":"))).when(s == CALL, capture(c, p.API_LINE, 1)).alias("api_name"),
        F.when(words.isNotNull(), as_long(word(1, len("count="), len(","))))
        .when(s == CALL, as_long(capture(c, p.API_LINE, 2)))
        .alias("call_count"),
        F.when(words.isNotNull(), as_long(word(2, len("time="), 0)))
        .when(s == CALL, as_long(capture(c, p.API_LINE, 3)))
        .when(s == SWAP, F.coalesce(as_long(capture(c, p.SWAP_LINE)), F.lit(LONG_MAX)))
        .when(s == COST, F.try_multiply(as_long(capture(c, p.COST_LINE)), F.lit(1000)))
        .when(s == HEADER, as_long(capture(c, p.SHADER_HEADER)))
        .alias("value"),
        F.when(s == FPS, fps_value(c)).alias("fps"),
    )
    unusable = F.col("value").isNull() | ((s == CALL) & F.col("call_count").isNull())
    line_class = (
        F.when((s == HEADER) & unusable, NOISE)
        .when(s.isin(CALL, COST) & unusable, REJECT)
        .otherwise(s)
    )
    return fields.withColumn("line_class", line_class).drop("shape")


def is_raw_noise(c: Column) -> Column:
    """Lines of a raw trace that hold no call."""
    return (
        (strip_space(c) == "")
        | c.rlike(p.BROWSER_LINE)
        | c.rlike(p.WARNING_LINE)
        | starts_with_any(c, p.RAW_SKIP_PREFIXES)
        | (c.startswith("(") & c.contains("gc="))
    )


def is_raw_frame_end(name: Column) -> Column:
    return name.isin(p.RAW_FRAME_ENDS)


def raw_calls(lines: DataFrame) -> DataFrame:
    """Name and parameters of every call of a raw trace.

    ``name: parameters`` is read up to the colon if that is among the first 50
    characters, anything else up to the first white space. Lines are chosen on their
    text, so that no filter on the name repeats the extraction.
    """
    c, text = F.col("content"), F.col("text")
    colon = F.instr(text, ":")
    has_colon = colon.between(2, 50)
    name = F.when(has_colon, strip_space(F.substring(text, F.lit(1), colon - 1))).otherwise(
        capture(text, r"(?U)^\S+", 0)
    )
    rest = F.when(has_colon, strip_space(F.substring(text, colon + 1, F.length(text)))).otherwise(
        F.regexp_replace(F.regexp_replace(text, r"(?U)^\S+\s*", ""), r"(?U)\s+", " ")
    )
    return (
        lines.filter(c.rlike(p.RAW_CALL_LINE) & ~is_raw_noise(c))
        .select("chunk_id", "line_num", strip_sequence_prefix(strip_space(c)).alias("text"))
        .select("chunk_id", "line_num", name.alias("api_name"), rest.alias("raw_params"))
    )


def program_id(params: Column) -> Column:
    """Program of a glUseProgram call: the whole text as a number, else its first digits."""
    text = strip_space(params)
    return F.coalesce(
        F.when(text.rlike(r"^[+-]?\d+\z"), as_long(text)), as_long(capture(text, r"(\d+)"))
    )


def listed_ids(params: Column) -> Column:
    """Integers among the tokens of a comma- or blank-separated list."""
    tokens = F.split(strip_space(params), r"[,\s]+")
    numbers = F.filter(tokens, lambda t: t.rlike(r"^[+-]?\d+\z"))
    return F.filter(F.transform(numbers, as_long), lambda n: n.isNotNull())
