"""Which grammar a log is written in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framesift.functions import patterns as p
from framesift.functions.text import strip_sequence_prefix, strip_space
from framesift.sources.loglines import LogLines

APITRACE, PROFILE, RAWTRACE, UNKNOWN = "apitrace", "profile", "rawtrace", "unknown"
KNOWN = [APITRACE, PROFILE, RAWTRACE]
RAW_NAME = "^(?:" + "|".join(p.RAW_NAME_PREFIXES) + ")"

# Lines read from the head of a log; the command-line tool reads 100.
HEAD_LINES = 50


def _number(text: Column) -> Column:
    """Place in ``KNOWN`` of the kind a stripped text shows, NULL for none."""
    return (
        F.when(text.startswith("<<"), KNOWN.index(PROFILE))
        .when(text.contains("count=") & text.contains("time="), KNOWN.index(APITRACE))
        .when(text.rlike(RAW_NAME), KNOWN.index(RAWTRACE))
    )


def _name(number: Column) -> Column:
    return F.coalesce(F.get(F.array(*map(F.lit, KNOWN)), number), F.lit(UNKNOWN))


def kind_of_line(line: Column) -> Column:
    return _name(_number(strip_sequence_prefix(strip_space(line))))


def shows_aggregation(line: Column) -> Column:
    """Text that only aggregated logs hold, even on lines that are skipped otherwise."""
    return (
        (line.contains("count=") & line.contains("time="))
        | (line.contains("swapBuffers:") & line.contains("us"))
        | line.contains("frame cost")
    )


def is_undecided(text: Column) -> Column:
    """Stripped lines that never decide the kind."""
    browser = text.rlike(p.BROWSER_LINE_BARE) & ~text.contains("gl") & ~text.contains("swapBuffers")
    return (
        (text == "")
        | text.rlike(p.ERROR_LINE)
        | browser
        | text.rlike(p.GC_LINE)
        | text.rlike(p.VENDOR_LINE)
    )


def detect_kinds(lines: DataFrame, head_lines: int = HEAD_LINES) -> DataFrame:
    """Kind of each log from its first lines.

    The first line of a known kind decides, unless aggregated text was seen up to
    that line; three minima per log say which came first, so no order is needed.
    """
    heads = (
        line_signs(lines.filter(F.col("line_num") <= head_lines), F.col("content"), F.lit(True))
        .groupBy("log_id")
        .agg(*first_signs(F.col("line_num")))
    )
    return _decided(heads, head_lines)


def line_signs(lines: DataFrame, content: Column, wanted: Column) -> DataFrame:
    """Add what each wanted line tells of the kind: its own as a number, NULL if it decides
    nothing (numbers can be aggregated by hash), and whether it shows aggregated text.

    The stripped texts are columns of their own, as each is used many times.
    """
    text = F.col("head_text")
    return (
        lines.withColumn("head_text", F.when(wanted, strip_space(content)))
        .withColumn("head_rest", strip_sequence_prefix(text))
        .withColumn("line_kind", F.when(~is_undecided(text), _number(F.col("head_rest"))))
        .withColumn("agg", F.when(wanted, shows_aggregation(content)))
        .drop("head_text", "head_rest")
    )


def first_signs(place: Column) -> list[Column]:
    """First places of aggregated text and of a line of known kind, and that kind."""
    known = F.when(F.col("line_kind").isNotNull(), place)
    return [
        F.min(F.when(F.col("agg"), place)).alias("agg_line"),
        F.min(known).alias("kind_line"),
        F.min_by("line_kind", known).alias("kind"),
    ]


def kinds_of(log: LogLines, head_lines: int = HEAD_LINES) -> DataFrame:
    """Kind of each log; without another pass over the text where the reader noted the
    signs of the first chunks and these hold all lines asked for."""
    heads = log.heads
    if heads is None:
        return detect_kinds(log.lines, head_lines)
    # What the first chunk says stands, unless it is shorter than the head and a later line could still speak.
    known = F.least(F.coalesce("kind_line", F.lit(head_lines + 1)), F.coalesce("agg_line", F.lit(head_lines + 1)))
    short = (F.col("n_lines") < head_lines) & ~F.col("is_whole") & (known > F.col("n_lines"))
    if heads.filter(short).isEmpty():
        return _decided(heads, head_lines)
    again = detect_kinds(log.only(heads.filter(short)).lines, head_lines)
    return _decided(heads.filter(~short), head_lines).unionByName(again)


def _decided(heads: DataFrame, head_lines: int) -> DataFrame:
    a, k = (F.when(F.col(c) <= head_lines, F.col(c)) for c in ("agg_line", "kind_line"))
    return heads.select(
        "log_id",
        F.when(k.isNotNull() & (a.isNull() | (k < a)), _name(F.col("kind")))
        .when(a.isNotNull(), APITRACE)
        .otherwise(UNKNOWN)
        .alias("kind"),
    )
