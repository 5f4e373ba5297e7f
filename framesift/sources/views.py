"""Trace logs as views over the star-schema tables.

Each view builds log lines as a pure function of one table, so that the same
text can be built by any SQL engine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framesift.session import small_side
from framesift.sources.loglines import LogLines
from framesift.sources.tables import number_lines

DOCS_PER_LOG = 10
LINES_PER_CHUNK = 4096


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")



def _agg_content() -> Column:
    kind, value = F.col("event_type"), F.col("value")
    name = (
        F.when(kind == "view", "glDrawElements")
        .when(kind == "click", "glBindBuffer")
        .otherwise("glCompileShader")
    )
    return (
        F.when(kind == "purchase", F.concat(F.lit("swapBuffers: "), F.floor(value), F.lit(" us")))
        .when(
            kind == "error",
            F.concat(F.col("event_id") % 500, F.lit(" frame cost "), F.floor(value) % 20, F.lit("ms")),
        )
        .otherwise(
            F.concat(
                name, F.lit(": count="), F.col("event_id") % 50 + 1,
                F.lit(", time="), F.floor(value * 100), F.lit(" us"),
            )
        )
    )


def _of_events(spark: SparkSession, folder: str, content: Column) -> LogLines:
    """One log per user, in order of time."""
    records = table(spark, folder, "events").select(
        F.col("user_id").alias("log_id"), content.alias("content"), "ts", "event_id"
    )
    return number_lines(records, "ts", "event_id")


def agg_lines(spark: SparkSession, folder: str) -> LogLines:
    """Aggregated logs from ``events``."""
    return _of_events(spark, folder, _agg_content())


def noisy_lines(spark: SparkSession, folder: str) -> LogLines:
    """The aggregated logs with prefixes, wide blanks, rates, unusable numbers and every kind of noise."""
    event = F.col("event_id")
    lines = {
        0: F.concat(F.lit("[ "), event % 90, F.lit("] "), _agg_content()),
        1: F.concat(F.lit("x libGL: FPS =  "), event % 90, F.lit(".5 (mean)")),
        2: F.lit("libGL: FPS = 8.9.1"),
        3: F.concat(F.lit("warning: glLate: count=1, time="), event, F.lit(" us")),
        4: F.lit("12 [7:8:9 worker] libGL: FPS = 77"),
        5: F.lit("<<gc = 0x1aF>>"),
        6: F.lit("[ 4] vendor: count=2, time=9 us"),
        7: F.lit(""),
        8: F.concat(F.lit("glWide:   count=3,  time="), event, F.lit("  us")),
        9: F.lit("glMany: count=99999999999999999999, time=1 us"),
        10: F.lit("[7:8:9 worker] ERROR glLost: count=1, time=1 us"),
    }
    content = _agg_content()
    for k, line in lines.items():
        content = F.when(event % 17 == k, line).otherwise(content)
    return _of_events(spark, folder, content)


def raw_lines(spark: SparkSession, folder: str) -> LogLines:
    """Raw traces from ``events``."""
    return _of_events(spark, folder, _raw_content())


def odd_raw_lines(spark: SparkSession, folder: str) -> LogLines:
    """The raw traces with prefixes, wide blanks, several ids, two more forms of calls and noise."""
    event = F.col("event_id")
    k = event % 7 + 1
    lines = {
        0: F.concat(F.lit("[ 7] "), _raw_content()),
        1: F.lit("  glFlush"),
        2: F.lit("[__dri3 x] glFlush"),
        3: F.lit("(tid=1 gc=0x1) glFlush"),
        4: F.lit("no call"),
        5: F.concat(F.lit("glUseProgram: program = "), k),
        6: F.concat(F.lit("glGenBuffers: 30, 0x1F -2  "), k),
        7: F.concat(F.lit("glUniform4f   "), k, F.lit("   0x1F\t  2")),
        8: F.lit("eglSwapBuffers"),
        9: F.lit("glUseProgram -4"),
        10: F.lit("glUseProgram none"),
    }
    content = _raw_content()
    for n, line in lines.items():
        content = F.when(event % 19 == n, line).otherwise(content)
    return _of_events(spark, folder, content)


def _raw_content() -> Column:
    kind, event = F.col("event_type"), F.col("event_id")
    k = event % 7 + 1
    return (
        F.when(kind == "signup", F.concat(F.lit("glGenBuffers "), k))
        .when(
            kind == "click",
            F.concat(
                F.lit("glBindBuffer "),
                F.when(event % 3 == 0, "GL_ARRAY_BUFFER").when(event % 3 == 1, "0x8892").otherwise("GL_UNIFORM_BUFFER"),
                F.lit(" "), k,
            ),
        )
        .when((kind == "view") & (event % 2 == 0), F.concat(F.lit("glUseProgram "), k))
        .when(
            (kind == "view") & (event % 3 == 0),
            F.concat(F.lit("glBufferSubData GL_ARRAY_BUFFER 0 "), F.floor("value"), F.lit(" 0x7f")),
        )
        .when(
            kind == "view",
            F.concat(
                F.lit("glBufferData "),
                F.when(event % 5 == 0, "0x8892").when(event % 5 < 3, "GL_ARRAY_BUFFER").otherwise("GL_UNIFORM_BUFFER"),
                F.lit(" "), F.floor("value"), F.lit(" 0x7f "),
                F.when(event % 4 == 1, "GL_STATIC_DRAW").otherwise("0x88E8"),
            ),
        )
        .when(kind == "error", F.concat(F.lit("glDeleteBuffers "), k))
        .otherwise("glXSwapBuffers: dpy = 0x1, drawable = 2")
    )


def bench_lines(spark: SparkSession, folder: str) -> LogLines:
    """Aggregated logs from ``lineitem``: a call per row, a frame per order."""
    order = ["l_orderkey", "after_calls", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"]
    items = table(spark, folder, "lineitem")
    log = (F.col("l_orderkey") % 100).alias("log_id")
    calls = items.select(
        log,
        F.concat(
            F.lit("gl"), "l_returnflag", "l_linestatus", F.lit(": count="), F.floor("l_quantity"),
            F.lit(", time="), F.floor("l_extendedprice"), F.lit(" us"),
        ).alias("content"),
        F.lit(0).alias("after_calls"), *[c for c in order if c != "after_calls"],
    )
    swaps = items.select("l_orderkey").distinct().select(
        log,
        F.concat(F.lit("swapBuffers: "), F.col("l_orderkey") % 1000, F.lit(" us")).alias("content"),
        F.lit(1).alias("after_calls"), "l_orderkey",
    )
    records = calls.unionByName(swaps, allowMissingColumns=True)
    return number_lines(records, *order, "content")


def text_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of ``documents``, one log per document."""
    return table(spark, folder, "documents").select(
        F.col("doc_id").alias("log_id"), "doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "content")
    ).select(
        "log_id",
        # Room for 2^20 chunks, that is 4 billion lines, in a document.
        (F.col("doc_id") * 2**20 + F.expr(f"pos div {LINES_PER_CHUNK}")).alias("chunk_id"),
        (F.col("pos") + 1).cast("bigint").alias("line_num"),
        "content",
    )


def shader_lines(spark: SparkSession, folder: str) -> LogLines:
    """Aggregated logs of ten ``documents`` each, every text as a fenced shader source."""
    doc = F.col("doc_id")
    lines = F.concat(
        F.array(
            F.concat(F.lit("glCompileShader: count=1, time="), F.col("n_chars"), F.lit(" us")),
            F.concat(F.lit("[ 1] (gc=0x1, tid=0x2): glShaderSource "), doc, F.lit(" 1 0xff (nil)")),
            F.lit("####"),
        ),
        F.split("text", "\n"),
        F.array(F.lit("####"), F.concat(F.lit("swapBuffers: "), doc, F.lit(" us"))),
    )
    docs = table(spark, folder, "documents").select(
        F.expr(f"doc_id div {DOCS_PER_LOG}").alias("log_id"), "doc_id", lines.alias("lines")
    )
    # Ten rows of two numbers per log.
    earlier = Window.partitionBy("log_id").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, -1)
    sizes = docs.select("log_id", "doc_id", F.size("lines").cast("bigint").alias("n"))
    base = sizes.select("doc_id", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("line_base"))
    placed = docs.join(small_side(base, "line_bases"), "doc_id").select(
        "log_id", "line_base", F.posexplode("lines").alias("pos", "content")
    )
    return LogLines.of(
        placed.select(
            "log_id", F.lit(0).cast("bigint").alias("chunk_id"),
            (F.col("line_base") + F.col("pos") + 1).alias("line_num"), "content",
        )
    )
