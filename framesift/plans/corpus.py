"""Corpora built from the star-schema tables: read and parsed once, asked many times."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framesift.plans.parse import ParsedLogs, parse_aggregated, parse_lines, parse_raw
from framesift.sources import views
from framesift.sources.loglines import LogLines

_TABLES = {"agg": "events", "raw": "events", "mixed": "events", "noisy": "events", "odd": "events", "trace": "lineitem", "shader": "documents"}
_kept: dict[tuple, object] = {}


def once(spark: SparkSession, folder: str, name: str, make: Callable[[], object]):
    """Keep a result for the session, for as long as the files under it stay the same."""
    # Lists the files only: their content is not selected, hence not read.
    listed = spark.read.format("binaryFile").load(f"{folder}/{_TABLES[name.split('/')[0]]}.parquet")
    files = listed.select("path", "length", "modificationTime")
    state = files.agg(F.count("*"), F.bit_xor(F.xxhash64(*files.columns))).first()
    key = (spark.sparkContext.applicationId, folder, name, *state)
    if key not in _kept:
        _kept[key] = make()
    return _kept[key]


def mixed_lines(spark: SparkSession, folder: str) -> LogLines:
    """Aggregated and raw logs of the same events in one corpus, told apart by their id."""
    def named(log: LogLines, letter: str) -> tuple[DataFrame, DataFrame]:
        # Chunk ids of the two corpora are kept apart by a bit beyond those of partitions.
        chunk = F.col("chunk_id") + (2**52 if letter == "r" else 0)
        return tuple(
            df.withColumns({"log_id": F.concat(F.lit(letter), F.col("log_id")), "chunk_id": chunk})
            for df in (log.lines, log.chunks)
        )

    a_lines, a_chunks = named(lines(spark, folder, "agg"), "a")
    r_lines, r_chunks = named(lines(spark, folder, "raw"), "r")
    return LogLines(a_lines.unionByName(r_lines), a_chunks.unionByName(r_chunks))


def lines(spark: SparkSession, folder: str, name: str) -> LogLines:
    make = {
        "agg": views.agg_lines, "raw": views.raw_lines, "trace": views.bench_lines, "shader": views.shader_lines,
        "mixed": mixed_lines, "noisy": views.noisy_lines, "odd": views.odd_raw_lines,
    }[name]
    return once(spark, folder, f"{name}/lines", lambda: make(spark, folder))


def parsed(spark: SparkSession, folder: str, name: str) -> ParsedLogs:
    parse = {"agg": parse_aggregated, "trace": parse_aggregated, "shader": parse_aggregated, "raw": parse_raw, "mixed": parse_lines, "noisy": parse_aggregated, "odd": parse_raw}[name]
    return once(spark, folder, f"{name}/parsed", lambda: parse(lines(spark, folder, name)))
