"""From log lines to the parsed tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framesift.operators import aggregated, kinds as kind_ops, rawtrace, shaders as shader_ops
from framesift.operators.kinds import APITRACE, RAWTRACE
from framesift.operators.stats import total_of_frames
from framesift.session import small_side, store
from framesift.sources.loglines import LogLines
from framesift.sources.text import read_lines

SHADERS = {"block_num": "bigint", "shader_id": "bigint", "command_line": "string", "source": "string"}
SHADER_LINES = {"block_num": "bigint", "chunk_id": "bigint", "line_num": "bigint", "content": "string"}
PROGRAMS = {"line_num": "bigint", "program_id": "bigint"}
CREATIONS = {
    "line_num": "bigint", "pos": "int", "buffer_id": "bigint", "target": "string", "size": "bigint",
    "usage": "string",
}
CALL_COLUMNS = ["log_id", "frame_num", "line_num", "api_name", "call_count", "time_us", "raw_params"]


@dataclass(frozen=True)
class ParsedLogs:
    """The tables of a parsed corpus; all of them carry ``log_id``."""

    lines: DataFrame
    kinds: DataFrame
    calls: DataFrame
    frames: DataFrame
    facts: DataFrame
    shaders: DataFrame
    shader_lines: DataFrame
    programs: DataFrame
    buffer_creations: DataFrame

    @property
    def api_calls(self) -> DataFrame:
        return self.calls.select(*CALL_COLUMNS)

    def logs(self) -> DataFrame:
        """Totals per log. Frame rate: the last one logged, else frames per summed time."""
        totals = self.frames.groupBy("log_id").agg(
            F.count("*").alias("frame_count"), total_of_frames()
        )
        n = F.coalesce("frame_count", F.lit(0))
        total = F.when(n > 0, F.col("total_time_us")).otherwise(0)
        fps = (
            F.when(F.col("fps_line") > 0, F.col("fps_line"))
            .when(total > 0, n * F.lit(1e6) / total)
            .otherwise(0.0)
        )
        return (
            self.facts.join(totals, "log_id", "left")
            .join(self.kinds, "log_id", "left")
            .select(
                "log_id", "kind", n.alias("frame_count"), total.alias("total_time_us"),
                fps.alias("fps"), "line_count", "rejects",
            )
        )


def parse_aggregated(log: LogLines, kinds: DataFrame | None = None) -> ParsedLogs:
    """Parse lines that are all of the aggregated grammar.

    What is kept of the text are typed fields, one row per useful line. Later steps
    read only that table and one row per chunk.
    """
    ends = log.log_ends()
    shader = aggregated.shader_state(log)
    marks = store(aggregated.mark(aggregated.log_rows(log, shader)), "marks")
    rows = aggregated.attribute(marks, small_side(aggregated.carry(marks, log), "carry"))
    frames = store(aggregated.frames(rows), "frames")
    shaders, shader_lines = _none(frames, SHADERS), _none(frames, SHADER_LINES)
    if shader:
        body = shader_ops.body_lines(log, shader)
        shaders = store(shader_ops.shaders(body, shader, rows, frames), "shaders", "zstd")
        shader_lines = shader_ops.lines_of_shaders(body, shaders)
    return ParsedLogs(
        lines=log.lines,
        kinds=kinds if kinds is not None else _kinds(ends, APITRACE),
        calls=aggregated.api_calls(rows),
        frames=frames,
        facts=aggregated.log_facts(rows, ends),
        shaders=shaders,
        shader_lines=shader_lines,
        programs=_none(frames, PROGRAMS),
        buffer_creations=_none(frames, CREATIONS),
    )


def parse_raw(log: LogLines, kinds: DataFrame | None = None) -> ParsedLogs:
    """Parse lines that are all of the raw grammar."""
    ends = log.log_ends()
    marks = store(rawtrace.mark(log.lines), "marks")
    rows = rawtrace.attribute(marks, small_side(rawtrace.carry(marks, log), "carry"))
    calls = rawtrace.api_calls(rows)
    frames = store(rawtrace.frames(rows), "frames")
    return ParsedLogs(
        lines=log.lines,
        kinds=kinds if kinds is not None else _kinds(ends, RAWTRACE),
        calls=calls,
        frames=frames,
        facts=rawtrace.log_facts(ends),
        shaders=_none(frames, SHADERS),
        shader_lines=_none(frames, SHADER_LINES),
        programs=rawtrace.programs(calls),
        buffer_creations=rawtrace.buffer_creations(calls),
    )


#: More lines than any log has.
ALL_LINES = 2**62


def parse_lines(log: LogLines, head_lines: int = kind_ops.HEAD_LINES) -> ParsedLogs:
    """Detect the grammar of every log and parse each with its own.

    A log whose first lines decide nothing is decided from all of its lines. Logs that
    stay unknown are read with the aggregated grammar.
    """
    kinds = small_side(kind_ops.kinds_of(log, head_lines), "kinds")
    unknown = kinds.filter(F.col("kind") == kind_ops.UNKNOWN)
    if not unknown.isEmpty():
        late = kind_ops.detect_kinds(log.only(unknown).lines, ALL_LINES).withColumnRenamed("kind", "late")
        kinds = small_side(kinds.join(late, "log_id", "left").select("log_id", F.coalesce("late", "kind").alias("kind")), "kinds")
    raw, other = kinds.filter(F.col("kind") == RAWTRACE), kinds.filter(F.col("kind") != RAWTRACE)
    # With one grammar only, the text is not read for the other.
    if raw.isEmpty():
        return parse_aggregated(log, kinds)
    if other.isEmpty():
        return parse_raw(log, kinds)
    a, r = parse_aggregated(log.only(other), kinds), parse_raw(log.only(raw), kinds)
    return ParsedLogs(
        lines=log.lines,
        kinds=kinds,
        calls=a.calls.unionByName(r.calls),
        frames=a.frames.unionByName(r.frames),
        facts=a.facts.unionByName(r.facts),
        shaders=a.shaders,
        shader_lines=a.shader_lines,
        programs=r.programs,
        buffer_creations=r.buffer_creations,
    )


def parse_files(spark: SparkSession, path: str | list[str], head_lines: int = kind_ops.HEAD_LINES) -> ParsedLogs:
    """Parse one log file, a folder or a glob."""
    return parse_lines(read_lines(spark, path), head_lines)


def _kinds(logs: DataFrame, kind: str) -> DataFrame:
    return logs.select("log_id", F.lit(kind).alias("kind"))


def _none(frames: DataFrame, columns: dict[str, str]) -> DataFrame:
    """An empty table with the log and frame columns of ``frames``."""
    return frames.filter(F.lit(False)).select(
        "log_id", "frame_num", *[F.lit(None).cast(t).alias(c) for c, t in columns.items()]
    )
