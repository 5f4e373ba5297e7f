"""Lifetimes of buffers in raw traces.

Buffer calls become events with a total order. An incarnation is one life of a
buffer id; a segment is a stretch of it between two binds, with one target. Data
updates reach segments by "last update before" and "first update after" lookups.
All of it is found by windows inside (key, chunk) and over one row per (key, chunk).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framesift.functions.gl import (
    DEFAULT_TARGET, TARGETS, id_of, is_target_name, number, target_name, tokens, usage_name,
)
from framesift.operators.rawtrace import buffer_creations
from framesift.operators.scan import before, upto
from framesift.session import store

GENERATE = ["glGenBuffers", "glCreateBuffers"]
BIND, DATA, SUBDATA, DELETE = "glBindBuffer", "glBufferData", "glBufferSubData", "glDeleteBuffers"

ALL = "*"
BUFFER = ["log_id", "buffer_id"]
LIFE = [*BUFFER, "incarnation"]
_END = 2**63 - 1
_LAST_CHUNKS = 1024


def _position(line, late, origin, arg) -> Column:
    """Place of an event; creations of a frame come after its last call."""
    def long(v):
        return (v if isinstance(v, Column) else F.lit(v)).cast("bigint")

    return F.struct(
        long(line).alias("line"), long(late).alias("late"), long(origin).alias("origin"), long(arg).alias("arg")
    )


_FOREVER = (_END, _END, _END, _END)


def buffer_events(calls: DataFrame) -> DataFrame:
    """Ordered events: ``born`` true or false for creation and deletion, ``target`` for a
    bind, ``target``, ``size`` and ``usage`` for the two data calls."""
    line, t = F.col("line_num"), F.col("t")
    none = F.lit(None)
    parsed = calls.filter(
        F.col("api_name").isin(*GENERATE, BIND, DATA, SUBDATA, DELETE) & (F.col("raw_params") != "")
    ).select("log_id", "chunk_id", "frame_num", "line_num", "api_name", tokens(F.col("raw_params")).alias("t"))

    existence = (
        parsed.filter(F.col("api_name").isin(*GENERATE, DELETE))
        .select("log_id", "chunk_id", "line_num", "api_name", F.posexplode("t").alias("arg", "token"))
        .select(
            "log_id", "chunk_id", _position(line, 0, 0, F.col("arg")).alias("pos"), "api_name",
            id_of(F.col("token")).alias("buffer_id"), (F.col("api_name") != DELETE).alias("born"),
            none.cast("string").alias("target"), none.cast("bigint").alias("size"), none.cast("string").alias("usage"),
        )
        .filter(F.col("buffer_id") > 0)
    )
    name, n = F.col("api_name"), F.size("t")
    others = parsed.filter(
        ((name == BIND) & (n >= 2)) | ((name == DATA) & (n >= 3)) | ((name == SUBDATA) & (n >= 4))
    ).select(
        "log_id", "chunk_id", _position(line, 0, 0, 0).alias("pos"), "api_name",
        F.when(name == BIND, number(F.get(t, 1))).alias("buffer_id"), none.cast("boolean").alias("born"),
        F.get(t, 0).alias("target"),
        F.when(name == DATA, number(F.get(t, 1))).when(name == SUBDATA, number(F.get(t, 2))).alias("size"),
        F.when(name == DATA, usage_name(F.element_at(t, -1))).alias("usage"),
    )
    frame_ends = calls.groupBy("log_id", "frame_num").agg(
        F.max("chunk_id").alias("chunk_id"), F.max("line_num").alias("last_call")
    )
    creations = buffer_creations(calls).join(frame_ends, ["log_id", "frame_num"]).select(
        "log_id", "chunk_id", _position(F.col("last_call"), 1, line, F.col("pos")).alias("pos"),
        F.lit("creation").alias("api_name"), "buffer_id", F.lit(True).alias("born"),
        none.cast("string").alias("target"), none.cast("bigint").alias("size"), none.cast("string").alias("usage"),
    )
    return existence.unionByName(others).unionByName(creations)


def _in_chunk(keys: list[str]):
    return Window.partitionBy(*keys, "chunk_id").orderBy("pos")


def _over_chunks(keys: list[str]):
    return Window.partitionBy(*keys).orderBy("chunk_id")


def lives(events: DataFrame) -> DataFrame:
    """Creations, binds and deletions that take effect, with the incarnation they belong to.

    ``step`` is start, bind or end. A creation of a live id and a bind or deletion
    of a dead one have no effect.
    """
    w = _in_chunk(BUFFER)
    born, prev = F.col("born"), F.col("prev")
    df = (
        events.filter(born.isNotNull() | ((F.col("api_name") == BIND) & (F.col("buffer_id") > 0)))
        .withColumn("prev", F.last("born", ignorenulls=True).over(before(w)))
        .withColumn("starts_here", F.sum(F.when(born & ~prev, 1).otherwise(0)).over(upto(w)))
    )
    stated = F.when(born.isNotNull(), F.col("pos"))
    prior = _over_chunks(BUFFER)
    chunks = (
        df.groupBy(*BUFFER, "chunk_id")
        .agg(
            F.min_by("born", stated).alias("first_born"),
            F.max_by("born", stated).alias("last_born"),
            F.max("starts_here").alias("n_starts"),
        )
        .withColumn(
            "alive_in", F.coalesce(F.last("last_born", ignorenulls=True).over(before(prior)), F.lit(False))
        )
        .withColumn(
            "first_starts", F.coalesce((F.col("first_born") & ~F.col("alive_in")).cast("int"), F.lit(0))
        )
        .select(
            *BUFFER, "chunk_id", "alive_in", "first_starts",
            F.coalesce(F.sum(F.col("n_starts") + F.col("first_starts")).over(before(prior)), F.lit(0)).alias("base"),
        )
    )
    alive = F.coalesce(prev, F.col("alive_in"))
    stated_before_or_here = prev.isNotNull() | born.isNotNull()
    step = (
        F.when(born & ~alive, "start").when(~born & alive, "end").when(born.isNull() & alive, "bind")
    )
    return (
        df.join(chunks, [*BUFFER, "chunk_id"])
        .select(
            *BUFFER, "chunk_id", "pos", step.alias("step"),
            (
                F.col("base") + F.col("starts_here")
                + F.when(stated_before_or_here, F.col("first_starts")).otherwise(0)
            ).alias("incarnation"),
            F.when(born.isNull(), target_name(F.col("target"))).otherwise(DEFAULT_TARGET).alias("target"),
        )
        .filter(F.col("step").isNotNull())
    )


def segments(steps: DataFrame) -> DataFrame:
    """Stretches of one target: from a start or bind to the next bind or the end.

    A segment without an end (``to`` is NULL) lasts to the end of the log.
    """
    w = _in_chunk(LIFE)
    first = steps.groupBy(*LIFE, "chunk_id").agg(F.min("pos").alias("first_pos"))
    following = first.select(
        *LIFE, "chunk_id",
        F.lead("first_pos").over(_over_chunks(LIFE)).alias("next_pos"),
        F.lead("chunk_id").over(_over_chunks(LIFE)).alias("next_chunk"),
    )
    here = steps.select(
        "*", F.lead("pos").over(w).alias("pos_after")
    ).join(following, [*LIFE, "chunk_id"])
    return here.filter(F.col("step") != "end").select(
        *LIFE, "target", "chunk_id", F.col("pos").alias("from"),
        F.coalesce("pos_after", "next_pos").alias("to"),
        F.when(F.col("pos_after").isNotNull(), F.col("chunk_id")).otherwise(F.col("next_chunk")).alias("to_chunk"),
        (F.col("step") == "start").alias("is_start"),
    )


def _scoped(events: DataFrame, strict_targets: bool) -> DataFrame:
    """Data updates with the target they are limited to, or ``*`` for every live buffer.

    Only a symbolic target limits an update, unless ``strict_targets`` also asks it of
    target numbers.
    """
    t = F.col("target")
    limited = is_target_name(t) | (t.isin(list(TARGETS)) if strict_targets else F.lit(False))
    positive = F.when(F.col("size") > 0, F.struct("pos", "size"))
    return events.filter(F.col("api_name").isin(DATA, SUBDATA)).select(
        "log_id", F.when(limited, target_name(t)).otherwise(ALL).alias("scope"), "chunk_id", "pos",
        F.when(F.col("api_name") == DATA, positive).alias("data"),
        F.when(F.col("api_name") == DATA, F.struct("pos", "usage")).alias("used"),
        F.when(F.col("api_name") == SUBDATA, positive).alias("sub"),
    )


_SCOPE = ["log_id", "scope"]


_VALUES = ["data", "used", "sub"]


def _as_of(points: DataFrame, updates: DataFrame) -> DataFrame:
    """For every point the last ``data`` and ``used`` before it and the first ``sub`` after it.

    Points and updates are shuffled once; both directions are windows over that one
    partitioning, and what comes from other chunks is found over one row per (scope, chunk).
    """
    both = points.unionByName(updates.select(*_SCOPE, "chunk_id", "pos", *_VALUES), allowMissingColumns=True)
    both = both.repartition(*_SCOPE, "chunk_id")
    up = before(_in_chunk(_SCOPE))
    down = before(Window.partitionBy(*_SCOPE, "chunk_id").orderBy(F.desc("pos")))
    sides = {"data": up, "used": up, "sub": down}
    here = both.select("*", *[F.last(c, ignorenulls=True).over(w).alias(f"{c}_here") for c, w in sides.items()])

    def end(c: str) -> Column:
        known = F.when(F.col(c).isNotNull(), F.col("pos"))
        return (F.min_by if c == "sub" else F.max_by)(c, known).alias(c)

    chunks = both.groupBy(*_SCOPE, "chunk_id").agg(*[end(c) for c in _VALUES])
    earlier = before(_over_chunks(_SCOPE))
    later = before(Window.partitionBy(*_SCOPE).orderBy(F.desc("chunk_id")))
    over = {"data": earlier, "used": earlier, "sub": later}
    carried = chunks.select(*_SCOPE, "chunk_id", *[F.last(c, ignorenulls=True).over(w).alias(f"{c}_carried") for c, w in over.items()])
    return here.filter("is_point").drop(*_VALUES).join(carried, [*_SCOPE, "chunk_id"]).select(
        *points.columns, *[F.coalesce(f"{c}_here", f"{c}_carried").alias(c) for c in _VALUES]
    )


def incarnations(calls: DataFrame, strict_targets: bool = False) -> DataFrame:
    """Every life of every buffer with its last target, size and usage.

    Size: the last positive one given by a data call that applies, else the first
    positive one of a sub-data call. Usage: that of the last data call that applies.
    """
    events = store(buffer_events(calls), "buffer_events")
    parts = store(segments(lives(events)), "buffer_segments")
    updates = _scoped(events, strict_targets)

    start = F.min(F.when(F.col("is_start"), F.struct("from", "chunk_id"))).alias("start")
    # The last segment carries the end of the life; NULL there means it never ends.
    last = F.max_by(F.struct("target", "to", "to_chunk"), F.col("from")).alias("last")
    whole = parts.groupBy(*LIFE).agg(start, last)
    spans = whole.select(
        *LIFE, F.lit(ALL).alias("scope"), F.col("start.from").alias("from"),
        F.col("start.chunk_id").alias("chunk_id"), F.col("last.to").alias("to"),
        F.col("last.to_chunk").alias("to_chunk"),
    ).unionByName(
        parts.filter(is_target_name(F.col("target"))).select(
            *LIFE, F.col("target").alias("scope"), "from", "chunk_id", "to", "to_chunk"
        )
    )
    end_pos = F.coalesce("to", _position(*_FOREVER))
    # Lives without an end lie after every chunk, spread over many so that none gets large.
    after_all = F.lit(_END) - F.pmod(F.xxhash64("buffer_id", "incarnation", "from"), F.lit(_LAST_CHUNKS))
    to_points = spans.select(
        *_SCOPE, F.coalesce("to_chunk", after_all).alias("chunk_id"), end_pos.alias("pos"),
        F.lit(True).alias("is_point"), F.lit(True).alias("is_end"), "buffer_id", "incarnation", F.col("from").alias("other"),
    )
    from_points = spans.select(
        *_SCOPE, "chunk_id", F.col("from").alias("pos"), F.lit(True).alias("is_point"), F.lit(False).alias("is_end"),
        "buffer_id", "incarnation", end_pos.alias("other"),
    )
    at_end, other = F.col("is_end"), F.col("other")
    values = (
        _as_of(to_points.unionByName(from_points), updates)
        .groupBy(*LIFE)
        .agg(
            F.max(F.when(at_end & (F.col("data.pos") > other), F.col("data"))).alias("data"),
            F.max(F.when(at_end & (F.col("used.pos") > other), F.col("used"))).alias("used"),
            F.min(F.when(~at_end & (F.col("sub.pos") < other), F.col("sub"))).alias("sub"),
        )
    )
    return whole.join(values, LIFE, "left").select(
        *LIFE,
        F.col("last.to").isNull().alias("is_live"),
        F.lit(DEFAULT_TARGET).alias("created_target"),
        F.col("last.target").alias("target"),
        F.coalesce("data.size", "sub.size", F.lit(0)).alias("size"),
        F.coalesce("used.usage", F.lit("")).alias("usage"),
    )


def live_buffers(lives: DataFrame) -> DataFrame:
    """Buffers alive at the end of the log."""
    return lives.filter("is_live").select("log_id", "buffer_id", "target", "size", "usage")


def buffers_by_target(lives: DataFrame) -> DataFrame:
    """All buffers ever made under the target they had when made, deleted ones included."""
    return lives.select("log_id", F.col("created_target").alias("by_target"), "buffer_id", "incarnation", "target", "size", "usage")


def total_size(lives: DataFrame) -> DataFrame:
    """Summed size at creation, which traces never give, and size of what is alive at the end."""
    return lives.groupBy("log_id").agg(
        F.lit(0).cast("bigint").alias("total_size"),
        F.sum(F.when(F.col("is_live"), F.col("size")).otherwise(0)).alias("live_bytes"),
    )


def buffer_summary(lives: DataFrame) -> DataFrame:
    """Live buffers, total size, and per creation target all buffers with their summed size."""
    live = lives.groupBy("log_id").agg(F.count(F.when(F.col("is_live"), 1)).alias("total_count"))
    per_target = lives.groupBy("log_id", F.col("created_target").alias("target")).agg(
        F.count("*").alias("target_count"), F.sum("size").alias("target_size")
    )
    return per_target.join(live, "log_id").select(
        "log_id", "total_count", F.lit(0).cast("bigint").alias("total_size"), "target", "target_count", "target_size"
    )
