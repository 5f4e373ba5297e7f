"""Two runs side by side: functions, frames and whole runs, with what changed.

A run is any set of parsed logs, for example those of one driver version. Names that only one
run has are kept; their other side is NULL, and a change is taken against nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framesift.operators.stats import total_of_frames, whole_part

BOTH, ONLY_BEFORE, ONLY_AFTER = "both", "before", "after"


def _side() -> Column:
    return (
        F.when(F.col("in_before").isNull(), ONLY_AFTER).when(F.col("in_after").isNull(), ONLY_BEFORE).otherwise(BOTH).alias("side")
    )


def _change(measure: str) -> list[Column]:
    """A measure before and after, its change (NULL beyond 64 bits), and its growth where there was some."""
    before, after = F.col(f"before.{measure}"), F.col(f"after.{measure}")
    delta = F.try_subtract(F.coalesce(after, F.lit(0)), F.coalesce(before, F.lit(0)))
    # A value that overflowed is NULL on a side that has the name, and so is its change.
    lost = (F.col("in_before").isNotNull() & before.isNull()) | (F.col("in_after").isNotNull() & after.isNull())
    return [
        before.alias(f"{measure}_before"), after.alias(f"{measure}_after"),
        F.when(~lost, delta).alias(f"{measure}_change"),
        F.when(before > 0, after / before).alias(f"{measure}_growth"),
    ]


def side_by_side(before: DataFrame, after: DataFrame, keys: list[str], measures: list[str]) -> DataFrame:
    """Full outer join of two tables with one row per key, null keys meeting each other."""
    b = before.select(*keys, F.lit(1).alias("in_before"), *measures).alias("before")
    a = after.select(*keys, F.lit(1).alias("in_after"), *measures).alias("after")
    same = reduce(lambda x, y: x & y, [F.col(f"before.{k}").eqNullSafe(F.col(f"after.{k}")) for k in keys])
    named = [F.when(F.col("in_before").isNotNull(), F.col(f"before.{k}")).otherwise(F.col(f"after.{k}")).alias(k) for k in keys]
    changes = [c for m in measures for c in _change(m)]
    return b.join(a, same, "full_outer").select(*named, _side(), *changes)


def _functions(calls: DataFrame) -> DataFrame:
    """Statistics per function over all logs of a run."""
    totals = calls.groupBy("api_name").agg(F.count("*").alias("call_count"), F.try_sum("time_us").alias("total_time_us"))
    return totals.withColumn("avg_time_us", whole_part("total_time_us", "call_count"))


def compare_functions(before: DataFrame, after: DataFrame) -> DataFrame:
    """Per function of two tables of calls: entries, time and mean time, and how they changed."""
    return side_by_side(_functions(before), _functions(after), ["api_name"], ["call_count", "total_time_us", "avg_time_us"])


def compare_frames(before: DataFrame, after: DataFrame, *pair: str) -> DataFrame:
    """Frame by frame: logs are paired by the named columns (their id unless given), frames by number."""
    keys = [*(pair or ("log_id",)), "frame_num"]
    return side_by_side(before, after, keys, ["total_time_us", "swap_time_us", "api_call_count"])


def compare_runs(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row per run that has frames: their number and times, and how these differ from the other run."""
    frames = before.select(F.lit(ONLY_BEFORE).alias("run"), "total_time_us").union(after.select(F.lit(ONLY_AFTER).alias("run"), "total_time_us"))
    runs = frames.groupBy("run").agg(
        F.count("*").alias("total_frames"), F.max("total_time_us").alias("max_time_us"), F.min("total_time_us").alias("min_time_us"),
        total_of_frames(),
    ).withColumn("avg_time_us", whole_part("total_time_us", "total_frames"))
    measures = ["total_frames", "total_time_us", "avg_time_us", "max_time_us", "min_time_us"]
    other = runs.select(F.when(F.col("run") == ONLY_BEFORE, ONLY_AFTER).otherwise(ONLY_BEFORE).alias("run"), *[F.col(m).alias(f"other_{m}") for m in measures])
    return runs.join(other, "run", "left").select("run", *measures, *[F.try_subtract(m, f"other_{m}").alias(f"{m}_beyond_other") for m in measures])


def regressions(compared: DataFrame, measure: str = "total_time_us", least_growth: float = 1.0) -> DataFrame:
    """Rows whose measure grew by more than a factor, or that are new, the largest change first."""
    grew = (F.col(f"{measure}_growth") > least_growth) | ((F.col("side") == ONLY_AFTER) & (F.col(f"{measure}_after") > 0))
    keys = [c for c in compared.columns if c in ("api_name", "log_id", "frame_num")]
    return compared.filter(grew).orderBy(F.desc(f"{measure}_change"), *keys)
