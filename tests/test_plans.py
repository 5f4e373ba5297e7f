"""Plans that must hold at any size: no cross joins, no single-task windows, no Python per row."""

import contextlib
import io
import re

import pytest

import __spark_entry__ as entry
from framesift.catalog import QUERIES
from framesift.oracle import ORACLE

FOLDER = "/root/testdata/sf0.001"


def plan_of(df):
    with contextlib.redirect_stdout(io.StringIO()) as text:
        df.explain("formatted")
    return text.getvalue()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_plan(spark, name):
    plan = plan_of(QUERIES[name](spark, FOLDER))
    assert not re.search(r"CartesianProduct|BroadcastNestedLoopJoin|BatchEvalPython|ArrowEvalPython", plan)
    # One task is used only to put the first rows of a top list together.
    single = plan.count("SinglePartition")
    assert single == 0 or (name == "top_frames_of_all" and "TakeOrderedAndProject" in plan), plan


@pytest.mark.parametrize("name", ["agg", "raw", "shader", "mixed"])
def test_plans_of_tables_that_a_parse_writes(spark, written_plans, name):
    from framesift.plans import corpus

    corpus._kept.clear()
    corpus.parsed(spark, FOLDER, name)
    assert len(written_plans) >= 4
    for plan in written_plans:
        assert not re.search(r"CartesianProduct|BroadcastNestedLoopJoin|SinglePartition|Python|InArrow|InPandas", plan), plan


def test_calls_are_shuffled_once(spark, written_plans):
    """Marks need one exchange of call rows, by chunk, and one sort."""
    from framesift.operators import aggregated
    from framesift.plans.corpus import lines

    plan = plan_of(aggregated.mark(aggregated.log_rows(lines(spark, FOLDER, "agg"), None)))
    assert plan.count("hashpartitioning") == 1 and len(re.findall(r"^\(\d+\) Sort", plan, re.M)) == 1
    assert "decimal" not in plan


def test_top_frames_are_cut_before_the_shuffle(spark):
    plan = plan_of(QUERIES["top_frames"](spark, FOLDER))
    assert plan.count("WindowGroupLimit") >= 2


def test_function_statistics_read_few_columns_and_combine_first(spark):
    plan = plan_of(QUERIES["func_stats"](spark, FOLDER))
    assert "partial_count" in plan and "partial_try_sum" in plan
    assert "ReadSchema: struct<chunk_id:bigint,api_name:string,value:bigint,line_class:string>" in plan


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLE) <= set(entry.oracle_sql())
