"""Plans of the training-data queries, those of the tables that they write on the way included."""

import contextlib
import io
import re

import pytest
from framesift.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
NATIVE = ["op2_mixing", "op10_quality_rules"]


def all_plans(spark, written_plans, name):
    df = QUERIES[name](spark, FOLDER)
    with contextlib.redirect_stdout(io.StringIO()) as text:
        df.explain("formatted")
    return [*written_plans, text.getvalue()]


@pytest.mark.parametrize("name", NATIVE)
def test_native_queries_run_no_python(spark, written_plans, name):
    for plan in all_plans(spark, written_plans, name):
        assert not re.search(r"Python|InArrow|InPandas|CartesianProduct|BroadcastNestedLoopJoin", plan), plan


@pytest.mark.parametrize("name", ["op11_forest_search", "op12_vector_codes", "op13_merkle_log"])
def test_no_cross_joins_and_no_single_task(spark, written_plans, name):
    plans = all_plans(spark, written_plans, name)
    assert len(plans) >= 3
    for plan in plans:
        assert not re.search(r"CartesianProduct|BroadcastNestedLoopJoin|SinglePartition|BatchEvalPython|ArrowEvalPython", plan), plan
