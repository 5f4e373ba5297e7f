"""Comparison of runs and searches by expressions."""

import random

import pytest

from framesift.operators import compare, expressions as ex

CALLS = "log_id string, frame_num long, api_name string, time_us long"
FRAMES = "log_id string, frame_num long, total_time_us long, swap_time_us long, api_call_count long"


def by(df, *keys):
    return {tuple(r[k] for k in keys): r.asDict() for r in df.collect()}


def test_functions_on_one_side_and_both(spark):
    before = spark.createDataFrame([("a", 0, "glA", 10), ("b", 0, "glA", 20), ("a", 1, "glOld", 5), ("a", 1, None, 1)], CALLS)
    after = spark.createDataFrame([("c", 0, "glA", 90), ("c", 0, "glNew", 7), ("c", 1, None, 4)], CALLS)
    found = by(compare.compare_functions(before, after), "api_name")
    assert len(found) == 4
    a = found["glA",]
    assert (a["side"], a["call_count_before"], a["call_count_after"], a["call_count_change"]) == ("both", 2, 1, -1)
    assert (a["total_time_us_change"], a["total_time_us_growth"], a["avg_time_us_before"], a["avg_time_us_after"]) == (60, 3.0, 15, 90)
    old, new, none = found["glOld",], found["glNew",], found[None,]
    assert (old["side"], old["total_time_us_after"], old["total_time_us_change"], old["total_time_us_growth"]) == ("before", None, -5, None)
    assert (new["side"], new["total_time_us_before"], new["total_time_us_change"], new["total_time_us_growth"]) == ("after", None, 7, None)
    assert (none["side"], none["total_time_us_change"]) == ("both", 3)


def test_sums_beyond_64_bits_are_null_and_so_is_their_change(spark):
    big = 2**62
    before = spark.createDataFrame([("a", 0, "glA", big), ("a", 0, "glA", big)], CALLS)
    after = spark.createDataFrame([("a", 0, "glA", 1), ("a", 0, "glB", big)], CALLS)
    found = by(compare.compare_functions(before, after), "api_name")
    assert found["glA",]["total_time_us_before"] is None and found["glA",]["total_time_us_change"] is None
    assert found["glB",]["total_time_us_change"] == big


def test_frames_are_paired_by_number_and_regressions_sorted(spark):
    before = spark.createDataFrame([("x", 0, 100, 1, 5), ("x", 1, 50, 2, 5), ("y", 0, 10, 0, 1)], FRAMES)
    after = spark.createDataFrame([("x", 0, 250, 1, 6), ("x", 1, 51, 2, 5), ("x", 2, 70, 0, 2), ("y", 0, 5, 0, 1)], FRAMES)
    compared = compare.compare_frames(before, after)
    found = by(compared, "log_id", "frame_num")
    assert found["x", 0]["total_time_us_change"] == 150 and found["x", 0]["api_call_count_change"] == 1
    assert found["x", 2]["side"] == "after" and found["y", 0]["total_time_us_growth"] == 0.5
    worst = [(r["log_id"], r["frame_num"]) for r in compare.regressions(compared, least_growth=1.5).collect()]
    assert worst == [("x", 0), ("x", 2)]


def test_runs_and_empty_runs(spark):
    before = spark.createDataFrame([("x", 0, 100, 1, 5), ("x", 1, 50, 2, 5)], FRAMES)
    after = spark.createDataFrame([("x", 0, 30, 1, 6)], FRAMES)
    found = by(compare.compare_runs(before, after), "run")
    assert found["before",]["total_frames_beyond_other"] == 1 and found["after",]["avg_time_us_beyond_other"] == -45
    alone = compare.compare_runs(before, after.limit(0)).collect()
    assert [(r["run"], r["total_frames"], r["total_frames_beyond_other"]) for r in alone] == [("before", 2, None)]
    assert compare.compare_functions(spark.createDataFrame([], CALLS), spark.createDataFrame([], CALLS)).count() == 0


def holds(term, line):
    """The search, evaluated by hand."""
    import re

    if isinstance(term, ex.Word):
        return term.text.lower() in line.lower()
    if isinstance(term, ex.Pattern):
        return re.search(term.text, line) is not None
    if isinstance(term, ex.Not):
        return not holds(term.part, line)
    return (all if isinstance(term, ex.All) else any)([holds(p, line) for p in term.parts])


def drawn(rng, depth):
    kind = rng.randrange(5 if depth else 2)
    if kind == 0:
        return ex.word(rng.choice(["GL", "bind", "", "Us", "count=3"]))
    if kind == 1:
        return ex.pattern(rng.choice([r"^gl\w+:", r"count=\d\d", "B"]))
    if kind == 2:
        return ~drawn(rng, depth - 1)
    parts = [drawn(rng, depth - 1) for _ in range(rng.randrange(4))]
    return (ex.all_of if kind == 3 else ex.any_of)(*parts)


@pytest.mark.parametrize("seed", range(6))
def test_expressions_equal_evaluation_by_hand(spark, log_of, seed):
    rng = random.Random(seed)
    lines = ["glBind: count=3, time=4 us", "GLFLUSH count=12", "swapBuffers: 9 us", "", "bind B", "glDraw: count=33"]
    log, term = log_of({"a": lines}).lines, drawn(rng, 3)
    assert sorted(r["line_num"] for r in ex.search(log, term).collect()) == [i + 1 for i, x in enumerate(lines) if holds(term, x)]


def test_operators_flatten_and_order_by_cost():
    both = ex.pattern("a") & ex.word("b") & ex.word("c")
    assert isinstance(both, ex.All) and len(both.parts) == 3
    assert isinstance((ex.word("a") | ex.word("b")) & ex.word("c"), ex.All)
    assert ex.pattern("x").cost > ex.word("x").cost


def test_the_predicate_is_one_filter_over_the_scan(spark, log_of):
    from tests.test_plans import plan_of

    found = ex.search(log_of({"a": ["x"]}).lines, (ex.pattern("late") | ex.word("soon")) & ex.word("us"))
    condition = next(x for x in plan_of(found).splitlines() if "Condition" in x and "late" in x)
    assert condition.count("RLIKE") == 1 and condition.index("Contains") < condition.index("RLIKE")
