"""Totals beyond 64 bits, and logs without matches."""

from framesift.operators import search, stats
from framesift.plans.parse import parse_aggregated

BIG = 2**63 - 1


def call(name, us):
    return f"{name}: count=1, time={us} us"


def test_a_total_that_does_not_fit_leaves_other_logs_alone(log_of):
    bad = [call("glOne", BIG), call("glOne", BIG), "swapBuffers: 4 us", call("glTwo", 6), "swapBuffers: 1 us"]
    good = [call("glTwo", 11), "swapBuffers: 3 us"]
    for chunk in (1, 2, 1000):
        parsed = parse_aggregated(log_of({"bad": "\n".join(bad), "good": "\n".join(good)}, chunk))
        found = {(r.log_id, r.frame_num): (r.total_time_us, r.api_total_time_us) for r in parsed.frames.collect()}
        assert found == {("bad", 0): (None, None), ("bad", 1): (6, 5), ("good", 0): (11, 8)}
        totals = {r.log_id: (r.frame_count, r.total_time_us, r.fps > 0) for r in parsed.logs().collect()}
        assert totals == {"bad": (2, None, False), "good": (1, 11, True)}
        sums = {(r.log_id, r.api_name): (r.total_time_us, r.avg_time_us) for r in stats.func_stats(parsed.calls).collect()}
        assert sums == {("bad", "glOne"): (None, None), ("bad", "glTwo"): (6, 6), ("good", "glTwo"): (11, 11)}


def test_page_of_a_log_without_matches(log_of):
    log = log_of({"a": "red\nred\nblue", "b": "green"})
    found = search.keyword_search(log.lines, ["red"])
    rows = {tuple(r) for r in search.page_info(found, 2, 1, log.log_ends()).collect()}
    assert rows == {("a", 2, 2, 1), ("b", 0, 1, 1)}
