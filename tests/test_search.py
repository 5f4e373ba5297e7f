import pytest

from framesift.operators import kinds, search, shaders, stats
from framesift.plans import answers
from framesift.plans.parse import parse_aggregated
from framesift.sources.tables import number_lines, of_log, open_table, save_table

LINES = [
    "glTexImage2D: count=36, time=900 us", "glClear: count=7, time=52 us", "libGL: FPS = 40.5",
    "glTexStorage3D: count=368, time=4100 us", "glFlush: count=5, time=1948 us", "swapBuffers: 600 us",
]


def numbers(df):
    return [r.line_num for r in df.orderBy("line_num").collect()]


def test_keywords(log_of):
    lines = log_of({"a": LINES}).lines
    expected = {
        ("TEXS",): [4], ("gltex",): [1, 4], ("time", "36"): [1, 4], ("fps", "count"): [], ("", "clear"): [2], (): [], ("",): [],
    }
    for words, want in expected.items():
        assert numbers(search.keyword_search(lines, list(words))) == want, words
    assert numbers(search.raw_search(lines, "  ")) == [1, 2, 3, 4, 5, 6]
    assert numbers(search.raw_search(lines, " us  fl ")) == [5]
    with pytest.raises(ValueError):
        search.raw_search(lines, "")


def test_pages(log_of):
    # Every third line matches: 700 matches on lines 3, 6, 9 and so on.
    body = [f"glFlush {i}" if i % 3 == 0 else "other" for i in range(1, 2101)]
    found = search.keyword_search(log_of({"a": body}, chunk=130).lines, ["FLUSH"])
    assert [search.page_from_zero(found, p, 300).count() for p in range(4)] == [300, 300, 100, 0]
    assert numbers(search.page_from_zero(found, 2, 300)) == list(range(1803, 2101, 3))
    assert numbers(search.page_from_zero(found, -5, -1)) == list(range(3, 2101, 3))
    assert search.match_counts(found).first().total == 700
    pages = search.with_page_numbers(found, 300).groupBy("page_num").count().orderBy("page_num").collect()
    assert [tuple(r) for r in pages] == [(0, 300), (1, 300), (2, 100)]
    assert numbers(search.page_from_one(found, 3, 7)) == list(range(45, 66, 3))
    assert numbers(search.page_from_one(found)) == list(range(3, 151, 3))
    assert search.page_info(found, 9000, 10).first()[1:] == (700, 1, 10)
    assert search.page_info(found, 3, -1).first()[1:] == (700, 3, 50)
    shown = search.preview(found).collect()
    assert len(shown) == 100 and {r.left_out for r in shown} == {600}


def test_patterns_count_from_zero(log_of):
    found = search.pattern_search(log_of({"a": LINES}).lines, r"^gl\w+: count=36").collect()
    assert sorted(r.position for r in found) == [0, 3]


def some_calls(spark):
    frames = spark.createDataFrame([("z", 4, 95), ("z", 5, 640), ("z", 6, 7)], "log_id string, frame_num long, total_time_us long")
    calls = spark.createDataFrame(
        [("z", 4, 21, "glFlush", 90), ("z", 4, 22, "glClear", 5), ("z", 5, 30, "glClear", 400), ("z", 5, 31, "glClearColor", 240),
         ("z", 6, 40, "glFlush", 7)],
        "log_id string, frame_num long, line_num long, api_name string, time_us long",
    )
    return frames, calls


def test_duration_and_frame_ranges(spark):
    frames, calls = some_calls(spark)
    # Both ends belong to the range, and the frame's time decides.
    ranges = {(0, 6): [], (7, 7): [40], (7, 95): [21, 22, 40], (96, 639): [], (95, 640): [21, 22, 30, 31], (640, 7): []}
    for (low, high), want in ranges.items():
        assert numbers(search.calls_in_duration_range(calls, frames, low, high)) == want
    assert sorted(r.frame_num for r in search.frame_range(frames, 5, 9).collect()) == [5, 6]


def test_postings(spark):
    _, calls = some_calls(spark)
    postings = stats.call_postings(calls)
    assert sorted(r.line_num for r in stats.lookup(postings, "glClear").collect()) == [22, 30]
    assert stats.lookup(postings, "glCl").count() == 0
    assert stats.has_postings(postings) and not stats.has_postings(postings.limit(0))


def test_rankings_and_summaries(spark):
    frames = spark.createDataFrame(
        [("a", 0, 1, 5, 37179), ("a", 1, 6, 9, 50000), ("a", 2, 10, 12, 1000)],
        "log_id string, frame_num long, start_line long, end_line long, total_time_us long",
    )
    for n, want in ((1, [1]), (2, [1, 0]), (10, [1, 0, 2]), (0, [])):
        assert [r.frame_num for r in stats.top_frames(frames, n).orderBy("place").collect()] == want
        assert [r.frame_num for r in stats.top_frames_of_all(frames, n).collect()] == want
    assert stats.longest_frame(frames).first().frame_num == 1
    s = stats.frame_summary(frames).first()
    assert (s.total_frames, s.avg_time_us, s.max_time_us, s.min_time_us, s.total_time_us) == (3, 29393, 50000, 1000, 88179)
    calls = spark.createDataFrame(
        [("a", 0, 1, "glDrawElements", 3, 100), ("a", 1, 2, "glDrawElements", 0, 35), ("a", 1, 3, "glShaderSource", 1, 20),
         ("a", 2, 4, "glCompileShader", 1, 35)],
        "log_id string, frame_num long, line_num long, api_name string, call_count long, time_us long",
    )
    first = stats.by_time(stats.func_stats(calls)).first()
    assert (first.api_name, first.call_count, first.total_time_us, first.avg_time_us) == ("glDrawElements", 2, 135, 67)
    assert stats.func_stats_with_prefix(calls, "glDraw").count() == 1
    assert stats.func_stats_with_prefix(calls, "GLDRAW").count() == 0
    assert stats.func_stats_with_prefix(calls, "").count() == 3
    one = {r.api_name: (r.call_count, r.avg_time_us) for r in stats.frame_func_stats(calls, 1).collect()}
    assert one == {"glDrawElements": (0, None), "glShaderSource": (1, 20)}
    kinds_seen = {r.type: r.compile_count for r in shaders.shader_call_stats(calls).collect()}
    assert kinds_seen == {"Source": 1, "Compile": 1}
    assert shaders.shader_summary(shaders.shader_call_stats(calls)).first()[1:] == (2, 2, 55)
    top = {r.frame_num: (r.api_name, r.api_call_count) for r in stats.slowest_call_per_frame(calls).collect()}
    assert top == {0: ("glDrawElements", 1), 1: ("glDrawElements", 2), 2: ("glCompileShader", 1)}


def test_parse_summary(log_of):
    parsed = parse_aggregated(log_of({"a": LINES, "b": ["glX 1"]}))
    by_log = {r.log_id: r for r in answers.summary(parsed).collect()}
    assert (by_log["a"].format_label, by_log["a"].frame_count, by_log["a"].max_frame_time) == ("profile", 1, 7.0)
    assert (by_log["b"].format_label, by_log["b"].frame_count, by_log["b"].max_frame_time) == ("rawtrace", 0, 0.0)
    assert answers.longest_or_zero(parsed).filter("log_id = 'b'").first().total_time_us == 0


def test_kind_of_single_lines(text_column):
    expected = {
        "": "unknown", "plain words": "unknown", "[44]": "unknown", "<<gc = 0x77>>": "profile", "glFlush: count=1, time=2 us": "apitrace",
        "[ 5] glClear 0x4000": "rawtrace", "glXSwapBuffers: dpy = 0x9, drawable = 3": "rawtrace", "glDeleteTextures 2": "rawtrace",
        "glUniform1f 3 0.5": "unknown",
    }
    assert text_column(kinds.kind_of_line, list(expected)) == list(expected.values())


def test_kind_of_logs(log_of):
    logs = {
        "late": ["x"] * 50 + ["glGenBuffers 1"],
        "gc": ["<<gc = 0x1>>", "glGenBuffers 1"],
        "profile": ["<<other>>", "glGenBuffers 1"],
        "cost after": ["glGenBuffers 1", "1 frame cost 2ms"],
        "cost before": ["1 frame cost 2ms", "glGenBuffers 1"],
        "cost in noise": ["[1:2:3 a] 1 frame cost 2ms", "", "glGenBuffers 1"],
        "only cost in noise": ["[1:2:3 a] frame cost"],
        "nothing": ["", "hello"],
    }
    found = {r.log_id: r.kind for r in kinds.detect_kinds(log_of(logs).lines).collect()}
    assert found == {
        "late": "unknown", "gc": "rawtrace", "profile": "profile", "cost after": "rawtrace", "cost before": "apitrace",
        "cost in noise": "apitrace", "only cost in noise": "apitrace", "nothing": "unknown",
    }
    assert kinds.detect_kinds(log_of(logs).lines.filter("log_id = 'late'"), 100).first().kind == "rawtrace"


def test_numbering_of_table_rows(spark):
    rows = [("hot", i, f"line {i}") for i in range(3000)] + [(f"log{i % 7}", i, f"line {i}") for i in range(70)]
    df = spark.createDataFrame(rows, "log_id string, at long, content string").repartition(5)
    # Such small partitions would be merged otherwise.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    log = number_lines(df, "at")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    got = log.lines.orderBy("log_id", "line_num").collect()
    assert [r.line_num for r in got if r.log_id == "hot"] == list(range(1, 3001))
    assert [r.content for r in got if r.log_id == "hot"] == [f"line {i}" for i in range(3000)]
    assert [r.line_num for r in got if r.log_id == "log3"] == list(range(1, 11))
    assert log.lines.filter("log_id = 'hot'").select("chunk_id").distinct().count() > 1
    ends = {r.log_id: r.last_line for r in log.log_ends().collect()}
    assert ends["hot"] == 3000 and ends["log0"] == 10


def test_saved_tables(spark, log_of, tmp_path):
    parsed = parse_aggregated(log_of({"a": LINES, "b": LINES}))
    save_table(parsed.frames, f"{tmp_path}/frames", "frame_num")
    assert sorted(map(tuple, open_table(spark, f"{tmp_path}/frames").collect())) == sorted(map(tuple, parsed.frames.collect()))
    one = of_log(spark.read.parquet(f"{tmp_path}/frames"), "a")
    assert [r.log_id for r in one.collect()] == ["a"]


def test_lists_of_shaders(spark):
    df = spark.createDataFrame([("x" * 3000,), ("y" * 2000,), ("z" * 10,)], "source string")
    cut = [r[0] for r in shaders.shader_list(df).collect()]
    assert cut == ["x" * 2000 + "\n[Source truncated]", "y" * 2000, "z" * 10]
    assert [r.preview for r in shaders.shader_previews(df).collect()] == ["x" * 50 + "...", "y" * 50 + "...", "z" * 10]


def test_frame_pages_and_times(log_of):
    body = [x for i in range(120) for x in (f"glA: count=1, time={i} us", "swapBuffers: 1 us")]
    frames = parse_aggregated(log_of({"a": body}, chunk=17)).frames
    assert [r.frame_num for r in search.frame_page(frames, 2).orderBy("frame_num").collect()] == list(range(50, 100))
    assert search.frame_page(frames, 4).count() == 0
    assert search.page_info(frames, 4).first()[1:] == (120, 1, 50)
    assert stats.frame_ms(frames.filter("frame_num = 7")).first()[2:] == (0.007, 0.001, 0.006)


def test_kinds_of_files_in_splits_of_any_size(spark, tmp_path):
    from framesift.sources.text import read_lines

    logs = {
        "late": ["x"] * 60 + ["glGenBuffers 1"], "early": ["", "glGenBuffers 1"] + ["1 frame cost 2ms"] * 80,
        "agg": ["[1:2:3 a] 1 frame cost 2ms", "", "glGenBuffers 1"], "profile": ["<<other>>", "glGenBuffers 1"],
        "none": ["hello"] * 3,
    }
    for name, body in logs.items():
        (tmp_path / f"{name}.txt").write_text("\r\n".join(body))
    want = {"late": "unknown", "early": "rawtrace", "agg": "apitrace", "profile": "profile", "none": "unknown"}
    for split in ("64b", "128mb"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        log = read_lines(spark, str(tmp_path))
        found = {r.log_id.rsplit("/", 1)[1][:-4]: r.kind for r in kinds.kinds_of(log).collect()}
        assert found == want, split
        late = {r.log_id.rsplit("/", 1)[1][:-4]: r.kind for r in kinds.kinds_of(log, 100).collect()}
        assert late == {**want, "late": "rawtrace"}
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
