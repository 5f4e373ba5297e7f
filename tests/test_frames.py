import random

from framesift.functions.lines import fps_value, is_frame_boundary
from framesift.operators import shaders
from framesift.plans.parse import parse_aggregated, parse_files, parse_lines, parse_raw
from framesift.sources.text import detect_encodings, frame_offsets, log_sizes, read_lines
from tests import made_logs

SHORT = """glViewport: count=12, time=300 us
glTexParameteri: count=4, time=1250 us
libGL: FPS = 24.5
glDrawArrays: count=70, time=8000 us
glFinish: count=1, time=450 us
swapBuffers: 2500 us
17 frame cost 41ms"""

RAW = """[ 1] glXSwapBuffers: dpy = 0x7a, drawable = 44
glGenTextures 3
glUseProgram 5
glBindBuffer 0x8893 61
glXSwapBuffers: dpy = 0x7a, drawable = 44
glUseProgram 9
glBufferData 0x8893 4096 0x55d0 GL_DYNAMIC_DRAW
glUseProgram 5
glDrawElements 0x0001 36 0x1405 (nil)
glClear 0x4000"""

COLUMNS = ["frame_num", "start_line", "end_line", "total_time_us", "swap_time_us", "api_total_time_us", "api_call_count"]

# A profile of one frame as written on Windows, without a final line end.
PROFILE = [
    "<<gc = 0x5a1c>>", "glViewport: count=2, time=310 us", "", "glDrawArrays: count=8, time=270 us",
    "glFlush: count=3, time=60 us", "libGL: FPS = 52.25", "swapBuffers: 1900 us", "88 frame cost 12ms",
]


def frames_of(parsed):
    rows = parsed.frames.orderBy("log_id", "frame_num").select(*COLUMNS).collect()
    return [tuple(r) for r in rows]


def test_short_log(log_of):
    parsed = parse_aggregated(log_of(SHORT))
    assert frames_of(parsed) == [(0, 1, 6, 10000, 2500, 7500, 4)]
    log = parsed.logs().first()
    assert (log.fps, log.frame_count, log.total_time_us, log.line_count, log.rejects) == (24.5, 1, 10000, 7, 0)
    calls = parsed.api_calls.orderBy("line_num").collect()
    assert [(c.line_num, c.api_name) for c in calls] == [(1, "glViewport"), (2, "glTexParameteri"), (4, "glDrawArrays"), (5, "glFinish")]
    assert (calls[2].call_count, calls[2].time_us, calls[2].raw_params) == (70, 8000, "")


def test_boundary_lines(text_column):
    texts = ["5 frame cost 0ms", "libGL: FPS = 61", "[ 8] swapBuffers: 1 us", "glFlush: count=1, time=2 us", "swapBuffers: x us"]
    assert text_column(is_frame_boundary, texts) == [True, False, True, False, False]


def test_unreadable_rate_is_skipped(text_column, log_of):
    assert text_column(fps_value, ["libGL: FPS = 8.9.1", "x libGL: FPS = 60"]) == [None, 60.0]
    log = parse_aggregated(log_of("glA: count=1, time=5 us\nlibGL: FPS = 7\nlibGL: FPS = 1.2.3")).logs().first()
    assert log.fps == 7.0


def test_rate_from_times_without_a_logged_one(log_of):
    log = parse_aggregated(log_of("glA: count=1, time=500 us\nswapBuffers: 1 us")).logs().first()
    assert log.fps == 2000.0


def test_too_large_numbers_are_counted_as_rejects(log_of):
    text = "glA: count=99999999999999999999, time=5 us\nglA: count=1, time=5 us\nswapBuffers: 1 us"
    parsed = parse_aggregated(log_of(text))
    assert frames_of(parsed) == [(0, 2, 3, 5, 1, 4, 1)]
    assert parsed.logs().first().rejects == 1


def test_names_that_are_noise_words(log_of):
    text = "warning: count=1, time=5 us\nvendor: count=1, time=5 us\n[ 1] vendor: count=1, time=5 us\n[ 1] warning: count=1, time=7 us"
    assert [c.line_num for c in parse_aggregated(log_of(text)).api_calls.collect()] == [4]


def test_raw_log(log_of):
    parsed = parse_lines(log_of(RAW, chunk=3))
    assert [(f[0], f[1], f[2], f[6]) for f in frames_of(parsed)] == [(1, 2, 4, 3), (2, 6, 10, 5)]
    assert [(p.frame_num, p.program_id) for p in parsed.programs.orderBy("line_num").collect()] == [(1, 5), (2, 9), (2, 5)]
    log = parsed.logs().first()
    assert (log.kind, log.fps, log.total_time_us) == ("rawtrace", 0.0, 0)


def test_raw_call_forms(log_of):
    text = [
        "[  4090] glXSwapBuffers: dpy = 0x1", "  glIndented 1", "=> 5", "__x", "(gc=0x1, tid=0x2): glCall 1",
        "[     1] glGenFramebuffers   1,\t2", "eglFoo", "glut x", "[gl", "some text", "x glCall", "glUseProgram program = 7",
        "glUseProgram -3", "glGenBuffers 4, x, 5", "glCreateBuffers: n = 2, 9", "[12] : glNo", "[1:2:3 x] glBrowser 1",
    ]
    parsed = parse_raw(log_of({"a": text}, chunk=2))
    calls = parsed.api_calls.orderBy("line_num").collect()
    assert [(c.line_num, c.api_name, c.raw_params) for c in calls] == [
        (6, "glGenFramebuffers", "1, 2"), (7, "eglFoo", ""), (8, "glut", "x"), (12, "glUseProgram", "program = 7"),
        (13, "glUseProgram", "-3"), (14, "glGenBuffers", "4, x, 5"), (15, "glCreateBuffers", "n = 2, 9"),
    ]
    assert [r.program_id for r in parsed.programs.collect()] == [7]
    made = parsed.buffer_creations.orderBy("line_num", "pos").collect()
    assert [(r.line_num, r.buffer_id) for r in made] == [(14, 4), (14, 5), (15, 2), (15, 9)]


def test_made_logs(log_of):
    rng = random.Random(11)
    # Some logs without shader lines, some with many.
    logs = {f"log{i:03d}": made_logs.aggregated(rng, rng.randint(0, 6), shaders=i % 3 > 0) for i in range(600)}
    assert sum(len(m.shaders) for m in logs.values()) > 300
    for chunk in (3, 7, 1000):
        parsed = parse_aggregated(log_of({n: m.lines for n, m in logs.items() if m.lines}, chunk))
        frames, shaders = {}, {}
        for r in parsed.frames.orderBy("log_id", "frame_num").collect():
            frames.setdefault(r.log_id, []).append(tuple(r[c] for c in COLUMNS))
        for r in parsed.shaders.orderBy("log_id", "block_num").collect():
            shaders.setdefault(r.log_id, []).append((r.frame_num, r.shader_id, r.command_line, r.source))
        for name, made in logs.items():
            assert frames.get(name, []) == made.frames, (chunk, name, made.lines)
            assert shaders.get(name, []) == made.shaders, (chunk, name, made.lines)
        assert parsed.logs().count() == sum(bool(m.lines) for m in logs.values())


def test_blocks_over_many_chunks_and_longer_than_a_value(log_of, monkeypatch):
    body = [f"vec4 v{i};" for i in range(400)]
    closed = ["glA: count=1, time=5 us", "[ 1] (gc=0x1, tid=0x2): glShaderSource 9 1 0xff", "####", *body, "libGL: FPS = 12", "####", "swapBuffers: 1 us"]
    opened = ["glA: count=1, time=5 us", "####", "warning: none", *body, "swapBuffers: 1 us"]
    for chunk in (13, 5000):
        log = log_of({"closed": closed, "open": opened}, chunk)
        parsed = parse_aggregated(log)
        found = {r.log_id: r for r in parsed.shaders.collect()}
        assert found["closed"].source == "\n".join(body) and found["closed"].shader_id == 9
        assert found["open"].source == "\n".join([*body, "swapBuffers: 1 us"]) and found["open"].frame_num == 0
        assert {r.log_id: r.fps for r in parsed.logs().collect()}["closed"] == 12.0
        monkeypatch.setattr(shaders, "LONGEST_SOURCE_BYTES", len("\n".join(body)) + 1)
        cut = parse_aggregated(log)
        assert {r.log_id: r.source for r in cut.shaders.collect()} == {"closed": "\n".join(body), "open": None}
        lines = cut.shader_lines.orderBy("line_num").collect()
        assert [r.content for r in lines if r.log_id == "open"] == [*body, "swapBuffers: 1 us"]
        assert [r.line_num for r in lines if r.log_id == "closed"] == list(range(4, 404))
        monkeypatch.undo()


def test_sources_are_shuffled_once(log_of):
    """Blocks of one chunk are not put together a second time, and joins with what else is known of
    a block keep its partitions."""
    from framesift.operators import aggregated

    block = ["glA: count=1, time=1 us", "####", "a", "b", "####", "swapBuffers: 1 us"]
    for chunk, tables in ((100, 1), (3, 2)):
        log = log_of({"x": block * 3, "y": block}, chunk=chunk)
        state = aggregated.shader_state(log)
        found = shaders._sources(shaders.body_lines(log, state), state)
        assert len(found) == tables
        assert sorted((r.log_id, r.block, r.source) for t in found for r in t.collect()) == [("x", 2, "a\nb"), ("x", 8, "a\nb"), ("x", 14, "a\nb"), ("y", 2, "a\nb")]


def test_files_in_splits_of_any_size(spark, tmp_path):
    made = made_logs.aggregated(random.Random(5), 500)
    body, want = made.lines, made.frames
    (tmp_path / "a.txt").write_bytes("\r\n".join(body).encode())
    (tmp_path / "b.txt").write_bytes(b"\xef\xbb\xbf" + ("\n".join(PROFILE) + "\n").encode())
    (tmp_path / "c.txt").write_bytes((RAW + "\n").encode())
    seen = []
    for split in ("200b", "7kb", "128mb"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        try:
            log = read_lines(spark, str(tmp_path))
            parsed = parse_lines(log)
            rows = parsed.frames.orderBy("log_id", "frame_num").collect()
            by_log = {}
            for r in rows:
                by_log.setdefault(r.log_id[-5], []).append(tuple(r[c] for c in COLUMNS))
            assert by_log["a"] == want
            assert by_log["b"] == [(0, 2, 7, 640, 1900, 0, 3)]
            assert [f[0] for f in by_log["c"]] == [1, 2]
            assert parsed.shaders.count() == len(made.shaders)
            kinds = {r.log_id[-5]: (r.kind, r.line_count) for r in parsed.logs().collect()}
            assert kinds["b"] == ("apitrace", 8) and kinds["c"] == ("rawtrace", 10)
            sizes = {r.log_id[-5]: r.line_count for r in log_sizes(log.lines).collect()}
            assert sizes == {"a": len(body), "b": 8, "c": 10}
            offsets = {(r.log_id[-5], r.frame_num): r.byte_offset for r in frame_offsets(log.lines, parsed.frames).collect()}
            assert len(offsets) == len(rows)
            seen.append(offsets)
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert seen[0] == seen[1] == seen[2]
    for name in "abc":
        data = (tmp_path / f"{name}.txt").read_bytes()
        lines = (body if name == "a" else PROFILE if name == "b" else RAW.split("\n"))
        for f in [k for k in seen[0] if k[0] == name]:
            at = seen[0][f]
            start = {"a": want, "b": by_log["b"], "c": by_log["c"]}[name]
            line = next(x[1] for x in start if x[0] == f[1])
            assert data[at:].split(b"\n")[0].rstrip(b"\r").decode() == lines[line - 1]


def test_encodings(spark, tmp_path):
    (tmp_path / "le.txt").write_bytes(b"\xff\xfea\x00\n\x00")
    (tmp_path / "be.txt").write_bytes(b"\xfe\xff\x00a\x00\n")
    (tmp_path / "u8.txt").write_bytes(b"\xef\xbb\xbfabc\n")
    (tmp_path / "short.txt").write_bytes(b"\xff\xfe")
    (tmp_path / "plain.txt").write_bytes(b"abc\n")
    found = {r.log_id.rsplit("/", 1)[1]: r.encoding for r in detect_encodings(spark, str(tmp_path)).collect()}
    assert found == {
        "le.txt": "utf-16-le", "be.txt": "utf-16-be", "u8.txt": "utf-8", "short.txt": "utf-8", "plain.txt": "utf-8",
    }


def test_profile_sample_file(spark, tmp_path):
    (tmp_path / "p.txt").write_bytes("\r\n".join(PROFILE).encode())
    parsed = parse_files(spark, str(tmp_path / "p.txt"))
    assert frames_of(parsed) == [(0, 2, 7, 640, 1900, 0, 3)]
    assert parsed.logs().first().fps == 52.25


def test_results_without_broadcast_are_the_same(spark, tmp_path, monkeypatch):
    from framesift import session

    made = made_logs.aggregated(random.Random(8), 200)
    (tmp_path / "a.txt").write_text("\n".join(made.lines))
    monkeypatch.setattr(session, "BROADCAST_BYTES", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1kb")
    try:
        parsed = parse_files(spark, str(tmp_path))
        assert frames_of(parsed) == made.frames
        assert parsed.shaders.count() == len(made.shaders)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_split_layout_is_pinned(spark, tmp_path):
    (tmp_path / "a.txt").write_text("glA: count=1, time=5 us\n")
    read_lines(spark, str(tmp_path))
    assert int(spark.conf.get("spark.sql.files.minPartitionNum")) >= 1
