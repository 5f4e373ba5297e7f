import csv
import glob
import hashlib
import json
from pathlib import Path

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from framesift import catalog
from framesift.operators import export, stats
from framesift.operators.shaders import shader_call_stats
from framesift.plans import answers
from framesift.plans.parse import parse_aggregated, parse_lines
from framesift.sources.loglines import LogLines
from framesift.sources.text import read_lines

LOG = """glBindBuffer: count=2, time=1005 us
glCompileShader: count=1, time=7 us
[ 9] (gc=0x1, tid=0x2): glShaderSource 4 1 0xff (nil)
####
void main() {
  x = "a, b";
}
####
swapBuffers: 5 us
glBindBuffer: count=1, time=9 us
glBindBuffer: count=3, time=1 us
####
late
####
swapBuffers: 2 us"""
RAW = "glGenBuffers 1, 2\nglUseProgram 7\nglUseProgram 7\nglXSwapBuffers\nglDraw <1>"


def written(path):
    return "".join(open(f).read() for f in sorted(glob.glob(f"{path}/part-*")))


def test_search_text_is_sorted(spark, tmp_path):
    df = spark.createDataFrame([("a", 20, "later", 0), ("a", 10, "first", 0)], "log_id string, line_num long, content string, page_num long")
    export.export(df, "search", "txt", f"{tmp_path}/o")
    assert written(f"{tmp_path}/o") == "[10] first\n[20] later\n"


def test_csv_headings_and_quotes(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, 'x "y", z', 0)], "log_id string, line_num long, content string, page_num long")
    export.export(df, "search", "csv", f"{tmp_path}/o")
    rows = list(csv.reader(open(glob.glob(f"{tmp_path}/o/part-*")[0])))
    assert rows == [["LineNum", "Content", "PageNum"], ["1", 'x "y", z', "0"]]


def test_all_kinds_in_all_formats(log_of, tmp_path):
    parsed = parse_aggregated(log_of(LOG))
    results = {
        "funcs": stats.func_stats(parsed.calls), "frames": parsed.frames, "frame": parsed.frames.limit(1),
        "shader_stats": shader_call_stats(parsed.calls), "shaders": parsed.shaders,
    }
    for kind, df in results.items():
        for fmt in export.FORMATS:
            path = f"{tmp_path}/{kind}-{fmt}"
            export.export(df, kind, fmt, path, parsed.api_calls)
            text = written(path)
            if fmt == "csv":
                assert text.startswith(",".join(export.HEADINGS[kind]))
            if fmt == "json":
                names = [n for n in export.JSON_HEADINGS[kind] if n in json.loads(text.split("\n")[0])]
                assert set(export.HEADINGS[kind]) <= set(names)
                assert "CommandLine" in names or kind != "shaders"
            assert text
    with pytest.raises(ValueError):
        export.export(parsed.frames, "frames", "xml", f"{tmp_path}/x")
    with pytest.raises(ValueError):
        export.export(parsed.frames, "nonsense", "csv", f"{tmp_path}/x")
    with pytest.raises(ValueError):
        export.export(None, "frame", "csv", f"{tmp_path}/x")


def test_each_log_has_its_folder_in_every_format(spark, log_of, tmp_path):
    parsed = parse_lines(log_of({"a": LOG, "b": RAW, "c/d": LOG}))
    results = {
        "funcs": stats.func_stats(parsed.calls), "frames": parsed.frames, "frame": stats.longest_frame(parsed.frames),
        "shader_stats": shader_call_stats(parsed.calls), "shaders": parsed.shaders,
    }
    for kind, df in results.items():
        for fmt in export.FORMATS:
            path = f"{tmp_path}/{kind}-{fmt}"
            export.export(df, kind, fmt, path, parsed.api_calls, by_log=True)
            for log in {r.log_id for r in df.select("log_id").distinct().collect()}:
                folder = f"{path}/log={log.replace('/', '%2F')}"
                alone = f"{tmp_path}/alone-{kind}-{fmt}-{log.replace('/', '')}"
                export.export(df.filter(df.log_id == log), kind, fmt, alone, parsed.api_calls)
                assert written(folder) == written(alone) != "", (kind, fmt, log)
    answers.export_answer(parsed, f"{tmp_path}/top", "top", "csv", "1", by_log=True)
    assert len(glob.glob(f"{tmp_path}/top/log=*")) == 3


def test_frames_as_trees_from_the_exporter(log_of, tmp_path):
    parsed = parse_lines(log_of({"a": LOG, "b": RAW}))
    export.export(parsed.frames, "frames", "json", f"{tmp_path}/t", parsed=parsed)
    text = written(f"{tmp_path}/t").replace("\n", "")
    found = json.loads("[" + text.replace('}{"FrameNum"', '},{"FrameNum"') + "]")
    assert len(found) == parsed.frames.count() and found[0]["APICalls"][0]["APIName"] == "glBindBuffer"


def test_text_layouts(log_of):
    parsed = parse_aggregated(log_of(LOG))
    frame = [r["value"] for r in export.frame_text(parsed.frames.filter("frame_num = 0"), parsed.calls).sorted().collect()]
    assert frame == [
        "Frame #0", "Lines: 1 - 9", "Total Time: 1012 us (1.01 ms)", "API Calls: 2", "",
        "API Name                            Count   Time(us)", "-" * 50,
        "glBindBuffer                            2       1005", "glCompileShader                         1          7", "",
    ]
    funcs = [r["value"] for r in export.func_stats_text(stats.func_stats(parsed.calls)).sorted().collect()]
    assert funcs == [
        "Function                        CallCount   TotalTime(us)     AvgTime(us)", "-" * 50,
        "glBindBuffer                            3            1015             338",
        "glCompileShader                         1               7               7",
    ]
    shaders = "\n".join(r["value"] for r in export.shader_text(parsed.shaders).sorted().collect())
    source = 'void main() {\n  x = "a, b";\n}'
    assert shaders == f"Shader ID: 4\n{'-' * 50}\n{source}\n\n{'=' * 50}\n\nShader ID: 4\n{'-' * 50}\nlate"


def test_two_decimals_round_by_exact_value(spark):
    df = spark.createDataFrame([(125,), (1005,), (375,)], "us long")
    assert [r[0] for r in df.select(export.two_decimals(df.us / 1000.0)).collect()] == ["0.12", "1.00", "0.38"]


def test_whole_logs_as_json(log_of, tmp_path):
    parsed = parse_lines(log_of({"agg": LOG, "raw": RAW, "none": "nothing here"}, chunk=4))
    export.write_document(export.log_json(parsed), f"{tmp_path}/j", by_log=True)
    logs = {n: json.loads(written(f"{tmp_path}/j/log={n}")) for n in ("agg", "raw", "none")}
    assert logs["none"] == {"Frames": None, "TotalTimeUs": 0, "FPS": 0.0}
    first, second = logs["agg"]["Frames"]
    assert logs["agg"]["TotalTimeUs"] == 1022
    assert [c["APIName"] for c in first["APICalls"]] == ["glBindBuffer", "glCompileShader"]
    assert first["APISummary"]["glBindBuffer"] == {"APIName": "glBindBuffer", "Count": 2, "TimeUs": 1005}
    assert second["APISummary"]["glBindBuffer"] == {"APIName": "glBindBuffer", "Count": 4, "TimeUs": 10}
    assert [s["Source"] for s in first["Shaders"]] == ['void main() {\n  x = "a, b";\n}']
    assert (first["Programs"], first["BufferCreations"]) == (None, None)
    raw = logs["raw"]["Frames"]
    assert [f["FrameNum"] for f in raw] == [0, 1]
    assert raw[0]["Programs"] == [7, 7] and raw[1]["Programs"] is None
    assert [b["ID"] for b in raw[0]["BufferCreations"]] == [1, 2]
    assert raw[0]["APISummary"] == {} and raw[0]["Shaders"] == []
    assert raw[1]["APICalls"] == [{"APIName": "glDraw", "Count": 1, "TimeUs": 0, "LineNum": 5, "RawParams": "<1>"}]
    detail = json.loads("".join(r["value"] for r in answers.frame_detail(parse_lines(log_of({"agg": LOG})), 1).sorted().collect()))
    assert detail == second


def test_export_by_question(log_of, tmp_path):
    parsed = parse_aggregated(log_of(LOG))
    n = 0

    def run(*args):
        nonlocal n
        n += 1
        answers.export_answer(parsed, f"{tmp_path}/{n}", *args)
        return written(f"{tmp_path}/{n}")

    assert run("search", "txt", "BIND count=3") == "[4] glBindBuffer: count=3, time=1\n"
    assert run("search", "csv", " ").strip() in ("", "LineNum,Content,PageNum")
    assert run("top", "csv", "1").split("\n")[1] == "0,1,9,1012,2"
    assert run("longest", "csv").split("\n")[:2] == [
        "FrameNum,StartLine,EndLine,TotalTimeUs,SwapBufferTimeUs,APITotalTimeUs,APICallCount", "0,1,9,1012,5,1007,2",
    ]
    assert run("unknown", "csv").count("\n") == 3
    assert run("funcs", "json").startswith('{"FuncName":"glBindBuffer","CallCount":3')
    assert "Shader ID: 4" in run("shader", "txt")
    assert json.loads(run("longest"))["FrameNum"] == 0
    with pytest.raises(ValueError):
        run("frames", "xml")


def writing_tasks(path):
    """Numbers of the tasks that wrote the files below a folder."""
    return {f.name.split("-")[1] for f in Path(path).rglob("part-*")}


def test_files_of_many_logs_are_written_by_many_tasks(spark, tmp_path):
    rows = spark.range(400).selectExpr("id div 10 AS log_id", "id AS line_num", "concat('c', id) AS content", "0L AS page_num")
    for fmt in ("csv", "json", "txt"):
        path = f"{tmp_path}/{fmt}"
        export.export(rows, "search", fmt, path, by_log=True)
        assert len(writing_tasks(path)) > 1, fmt
        assert len(list(Path(path).glob("log=*"))) == 40


def test_log_files_are_written_by_many_tasks_and_each_is_one_file(spark, tmp_path):
    lines = spark.range(400).selectExpr("id div 10 AS log_id", "id % 10 + 1 AS line_num", "concat('c', id) AS content")
    catalog._log_files(spark, lines, f"{tmp_path}/logs")
    assert len(writing_tasks(f"{tmp_path}/logs")) > 1
    files = {f.parent.name: f.read_text() for f in Path(f"{tmp_path}/logs").rglob("part-*")}
    assert len(files) == len(list(Path(f"{tmp_path}/logs").rglob("part-*"))) == 40
    assert files["log_id=3"].split() == [f"c{i}" for i in range(30, 40)]


def text_of_folders(path):
    """Folders below a path, each with the text of its files in order, without their headings."""
    found = {}
    for f in sorted(Path(path).glob("*/part-*"), key=lambda f: f.name.split("-")[1]):
        found[f.parent.name] = found.get(f.parent.name, b"") + f.read_bytes().removeprefix(b"ID,Source\n")
    return found


ODD = [None, "", "  ", " x ", "a,b", 'q"q', "l1\nl2", "é中", '"', "a\\b", "#c", "t\t", "\x01b"]


def test_files_of_logs_are_those_of_sparks_writers(spark, tmp_path, monkeypatch):
    values = [(v, w) for v in ODD for w in ODD]
    logs = [None, "a/b", "c:d=e", "x y%[1]^", "é", *map(str, range(40))]
    rows = [(log, i, i, 4, v, w) for log in logs for i, (v, w) in enumerate(values)]
    rows = spark.createDataFrame(rows, "log_id string, frame_num long, block_num long, shader_id long, source string, command_line string")
    lines = rows.select("log_id", F.col("frame_num").alias("line_num"), F.col("source").alias("content"))
    found = []
    for kind in ("plain", "spark"):
        if kind == "spark":
            for module in (export, catalog):
                monkeypatch.setattr(module, "local_folder", lambda *_: None)
        for fmt in export.FORMATS:
            export.export(rows, "shaders", fmt, f"{tmp_path}/{kind}/{fmt}", by_log=True)
        for code in ("UTF-8", "UTF-16LE"):
            catalog._log_files(spark, lines, f"{tmp_path}/{kind}/{code}", code, "\ufeff")
        found.append({x: text_of_folders(f"{tmp_path}/{kind}/{x}") for x in (*export.FORMATS, "UTF-8", "UTF-16LE")})
    for x in found[0]:
        assert found[0][x].keys() == found[1][x].keys(), x
        assert [log for log in found[0][x] if found[0][x][log] != found[1][x][log]] == [], x
    # The text of shaders has none of a log without an id.
    assert {x: len(found[0][x]) for x in found[0]} == {x: len(logs) - (x == "txt") for x in found[0]}


def test_files_of_logs_are_made_without_programs(spark, tmp_path):
    """Hadoop's local files come with checksums and start a program each; those of logs are plain."""
    rows = spark.range(40).selectExpr("id AS log_id", "1L AS line_num", "'c' AS content", "0L AS page_num")
    for fmt in export.FORMATS:
        export.export(rows, "search", fmt, f"{tmp_path}/{fmt}", by_log=True)
        with pytest.raises(AnalysisException):
            export.export(rows, "search", fmt, f"{tmp_path}/{fmt}", by_log=True)
    catalog._log_files(spark, rows, f"{tmp_path}/logs")
    assert len(list(tmp_path.rglob("part-*"))) == 160 and not list(tmp_path.rglob("*.crc"))
    assert len(list(tmp_path.rglob("_SUCCESS"))) == 4 and not list(tmp_path.rglob(".part*"))


def test_listing_of_many_folders_takes_some_tasks_for_each_core(spark, tmp_path):
    for i in range(60):
        (tmp_path / f"log_id={i}").mkdir()
        (tmp_path / f"log_id={i}" / "a.txt").write_text("swapBuffers: 1 us\n")
    spark.conf.unset("spark.sql.sources.parallelPartitionDiscovery.parallelism")
    spark.sparkContext.setJobGroup("listing", "")
    assert read_lines(spark, str(tmp_path)).lines.count() == 60
    tracker = spark.sparkContext.statusTracker()
    stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup("listing") for s in tracker.getJobInfo(j).stageIds]
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert 0 < max(s.numTasks for s in stages if s and s.name.startswith("text at")) < 60


def test_sources_of_any_length_are_exported_whole(spark, tmp_path):
    """70 MB in a block, in one chunk and over many."""
    n, place = 14_000, F.col("id")
    text = [f"{i};" * 1000 for i in range(n)]
    want = "\n".join(text)
    assert len(want) > 64 * 2**20
    line = F.when(place == 0, "glA: count=1, time=5 us").when(place.isin(1, n + 2), "####").when(place == n + 3, "swapBuffers: 1 us")
    line = line.otherwise(F.repeat(F.concat(place - 2, F.lit(";")), 1000))
    for chunk in (n * 2, 4000):
        rows = spark.range(n + 4).select(F.lit("a").alias("log_id"), F.expr(f"id div {chunk}").alias("chunk_id"), (place + 1).alias("line_num"), line.alias("content"))
        parsed = parse_aggregated(LogLines.of(rows))
        answers.export_answer(parsed, f"{tmp_path}/{chunk}-txt", "shader", "txt")
        assert written(f"{tmp_path}/{chunk}-txt") == f"Shader ID: 0\n{'-' * 50}\n{want}\n"
        answers.export_answer(parsed, f"{tmp_path}/{chunk}-csv", "shader", "csv")
        read = spark.read.csv(f"{tmp_path}/{chunk}-csv", header=True, multiLine=True, escape='"', schema="ID bigint, Source string")
        found = read.select("ID", F.length("Source").alias("n"), F.md5("Source").alias("sum")).collect()
        assert [(r.ID, r.n, r["sum"]) for r in found] == [(0, len(want), hashlib.md5(want.encode()).hexdigest())]
