"""Corpora that are saved, opened again, added to and captured; stored postings."""

import os
import re
from types import SimpleNamespace

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from framesift import catalog
from framesift.operators import postings, search, stats
from framesift.plans import answers
from framesift.plans.parse import parse_aggregated, parse_files, parse_lines
from framesift.sources import saved
from framesift.streaming.capture import capture, captured_batches
from tests.made_logs import aggregated
from tests.test_plans import plan_of


def rows(df):
    names = sorted(df.columns)
    return sorted(map(str, df.select(*names).collect()))


def made(rng, n):
    logs = {f"log{i}": aggregated(rng, 6).lines for i in range(n)}
    logs["raw"] = ["glGenBuffers 3", "glBindBuffer GL_ARRAY_BUFFER 3", "glXSwapBuffers", "glUseProgram 7"]
    return logs


@pytest.fixture
def rng():
    import random

    return random.Random(11)


def test_opened_tables_are_the_parsed_ones(spark, log_of, rng, tmp_path):
    parsed = parse_lines(log_of(made(rng, 5), chunk=7))
    saved.save_logs(parsed, str(tmp_path / "c"), buckets=8)
    opened = saved.open_logs(spark.newSession(), str(tmp_path / "c")).parsed
    for name in saved.TABLES:
        mine, theirs = getattr(parsed, name), getattr(opened, name)
        assert [(f.name, f.dataType) for f in mine.schema] == [(f.name, f.dataType) for f in theirs.schema], name
        assert rows(mine.drop("chunk_id")) == rows(theirs.drop("chunk_id")), name
    # Questions that depend on the order of chunks give the same answers.
    assert rows(answers.summary(opened)) == rows(answers.summary(parsed))
    for p in (parsed, opened):
        assert p.calls.groupBy("log_id").agg(F.count_distinct("chunk_id").alias("n")).agg(F.max("n")).first()[0] > 1
    assert rows(search.rendered_calls(opened.calls).drop("chunk_id")) == rows(search.rendered_calls(parsed.calls).drop("chunk_id"))
    found = [search.with_page_numbers(search.keyword_search(p.lines, ["us"]), 3) for p in (parsed, opened)]
    assert rows(found[0].select("log_id", "line_num", "page_num")) == rows(found[1].select("log_id", "line_num", "page_num"))


def test_one_log_reads_one_folder(spark, log_of, rng, tmp_path):
    parsed = parse_lines(log_of(made(rng, 6)))
    saved.save_logs(parsed, str(tmp_path / "c"), buckets=16)
    one = saved.open_logs(spark, str(tmp_path / "c")).only(["log4", "none"])
    assert rows(one.frames) == rows(parsed.frames.filter("log_id = 'log4'"))
    assert re.search(r"PartitionFilters: \[.*log_bucket", plan_of(one.api_calls))
    scanned = {row[0] for row in one.lines.select(F.input_file_name()).distinct().collect()}
    assert len({os.path.dirname(f) for f in scanned}) == 1
    assert saved.open_logs(spark, str(tmp_path / "c")).only([]).frames.count() == 0


def test_batches_are_added_once_and_unfinished_ones_never_read(spark, log_of, rng, tmp_path):
    path, logs = str(tmp_path / "c"), made(rng, 4)
    with pytest.raises(ValueError):
        saved.open_logs(spark, path)
    first = parse_aggregated(log_of({k: logs[k] for k in ("log0", "log1")}, chunk=5))
    second = parse_aggregated(log_of({k: logs[k] for k in ("log2", "log3")}, chunk=5))
    saved.save_logs(first, path, 0, 4)
    # What a write left that was lost before its note in the manifest.
    saved._write(first.frames, f"{path}/frames/batch=1", ["frame_num"], 4)
    assert rows(saved.open_logs(spark, path).parsed.frames) == rows(first.frames)
    for _ in range(2):
        saved.save_logs(second, path, 1, 4)
    opened = saved.open_logs(spark, path).parsed
    assert rows(opened.frames) == rows(first.frames.union(second.frames))
    assert rows(opened.api_calls) == rows(first.api_calls.union(second.api_calls))
    # Chunk ids of both batches stay apart.
    assert opened.lines.groupBy("chunk_id").agg(F.count_distinct("log_id").alias("n")).agg(F.max("n")).first()[0] == 1
    again = search.with_page_numbers(search.keyword_search(opened.lines, ["us"]), 3).select("log_id", "line_num", "page_num")
    whole = parse_aggregated(log_of({k: v for k, v in logs.items() if k != "raw"}))
    assert rows(again) == rows(search.with_page_numbers(search.keyword_search(whole.lines, ["us"]), 3).select("log_id", "line_num", "page_num"))


def test_empty_corpus(spark, log_of, tmp_path):
    parsed = parse_aggregated(log_of({"a": ["nothing"]}))
    saved.save_logs(parsed, str(tmp_path / "c"))
    opened = saved.open_logs(spark, str(tmp_path / "c")).parsed
    assert opened.frames.count() == 0 and opened.lines.count() == 1 and rows(answers.summary(opened)) == rows(answers.summary(parsed))


# --- capture ---------------------------------------------------------------------


def put(folder, name, lines):
    whole = folder / f".{name}"
    whole.write_text("\n".join(lines) + "\n")
    os.rename(whole, folder / name)


def test_capture_equals_one_parse_and_survives_restarts(spark, rng, tmp_path):
    logs, folder = made(rng, 5), tmp_path / "logs"
    folder.mkdir()
    corpus, checkpoint = str(tmp_path / "corpus"), str(tmp_path / "checkpoint")

    def run(n=2):
        capture(spark, str(folder), corpus, checkpoint, files_per_batch=n, pattern="*.txt").awaitTermination()

    for name in ("log0", "log1", "log2"):
        put(folder, f"{name}.txt", logs[name])
    put(folder, "notes.md", ["glOther: count=1, time=1 us"])
    run()
    assert [tuple(r) for r in captured_batches(saved.manifest(spark, corpus)).orderBy("batch").collect()] == [(0, 2), (1, 1)]
    run()  # nothing has arrived
    for name in ("log3", "log4", "raw"):
        put(folder, f"{name}.txt", logs[name])
    run(5)
    assert captured_batches(saved.manifest(spark, corpus)).count() == 3
    opened, whole = saved.open_logs(spark, corpus).parsed, parse_files(spark, f"{folder}/*.txt")
    for name in saved.TABLES:
        assert rows(getattr(opened, name).drop("chunk_id", "n_bytes", "byte_base")) == rows(getattr(whole, name).drop("chunk_id", "n_bytes", "byte_base")), name


def test_a_batch_without_a_bound_takes_all_files(spark, rng, tmp_path, monkeypatch):
    """The queries of captured logs have two batches however many logs there are, and folders are listed by few tasks."""
    logs, folder = made(rng, 4), tmp_path / "logs"
    for name in logs:
        (folder / f"log={name}").mkdir(parents=True)
        put(folder / f"log={name}", "a.txt", logs[name])
    spark.conf.unset("spark.sql.sources.parallelPartitionDiscovery.parallelism")
    capture(spark, str(folder), str(tmp_path / "c"), str(tmp_path / "k"), None, "*.txt").awaitTermination()
    assert spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism") == str(4 * spark.sparkContext.defaultParallelism)
    assert [tuple(r) for r in captured_batches(saved.manifest(spark, str(tmp_path / "c"))).collect()] == [(0, 5)]
    assert rows(saved.open_logs(spark, str(tmp_path / "c")).parsed.frames) == rows(parse_files(spark, f"{folder}/*").frames)
    asked = []
    monkeypatch.setattr(catalog, "capture", lambda *a: asked.append(a[4]) or SimpleNamespace(awaitTermination=lambda: None))
    events = spark.range(40).selectExpr("id AS event_id", "timestamp_seconds(id) AS ts", "id % 8 AS user_id", "'view' AS event_type", "1.5D AS value")
    events.write.parquet(str(tmp_path / "tables" / "events.parquet"))
    catalog._capture(spark, str(tmp_path / "tables"))
    assert asked == [None, None]


def test_capture_after_a_failure_between_corpus_and_checkpoint(spark, rng, tmp_path):
    """The stream repeats a batch that the corpus has already: it is not taken twice."""
    logs, folder = made(rng, 2), tmp_path / "logs"
    folder.mkdir()
    corpus, checkpoint = str(tmp_path / "corpus"), str(tmp_path / "checkpoint")
    put(folder, "log0.txt", logs["log0"])
    capture(spark, str(folder), corpus, checkpoint).awaitTermination()
    before = rows(saved.open_logs(spark, corpus).parsed.frames)
    for name in ("0", ".0.crc"):  # the note that batch 0 is done is lost
        os.remove(f"{checkpoint}/commits/{name}")
    put(folder, "log1.txt", logs["log1"])
    capture(spark, str(folder), corpus, checkpoint).awaitTermination()
    after = saved.open_logs(spark, corpus).parsed
    assert set(before) < set(rows(after.frames))
    assert rows(after.frames) == rows(parse_files(spark, f"{folder}/*.txt").frames)


# --- postings --------------------------------------------------------------------


def many_calls(spark, n=60_000):
    """One function on half of all lines of a log, many others on few."""
    line = F.col("id") + 1
    name = F.when(line % 2 == 0, "glHot").otherwise(F.concat(F.lit("gl"), F.lpad((line % 499).cast("string"), 3, "0")))
    return spark.range(n).select(
        F.lit("log").alias("log_id"), F.expr("id div 1000").alias("chunk_id"), line.alias("line_num"), name.alias("api_name")
    ).union(spark.sql("SELECT 'other' AS log_id, 100L AS chunk_id, 7L AS line_num, 'glHot' AS api_name"))


def test_lookups_equal_the_calls(spark, tmp_path):
    calls = many_calls(spark)
    postings.save_postings(calls, str(tmp_path / "p"))
    stored = postings.open_postings(spark, str(tmp_path / "p"))
    for name, log, low, high in (("glHot", None, None, None), ("glHot", "log", 31_000, 31_300), ("gl007", None, 1, 20_000), ("glHot", "other", None, 7), ("glHo", None, None, None), ("glHot", "log", 9, 8)):
        wanted = calls.filter(F.col("api_name") == name)
        wanted = wanted if log is None else wanted.filter(F.col("log_id") == log)
        wanted = wanted.filter(F.col("line_num").between(low or 1, high if high is not None else 10**9))
        assert rows(postings.lines_of(stored, name, log, low, high)) == rows(wanted.select("api_name", "log_id", "line_num"))
    assert rows(stats.lookup(stats.call_postings(calls), "gl011")) == rows(postings.lines_of(stored, "gl011"))
    assert postings.has_postings(stored, "glHot") and not postings.has_postings(stored, "glho")
    counts = {(r["api_name"], r["log_id"]): r["n_calls"] for r in postings.calls_of_functions(stored).collect()}
    assert counts["glHot", "log"] == 30_000 and counts["glHot", "other"] == 1


def test_calls_are_numbered_once(spark, tmp_path, written_plans):
    postings.save_postings(many_calls(spark, 2_000), str(tmp_path / "p"))
    # Bounds of ranges are sampled from what the last write reads, so nothing is numbered there.
    assert ["Window" in p for p in written_plans] == [True, False]


def test_blocks_are_short_and_ranges_of_row_groups_narrow(spark, tmp_path):
    # Logs of many lines, so that the blocks need several row groups.
    calls = many_calls(spark, 400_000)
    postings.save_postings(calls, str(tmp_path / "p"))
    stored = postings.open_postings(spark, str(tmp_path / "p"))
    assert stored.agg(F.max("n_calls")).first()[0] <= postings.BLOCK_LINES
    assert stored.agg(F.sum("n_calls")).first()[0] == 400_001
    groups = met = 0
    for f in (tmp_path / "p").glob("part-*"):
        meta = pq.ParquetFile(f).metadata
        names = meta.schema.names
        for g in range(meta.num_row_groups):
            def span(c):
                s = meta.row_group(g).column(names.index(c)).statistics
                return s.min, s.max

            groups += 1
            low, high = span("api_name")
            met += low <= "glHot" <= high and span("last_line")[1] >= 200_000 and span("first_line")[0] <= 200_500
    assert groups >= 6 and met <= groups / 3
    plan = plan_of(postings.lines_of(stored, "glHot", "log", 200_000, 200_500))
    assert "EqualTo(api_name,glHot)" in plan and "GreaterThanOrEqual(last_line,200000)" in plan and "LessThanOrEqual(first_line,200500)" in plan
