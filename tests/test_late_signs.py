"""Texts and kinds that the first lines, or the ends of a line, must not decide."""

import csv
import glob

from framesift.operators import export, search
from framesift.plans.parse import parse_lines
from pyspark.sql import functions as F


def test_kind_shown_after_the_first_lines(spark, log_of):
    neutral = [f"note {i}" for i in range(120)]
    logs = parse_lines(log_of({"late": [*neutral, "[0] glClear(mask = 1)", "[1] eglSwapBuffers(dpy = 0x1, surface = 0x2)"], "never": neutral}))
    kinds = {r.log_id: r.kind for r in logs.kinds.collect()}
    assert kinds["never"] == "unknown" and kinds["late"] != "unknown"
    assert {r.log_id for r in logs.calls.collect()} == {"late"}


def test_csv_keeps_blanks_at_both_ends(spark, log_of, tmp_path):
    lines = log_of({"log": ["  leading glfoo", "trailing glfoo  ", "plain"]}).lines
    export.export(search.raw_search(lines, "glfoo").withColumn("page_num", F.lit(1)), "search", "csv", str(tmp_path / "out"))
    text = "".join(open(f, newline="").read() for f in sorted(glob.glob(f"{tmp_path}/out/*.csv")))
    cells = {c for row in csv.reader(text.splitlines()) for c in row}
    assert {"  leading glfoo", "trailing glfoo  "} <= cells
