import contextlib
import io

import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from framesift.session import local_session
from framesift.sources.loglines import LogLines


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "framesift-tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def written_plans(monkeypatch):
    """The plans of all tables that are written as Parquet while a test runs."""
    plans, write = [], DataFrameWriter.parquet

    def noted(self, path, *args, **kwargs):
        with contextlib.redirect_stdout(io.StringIO()) as text:
            self._df.explain("formatted")
        plans.append(text.getvalue())
        return write(self, path, *args, **kwargs)

    monkeypatch.setattr(DataFrameWriter, "parquet", noted)
    return plans


@pytest.fixture
def log_of(spark):
    """Numbered lines of inline logs, cut into chunks of the given length."""

    def make(logs, chunk=1000):
        if isinstance(logs, str):
            logs = {"log": logs}
        rows = [
            (name, i // chunk, i + 1, text)
            for name, body in logs.items()
            for i, text in enumerate(body.split("\n") if isinstance(body, str) else body)
        ]
        lines = spark.createDataFrame(rows, "log_id string, chunk_id bigint, line_num bigint, content string")
        return LogLines.of(lines)

    return make


@pytest.fixture
def text_column(spark):
    """Apply a column expression to a list of texts and return the values in order."""

    def run(expression, texts):
        df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, c string")
        return [r[0] for r in df.orderBy("i").select(expression(F.col("c"))).collect()]

    return run
