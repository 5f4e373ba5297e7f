"""Order-dependent state over logs that are cut into chunks.

A log of any size is a series of chunks. State along its lines is found in two
steps: windows inside each chunk, which spread over the cluster however large one
log is, and a window over one summary row per chunk, which hands each chunk the
state it starts with. Chunk ids are unique in a corpus and rise along each log, so
that rows are shuffled and sorted by one number instead of a file name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK = "chunk_id"


def in_chunk():
    return Window.partitionBy(CHUNK).orderBy("line_num")


def upto(window):
    return window.rowsBetween(Window.unboundedPreceding, 0)


def before(window):
    return window.rowsBetween(Window.unboundedPreceding, -1)


def over_chunks():
    return Window.partitionBy("log_id").orderBy(CHUNK)


def earlier_chunks():
    return before(over_chunks())


def chunk_base(df: DataFrame, **amounts: Column) -> DataFrame:
    """Per chunk, the sum of each amount over all earlier chunks of its log."""
    totals = df.groupBy("log_id", CHUNK).agg(*[F.sum(c).alias(n) for n, c in amounts.items()])
    return totals.select(
        "log_id", CHUNK,
        *[F.coalesce(F.sum(n).over(earlier_chunks()), F.lit(0)).alias(n) for n in amounts],
    )


def rank_in_log(
    df: DataFrame, out: str, order: str = "line_num", skip: int = 0, take: int | None = None
) -> DataFrame:
    """Number the rows of each log from 1 along ``order``, without one task per log.

    With ``take``, only the rows after the first ``skip`` are kept, and rows are
    shuffled only from the chunks that hold some of them.
    """
    keys = ["log_id", CHUNK]
    chunks = df.groupBy(*keys).agg(F.count("*").alias("n_here"))
    chunks = chunks.withColumn("rank_base", F.coalesce(F.sum("n_here").over(earlier_chunks()), F.lit(0)))
    if take is not None:
        chunks = chunks.filter((F.col("rank_base") < skip + take) & (F.col("rank_base") + F.col("n_here") > skip))
    here = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    ranked = (
        df.join(chunks.drop("n_here"), keys)
        .withColumn(out, F.col("rank_base") + here)
        .drop("rank_base")
    )
    return ranked if take is None else ranked.filter(F.col(out).between(skip + 1, skip + take))
