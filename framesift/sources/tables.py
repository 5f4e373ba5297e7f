"""Log lines kept in tables, and parsed tables kept for later sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framesift.operators.scan import CHUNK, before
from framesift.session import store
from framesift.sources.loglines import LogLines, content_facts, keyed


def number_lines(records: DataFrame, *order: str) -> LogLines:
    """``log_lines`` from records ``(log_id, content, <order columns>)``.

    The records are range-partitioned on log and order, so a log that holds a large
    part of all rows is spread over many partitions; each becomes one chunk of it.
    The partitioning is written once, as sampled range bounds may differ between runs.
    """
    placed = store(
        records.repartitionByRange("log_id", *order)
        .sortWithinPartitions("log_id", *order)
        .select("log_id", "content", F.monotonically_increasing_id().alias("seq"))
        # The upper bits of the running id are the partition number.
        .withColumn("place", F.shiftright("seq", 33)),
        "lines",
    )
    chunks = placed.groupBy("log_id", "place").agg(
        F.min("seq").alias("first_seq"), F.count("*").alias("n_lines"), *content_facts(F.col("content"))
    )
    ahead = F.coalesce(F.sum("n_lines").over(before(Window.partitionBy("log_id").orderBy("place"))), F.lit(0))
    chunks = keyed(
        chunks.select(
            "log_id", "place", (ahead - F.col("first_seq") + 1).alias("shift"),
            (ahead + F.col("n_lines")).alias("chunk_end"), "fenced", "has_text",
        ),
        "chunks",
    )
    lines = placed.join(chunks.select("log_id", "place", CHUNK, "shift"), ["log_id", "place"]).select(
        "log_id", CHUNK, (F.col("seq") + F.col("shift")).alias("line_num"), "content"
    )
    return LogLines(lines, chunks.drop("shift", "place"))


def save_table(df: DataFrame, path: str, *order: str, buckets: int = 64) -> None:
    """Write a parsed table as Parquet, in folders by a hash of the log.

    Rows are range-partitioned first: a task writes few folders, and a large log is
    written by many tasks.
    """
    (
        df.withColumn("log_bucket", F.pmod(F.xxhash64("log_id"), F.lit(buckets)).cast("int"))
        .repartitionByRange("log_bucket", "log_id", *order)
        .sortWithinPartitions("log_bucket", "log_id", *order)
        .write.mode("errorifexists")
        .partitionBy("log_bucket")
        .parquet(path)
    )


def open_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("log_bucket")


def of_log(df: DataFrame, log_id, buckets: int = 64) -> DataFrame:
    """Rows of one log of a saved table; the folder filter prunes all other buckets."""
    spark = df.sparkSession
    bucket = spark.range(1).select(
        F.pmod(F.xxhash64(F.lit(log_id).cast(df.schema["log_id"].dataType)), F.lit(buckets))
    ).first()[0]
    return df.filter((F.col("log_bucket") == bucket) & (F.col("log_id") == log_id)).drop("log_bucket")
