"""Session set-up, shared-folder tables and size-checked broadcasts."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A side is joined by broadcast only up to this measured size, as several may be held at a
# time; larger ones are joined by shuffle.
BROADCAST_BYTES = 128 * 2**20
SCALAR_BYTES = 16
ROW_GROUP_BYTES = 16 * 2**20
# From so many logs on, a write of files for each takes time by files.
FEW_LOGS = 32
# Tasks for each core that list folders.
LISTING_TASKS = 4

_local_roots: dict[str, tempfile.TemporaryDirectory] = {}


def local_session(cpus: int | str = 8, app: str = "framesift") -> SparkSession:
    """A single-machine session for tests and benchmarks."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.driver.memory", os.environ.get("FRAMESIFT_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        # Generated classes of a whole parse stay cached, so later parses start warm.
        .config("spark.sql.codegen.cache.maxEntries", "2000")
        # Several splits per core also for logs of some megabytes.
        .config("spark.sql.files.maxPartitionBytes", "4m")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )


def shared_root(spark: SparkSession) -> str:
    """Folder for intermediate tables: the one named by ``spark.checkpoint.dir``.

    A temporary folder is used only where that is unset and the session runs on
    one machine.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _local_roots:
        _local_roots[app] = tempfile.TemporaryDirectory(prefix="framesift-", ignore_cleanup_errors=True)
    return _local_roots[app].name


def store(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage, so that a lost executor re-reads files, and lets several
    branches use one evaluation with column pruning on each.
    """
    spark = df.sparkSession
    app = spark.sparkContext.applicationId
    path = f"{shared_root(spark)}/framesift-{app}/{name}-{uuid.uuid4().hex}"
    # Delta encoding halves these tables, whose columns are mostly rising numbers; tables of texts
    # are a third smaller by zstd. A writer holds a row group in memory, which whole texts fill.
    options = {
        "parquet.writer.version": "PARQUET_2_0", "parquet.enable.dictionary": "false", "parquet.block.size": str(ROW_GROUP_BYTES), "compression": codec,
    }
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def file_tasks(spark: SparkSession) -> int:
    """Number of tasks for a write of a file or more for each log.

    Such a write takes time by files, not by bytes. Adaptive execution merges partitions of few
    bytes, down to one task that writes the files of all logs, unless their number is given.
    """
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def ranged_for_files(df: DataFrame, log: str, *order: str | Column) -> DataFrame:
    """Sorted range partitions for a write of files for each log; a large log is written by many tasks.

    For few logs time goes by bytes again, and small ones stay whole files.
    """
    few = df.select(log).distinct().limit(FEW_LOGS).count() < FEW_LOGS
    n = [] if few else [file_tasks(df.sparkSession)]
    return df.repartitionByRange(*n, log, *order).sortWithinPartitions(log, *order)


def list_many_folders(spark: SparkSession) -> None:
    """Let a listing of very many folders take some tasks for each core; by default each folder is a task."""
    name = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, str(LISTING_TASKS * spark.sparkContext.defaultParallelism))


def small_side(df: DataFrame, name: str) -> DataFrame:
    """Store ``df`` and hint a broadcast only if its measured size allows it.

    Without the hint Spark chooses the join itself, and none of the callers needs a
    broadcast for its result.
    """
    kept = store(df, name)
    texts = [F.sum(F.octet_length(c)) for c, kind in kept.dtypes if kind == "string"]
    rows, *characters = kept.agg(F.count("*"), *texts).first()
    size = rows * len(kept.columns) * SCALAR_BYTES + sum(n or 0 for n in characters)
    return F.broadcast(kept) if size <= BROADCAST_BYTES else kept
