"""Session settings, checkpointing and size-checked broadcasts shared by every operator."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Above this many bytes a side is never sent whole to every executor.
BROADCAST_BYTES = 64 * 1024 * 1024


def build_session(app: str = "corpusweave", cores: int | str = "*", **conf: str) -> SparkSession:
    """Local session for tests and benchmarks; a cluster supplies its own session."""
    # workers import this package from where the driver did, whatever folder it was started in
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.executorEnv.PYTHONPATH", os.pathsep.join(filter(None, [root, os.environ.get("PYTHONPATH")])))
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """Shared checkpoint folder. The cluster's own setting wins; a local master without
    one gets a fresh temporary folder; a cluster without one is an error."""
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not root:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        root = tempfile.mkdtemp(prefix="corpusweave-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(root)
    return root


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint, so that a lost executor or a re-run of a
    sampled range partitioning can not change rows that were already numbered."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the checkpoint folder for intermediate tables."""
    return os.path.join(checkpoint_root(spark), f"{name}-{uuid.uuid4().hex}")


def land(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Write an intermediate table to the shared folder and read it back: later passes read
    columns of a file instead of repeating the work. The session sets the compression otherwise."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.parquet(path)


def shuffle_width(df: DataFrame) -> int:
    """Number of range partitions used for global orderings."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def spread(df: DataFrame) -> DataFrame:
    """Give every core a share of a small input that comes in one or two files. An input
    with at least one partition per core, as any large one has, is left as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def fits_broadcast(rows: int, bytes_per_row: int) -> bool:
    return rows * bytes_per_row <= BROADCAST_BYTES


def hint_if_small(df: DataFrame, bytes_per_row: int = 64) -> DataFrame:
    """Broadcast `df` only if a count shows that it fits; otherwise leave the join to AQE."""
    limit = BROADCAST_BYTES // bytes_per_row
    small = df.limit(limit + 1).count() <= limit
    return F.broadcast(df) if small else df


def keep(df: DataFrame) -> DataFrame:
    """Cache with spill to disk for a result that two branches of one plan read."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)
