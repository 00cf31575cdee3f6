"""Partitioned tables: token shards, datastores, regrouping, skip lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SHARD_COLUMNS = ["lang", "split", "suffix", "shard"]
#: Tasks that share the rows of one folder, and so its files per write.
FOLDER_TASKS = 4


def _by_folder(df: DataFrame, folder: list[str], tasks: int) -> DataFrame:
    """Rows of a folder meet in a few tasks, dealt by a hash of the whole row: a large folder has
    several writers, and no folder a file from every task."""
    simple = [F.col(c).cast("string") for c in df.columns]
    return df.repartition(*folder, F.pmod(F.xxhash64(*simple), F.lit(tasks)))


def write_splits(df: DataFrame, path: str, mode: str = "errorifexists", tasks: int = FOLDER_TASKS) -> None:
    """One folder per (lang, split, suffix, shard), written by at most `tasks` tasks each."""
    _by_folder(df, SHARD_COLUMNS, tasks).write.mode(mode).partitionBy(*SHARD_COLUMNS).parquet(path)


def write_datastore(df: DataFrame, path: str, mode: str = "append", tasks: int = 64) -> None:
    """Append-only; readers of one language pair open only its folder. Pairs are few and large, so
    many tasks share one."""
    _by_folder(df, ["language_pair"], tasks).write.mode(mode).partitionBy("language_pair").parquet(path)


def read_datastore(spark: SparkSession, path: str, language_pair: str | None = None) -> DataFrame:
    store = spark.read.parquet(path)
    return store if language_pair is None else store.filter(F.col("language_pair") == language_pair)


def regroup(parts: list[DataFrame]) -> DataFrame:
    """All shards as one set; columns are matched by name."""
    return reduce(DataFrame.unionByName, parts)


def not_done(inputs: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Inputs without an output yet."""
    return inputs.join(done.select(key), key, "left_anti")
