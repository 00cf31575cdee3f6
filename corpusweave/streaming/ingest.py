"""Incremental ingestion of new input files with Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.hashing import content_id


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def _state_on_disk(spark: SparkSession) -> Iterator[None]:
    """A query that starts inside keeps its state in RocksDB, off the executors' heap."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)


def ingest_new(
    spark: SparkSession, source: str, target: str, checkpoint: str, schema: str, source_format: str = "json",
    transform=None, max_files: int = 10_000,
) -> None:
    """Process input files that were not processed before and append them to `target`.

    The checkpoint remembers finished files, so a second run skips them; a failed batch is
    repeated as a whole and its output committed once."""
    rows = spark.readStream.schema(schema).format(source_format).option("maxFilesPerTrigger", max_files).load(source)
    if transform is not None:
        rows = transform(rows)
    query = (
        rows.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()


def _first_ever(row_id: str):
    """Per key: nothing once it was seen, else its row with the lowest id, the first one of equals.
    Rows of a key come in pieces of bounded size, of which only the best row is held."""

    def choose(key: tuple, pieces: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        best = None
        for piece in pieces:
            if not state.exists:
                own = piece.sort_values(row_id, kind="stable", na_position="first").head(1)
                best = own if best is None else pd.concat([best, own]).sort_values(row_id, kind="stable", na_position="first").head(1)
        if best is not None:
            state.update((True,))
            yield best

    return choose


def ingest_distinct(
    spark: SparkSession, source: str, target: str, checkpoint: str, schema: str, text: str, row_id: str,
    scope: list[str] | None = None, source_format: str = "json", max_files: int = 10_000,
) -> None:
    """As `ingest_new`, keeping only texts that are new in their scope, with their `content_hash`.

    The hashes seen so far are keyed state of the query, so a micro-batch reads its own rows and
    looks up its own keys, however many were written before. Within a micro-batch the row with the
    lowest `row_id` stays, one row also where a row was delivered twice. State and output are
    committed once per micro-batch: a retry changes nothing. Null texts count as one text."""
    keys = [*(scope or []), "content_hash"]
    rows = spark.readStream.schema(schema).format(source_format).option("maxFilesPerTrigger", max_files).load(source)
    hashed = rows.withColumn("content_hash", content_id(text))
    fresh = hashed.groupBy(*keys).applyInPandasWithState(_first_ever(row_id), hashed.schema, "seen boolean", "append", GroupStateTimeout.NoTimeout)
    writer = fresh.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    with _state_on_disk(spark):
        query = writer.start()
    query.awaitTermination()
