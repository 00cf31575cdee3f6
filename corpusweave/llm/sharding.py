"""Sharding [native]: contiguous shards of near-equal bytes, in the order of document ids.

Method: global byte-size prefix sums from per-partition totals, cut at equal targets. Only
(id, size, checksum) take part in the sort; texts stay where they are. Built from DataFrame
functions alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import input_columns
from .ranks import running_sums

LAW = "bytes"
ROW_BYTES = 8


def shard_by_bytes(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Return doc_id, size, text_crc32, law, shard, slot, grown_shard (always null under this law).

    Size is the UTF-8 bytes of the text plus 8. A row goes to the shard in whose equal share of
    all bytes its middle byte lies, so every shard is within one document of its target.

    Null text: size 8, checksum 0. Null ids come first, in order of checksum. Rows that agree in
    all three columns are interchangeable and each gets its own slot. An empty table gives none.
    A text longer than a share leaves the shards under it empty. Other columns are ignored."""
    rows = input_columns(docs, doc_id=id_col, text=text_col).select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    running = running_sums(rows, ["doc_id", "text_crc32", "size"], {"upto": "size"}, "row_index")
    total = running.agg(F.max("upto")).first()[0] or 1
    middle = F.col("upto") * 2 - F.col("size")
    placed = running.withColumn("shard", F.expr(f"cast((upto * 2 - size) * {shards} div {2 * total} as int)"))
    placed = placed.withColumn("shard", F.when(middle >= 2 * total, shards - 1).otherwise(F.col("shard")))
    first = placed.groupBy("shard").agg(F.min("row_index").alias("first_index"))  # one row per shard
    return placed.join(F.broadcast(first), "shard").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit(LAW).alias("law"),
        "shard",
        (F.col("row_index") - F.col("first_index")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
