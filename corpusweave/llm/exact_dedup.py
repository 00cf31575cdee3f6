"""Exact deduplication by deterministic block naming.

Method: a normalised text is cut into blocks of fixed size. Blocks are sorted and equal ones get
one integer name; adjacent pairs of names are then named in the same way, level by level, until
each document has one name. Names stand for exact content at every level, so no hash decides.

Tasks first name their own blocks and documents by comparing bytes. A block or text with any
share of all rows then costs one row per task in the shuffles that follow."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import land, materialize
from .common import input_columns, output_field, text_slices, tidy

BLOCK_BYTES = 4096
#: Bytes of blocks that a task remembers; beyond it forgets them, which only costs repeats.
MEMORY_BYTES = 48 << 20
_LOCAL_BITS = 33
_NO_NAME = -1


@tidy
def _name_locally(batches: Iterator[pa.RecordBatch], schema: pa.Schema, block_bytes: int) -> Iterator[pa.RecordBatch]:
    """One row per document (row, doc_id, text_sha256, doc; blocks on the first of equal ones)
    and one per new block (name, block). Names are numbers unique over all tasks."""
    base = TaskContext.get().partitionId() << _LOCAL_BITS
    blocks: dict[bytes, int] = {}
    docs: dict[tuple, int] = {}
    row = fresh = held = 0
    for batch in text_slices(batches):
        out = {name: [] for name in schema.names}

        def put(**values):
            for name in schema.names:
                out[name].append(values.get(name))

        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            data = (text or "").encode().lower()  # bytes.lower changes A-Z only
            names = []
            for start in range(0, max(1, len(data)), block_bytes):
                block = data[start : start + block_bytes]
                name = blocks.get(block)
                if name is None:
                    name = blocks[block] = base + fresh
                    fresh += 1
                    held += len(block)
                    put(name=name, block=block)
                names.append(name)
            key = tuple(names)
            first = docs.setdefault(key, base + row)
            put(row=base + row, doc_id=doc_id, text_sha256=hashlib.sha256(data).hexdigest(), doc=first, blocks=names if first == base + row else None)
            row += 1
        yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in schema], schema=schema)
        if held > MEMORY_BYTES:
            blocks.clear()
            docs.clear()
            held = 0


def _name_blocks(blocks: DataFrame) -> DataFrame:
    """name, final for blocks named by several tasks: all take the smallest of their names.
    A group holds at most a few rows per task, however many documents share the block."""
    same = Window.partitionBy("block")
    return blocks.withColumn("final", F.min("name").over(same)).filter("final <> name").select("name", "final")


def _identities(docs: DataFrame, block_names: DataFrame) -> DataFrame:
    """doc, level, name: documents are equal when level and name agree."""
    parts = docs.select("doc", F.size("blocks").alias("parts"), F.posexplode("blocks").alias("pos", "name"))
    named = parts.join(block_names, "name", "left").select("doc", "parts", F.col("pos").cast("long").alias("pos"), F.coalesce("final", "name").alias("name"))
    named = materialize(named)
    done = named.filter("parts = 1").select("doc", F.lit(0).alias("level"), "name")
    level = 0
    rest = named.filter("parts > 1")
    while not rest.isEmpty():
        level += 1
        even = F.col("pos") % 2 == 0
        pairs = (
            rest.groupBy("doc", F.floor(F.col("parts") / 2 + F.lit(0.5)).cast("int").alias("parts"), F.shiftright("pos", 1).alias("pos"))
            .agg(F.max(F.when(even, F.col("name"))).alias("left"), F.coalesce(F.max(F.when(~even, F.col("name"))), F.lit(_NO_NAME)).alias("right"))
            .withColumn("number", F.monotonically_increasing_id())
        )
        pairs = materialize(pairs)
        names = pairs.groupBy("left", "right").agg(F.min("number").alias("name"))
        named = materialize(pairs.join(names, ["left", "right"]).select("doc", "parts", "pos", "name"))
        done = done.unionByName(named.filter("parts = 1").select("doc", F.lit(level).alias("level"), "name"))
        rest = named.filter("parts > 1")
    return done


def exact_duplicates(docs: DataFrame, block_bytes: int = BLOCK_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Return doc_id, keep_id, group_size, kept, text_sha256 and row, one row per input row.

    Texts are equal when they agree after lower-casing A-Z. Of equal texts the row with the
    largest id stays; of repeated ids within a group, one row. `text_sha256` is information
    about the normalised text and takes no part in the grouping.

    Null counts as the empty text. A null id is smaller than any other. An empty table gives no
    rows. Other columns are ignored."""
    rows = input_columns(docs, doc_id=id_col, text=text_col)
    id_type = output_field(rows, "doc_id")
    ddl = f"row bigint, doc_id {id_type}, text_sha256 string, doc bigint, blocks array<bigint>, name bigint, block binary"
    id_arrow = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[id_type]
    schema = pa.schema([("row", pa.int64()), ("doc_id", id_arrow), ("text_sha256", pa.string()), ("doc", pa.int64()), ("blocks", pa.list_(pa.int64())), ("name", pa.int64()), ("block", pa.binary())])
    landed = land(rows.mapInArrow(lambda it: _name_locally(it, schema, block_bytes), ddl), "dedup-blocks")
    named_docs = landed.filter("row is not null").select("row", "doc_id", "text_sha256", "doc", "blocks")
    block_names = _name_blocks(landed.filter("name is not null").select("name", "block"))
    identity = _identities(named_docs.filter("blocks is not null"), block_names)
    local = named_docs.groupBy("doc").agg(F.count(F.lit(1)).alias("copies"), F.max(F.struct("doc_id", "row")).alias("best"))
    local = materialize(local.join(identity, "doc"))
    groups = local.groupBy("level", "name").agg(F.sum("copies").alias("group_size"), F.max("best").alias("best"))
    info = local.select("doc", "level", "name").join(groups, ["level", "name"]).select("doc", "group_size", "best")
    return named_docs.select("row", "doc_id", "text_sha256", "doc").join(info, "doc").select(
        "doc_id",
        F.col("best.doc_id").alias("keep_id"),
        "group_size",
        (F.col("best.row") == F.col("row")).alias("kept"),
        "text_sha256",
        "row",
    )
