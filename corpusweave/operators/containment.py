"""Containment join: which texts hold which snippets, in one pass over the texts.

The distinct snippets are cut into groups of measured bytes. One automaton per group finds all its
snippets in a text at once, in time that depends on the text and its matches alone; texts do not
move and no word of them is posted. A task holds one automaton at a time."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from ..session import keep, materialize

#: UTF-8 bytes of snippets in one automaton, which takes some sixty times as much memory.
GROUP_BYTES = 2 << 20

_built: dict[str, ahocorasick.Automaton] = {}


def _automaton(shared: Broadcast) -> ahocorasick.Automaton:
    """The automaton of a group, built once per Python worker; only the latest one is held."""
    key, snippets = shared.value
    if key not in _built:
        _built.clear()
        automaton = ahocorasick.Automaton()
        for number, snippet in enumerate(snippets):
            automaton.add_word(snippet, number)
        automaton.make_automaton()
        _built[key] = automaton
    return _built[key]


def _groups(distinct: DataFrame, group_bytes: int) -> Iterator[list]:
    """Rows of one group after the other; equal hashes of snippets choose the group."""
    total = distinct.agg(F.sum(F.octet_length("snippet"))).first()[0] or 0
    groups = -(-total // group_bytes)
    number = F.pmod(F.xxhash64("snippet"), F.lit(max(1, groups)))
    for group in range(groups):
        if found := distinct.filter(number == group).collect():  # about group_bytes
            yield found


def _matches(df: DataFrame, text: str, found: list, schema: StructType) -> DataFrame:
    """`df`'s rows, once per snippet of the group that the text holds, with the snippet's key."""
    keys = pa.array([r["key"] for r in found], to_arrow_schema(schema).field(-1).type)
    snippets = df.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, [r["snippet"] for r in found]))
    arrow = to_arrow_schema(schema)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(snippets)
        for batch in batches:
            rows, numbers = [], []
            for row, value in enumerate(batch.column(text)):
                hits = sorted({number for _, number in automaton.iter(value.as_py())}) if value.is_valid else ()
                rows += [row] * len(hits)
                numbers += hits
            if rows:
                taken = batch.take(pa.array(rows))
                columns = [*taken.columns, keys.take(pa.array(numbers))]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return df.mapInArrow(scan, schema)


def contains_join(
    df: DataFrame, row_id: str, text: str, snippets: DataFrame, snippet_id: str, snippet: str, group_bytes: int = GROUP_BYTES
) -> DataFrame:
    """All (row, snippet) pairs where the row's text contains the snippet: row_id, snippet_id and
    `df`'s other columns, as the nested loop would give them.

    Null texts and snippets match nothing; the empty snippet is in every other text. Snippets of
    equal text are looked for once and told apart afterwards. `df` is read once per group."""
    if snippet_id in df.columns:
        raise ValueError(f"both sides have a column {snippet_id}")
    named = snippets.filter(F.col(snippet).isNotNull()).select(F.col(snippet_id).alias("id"), F.col(snippet).alias("snippet"))
    named = materialize(named)  # small rows that the steps below read several times
    distinct = keep(named.groupBy("snippet").agg(F.min("id").alias("key"), F.count(F.lit(1)).alias("same")))
    schema = StructType([*df.schema.fields, StructField("__key", named.schema["id"].dataType)])
    if distinct.filter("snippet <> '' and key is null").limit(1).count():
        raise ValueError(f"{snippet_id} must not be null")
    parts = [_matches(df, text, rows, schema) for rows in _groups(distinct.filter("snippet <> ''"), group_bytes)]
    empty = distinct.filter("snippet = ''").first()
    if empty:
        parts.append(df.filter(F.col(text).isNotNull()).withColumn("__key", F.lit(empty["key"])))
    if not parts:
        parts.append(df.limit(0).withColumn("__key", F.lit(None).cast(named.schema["id"].dataType)))
    pairs = parts[0]
    for part in parts[1:]:
        pairs = pairs.unionByName(part)
    if distinct.filter("same > 1").limit(1).count():
        twins = named.join(distinct.select("snippet", "key"), "snippet").select(F.col("key").alias("__key"), F.col("id").alias(snippet_id))
        pairs = pairs.join(materialize(twins), "__key").drop("__key")
    else:
        pairs = pairs.withColumnRenamed("__key", snippet_id)
    distinct.unpersist()
    return pairs.select(row_id, snippet_id, *[c for c in df.columns if c != row_id])


def select_specific(df: DataFrame, row_id: str, text: str, ids: DataFrame, id_key: str, id_text: str) -> DataFrame:
    """For each wanted id the first row whose text contains it. Only row and snippet ids leave the
    scan, with one row per task and wanted id; the rows chosen are fetched at the end."""
    hits = contains_join(df.select(row_id, text), row_id, text, ids, id_key, id_text).select(row_id, id_key)
    first = hits.groupBy(id_key).agg(F.min(row_id).alias(row_id))
    return first.join(df, row_id)
