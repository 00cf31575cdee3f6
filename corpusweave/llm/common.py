"""Helpers of this subpackage: shared tables, size-checked lookups, Arrow slices, shared files."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from contextlib import suppress
from functools import reduce, wraps

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A word: everything but blanks and the controls from tab to carriage return (fixed value).
WORD = r"[^\x20\x09-\x0D]+"
#: A lookup table above this many measured bytes is shuffled, never broadcast.
LOOKUP_BYTES = 24 << 20
#: Bytes of text that a task holds as Python or numpy objects at a time.
SLICE_BYTES = 1 << 20


def input_columns(docs: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns under fixed names, so that no extra column can clash."""
    return docs.select(*[docs[source].alias(name) for name, source in columns.items()])


def measured_bytes(table: DataFrame) -> int:
    """Bytes of all values, from one aggregate over the table."""
    sizes = [
        F.coalesce(F.octet_length(table[name]), F.lit(0)) + 16 if kind in ("string", "binary") else F.lit(16)
        for name, kind in table.dtypes
    ]
    return table.agg(F.sum(reduce(lambda a, b: a + b, sizes))).first()[0] or 0


def sized(table: DataFrame) -> DataFrame:
    """Hint a broadcast for a materialised table whose measured size allows it; above that the
    join shuffles, with the same rows. The table must be cheap to read twice."""
    return F.broadcast(table) if measured_bytes(table) <= LOOKUP_BYTES else table


def lookup(df: DataFrame, table: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Join on null-safe keys with a materialised table; key columns come from `df` only."""
    renamed = table.select(*[F.col(c).alias(f"__k_{c}") if c in keys else F.col(c) for c in table.columns])
    condition = reduce(lambda a, b: a & b, [df[k].eqNullSafe(renamed[f"__k_{k}"]) for k in keys])
    joined = df.join(sized(renamed), condition, how)
    return joined if how in ("left_anti", "left_semi") else joined.drop(*[f"__k_{k}" for k in keys])


def _give_back() -> None:
    """Freed memory of this process goes back to the machine: a worker is used again by later
    stages, and what its allocators keep would add up beside the executor's own memory."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # only the GNU library has this call
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def tidy(work):
    """An Arrow function (batches, ...) that gives memory back before and after its task."""

    @wraps(work)
    def run(*args, **named):
        _give_back()
        try:
            yield from work(*args, **named)
        finally:
            _give_back()

    return run


def text_slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about `limit` bytes in `column`; one longer text is a run of its own."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        start = held = 0
        for i, size in enumerate(sizes):
            if held and held + size > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size + 1
        if start < len(sizes):
            yield batch.slice(start)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The column as strings; null counts as empty."""
    return [t or "" for t in batch.column(column).to_pylist()]


def output_field(df: DataFrame, column: str) -> str:
    """Type of a column as DDL, for the schema of an Arrow function."""
    return df.schema[column].dataType.simpleString()


def shared_file(path: str) -> tuple[fs.FileSystem, str]:
    """File system and inner path for a folder that driver and executors share."""
    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path)
