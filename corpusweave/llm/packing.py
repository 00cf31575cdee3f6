"""Best-fit packing of token sequences into bins of a fixed number of tokens.

Method: minimum bin slack. For each bin the longest piece left is taken, and a bitset
subset-sum over the lengths still available finds the fullest feasible company for it. Pieces of
one length are alike, so the search runs on the table of lengths (at most as many as a bin has
tokens), and a combination is repeated for as long as the lengths last. Pieces are then dealt to
their places by their rank among the pieces of their length."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import land
from .common import input_columns, lookup, output_field, text_slices, texts_of, tidy
from .encoding import CACHE_BYTES, encoder, tokenizer_path

CAPACITY = 4096
END_ID = 1


def _companions(counts: dict[int, int], lengths: list[int], room: int) -> dict[int, int]:
    """Lengths and how often, with the largest total of at most `room`. Bit s of `reach` says
    that the lengths seen so far can fill s tokens; long ones come first."""
    reach, whole, seen = 1, (1 << (room + 1)) - 1, []
    for length in lengths:
        left = min(counts[length], room // length) if length <= room else 0
        size = 1
        while left > 0:
            take = min(size, left)
            seen.append((length, take, reach))
            reach |= (reach << (length * take)) & whole
            left, size = left - take, size * 2
            if reach >> room:
                break
        if reach >> room:
            break
    found: dict[int, int] = {}
    total = reach.bit_length() - 1
    for length, take, before in reversed(seen):
        if not before >> total & 1:
            found[length] = found.get(length, 0) + take
            total -= length * take
    return found


def plan_bins(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, dict[int, int]]]:
    """(bins, lengths and how often in each) until no piece is left. Every step exhausts a length
    or its multiple, so the plan's size depends on the capacity and not on the number of pieces."""
    left = {length: n for length, n in counts.items() if n > 0}
    lengths = sorted(left, reverse=True)
    plan = []
    while lengths:
        first = lengths[0]
        left[first] -= 1
        combination = _companions(left, lengths, capacity - first)
        left[first] += 1
        combination[first] = combination.get(first, 0) + 1
        bins = min(left[length] // n for length, n in combination.items())
        for length, n in combination.items():
            left[length] -= n * bins
        lengths = [x for x in lengths if left[x]]
        plan.append((bins, combination))
    return plan


class _Places:
    """Where the piece with a rank among those of its length goes."""

    def __init__(self, plan: list[tuple[int, dict[int, int]]]):
        used: dict[int, int] = {}
        rows, bin_base = [], 0
        for bins, combination in plan:
            offset = 0
            for length, n in sorted(combination.items(), reverse=True):
                start = used.get(length, 0)
                rows.append((length, start, bin_base, n, offset))
                used[length] = start + n * bins
                offset += n * length
            bin_base += bins
        rows.sort()
        self.length, self.start, self.base, self.times, self.offset = (np.array(c, np.int64) for c in zip(*rows, strict=True)) if rows else [np.zeros(0, np.int64)] * 5
        self.first = {int(x): i for i, x in reversed(list(enumerate(self.length)))}

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.empty(len(length), np.int64)
        for one in np.unique(length):
            lo, mask = self.first[int(one)], length == one
            hi = lo + int(np.searchsorted(self.length[lo:], one, "right"))
            at[mask] = lo + np.searchsorted(self.start[lo:hi], rank[mask], "right") - 1
        copy, slot = np.divmod(rank - self.start[at], self.times[at])
        return self.base[at] + copy, self.offset[at] + slot * length


@tidy
def _pieces(batches: Iterator[pa.RecordBatch], path: str, end_id: int, capacity: int, cache_bytes: int) -> Iterator[pa.RecordBatch]:
    """Pieces of each document, numbered within the task by their length."""
    own = encoder(path, cache_bytes)
    dtype = own.dtype if end_id < 1 << (8 * own.dtype.itemsize) else np.dtype("<u4")
    block = TaskContext.get().partitionId()
    seen = [0] * (capacity + 1)
    for batch in text_slices(batches):
        doc, piece, start, length, crc, within = [], [], [], [], [], []
        for i, data in enumerate(own.encode(texts_of(batch))):
            ids = np.append(own.ids(data).astype("<u4"), np.uint32(end_id))
            for k, at in enumerate(range(0, len(ids), capacity)):
                part = ids[at : at + capacity]
                n = len(part)
                doc.append(i)
                piece.append(k)
                start.append(at)
                length.append(n)
                crc.append(zlib.crc32(part))
                within.append(seen[n])
                seen[n] += 1
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id").take(pa.array(doc, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(np.full(len(doc), block, np.int64)), pa.array(within, pa.int64())],
            ["doc_id", "piece", "start", "length", "ids_crc32", "block", "within"],
        )


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", cache_bytes: int = CACHE_BYTES) -> DataFrame:
    """Return doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row per piece.

    A document's ids and one end id are cut into pieces of `capacity` tokens if they are more;
    the last piece may be shorter. Texts and ids do not move: the shuffles hold one narrow row
    per piece, and the driver sees one count per length. A worker remembers `cache_bytes` of pieces
    of text with their ids.

    Null and empty texts are one end id. Repeated rows and null ids are packed like any other.
    An empty table gives none. Other columns are ignored."""
    path = tokenizer or tokenizer_path("word_bpe_49k.json")
    rows = input_columns(docs, doc_id=id_col, text=text_col)
    ddl = f"doc_id {output_field(rows, 'doc_id')}, piece int, start bigint, length bigint, ids_crc32 bigint"
    pieces = land(rows.mapInArrow(lambda it: _pieces(it, path, end_id, capacity, cache_bytes), ddl + ", block bigint, within bigint"), "pack-pieces")
    counts = land(pieces.groupBy("length", "block").agg(F.count(F.lit(1)).alias("n")), "pack-counts")
    totals = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # one row per length
    places = _Places(plan_bins(totals, capacity))
    earlier = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = land(counts.select("length", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before")), "pack-before")
    ranked = lookup(pieces, before, ["length", "block"], "inner")
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("within")).alias("rank"))

    def place(batches):
        for batch in batches:
            sequence, offset = places.find(batch.column("length").to_numpy(), batch.column("rank").to_numpy())
            columns = [batch.column(i) for i in range(5)] + [pa.array(sequence), pa.array(offset)]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:5], "sequence_id", "offset"])

    return ranked.mapInArrow(place, ddl + ", sequence_id bigint, offset bigint")
