"""Token-budget batches, packed streams, running caps and the replay buffer."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import EOS
from ..functions.hashing import _col
from .ordering import with_row_index, with_running


def token_batches(df: DataFrame, row_id: str, lengths: list, budget: int) -> DataFrame:
    """Sort by total length (+2 end marks per side), then `batch = Σ so far // budget`."""
    total = sum((_col(c) for c in lengths[1:]), _col(lengths[0])) + 2 * len(lengths)
    sized = df.withColumn("length", total)
    running = with_running(sized, ["length", row_id], sums={"__upto": F.col("length")})
    return running.withColumn("batch", F.floor(F.col("__upto") / budget)).drop("__upto")


def count_batches(df: DataFrame, order: list, batch_size: int) -> DataFrame:
    """`ceil(n / batch_size)` near-equal contiguous batches; the first `n mod k` hold one more."""
    n, i = F.col("__n"), F.col("__i")
    k = F.greatest(F.ceil(n / batch_size), F.lit(1))
    short, n_long = F.floor(n / k), n % k
    edge = n_long * (short + 1)
    batch = F.when(i < edge, F.floor(i / (short + 1))).otherwise(n_long + F.floor((i - edge) / F.greatest(short, F.lit(1))))
    return with_row_index(df, order, "__i", "__n").select(*df.columns, batch.alias("batch"))


def pack_stream(df: DataFrame, order: list, ids: str, bptt: int, lanes: int) -> DataFrame:
    """(block, lane, ids): all sentences joined by end marks into one stream, padded at the
    front with end marks, cut into `lanes` equal lanes of blocks of `bptt` ids.

    Every lane starts with one end mark in front of its stream part; the last id of a lane
    has no successor and is left out. A sentence moves as one slice per block it touches."""
    body = df.select(*[F.col(c) for c in df.columns if c != ids], F.concat(F.col(ids), F.array(F.lit(EOS))).alias("__ids"))
    placed = with_running(body, order, sums={"__end": F.size("__ids")}).select("__ids", "__end")
    total = placed.agg(F.max("__end")).first()[0] or 0
    n_blocks = math.ceil(total / (lanes * bptt))
    lane_size = n_blocks * bptt
    pad = lane_size * lanes - total
    # position of the first id in the padded buffer
    starts = placed.select("__ids", (F.col("__end") - F.size("__ids") + pad).alias("__start"))
    front = df.sparkSession.range(1 if pad else 0).select(
        F.array_repeat(F.lit(EOS), pad).alias("__ids"), F.lit(0).cast("long").alias("__start")
    )
    stream = starts.unionByName(front)
    last = F.col("__start") + F.size("__ids") - 1
    # a buffer position p sits at row p % lane_size + 1 of lane p // lane_size
    cell = lambda p: F.floor(p / lane_size) * n_blocks + F.floor((p % lane_size + 1) / bptt)
    lane_of = lambda p: F.floor(p / lane_size)
    cells = F.flatten(
        F.transform(
            F.sequence(lane_of(F.col("__start")), lane_of(last)),
            lambda lane: F.transform(
                F.sequence(
                    F.floor((F.greatest(F.col("__start"), lane * lane_size) - lane * lane_size + 1) / bptt),
                    F.floor((F.least(last, (lane + 1) * lane_size - 1) - lane * lane_size + 1) / bptt),
                ),
                lambda block: F.struct(lane.alias("lane"), block.alias("block")),
            ),
        )
    )
    pieces = stream.select("__ids", "__start", last.alias("__last"), F.explode(cells).alias("c"))
    lane0 = F.col("c.lane") * lane_size
    # block b of a lane holds buffer offsets b·bptt − 1 … (b + 1)·bptt − 2 of that lane
    low = F.greatest(F.col("__start"), lane0 + F.greatest(F.col("c.block") * bptt - 1, F.lit(0)))
    high = F.least(F.col("__last"), lane0 + F.least((F.col("c.block") + 1) * bptt - 2, F.lit(lane_size - 2)))
    cut = pieces.filter(high >= low).select(
        F.col("c.lane").alias("lane"), F.col("c.block").alias("block"), low.alias("at"),
        F.slice("__ids", (low - F.col("__start") + 1).cast("int"), (high - low + 1).cast("int")).alias("piece"),
    )
    joined = cut.groupBy("block", "lane").agg(F.array_sort(F.collect_list(F.struct("at", "piece"))).alias("parts"))
    row = F.flatten(F.transform("parts", lambda p: p["piece"]))
    first = F.when(F.col("block") == 0, F.array(F.lit(EOS))).otherwise(F.array().cast("array<int>"))
    return joined.select("block", "lane", F.concat(first, row).alias("ids"))


def cap_by_tokens(df: DataFrame, order: list, left: Column, right: Column, budget: int) -> DataFrame:
    """Rows until `running max length · rows so far > budget`, less one: the row before the
    first violation goes too. A violation at the first row leaves nothing."""
    sized = df.withColumn("__l", F.greatest(left, right))
    running = with_running(sized, order, maxima={"__max": F.col("__l")}, rank="__i")
    over = F.col("__max") * (F.col("__i") + 1) > budget
    first = running.filter(over).agg(F.min("__i")).first()[0]
    kept = running if first is None else running.filter(F.col("__i") < first - 1)
    return kept.select(*df.columns)


def replay_buffer(df: DataFrame, sequence: str, n: int) -> DataFrame:
    """The last row written to each of `n` slots, slot = sequence mod n. Only the sequence
    numbers are aggregated; the rows follow by a join."""
    slot = F.pmod(F.col(sequence), F.lit(n))
    newest = df.groupBy(slot.alias("slot")).agg(F.max(sequence).alias(sequence))
    return df.join(newest, sequence)
