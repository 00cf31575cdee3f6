"""Mixing sources to target weights by nested hash thresholds.

Method: words are summed by source and hash bucket; running sums name the bucket in which a
source's budget ends; only that bucket is split again by further hash bits. The final rows are
chosen by comparing a hash with a threshold: nothing is sorted but the small histograms."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import land
from .common import WORD, input_columns, lookup
from .ranks import running_sums

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
HASH_BITS = 60
#: Bits of the hash used by each level of histograms; together all bits.
LEVEL_BITS = (12, 24, 24)


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """source, source_size, target from rows (source, size).

    Weights repeat over the sources in code point order, null last. A target stops at `most`
    times its source's size and the excess goes to the others by weight: sources are capped in
    order of size per weight until the share of the next one fits."""
    sums = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = running_sums(sums, [F.col("source").asc_nulls_last()], {}, "rank")
    weight = reduce(lambda c, i: c.when(F.col("rank") % len(weights) == i, weights[i]), range(1, len(weights)), F.when(F.col("rank") % len(weights) == 0, weights[0]))
    ranked = ranked.withColumn("weight", weight.cast("long")).withColumn("ratio", F.col("source_size") / F.col("weight"))
    running = running_sums(ranked, ["ratio", "rank"], {"size_upto": "source_size", "weight_upto": "weight"})
    total, all_weight = running.agg(F.sum("source_size"), F.sum("weight")).first()
    budget = share * (total or 0)
    left = F.lit(budget) - most * (F.col("size_upto") - F.col("source_size"))
    weight_left = F.lit(all_weight or 0) - (F.col("weight_upto") - F.col("weight"))
    running = running.withColumn("capped", most * F.col("source_size") * weight_left <= left * F.col("weight"))
    capped_size, capped_weight = running.filter("capped").agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    rest = F.lit(float(budget - most * capped_size)) / F.lit(max(1, (all_weight or 0) - capped_weight))
    target = F.when(F.col("capped"), F.col("source_size") * float(most)).otherwise(F.col("weight") * rest)
    return running.select("source", "source_size", target.cast("double").alias("target"))


def _thresholds(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """source, threshold: rows of the source whose hash lies below it hold as close to `budget`
    words as whole documents allow."""
    # open: hash prefix of the boundary bucket so far, and the words below it
    opened = budgets.select("source", "budget", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("below"))
    used = 0
    for bits in LEVEL_BITS:
        inside = lookup(rows, opened, ["source"], "inner")
        if used:
            inside = inside.filter(F.shiftright("hash", HASH_BITS - used) == F.col("prefix"))
        used += bits
        histogram = inside.groupBy("source", F.shiftright("hash", HASH_BITS - used).alias("bucket")).agg(
            F.sum("size").alias("words"), F.max("budget").alias("budget"), F.max("below").alias("start")
        )
        order = Window.partitionBy("source").orderBy("bucket")
        running = histogram.withColumn("upto", F.col("start") + F.sum("words").over(order))
        boundary = (
            running.filter(F.col("upto") > F.col("budget"))
            .groupBy("source")
            .agg(F.min(F.struct("bucket", "budget", (F.col("upto") - F.col("words")).alias("below"), "upto")).alias("b"))
        )
        opened = land(boundary.select("source", "b.budget", F.col("b.bucket").alias("prefix"), "b.below", "b.upto"), "mix-level")
    take_last = F.col("below") + F.col("upto") < F.col("budget") * 2  # the nearer of the two cuts
    return opened.select("source", (F.col("prefix") + F.when(take_last, 1).otherwise(0)).alias("threshold"))


def mix_sources(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Return doc_id, size, source_size, target, taken, copies.

    `copies` says how often the mix holds the document, at most `most` times; `taken` is copies
    times size. The hash is taken from seed, id and text, so reruns and any partitioning agree.

    Null text: size 0. Null source: a source of its own, last in order. Repeated rows share a
    hash and so the decision. A document of size 0 follows its hash like any other. Without
    words all targets are 0. An empty table gives no rows. Other columns are ignored."""
    text = F.coalesce(F.col("text"), F.lit(""))
    key = F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(text.cast("binary")))
    rows = land(
        input_columns(docs, doc_id=id_col, text=text_col, source=source_col).select(
            "doc_id",
            "source",
            F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
            F.conv(F.substring(F.md5(key), 1, HASH_BITS // 4), 16, 10).cast("long").alias("hash"),
        ),
        "mix-rows",
    )
    targets = land(source_targets(rows, weights, share, most), "mix-targets")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    targets = targets.withColumn("whole", F.least(whole, F.lit(most)).cast("long"))
    budgets = targets.select("source", (F.col("target") - F.col("whole") * F.col("source_size")).alias("budget")).filter("budget > 0")
    plan = land(lookup(targets, _thresholds(rows, budgets), ["source"]), "mix-plan")
    extra = F.when(F.col("hash") < F.col("threshold"), 1).otherwise(0)
    copies = (F.col("whole") + extra).cast("long")
    return lookup(rows, plan, ["source"], "inner").select(
        "doc_id", "size", "source_size", "target", (F.col("size") * copies).alias("taken"), copies.cast("int").alias("copies")
    )
