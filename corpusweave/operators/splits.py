"""Splits, shards, shuffles, heads, budgets and samples. All are repeatable."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.binding import let
from ..functions.hashing import _col, adler32, shuffle_rank, uniform
from ..session import keep
from .ordering import with_group_rank, with_row_index, with_running

SAMPLE_BUCKETS = 65536
SMALL_HEAD = 1000
LITERAL_KEYS = 10_000  # of a weight table that is written into the expression
_UNITS = 1 << 52


def split_label(repo, percent_test: int = 1, percent_valid: int = 1) -> Column:
    """`repo` is the field before the bar, blanks included; the owner part is ignored."""
    field = _col(repo)
    name = F.substring(field, F.instr(field, "/") + 1, F.length(field))
    return let(
        adler32(name) % 100,
        lambda bucket: F.when(bucket < percent_test, "test")
        .when(bucket >= percent_test + percent_valid, "train")
        .otherwise("valid"),
    )


def split_by_hash(df: DataFrame, repo, percent_test: int = 1, percent_valid: int = 1) -> DataFrame:
    """All rows of a repository fall into the same split. No shuffle."""
    return df.withColumn("split", split_label(repo, percent_test, percent_valid))


def shard(df: DataFrame, n: int, order_key: str) -> DataFrame:
    return df.withColumn("shard", F.pmod(F.col(order_key), F.lit(n)))


def shuffle(df: DataFrame, seed: int, row_id: str) -> DataFrame:
    """Seeded global shuffle. Parallel views in one row share the permutation."""
    return df.orderBy(shuffle_rank(seed, row_id), row_id)


def split_ordered(df: DataFrame, order: list, fraction: float = 0.6) -> DataFrame:
    """First `int(fraction·n)` rows are `train`, the rest `test`."""
    cut = F.floor(F.lit(fraction) * F.col("__n"))
    return with_row_index(df, order, "__i", "__n").select(
        *df.columns, F.when(F.col("__i") < cut, "train").otherwise("test").alias("split")
    )


def half(df: DataFrame, order: list, which: int) -> DataFrame:
    """Rows before (`which=1`) or from (`which=2`) position `n // 2`."""
    indexed = with_row_index(df, order, "__i", "__n")
    cut = F.floor(F.col("__n") / 2)
    condition = F.col("__i") < cut if which == 1 else F.col("__i") >= cut
    return indexed.filter(condition).select(*df.columns)


def with_worker(df: DataFrame, order: list, world: int) -> DataFrame:
    """Contiguous slices of `n // world` rows; the remainder belongs to nobody (null)."""
    size = F.floor(F.col("__n") / world)
    worker = F.floor(F.col("__i") / F.greatest(size, F.lit(1))).cast("int")
    inside = F.col("__i") < size * world
    return with_row_index(df, order, "__i", "__n").select(*df.columns, F.when(inside, worker).alias("worker"))


def worker_slice(df: DataFrame, order: list, rank: int, world: int) -> DataFrame:
    return with_worker(df, order, world).filter(F.col("worker") == rank).drop("worker")


def head_per_group(df: DataFrame, group: list[str], order: list, n: int) -> DataFrame:
    """First n rows of each group. A small n prunes inside every task before the shuffle;
    a large one uses the spread-out rank."""
    if n <= SMALL_HEAD:
        window = Window.partitionBy(*group).orderBy(*order)
        ranked = df.withColumn("__rank", F.row_number().over(window))
        return ranked.filter(F.col("__rank") <= n).drop("__rank")
    return with_group_rank(df, group, order, "__rank").filter(F.col("__rank") < n).drop("__rank")


def truncate_to_shortest(df: DataFrame, group: list[str], order: list) -> DataFrame:
    """Cut every group to the size of the smallest."""
    shortest = df.groupBy(*group).count().agg(F.min("count")).first()[0] or 0
    return head_per_group(df, group, order, shortest)


def budget_subset(df: DataFrame, group: str, text: str, order: list, total_bytes: int) -> DataFrame:
    """From each of k groups the first `int(total/k · lines/size)` lines, line breaks counted."""
    stats = df.groupBy(group).agg(
        F.count(F.lit(1)).alias("__lines"), F.sum(F.octet_length(text) + 1).alias("__size")
    )
    stats = keep(stats)
    share = total_bytes / max(stats.count(), 1)
    allowed = stats.select(
        F.col(group).alias("__g"),
        F.floor(F.lit(share) * (F.col("__lines") / F.col("__size"))).alias("__allowed"),
    )
    ranked = with_group_rank(df, [group], order, "__rank")
    return (
        ranked.join(allowed, F.col(group).eqNullSafe(F.col("__g")))
        .filter(F.col("__rank") < F.col("__allowed"))
        .select(*df.columns)
    )


def capped_sample(df: DataFrame, cap: int, seed: int, row_id: str) -> DataFrame:
    """`min(cap, n)` rows without replacement: those with the lowest seeded draws.

    A histogram of the draws (fixed number of buckets) finds the bucket that holds the cut;
    lower buckets are kept by a plain filter and only that one bucket is ordered."""
    draw = uniform(seed, row_id)
    bucket = F.floor(draw * SAMPLE_BUCKETS)
    running = Window.orderBy("b")  # at most SAMPLE_BUCKETS rows
    cut = (
        df.groupBy(bucket.alias("b")).count()
        .select("b", "count", F.sum("count").over(running).alias("upto"))
        .filter(F.col("upto") > cap).orderBy("b").first()
    )
    if cut is None:
        return df
    below = df.filter(bucket < cut["b"])
    rest = cap - (cut["upto"] - cut["count"])
    edge = df.filter(bucket == cut["b"]).orderBy(draw, row_id).limit(rest)
    return below.unionByName(edge)


def chunk(df: DataFrame, order: list, size: int) -> DataFrame:
    indexed = with_row_index(df, order, "__i")
    return indexed.select(*df.columns, F.floor(F.col("__i") / size).alias("chunk"))


def sampling_weights(df: DataFrame, key: str, alpha: float) -> DataFrame:
    """Smoothed share per key: `p = n/Σn`, `p^alpha`, renormalised; −1 gives equal shares.
    The windows run over one row per key."""
    everything = Window.partitionBy()
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    power = F.lit(1.0) if alpha == -1 else F.pow(F.col("n") / F.sum("n").over(everything), F.lit(float(alpha)))
    smoothed = counts.withColumn("__p", power)
    return smoothed.select(key, "n", (F.col("__p") / F.sum("__p").over(everything)).alias("weight"))


def _choice(rows: list, key: str, draw: Column) -> Column:
    """Inverse of the cumulative weights at `draw`, from a literal table."""
    total, steps = 0.0, []
    for row in rows:
        total += row["weight"]
        steps.append(F.struct(F.lit(row[key]).alias("key"), F.lit(total).alias("upto")))
    table = F.array(*steps)
    return F.coalesce(
        F.get(F.filter(table, lambda s: s["upto"] > draw), F.lit(0))["key"], F.lit(rows[-1][key])
    )


def weighted_choice(df: DataFrame, weights: DataFrame, key: str, seed: int, row_id: str) -> DataFrame:
    """One draw with replacement per row of `df`. A short weight table (languages or language
    pairs) becomes a literal; a longer one is joined by range."""
    rows = weights.select(key, "weight").orderBy(key).limit(LITERAL_KEYS + 1).collect()
    if len(rows) <= LITERAL_KEYS:
        return df.withColumn("choice", _choice(rows, key, uniform(seed, row_id)))
    return _range_choice(df, weights.select(key, "weight"), key, uniform(seed, row_id))


def _range_choice(df: DataFrame, weights: DataFrame, key: str, draw: Column) -> DataFrame:
    """As `_choice`, for any number of keys: cumulative weights and draws as whole numbers, which
    meet in equal slices of the range. A heavy key lies in many slices, so draws are spread."""
    units = weights.withColumn("__units", F.floor(F.col("weight") * _UNITS))
    upto = with_running(units, [key], sums={"__upto": F.col("__units")})
    last, n = upto.agg(F.max(key), F.count(F.lit(1))).first()
    width = max(1, _UNITS // n)
    # the last key takes what rounding leaves
    ends = upto.withColumn("__stop", F.when(F.col(key) == F.lit(last), F.lit(_UNITS)).otherwise(F.col("__upto")))
    ranges = ends.select(F.col(key).alias("choice"), (F.col("__upto") - F.col("__units")).alias("__start"), "__stop")
    slices = F.sequence(F.expr(f"__start div {width}"), F.expr(f"(__stop - 1) div {width}"))
    ranges = ranges.filter("__stop > __start").withColumn("__slice", F.explode(slices))
    drawn = df.withColumn("__draw", (draw * _UNITS).cast("long")).withColumn("__slice", F.expr(f"__draw div {width}"))
    joined = drawn.join(ranges, "__slice").filter("__draw >= __start and __draw < __stop")
    return joined.select(*df.columns, "choice")


def weighted_draw(weights: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """`min(n, number of keys)` draws with replacement."""
    size = min(n, weights.count())
    draws = weights.sparkSession.range(size).withColumnRenamed("id", "draw")
    return weighted_choice(draws, weights, key, seed, "draw")
