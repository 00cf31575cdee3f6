"""Positions in a global order, found without a second shuffle of the rows.

Narrow rows are range-partitioned, sorted and written once. A partition numbers its rows from its
own start, so a row's position in its group is that number, less the number of the group's first
row there, plus the group's rows in earlier partitions. Both come from one small row per partition
and group in it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import land, shuffle_width
from .common import lookup

_LOCAL_BITS = 33  # layout documented for monotonically_increasing_id


def _in_order(rows: DataFrame, keys: list) -> DataFrame:
    """The rows, sorted and written, with their partition and their place in it."""
    ordered = rows.repartitionByRange(shuffle_width(rows), *keys).sortWithinPartitions(*keys)
    fixed = land(ordered.withColumn("__at", F.monotonically_increasing_id()), "ranks")
    return fixed.withColumn("__part", F.shiftright("__at", _LOCAL_BITS))


def running_sums(rows: DataFrame, order: list, sums: dict[str, str], index: str | None = None) -> DataFrame:
    """The rows with inclusive sums {name: column} over all rows up to theirs, and their zero-based
    position. A partition's sums start from the totals of the partitions before it, one small row
    each. DataFrame functions only; the order should be unique."""
    fixed = _in_order(rows, order)
    parts = land(fixed.groupBy("__part").agg(F.count(F.lit(1)).alias("__rows"), *[F.sum(c).alias(f"__t_{n}") for n, c in sums.items()]), "rank-parts")
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    before = lambda c: F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_before")
    offsets = parts.select("__part", before("__rows"), *[before(f"__t_{n}") for n in sums])
    own = Window.partitionBy("__part").orderBy("__at").rowsBetween(Window.unboundedPreceding, 0)
    local = fixed.withColumns({**{n: F.sum(c).over(own) for n, c in sums.items()}, "__index": F.row_number().over(own) - 1})
    placed = lookup(local, land(offsets, "rank-offsets"), ["__part"])
    added = {n: (F.col(n) + F.col(f"__t_{n}_before")).alias(n) for n in sums}
    place = [(F.col("__index") + F.col("__rows_before")).alias(index)] if index else []
    return placed.select(*rows.columns, *added.values(), *place)


def positions(rows: DataFrame, group: list[str], order: list[str], name: str = "position") -> tuple[DataFrame, DataFrame]:
    """The rows (nulls first) with their zero-based position in their group, and the groups with
    their `size`. Groups may be of any size and number. Rows that agree in group and order may take
    each other's place; the written table fixes it."""
    fixed = _in_order(rows, [*group, *order])
    parts = land(fixed.groupBy("__part", *group).agg(F.count(F.lit(1)).alias("__rows"), F.min("__at").alias("__first")), "rank-parts")
    earlier = Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.withColumn("__shift", F.coalesce(F.sum("__rows").over(earlier), F.lit(0)) - F.col("__first"))
    offsets = land(offsets.select("__part", *group, "__shift"), "rank-offsets")
    placed = lookup(fixed, offsets, ["__part", *group]).withColumn(name, F.col("__at") + F.col("__shift"))
    return placed.select(*rows.columns, name), parts.groupBy(*group).agg(F.sum("__rows").alias("size"))
