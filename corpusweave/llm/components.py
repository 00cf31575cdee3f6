"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..session import land
from .common import tidy

#: Links that a task holds together to contract them, and rows for which one more task is worth its start.
TOGETHER = 1 << 20
ROWS_OF_TASK = 1 << 17


def contracted(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same components in at most as many links: each node to the smallest of its component."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while len(a):
        low = np.minimum(root[a], root[b])
        for side in (a, b):  # roots hang themselves on smaller ones
            np.minimum.at(root, root[side], low)
        while not np.array_equal(root[root], root):
            root = root[root]
        apart = root[a] != root[b]
        a, b = a[apart], b[apart]
    moved = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[moved], nodes[root[moved]]


@tidy
def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What the rows of a task join, in runs of bounded size; others of a component may be elsewhere."""
    held, n = [], 0

    def run():
        u, v = contracted(*(np.concatenate([b.column(c).to_numpy() for b in held]) for c in ("u", "v")))
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n > TOGETHER:
            yield run()
            held, n = [], 0
    if held:
        yield run()


def _star(links: DataFrame) -> DataFrame:
    """Each link (u, v, moved) once, with the smallest v of its u as m, and whether it has it itself."""
    # of equal links one that moved comes first
    own = Window.partitionBy("u").orderBy("v", F.desc("moved"))
    ranked = links.select("u", "v", "moved", F.first("v").over(own).alias("m"), F.lag("v").over(own).alias("last"))
    return ranked.filter("last is null or last <> v").select("u", "v", "moved", "m", F.col("last").isNull().alias("lowest"))


def _tasks(rows: DataFrame, n: int) -> DataFrame:
    """At most so many tasks as n rows are worth, and all cores; shuffles of small tables have more."""
    return rows.coalesce(max(rows.sparkSession.sparkContext.defaultParallelism, -(-n // ROWS_OF_TASK)))


def _round(links: DataFrame, n: int) -> tuple[DataFrame, dict]:
    """A large and a small star over at most n links (u, v) with u > v; how many remain and moved."""
    both = links.select(F.inline(F.array(*[F.struct(F.col(x).alias("u"), F.col(y).alias("v")) for x, y in ("uv", "vu")])))
    large = _star(both.withColumn("moved", F.lit(False))).filter("v > u")
    large = _tasks(large, n).select(F.col("v").alias("u"), F.least("u", "m").alias("v"), (F.col("m") < F.col("u")).alias("moved"))
    # links now point from larger to smaller nodes; pull a node's smaller neighbours together
    small = _star(large).select(F.when(F.col("lowest"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"), (F.col("moved") | ~F.col("lowest")).alias("moved"))
    seen = Observation()
    measured = small.observe(seen, F.count(F.lit(1)).alias("n"), F.count_if("moved").alias("moved"))
    table = land(_tasks(measured, n).select("u", "v"), "components")
    return table, seen.get


def components(links: DataFrame) -> DataFrame:
    """node, component (its smallest node) for every node of the links (a, b) with a <> b.

    Each round points nodes at smaller ones, first in each task among the links it holds, then at
    those of all links; rounds grow with the logarithm of the longest chain. Only links are
    shuffled, by node for each star, where equal ones meet and become one."""
    current, state = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")), {"n": links.count(), "moved": 1}
    while state["moved"]:
        current, state = _round(current.mapInArrow(_contract, "u bigint, v bigint"), state["n"])
    roots = _tasks(current.select(F.col("v").alias("node")).distinct(), state["n"])
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))
