"""Exact nearest neighbours: block distances in Arrow batches, top-k in two stages."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import fits_broadcast, hint_if_small, materialize

BLOCK_ROWS = 50_000  # store rows that meet one block of queries in one task
BLOCK_QUERIES = 50_000
CHUNK_BYTES = 16 * 1024 * 1024  # largest distance matrix held at once; a few arrays of its size exist
PIECE_PAIRS = 1 << 14  # pairs of vectors that are subtracted at once
RESULT = "query_id bigint, row_id bigint, distance double"


def as_matrix(vectors) -> np.ndarray:
    """Arrow list column or sequence of vectors → float64 matrix."""
    if isinstance(vectors, (pa.Array, pa.ChunkedArray)):
        if len(vectors) == 0:
            return np.empty((0, 0))
        flat = vectors.combine_chunks().flatten() if isinstance(vectors, pa.ChunkedArray) else vectors.flatten()
        return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)
    return np.stack([np.asarray(v, dtype=np.float64) for v in vectors]) if len(vectors) else np.empty((0, 0))


def _measure(q: np.ndarray, rows: np.ndarray, hit_q: np.ndarray, hit_r: np.ndarray) -> np.ndarray:
    """Squared distance of each pair. Copies can leave every pair open, so pairs come in pieces."""
    out = np.empty(len(hit_q))
    for at in range(0, len(out), PIECE_PAIRS):
        piece = slice(at, at + PIECE_PAIRS)
        out[piece] = ((q[hit_q[piece]] - rows[hit_r[piece]]) ** 2).sum(axis=1)
    return out


def block_topk(query_ids, queries, row_ids, rows, k: int) -> pd.DataFrame:
    """The k nearest rows of every query by squared distance, ties by lowest row id.

    A matrix product finds all rows within rounding error of the k-th distance; their
    distances are then summed directly, so equal vectors tie exactly."""
    parts = []
    if len(row_ids) and len(query_ids):
        step = max(1, CHUNK_BYTES // (8 * max(len(row_ids), 1)))
        row_norms = (rows**2).sum(axis=1)
        for start in range(0, len(query_ids), step):
            q, q_ids = queries[start : start + step], query_ids[start : start + step]
            norms = (q**2).sum(axis=1)
            approx = q @ rows.T
            approx *= -2.0
            approx += row_norms
            approx += norms[:, None]
            if len(row_ids) > k:
                kth = np.partition(approx, k - 1, axis=1)[:, k - 1]
                slack = 1e-9 * (1.0 + norms + row_norms.max())
                hit_q, hit_r = np.nonzero(approx <= (kth + slack)[:, None])
            else:
                hit_q, hit_r = (a.ravel() for a in np.indices(approx.shape))
            del approx
            exact = _measure(q, rows, hit_q, hit_r)
            order = np.lexsort((row_ids[hit_r], exact, hit_q))
            hit_q, hit_r, exact = hit_q[order], hit_r[order], exact[order]
            place = np.arange(len(hit_q)) - np.searchsorted(hit_q, hit_q, side="left")
            top = place < k
            parts.append(pd.DataFrame({
                "query_id": q_ids[hit_q[top]], "row_id": row_ids[hit_r[top]], "distance": exact[top],
            }))
    if not parts:
        return pd.DataFrame({"query_id": np.array([], "int64"), "row_id": np.array([], "int64"), "distance": np.array([], "float64")})
    return pd.concat(parts, ignore_index=True)


def final_topk(candidates: DataFrame, k: int) -> DataFrame:
    """Best k per query out of the per-block winners."""
    order = Window.partitionBy("query_id").orderBy("distance", "row_id")
    return candidates.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _by_broadcast(queries: DataFrame, store: DataFrame, k: int) -> DataFrame:
    """All queries fit into a task: the store is scanned once and does not move."""
    local = queries.toPandas()
    block = queries.sparkSession.sparkContext.broadcast(
        (local["query_id"].to_numpy(), as_matrix(local["vector"].tolist()))
    )

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, matrix = block.value
        best = None
        for batch in batches:
            found = block_topk(query_ids, matrix, batch.column(0).to_numpy(), as_matrix(batch.column(1)), k)
            best = found if best is None else pd.concat([best, found], ignore_index=True)
            best = best.sort_values(["query_id", "distance", "row_id"]).groupby("query_id", sort=False).head(k)
        if best is not None:
            yield pa.RecordBatch.from_pandas(best[["query_id", "row_id", "distance"]], preserve_index=False)

    return store.select("row_id", "vector").mapInArrow(search, RESULT)


def blocked_search(
    queries: DataFrame, store: DataFrame, k: int, cell: str | None = None, payload: str = "vector", decode=None
) -> DataFrame:
    """Per-block winners for queries and store rows that share a `cell` (all share one if
    none is given). `decode(cell, payload values)` rebuilds vectors inside the task.

    Both sides are hashed into blocks of bounded size; a (cell, store block, query block)
    triple is one task's work, so a cell with a third of all rows is split like any other."""
    blocks = lambda n, size: F.ceil(n / size).cast("int")
    if cell is None:
        counts = store.count(), queries.count()
        planned = {"cell": F.lit(0), "__sb": blocks(F.lit(counts[0]), BLOCK_ROWS), "__qb": blocks(F.lit(counts[1]), BLOCK_QUERIES)}
        s, q = store.withColumns(planned), queries.withColumns(planned)
    else:
        sizes = (
            store.groupBy(cell).agg(F.count(F.lit(1)).alias("__rows"))
            .join(queries.groupBy(cell).agg(F.count(F.lit(1)).alias("__queries")), cell)
            .select(
                F.col(cell).alias("cell"),
                blocks(F.col("__rows"), BLOCK_ROWS).alias("__sb"), blocks(F.col("__queries"), BLOCK_QUERIES).alias("__qb"),
            )
        )
        sizes = hint_if_small(materialize(sizes))  # one row per cell
        s = store.withColumnRenamed(cell, "cell").join(sizes, "cell")
        q = queries.withColumnRenamed(cell, "cell").join(sizes, "cell")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    left = s.select("cell", own("row_id", "__sb").alias("sb"), every("__qb").alias("qb"), "row_id", F.col(payload).alias("payload"))
    right = q.select("cell", own("query_id", "__qb").alias("qb"), every("__sb").alias("sb"), "query_id", "vector")
    keys = ["cell", "sb", "qb"]

    def search(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if rows.empty or asked.empty:
            return block_topk([], None, [], None, k)
        stored = rows["payload"].tolist()
        matrix = decode(rows["cell"].iloc[0], stored) if decode else as_matrix(stored)
        return block_topk(
            asked["query_id"].to_numpy(), as_matrix(asked["vector"].tolist()), rows["row_id"].to_numpy(), matrix, k
        )

    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(search, RESULT)


def knn_exact(queries: DataFrame, store: DataFrame, k: int) -> DataFrame:
    """(query_id, row_id, distance, rank) of the k nearest store rows by squared L2.

    `queries` has query_id and vector, `store` row_id and vector. Queries are broadcast only
    when a count shows that they fit; otherwise both sides are cut into blocks."""
    head = queries.select(F.size("vector").alias("d")).first()
    dim = head["d"] if head else 0
    if fits_broadcast(queries.count(), 8 * dim + 16):
        return final_topk(_by_broadcast(queries, store, k), k)
    return final_topk(blocked_search(queries, store, k), k)


def explain_neighbours(found: DataFrame, store: DataFrame, columns: list[str]) -> DataFrame:
    """Neighbours with their token and provenance columns."""
    return found.join(store.select("row_id", *columns), "row_id")


def topk(df: DataFrame, key: str, score: str, tie: str, k: int) -> DataFrame:
    """Highest k scores per query; each task keeps k per key before the shuffle."""
    order = Window.partitionBy(key).orderBy(F.desc(score), tie)
    return df.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
