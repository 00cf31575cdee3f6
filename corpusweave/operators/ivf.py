"""Inverted-list index with product quantisation, as plain tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize
from .neighbours import as_matrix, blocked_search, final_topk
from .splits import capped_sample

# Defaults of the index.
N_LISTS = 512
N_PROBE = 32
N_SUB = 64
N_CODES = 256
SEED = 1


def _centers(vectors: DataFrame, column: Column, k: int, seed: int) -> np.ndarray:
    data = vectors.select(array_to_vector(column).alias("features"))
    model = KMeans(k=k, seed=seed, initMode="k-means||", maxIter=20).fit(data)
    return np.stack(model.clusterCenters())


def _table(spark: SparkSession, centers: np.ndarray, name: str) -> DataFrame:
    rows = [(i, [float(x) for x in c]) for i, c in enumerate(centers)]
    return spark.createDataFrame(rows, f"{name} int, center array<double>")


def _sampled(rows: DataFrame, cap: int | None, seed: int) -> DataFrame:
    return rows if cap is None else capped_sample(rows, cap, seed, "row_id")


def train_ivf(store: DataFrame, n_lists: int = N_LISTS, cap: int | None = None, seed: int = SEED) -> DataFrame:
    """Coarse centres (list_id, center) from the store, or from a sample of at most `cap` rows."""
    sample = _sampled(store.select("row_id", "vector"), cap, seed)
    sample = materialize(sample.select(F.col("vector").cast("array<double>").alias("vector")))
    return _table(store.sparkSession, _centers(sample, F.col("vector"), n_lists, seed), "list_id")


def _matrix(centers: DataFrame, key: str) -> np.ndarray:
    """At most N_LISTS (or N_CODES) rows."""
    return np.stack([np.asarray(r["center"]) for r in centers.orderBy(key).collect()])


def nearest_lists(df: DataFrame, vector: str, centroids: DataFrame, n: int) -> Column:
    """Ids of the n nearest lists, nearest first."""
    centers = df.sparkSession.sparkContext.broadcast(_matrix(centroids, "list_id"))

    @F.pandas_udf("array<int>")
    def lists(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        c = centers.value
        norms = (c**2).sum(axis=1)
        for vectors in batches:
            distances = norms[None, :] - 2.0 * as_matrix(vectors.tolist()) @ c.T
            yield pd.Series(list(np.argsort(distances, axis=1, kind="stable")[:, :n].astype(np.int32)))

    return lists(F.col(vector))


def assign_lists(store: DataFrame, centroids: DataFrame) -> DataFrame:
    """Postings: every store row with the id of its nearest list."""
    return store.withColumn("list_id", F.get(nearest_lists(store, "vector", centroids, 1), F.lit(0)))


def knn_ivf(queries: DataFrame, postings: DataFrame, centroids: DataFrame, k: int, n_probe: int = N_PROBE) -> DataFrame:
    """Exact distances inside the n_probe nearest lists; all lists give the exact result.
    Queries meet postings by an equi-join on the list id."""
    probed = queries.withColumn("list_id", F.explode(nearest_lists(queries, "vector", centroids, n_probe)))
    return final_topk(blocked_search(probed, postings, k, "list_id"), k)


# --- product quantisation ---------------------------------------------------------------


def _residuals(postings: DataFrame, centroids: DataFrame) -> DataFrame:
    centers = centroids.select("list_id", F.col("center").alias("__c"))
    joined = postings.join(F.broadcast(centers), "list_id")  # at most N_LISTS rows
    residual = F.zip_with(F.col("vector").cast("array<double>"), "__c", lambda x, c: x - c)
    return joined.withColumn("residual", residual).drop("__c")


def _part(column: str, sub: int, width: int) -> Column:
    return F.slice(column, sub * width + 1, width)


def train_pq(
    postings: DataFrame, centroids: DataFrame, dim: int, n_sub: int = N_SUB, n_codes: int = N_CODES,
    cap: int | None = None, seed: int = SEED,
) -> DataFrame:
    """Codebooks (sub, code, center): one k-means per slice of the residuals."""
    if dim % n_sub:
        raise ValueError(f"{dim} dimensions can not be cut into {n_sub} equal slices")
    width = dim // n_sub
    sample = _sampled(_residuals(postings, centroids).select("row_id", "residual"), cap, seed)
    sample = materialize(sample)
    rows = []
    for sub in range(n_sub):
        centers = _centers(sample, _part("residual", sub, width), n_codes, seed)
        rows += [(sub, code, [float(x) for x in c]) for code, c in enumerate(centers)]
    return postings.sparkSession.createDataFrame(rows, "sub int, code int, center array<double>")


def _books(codebooks: DataFrame) -> list[np.ndarray]:
    """At most N_SUB × N_CODES short vectors."""
    rows = codebooks.orderBy("sub", "code").collect()
    subs = sorted({r["sub"] for r in rows})
    return [np.stack([np.asarray(r["center"]) for r in rows if r["sub"] == s]) for s in subs]


def encode_pq(postings: DataFrame, centroids: DataFrame, codebooks: DataFrame) -> DataFrame:
    """Postings (list_id, row_id, codes): nearest code of every residual slice."""
    books = postings.sparkSession.sparkContext.broadcast(_books(codebooks))

    @F.pandas_udf("array<int>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for vectors in batches:
            matrix = as_matrix(vectors.tolist())
            codes, at = [], 0
            for book in books.value:
                part = matrix[:, at : at + book.shape[1]]
                codes.append(((book**2).sum(axis=1)[None, :] - 2.0 * part @ book.T).argmin(axis=1))
                at += book.shape[1]
            yield pd.Series(list(np.stack(codes, axis=1).astype(np.int32)))

    coded = _residuals(postings, centroids).withColumn("codes", encode("residual"))
    return coded.select("list_id", "row_id", "codes")


def _decoder(centroids: DataFrame, codebooks: DataFrame):
    """Function (list, codes) → approximate vectors: list centre plus code centres."""
    shared = centroids.sparkSession.sparkContext.broadcast((_matrix(centroids, "list_id"), _books(codebooks)))

    def decode(list_id, codes) -> np.ndarray:
        centers, books = shared.value
        chosen = np.stack(codes)
        return centers[list_id] + np.concatenate([book[chosen[:, s]] for s, book in enumerate(books)], axis=1)

    return decode


def knn_ivfpq(
    queries: DataFrame, coded: DataFrame, centroids: DataFrame, codebooks: DataFrame, k: int,
    n_probe: int = N_PROBE, rerank_with: DataFrame | None = None, rerank_factor: int = 4,
) -> DataFrame:
    """Distances to the quantised vectors in the probed lists. With `rerank_with` (row_id,
    vector) the best `k · rerank_factor` are measured again exactly.

    Codes travel through the shuffle; vectors are rebuilt from them inside the task."""
    probed = queries.withColumn("list_id", F.explode(nearest_lists(queries, "vector", centroids, n_probe)))
    wide = k * rerank_factor if rerank_with is not None else k
    near = blocked_search(probed, coded, wide, "list_id", "codes", _decoder(centroids, codebooks))
    found = final_topk(near, wide)
    if rerank_with is None:
        return found
    both = (
        found.select("query_id", "row_id")
        .join(rerank_with.select("row_id", F.col("vector").alias("__x")), "row_id")
        .join(queries.select("query_id", F.col("vector").alias("__q")), "query_id")
    )
    square = lambda a, b: (a.cast("double") - b.cast("double")) * (a.cast("double") - b.cast("double"))
    distance = F.aggregate(F.zip_with("__q", "__x", square), F.lit(0.0), lambda total, d: total + d)
    return final_topk(both.select("query_id", "row_id", distance.alias("distance")), k)


def recall_at_k(found: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """Mean share of the true k neighbours that were found."""
    hits = truth.select("query_id", "row_id").join(found.select("query_id", "row_id").withColumn("hit", F.lit(1)), ["query_id", "row_id"], "left")
    per_query = hits.groupBy("query_id").agg((F.count("hit") / F.lit(k)).alias("recall"))
    return per_query.agg(F.avg("recall").alias("recall"), F.count(F.lit(1)).alias("queries"))


