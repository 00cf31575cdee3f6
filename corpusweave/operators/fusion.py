"""Fusion of neighbour votes with model scores into the next token."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

def _weights(df: DataFrame, score: Column, keys: list[str], share: float, first: int) -> DataFrame:
    rows = Window.partitionBy(*keys)
    scored = df.withColumn("__e", F.exp(score - F.max(score).over(rows)))
    return scored.select(
        *keys, "token",
        (F.col("__e") / F.sum("__e").over(rows) * F.lit(share)).alias("weight"),
        (F.col("rank") + F.lit(first)).alias("place"),
    )


def fuse_scores(
    neighbours: DataFrame, model: DataFrame, n: int = 1, query: str = "query_id", beam: str | None = None,
    k: int = 8, lambda_: float = 0.5, temperature: float = 10.0, model_temperature: float = 5.0,
    vocab_size: int = 0,
) -> DataFrame:
    """Best `n` tokens per query: `λ·softmax(−d/T)` of the neighbours plus
    `(1−λ)·softmax(s/Tₘ)` of the model's own top k, summed per token.

    `neighbours` has rank, token, distance; `model` has rank, token, score. With `beam` the
    token ids of beam i are shifted by `i · vocab_size`, which must then be given, and a
    sentence keeps its best `2·beams` (pass that as `n`). Equal sums go to the token met first, neighbours before
    model. Everything after the first shuffle is keyed by the query."""
    if beam and vocab_size <= 0:
        raise ValueError("beams need vocab_size: equal tokens of two beams are two candidates")
    keys = [query, beam] if beam else [query]
    votes = _weights(neighbours.filter(F.col("rank") <= k), -F.col("distance") / temperature, keys, lambda_, 0)
    own = _weights(model.filter(F.col("rank") <= k), F.col("score") / model_temperature, keys, 1.0 - lambda_, 1_000_000_000)
    both = votes.unionByName(own)
    if beam:
        both = both.withColumns({
            "token": F.col("token") + F.col(beam) * vocab_size,
            "place": F.col("place") + F.col(beam) * 1_000_000,
        })
    sums = both.groupBy(query, "token").agg(F.sum("weight").alias("score"), F.min("place").alias("__place"))
    order = Window.partitionBy(query).orderBy(F.desc(F.round("score", 12)), "__place")
    best = sums.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)
    return best.select(query, "token", "score", "rank")
