"""From raw documents to indexed, split and sharded sentences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import shuffle_rank
from ..functions.text import words
from ..operators import dedup, splits, vocab
from ..session import land


def prepare_corpus(
    df: DataFrame, row_id: str, text: str, repo: str, scope: list[str], seed: int = 0,
    percent_test: int = 1, percent_valid: int = 1, n_shards: int = 8,
) -> DataFrame:
    """Duplicates removed in seeded order, then split by repository and train shard.

    One shuffle of hashes and one of texts (the semi join); split and shard are narrow."""
    position = shuffle_rank(seed, row_id)
    kept = dedup.dedup_content(df, text, row_id, scope, position)
    split = splits.split_by_hash(kept, repo, percent_test, percent_valid)
    sharded = splits.shard(split.withColumn("__pos", position), n_shards, "__pos").drop("__pos")
    return sharded.withColumn("shard", F.when(F.col("split") == "train", F.col("shard")).otherwise(F.lit(0)))


def index_splits(corpus: DataFrame, row_id: str, text: str, size: int = vocab.VOCAB_SIZE) -> tuple[DataFrame, DataFrame]:
    """(vocabulary of the train part, ids of every part). Two passes read the corpus, so it
    is landed first."""
    corpus = land(corpus, "corpus")
    train = corpus.filter(F.col("split") == "train")
    known = vocab.build_vocab(vocab.count_tokens(train, words(text), size), size)
    tokens = corpus.select(row_id, words(text).alias("tokens"))
    return known, vocab.index_corpus(tokens, row_id, "tokens", known)
