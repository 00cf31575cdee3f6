"""Datastores from pairs, their small versions, and corrected next tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import words
from ..operators import datastore, dedup, fusion, neighbours, vocab
from ..session import land


def unique_pairs(pairs: DataFrame) -> DataFrame:
    """Repeated pairs removed per language pair, written once for all that is made of them."""
    return land(dedup.dedup_pairs(pairs, "source", "target", "pair_id", ["language_pair"]), "unique-pairs")


def datastore_from_pairs(pairs: DataFrame, vocabulary: DataFrame | None = None, features: str | None = None) -> DataFrame:
    """Repeated pairs removed per language pair, then one row per target token."""
    return datastore_from_unique(dedup.dedup_pairs(pairs, "source", "target", "pair_id", ["language_pair"]), vocabulary, features)


def datastore_from_unique(unique: DataFrame, vocabulary: DataFrame | None = None, features: str | None = None) -> DataFrame:
    """One row per target token of pairs without repetitions."""
    if vocabulary is None:
        vocabulary = vocab.build_vocab(vocab.count_tokens(unique, words("target")))
    return datastore.build_datastore(unique, vocabulary, features=features)


def small_datastores(store: DataFrame, unique: DataFrame | None = None) -> dict[str, DataFrame]:
    """The end rows, the rows before them, and the short fragments. With the pairs that the store
    was made of, fragments are cut from these: the prefixes of a target are not split one by one."""
    ends, before = datastore.eos_rows(store), datastore.pre_eos_rows(store)
    if unique is None:
        fragments = datastore.fragment_pairs(
            store.select(F.col("source").alias("fail_input"), F.col("prefix").alias("succ_prefix"))
        )
    else:
        fragments = datastore.fragment_pairs_of(unique)
    return {"eos": ends, "pre_eos": before, "fragments": fragments}


def corrected_tokens(queries: DataFrame, store: DataFrame, model: DataFrame, k: int = 8, **params) -> DataFrame:
    """Best token of every query after the vote of its k nearest store rows."""
    found = neighbours.explain_neighbours(neighbours.knn_exact(queries, store, k), store, ["token"])
    return fusion.fuse_scores(found, model, k=k, **params)
