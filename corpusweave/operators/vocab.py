"""Token counts, vocabularies, indexing of corpora and their statistics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.arrays import EOS, FIRST_SPECIAL, SPECIAL_WORDS, UNK, until_eos
from ..session import hint_if_small, keep, materialize, shuffle_width
from .ordering import with_row_index

# Base words and the number of placeholders per kind, in id order.
BASE_WORDS = ["<s>", "</s>", "<pad>", "<unk>"]
UNKNOWN_WORD = BASE_WORDS[3]
LINE_SEPARATOR = "\u2028"  # a word with it would split a vocabulary line
PLACEHOLDERS = {"CLASS": 100, "FUNC": 200, "VAR": 200}

RESERVED = (
    BASE_WORDS
    + [f"<special{i}>" for i in range(SPECIAL_WORDS)]
    + [f"{kind}_{i}" for kind, n in PLACEHOLDERS.items() for i in range(n)]
)
FIRST_ORDINARY = len(RESERVED)
VOCAB_SIZE = 64_000
# A vocabulary of up to so many bytes goes to every task; a larger one is joined.
LOOKUP_BYTES = 64 << 20
# Tokens that hold more rows than this share of a partition are looked up apart.
HEAVY_SHARE = 4
# Tokens that a task holds as Python or numpy objects at a time; a longer row is on its own.
TOKENS_AT_ONCE = 1 << 18


SMALL_TOP = 1000
STEPS_PER_E = 20  # histogram resolution: about 5 % in count


def _top(counts: DataFrame, n: int) -> DataFrame:
    """The n most frequent tokens. A large n would send n rows per task into one task, so a
    histogram over logarithmic count classes (a few hundred rows) finds the class that holds
    the cut: higher classes pass a filter, only that one class is sorted."""
    order = [F.desc("count"), F.col("token")]
    if n <= SMALL_TOP:
        return counts.orderBy(*order).limit(n)
    counts = keep(counts)
    step = F.floor(F.log(F.col("count").cast("double")) * STEPS_PER_E)
    upto = Window.orderBy(F.desc("step"))
    cut = (
        counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("words"))
        .select("step", "words", F.sum("words").over(upto).alias("upto"))
        .filter(F.col("upto") > n).orderBy(F.desc("step")).first()
    )
    if cut is None:
        return counts.orderBy(*order)
    rest = n - (cut["upto"] - cut["words"])
    edge = counts.filter(step == cut["step"]).orderBy(*order).limit(rest)
    return counts.filter(step > cut["step"]).unionByName(edge)


def count_tokens(df: DataFrame, tokens: Column | str, n: int | None = VOCAB_SIZE) -> DataFrame:
    """Counts per token; the n most frequent, ties by token. Partial counts are made before
    the shuffle, so frequent tokens cost one row per task."""
    counts = df.select(F.explode(tokens).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("count"))
    return counts if n is None else _top(counts, n)


def reserved_vocab(spark: SparkSession) -> DataFrame:
    rows = [(word, i, 0) for i, word in enumerate(RESERVED)]
    return spark.createDataFrame(rows, "token string, id int, count long")


def _usable(counts: DataFrame) -> DataFrame:
    return counts.filter(~F.col("token").isin(RESERVED) & ~F.col("token").contains(LINE_SEPARATOR) & (F.col("token") != ""))


def build_vocab(counts: DataFrame, n: int | None = VOCAB_SIZE) -> DataFrame:
    """Reserved ids, then words by falling count. At most `n` ordinary words are numbered in
    one sorted partition; without a bound the distributed row index is used."""
    order = [F.desc("count"), F.col("token")]
    words = _usable(counts)
    if n is None:
        numbered = with_row_index(words, order, "rank")
    else:
        top = _top(words, n)  # at most n rows in one sorted partition
        numbered = top.withColumn("rank", F.row_number().over(Window.orderBy(*order)) - 1)
    ordinary = numbered.select("token", (F.col("rank") + FIRST_ORDINARY).cast("int").alias("id"), "count")
    # fixed once: every later use reads this small table, not the corpus
    return materialize(reserved_vocab(counts.sparkSession).unionByName(ordinary))


def truncate_vocab(vocab: DataFrame, max_vocab: int | None = None, min_count: int = 0) -> DataFrame:
    """Keep ids below `max_vocab`; `min_count` acts only together with it. Reserved words stay."""
    if max_vocab is None:
        return vocab
    return vocab.filter(
        (F.col("id") < max_vocab) & ((F.col("count") >= min_count) | (F.col("id") < FIRST_ORDINARY))
    )


def _dropped(ids: Column) -> Column:
    """Ids of base and special words (but not the unknown word) never enter a sentence."""
    return (ids < FIRST_SPECIAL + SPECIAL_WORDS) & (ids != UNK)


def token_pieces(batches: Iterator[pa.RecordBatch], column: int, most: int = TOKENS_AT_ONCE) -> Iterator[pa.RecordBatch]:
    """The rows of each batch in runs with about `most` entries in a list column."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.list_value_length(batch.column(column)), 0).to_numpy(), dtype=np.int64)
        lo = 0
        while lo < batch.num_rows:
            before = ends[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(ends, before + most, side="right")))
            yield batch if hi - lo == batch.num_rows else batch.take(pa.array(np.arange(lo, hi)))
            lo = hi


def _index_arrow(df: DataFrame, row_id: str, tokens: str, rows: list) -> DataFrame:
    """Look all tokens of a batch up at once; rows stay where they are (no shuffle)."""
    words, ids = [r["token"] for r in rows], [r["id"] for r in rows]
    table = df.sparkSession.sparkContext.broadcast((words, ids))
    special = FIRST_SPECIAL + SPECIAL_WORDS

    def lookup(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pd.Index(table.value[0], dtype=object)  # hashed once per task
        numbers = np.array([*table.value[1], UNK], np.int32)  # -1 is the last one
        for batch in token_pieces(batches, 1):
            column = batch.column(1)
            coded = column.flatten().cast(pa.string()).dictionary_encode()
            places = known.get_indexer(pd.Index(coded.dictionary.to_pylist(), dtype=object))
            found = numbers[np.append(places, -1)[pc.fill_null(coded.indices, len(places)).to_numpy(zero_copy_only=False)]]
            keep = (found >= special) | (found == UNK)
            parents = pc.list_parent_indices(column).to_numpy()[keep]
            lengths = np.bincount(parents, minlength=batch.num_rows) + 1
            offsets = np.concatenate([[0], np.cumsum(lengths)])
            ids = np.full(offsets[-1], EOS, dtype=np.int32)
            # every earlier row adds one end mark, so token i of row r lands at i + r
            ids[np.arange(len(parents)) + parents] = found[keep]
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=[row_id, "ids"])

    kind = dict(df.dtypes)[row_id]
    return df.select(row_id, tokens).mapInArrow(lookup, f"`{row_id}` {kind}, ids array<int>")


def _small(vocab: DataFrame) -> bool:
    """Whether the measured bytes of a vocabulary let every task hold it."""
    size = vocab.agg(F.sum(F.coalesce(F.octet_length("token"), F.lit(0)) + 16)).first()[0] or 0
    return size <= LOOKUP_BYTES


def lookup_tokens(rows: DataFrame, token: str, vocab: DataFrame, value: str) -> DataFrame:
    """`rows` with the token's vocabulary id as `value`, null for unknown ones.

    A small vocabulary is broadcast. Otherwise tokens that hold more than a fair share of the rows
    (at most HEAVY_SHARE times as many as there are partitions, known or not) meet their ids by a
    broadcast, and only the others are shuffled: no partition has to take all rows of a token."""
    known = vocab.select(F.col("token").alias("__token"), F.col("id").alias(value))
    same = F.col(token) == F.col("__token")
    if _small(vocab):
        return rows.join(F.broadcast(known), same, "left").drop("__token")
    counts = keep(rows.groupBy(F.col(token).alias("__heavy")).agg(F.count(F.lit(1)).alias("__n")))
    fair = (counts.agg(F.sum("__n")).first()[0] or 0) / (HEAVY_SHARE * shuffle_width(rows))
    heavy = counts.filter((F.col("__n") >= fair) & F.col("__heavy").isNotNull()).select("__heavy")
    heavy = materialize(heavy.join(known, F.col("__heavy") == F.col("__token"), "left").select("__heavy", value))
    counts.unpersist()
    names = F.broadcast(heavy.select("__heavy"))
    often = rows.join(F.broadcast(heavy), F.col(token) == F.col("__heavy")).drop("__heavy")
    # a null token equals nothing and is spread by its own row
    seldom = rows.join(names, F.col(token) == F.col("__heavy"), "left_anti")
    nulls = seldom.filter(F.col(token).isNull()).withColumn(value, F.lit(None).cast(known.schema[value].dataType))
    plain = seldom.filter(F.col(token).isNotNull()).join(known, same, "left").drop("__token")
    return often.unionByName(plain).unionByName(nulls)


def _index_join(df: DataFrame, row_id: str, tokens: str, vocab: DataFrame) -> DataFrame:
    """For vocabularies too large to hold in a task: join on the token, then re-assemble."""
    exploded = df.select(row_id, F.posexplode_outer(tokens).alias("__pos", "__tok"))
    looked = lookup_tokens(exploded, "__tok", vocab, "__id").withColumn(
        "__id", F.when(F.col("__pos").isNotNull(), F.coalesce("__id", F.lit(UNK)))
    )
    item = F.when(F.col("__id").isNotNull() & ~_dropped(F.col("__id")), F.struct("__pos", "__id"))
    grouped = looked.groupBy(row_id).agg(F.array_sort(F.collect_list(item)).alias("__items"))
    ids = F.concat(F.transform("__items", lambda s: s["__id"].cast("int")), F.array(F.lit(EOS)))
    return grouped.select(row_id, ids.alias("ids"))


def index_corpus(df: DataFrame, row_id: str, tokens: str, vocab: DataFrame) -> DataFrame:
    """(row_id, ids): unknown words → 3, special words dropped, end mark appended; an empty
    sentence is `[1]`."""
    if not _small(vocab):
        return _index_join(df, row_id, tokens, vocab)
    return _index_arrow(df, row_id, tokens, vocab.select("token", "id").collect())


def ids_to_text(df: DataFrame, row_id: str, ids: str, vocab: DataFrame) -> DataFrame:
    """Drop the first id, stop at the first end mark, look the rest up, join by blanks. An id
    that the vocabulary lacks gives the unknown word, whatever the vocabulary's size."""
    body = df.select(row_id, until_eos(ids).alias("body"))
    if not _small(vocab):
        exploded = body.select(row_id, F.posexplode_outer("body").alias("__pos", "__id"))
        named = exploded.join(vocab.select(F.col("id").alias("__id"), F.col("token").alias("__token")), "__id", "left")
        grouped = named.groupBy(row_id).agg(F.array_sort(F.collect_list(F.struct("__pos", "__token"))).alias("__t"))
        return grouped.select(row_id, F.array_join(F.transform("__t", lambda s: s["__token"]), " ", UNKNOWN_WORD).alias("text"))
    rows = vocab.select("id", "token").collect()
    table = df.sparkSession.sparkContext.broadcast(([r["id"] for r in rows], [r["token"] for r in rows]))

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, words = pd.Index(table.value[0], dtype="int64"), pa.array([*table.value[1], UNKNOWN_WORD], pa.string())
        for batch in batches:
            column = batch.column(1)
            ids = pc.fill_null(column.flatten(), -1).to_numpy(zero_copy_only=False)
            places = numbers.get_indexer(pd.Index(ids, dtype="int64"))
            found = words.take(pa.array(np.where(places < 0, len(numbers), places)))
            offsets = pc.subtract(column.offsets, column.offsets[0])
            text = pc.binary_join(pa.ListArray.from_arrays(offsets, found), " ")
            yield pa.RecordBatch.from_arrays([batch.column(0), text], names=[row_id, "text"])

    kind = dict(df.dtypes)[row_id]
    return body.mapInArrow(name, f"`{row_id}` {kind}, text string")


def unk_report(df: DataFrame, tokens: Column | str, vocab: DataFrame, limit: int = 30, max_distinct: int | None = None) -> DataFrame:
    """Most frequent unknown words and their share of all tokens. Counting comes first, so
    only one row per distinct word meets the vocabulary. With `max_distinct`, no rows from so
    many distinct unknown words on."""
    known = vocab.select("token", F.lit(1).alias("__known"))
    counts = keep(count_tokens(df, tokens, None).join(hint_if_small(known), "token", "left"))
    unknown = F.col("__known").isNull()
    totals = counts.agg(F.sum("count").alias("all"), F.count_if(unknown).alias("distinct")).first()
    allowed = limit if max_distinct is None or totals["distinct"] < max_distinct else 0
    top = counts.filter(unknown).orderBy(F.desc("count"), "token").limit(allowed)
    return top.select("token", "count", (F.col("count") / F.lit(max(totals["all"] or 0, 1))).alias("share"))


def corpus_stats(indexed: DataFrame, vocab: DataFrame, ids: str = "ids") -> DataFrame:
    """Words (end marks not counted), vocabulary size, sentences, unknown share in percent."""
    unknown = F.size(F.filter(ids, lambda x: x == UNK))
    totals = indexed.agg(
        F.sum(F.size(ids) - 1).alias("words"),
        F.lit(vocab.count()).alias("unique_words"),
        F.count(F.lit(1)).alias("sentences"),
        F.sum(unknown).alias("unknown"),
    )
    percent = F.when(F.col("words") > 0, 100.0 * F.col("unknown") / F.col("words")).otherwise(0.0)
    return totals.withColumn("unk_percent", percent)


def mask_weights(vocab: DataFrame, alpha: float, pad: int = 2) -> DataFrame:
    """`max(count, 1)^-alpha`; padding and words without a count are never picked."""
    weight = F.pow(F.greatest(F.col("count"), F.lit(1)).cast("double"), F.lit(-float(alpha)))
    return vocab.withColumn("weight", F.when((F.col("count") == 0) | (F.col("id") == pad), 0.0).otherwise(weight))
