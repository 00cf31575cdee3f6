"""Noise, masking and name restoration. All draws depend only on seed, row key and
position, so results do not change with partitioning or retries."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from ..functions.arrays import EOS, MASK, PAD
from ..functions.binding import let
from ..functions.hashing import _col, uniform
from ..functions.text import format_dictionary, parse_dictionary
from ..session import hint_if_small, shuffle_width

FIRST_ORDINARY = 514  # fixed value: first id of an ordinary word


def _masked(token: Column, draw: Column, real: Column, probs: tuple[float, float, float], n_words: int) -> Column:
    """mask / keep / random word with the three probabilities."""
    mask, keep, _ = probs
    return F.when(draw < mask, F.lit(MASK)).when(draw < mask + keep, token).otherwise(F.floor(real * n_words).cast("int"))


def mask_tokens(
    ids, row_id: str, p: float, n_words: int, probs: tuple[float, float, float] = (0.8, 0.1, 0.1), seed: int = 0
) -> Column:
    """struct(ids, targets): positions picked with probability p (never the first, never
    padding); targets hold the original id where picked, else null."""
    def one(x: Column, i: Column) -> Column:
        picked = (uniform(f"{seed}p", row_id, i) <= p) & (i > 0) & (x != PAD)
        changed = _masked(x, uniform(f"{seed}a", row_id, i), uniform(f"{seed}r", row_id, i), probs, n_words)
        return F.struct(F.when(picked, changed).otherwise(x).alias("id"), F.when(picked, x).alias("target"))

    return let(
        F.transform(_col(ids), one),
        lambda both: F.struct(
            F.transform(both, lambda t: t["id"]).alias("ids"), F.transform(both, lambda t: t["target"]).alias("targets")
        ),
    )


def mask_eval(ids, row_id: str, p: float, seed: int = 0) -> Column:
    """Mask with probability p between the end marks; at least one word per sentence (the
    one with the lowest draw)."""
    array = _col(ids)
    inner = lambda i: (i > 0) & (i < F.size(array) - 1)
    draws = F.transform(array, lambda x, i: F.when(inner(i), uniform(seed, row_id, i)))

    def mask(drawn: Column) -> Column:
        limit = F.greatest(F.array_min(drawn), F.lit(p))
        return let(
            limit,
            lambda bound: F.zip_with(array, drawn, lambda x, u: F.when(u <= bound, F.lit(MASK)).otherwise(x)),
        )

    return let(draws, mask)


def mask_weighted(
    df: DataFrame, weights: DataFrame, batch: str, row_id: str, ids: str, p: float, seed: int = 0
) -> DataFrame:
    """(batch, row, pos, token_id) picked per batch: `ceil(p · rows · longest)` draws without
    replacement, weight per id. Smallest exponential keys are such a draw. A batch is
    bounded by its token budget: its rows move as arrays, once, and become slots in the task
    that ranks them. Picks at the first position do not count."""
    whole = Window.partitionBy(batch)
    size = F.ceil(F.lit(p) * F.count(F.lit(1)).over(whole) * F.max(F.size(ids)).over(whole))
    rows = df.select(batch, row_id, ids).filter(F.col(batch).isNotNull())
    rows = rows.repartition(shuffle_width(df), batch).withColumn("__n", size)
    slots = rows.select(batch, row_id, "__n", F.posexplode(ids).alias("pos", "__id"))
    known = hint_if_small(weights.filter("weight > 0").select(F.col("id").alias("__id"), "weight"), 16)
    draw = -F.log(1.0 - uniform(seed, row_id, "pos")) / F.col("weight")
    keyed = slots.join(known, "__id").withColumn("__key", draw)
    order = Window.partitionBy(batch).orderBy("__key", row_id, "pos")
    ranked = keyed.withColumn("__rank", F.row_number().over(order))
    kept = (F.col("__rank") <= F.col("__n")) & (F.col("pos") > 0) & (F.col("__id") != PAD)
    return ranked.filter(kept).select(batch, row_id, "pos", F.col("__id").alias("token_id"))


def _body(array: Column) -> Column:
    """All but the closing end mark."""
    return F.slice(array, F.lit(1), F.size(array) - 1)


def _end() -> Column:
    return F.array(F.lit(EOS))


def word_shuffle(ids, row_id: str, k: float, seed: int = 0) -> Column:
    """Order by `position + U(0, k)`; first and last stay."""
    array = _col(ids)
    if k == 0:
        return array
    scored = F.transform(
        _body(array),
        lambda x, i: F.struct(
            (i + F.when(i == 0, F.lit(-1.0)).otherwise(uniform(seed, row_id, i) * k)).alias("s"), i.alias("i"), x.alias("x")
        ),
    )
    return F.concat(F.transform(F.array_sort(scored), lambda s: s["x"]), _end())


def word_dropout(ids, row_id: str, p: float, seed: int = 0) -> Column:
    """Drop words with probability p; the start mark stays, and at least one word."""
    array = _col(ids)
    if p == 0:
        return array
    body = _body(array)
    pick = 1 + F.floor(uniform(f"{seed}one", row_id) * (F.size(body) - 1)).cast("int")
    saved = let(
        F.filter(body, lambda x, i: (i == 0) | (uniform(seed, row_id, i) >= p)),
        lambda kept: F.when((F.size(kept) == 1) & (F.size(body) > 1), F.array_append(kept, F.get(body, pick))).otherwise(kept),
    )
    return F.concat(saved, _end())


def word_blank(ids, row_id: str, p: float, seed: int = 0) -> Column:
    """Replace words by the mask id with probability p; both ends stay."""
    array = _col(ids)
    if p == 0:
        return array
    blanked = F.transform(
        _body(array), lambda x, i: F.when((i > 0) & (uniform(seed, row_id, i) < p), F.lit(MASK)).otherwise(x)
    )
    return F.concat(blanked, _end())


# --- span masking -----------------------------------------------------------------------


def span_lengths(lam: float | None = None, fixed: int | None = None) -> np.ndarray:
    """Probability of each span length: a Poisson cut where it falls below 1e-7, or one length."""
    if fixed is not None:
        return np.eye(fixed + 1)[fixed]
    probs = [np.exp(-lam)]
    while probs[-1] >= 1e-7 and len(probs) < 128:
        probs.append(probs[-1] * lam / len(probs))
    return np.array(probs) / np.sum(probs)


def length_bounds(lam: float | None = None, fixed: int | None = None) -> list[float]:
    """A draw's span length is the number of these bounds that it reaches."""
    return np.cumsum(span_lengths(lam, fixed))[:-1].tolist()


@F.pandas_udf(ArrayType(IntegerType()))
def _running(lengths: pd.Series) -> pd.Series:
    return lengths.map(lambda x: np.cumsum(x, dtype=np.int32))


def _numbers(first: Column, end: Column) -> Column:
    """Integers from `first` up to, but without, `end`."""
    return F.when(end > first, F.sequence(first, end - 1)).otherwise(F.array().cast("array<int>"))


def span_mask(
    df: DataFrame, row_id: str, ids: str, p: float, n_words: int, lam: float | None = None, fixed: int | None = None,
    probs: tuple[float, float, float] = (0.8, 0.1, 0.1), word_rand: float = 0.1, seed: int = 0,
) -> DataFrame:
    """(row, ids) with spans replaced by one mask each and zero-length spans as insertions.
    Without a length distribution this is `word_blank`.

    A sentence of n ids has a budget of ceil(p · n) ids and as many length draws; spans count
    until the budget is spent, and the last one is shortened to fit. The k-th span that is not
    empty starts at the inner position with the k-th lowest draw: that id becomes a mask, stays
    or becomes a random word, and the rest of the span goes. Each empty span adds a mask or, with
    probability `word_rand`, a random ordinary word at one of the lowest-drawn inner places of
    the result. End marks stay; null ids stay null."""
    if lam is None and fixed is None:
        return df.select(row_id, word_blank(ids, row_id, p, seed).alias("ids"))
    bounds = F.array(*[F.lit(b) for b in length_bounds(lam, fixed)]).cast("array<double>")
    probs = tuple(float(x) / sum(probs) for x in probs)
    ordinary = min(FIRST_ORDINARY, n_words - 1)
    array = F.col("__ids")
    n, budget = F.size(array), F.ceil(F.size(array) * F.lit(float(p))).cast("int")

    def length(j: Column) -> Column:
        return let(uniform(f"{seed}l", row_id, j), lambda u: F.size(F.filter(bounds, lambda b: b <= u)))

    def drawn(name: str, end: Column) -> Column:
        """(draw, place) of the places from 1 up to, but without, `end`."""
        return F.transform(_numbers(F.lit(1), end), lambda i: F.struct(uniform(f"{seed}{name}", row_id, i).alias("u"), i.alias("at")))

    def survivors(starts: Column, spans: Column) -> Column:
        """Ids outside all tails; `starts` are the (draw, place) pairs of the spans, lowest first."""
        tails = F.zip_with(starts, F.slice(spans, F.lit(1), F.size(starts)), lambda s, x: _numbers(s["at"] + 1, F.least(s["at"] + x, n - 1)))
        noisy = lambda x, i: _masked(x, uniform(f"{seed}k", row_id, i), uniform(f"{seed}r", row_id, i), probs, n_words)

        def joined(places: Column) -> Column:
            at = F.transform(starts, lambda s: s["at"])
            plain = F.transform(F.array_except(places, at), lambda i: F.struct(i.alias("at"), F.get(array, i).alias("id")))
            heads = F.transform(F.array_intersect(at, places), lambda i: F.struct(i.alias("at"), noisy(F.get(array, i), i).alias("id")))
            return F.transform(F.array_sort(F.concat(plain, heads)), lambda x: x["id"])

        return let(F.array_except(_numbers(F.lit(0), n), F.flatten(tails)), joined)

    def with_insertions(kept: Column) -> Column:
        added = F.transform(
            F.slice(F.array_sort(drawn("i", F.size(kept) + F.col("__empty") - 1)), F.lit(1), F.col("__empty")),
            lambda d: F.struct(
                d["at"].alias("at"),
                F.when(uniform(f"{seed}w", row_id, d["at"]) >= word_rand, F.lit(MASK))
                .otherwise((ordinary + F.floor(uniform(f"{seed}o", row_id, d["at"]) * (n_words - ordinary))).cast("int")).alias("id"),
            ),
        )

        def merged(new: Column) -> Column:
            free = F.array_except(_numbers(F.lit(0), F.size(kept) + F.size(new)), F.transform(new, lambda x: x["at"]))
            old = F.zip_with(free, kept, lambda at, x: F.struct(at.alias("at"), x.alias("id")))
            return F.transform(F.array_sort(F.concat(old, new)), lambda x: x["id"])

        return let(added, merged)

    lengths = df.select(row_id, _col(ids).alias("__ids")).withColumn("__drawn", F.transform(_numbers(F.lit(0), budget), length))
    spent = lengths.withColumn("__spent", _running("__drawn"))
    before = F.zip_with("__spent", "__drawn", lambda s, x: s - x)
    spans = F.filter(F.zip_with("__drawn", before, lambda x, s: F.least(x, budget - s)), lambda x: x > 0)
    empty = F.filter(F.zip_with("__drawn", before, lambda x, s: (x == 0) & (s < budget)), lambda hit: hit)
    planned = spent.select(row_id, "__ids", F.size(empty).alias("__empty"), spans.alias("__spans"))
    result = let(
        F.col("__spans"),
        lambda spans: let(F.slice(F.array_sort(drawn("s", n - 1)), F.lit(1), F.size(spans)), lambda starts: let(survivors(starts, spans), with_insertions)),
    )
    return planned.select(row_id, F.when(array.isNotNull(), result).alias("ids"))


def add_noise(df: DataFrame, row_id: str, ids: str, shuffle_k: float, dropout: float, blank: float, seed: int = 0, n_words: int = FIRST_ORDINARY, **span) -> DataFrame:
    """Shuffle, then dropout, then blanks or spans."""
    steps = [
        lambda c: word_shuffle(c, row_id, shuffle_k, f"{seed}s"),
        lambda c: word_dropout(c, row_id, dropout, f"{seed}d"),
    ]
    noisy = df
    for step in steps:  # one projection each, so that no expression is evaluated twice
        noisy = noisy.withColumn(ids, step(F.col(ids)))
    return span_mask(noisy, row_id, ids, blank, n_words, seed=f"{seed}b", **span)


# --- name restoration -------------------------------------------------------------------


def deobfuscate_occurrences(df: DataFrame, row_id: str, tokens: str, dictionary: str, p: float, seed: int = 0) -> DataFrame:
    """Give each single occurrence of a placeholder its name back with probability p."""
    def restore(names: Column) -> Column:
        return F.transform(
            tokens,
            lambda t, i: F.when(uniform(seed, row_id, i) <= p, F.coalesce(F.try_element_at(names, t), t)).otherwise(t),
        )

    return df.select(row_id, let(parse_dictionary(dictionary), restore).alias("tokens"))


def deobfuscate_identifiers(
    df: DataFrame, row_id: str, tokens: str, dictionary: str, p: float, max_len: int, seed: int = 0
) -> DataFrame:
    """Give whole identifiers their names back with probability p; at least one stays
    hidden (the one with the highest draw). The dictionary keeps only hidden ones; results
    of `max_len` or more tokens are dropped."""
    entries = F.transform(
        F.map_entries(parse_dictionary(dictionary)),
        lambda e: F.struct(uniform(seed, row_id, e["key"]).alias("u"), e["key"].alias("key"), e["value"].alias("value")),
    )

    def as_map(chosen: Column) -> Column:
        return F.map_from_entries(F.transform(chosen, lambda e: F.struct(e["key"], e["value"])))

    def restore(drawn: Column) -> Column:
        def split(top: Column) -> Column:
            shown = lambda e: (e["u"] <= p) & ((top["u"] > p) | (e["key"] != top["key"]))
            text = let(
                as_map(F.filter(drawn, shown)),
                lambda names: F.flatten(F.transform(tokens, lambda t: F.split(F.coalesce(F.try_element_at(names, t), t), " "))),
            )
            hidden = as_map(F.filter(drawn, lambda e: ~shown(e)))
            return F.struct(text.alias("tokens"), format_dictionary(hidden).alias("dictionary"))

        return let(F.array_max(drawn), split)

    out = df.select(row_id, let(entries, restore).alias("__r")).select(row_id, "__r.tokens", "__r.dictionary")
    return out.filter(F.size("tokens") < max_len)
