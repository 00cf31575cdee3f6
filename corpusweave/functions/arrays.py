"""Functions on arrays of token ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .hashing import _col

# Special ids.
BOS, EOS, PAD, UNK = 0, 1, 2, 3
FIRST_SPECIAL = 4
SPECIAL_WORDS = 10
MASK = 5


def wrap_ids(ids) -> Column:
    return F.concat(F.array(F.lit(EOS)), _col(ids), F.array(F.lit(EOS)))


def truncate_ids(ids, max_len: int) -> Column:
    """Cut to `max_len`; a cut sequence still ends in the end mark."""
    array = _col(ids)
    cut = F.concat(F.slice(array, 1, max_len - 1), F.array(F.lit(EOS)))
    return F.when(F.size(array) > max_len, cut).otherwise(array)


def pad_right(ids, length) -> Column:
    array = _col(ids)
    missing = F.greatest((F.lit(length) if isinstance(length, int) else length) - F.size(array), F.lit(0))
    return F.concat(array, F.array_repeat(F.lit(PAD), missing))


def pad_ids(ids, max_len: int) -> Column:
    """End marks on both sides, cut to `max_len`, padded to `max_len`."""
    return pad_right(truncate_ids(wrap_ids(ids), max_len), max_len)


def concat_pair(left, right, left_lang: int, right_lang: int, reset_positions: bool = True) -> Column:
    """Two wrapped sequences in one: struct(ids, positions, langs).

    With `reset_positions` the second part counts from zero; without, the two share one
    end mark (four end marks against three)."""
    a, b = _col(left), _col(right)
    keep = F.size(a) if reset_positions else F.size(a) - 1
    ids = F.concat(F.slice(a, F.lit(1), keep), b)
    if reset_positions:
        positions = F.concat(
            F.sequence(F.lit(0), F.size(a) - 1), F.sequence(F.lit(0), F.size(b) - 1)
        )
    else:
        positions = F.sequence(F.lit(0), keep + F.size(b) - 1)
    langs = F.concat(
        F.array_repeat(F.lit(left_lang), keep), F.array_repeat(F.lit(right_lang), F.size(b))
    )
    return F.struct(ids.alias("ids"), positions.alias("positions"), langs.alias("langs"))


def split_sentence_id(ids, separator: int) -> Column:
    """`id… separator sentence…` → struct(head, tail) at the first separator."""
    array = _col(ids)
    at = F.array_position(array, separator).cast("int")
    return F.struct(
        F.slice(array, F.lit(1), F.greatest(at - 1, F.lit(0))).alias("head"),
        F.slice(array, at + 1, F.size(array)).alias("tail"),
    )


def until_eos(ids) -> Column:
    """Drop the first id, stop before the first end mark after it."""
    array = _col(ids)
    tail = F.slice(array, F.lit(2), F.size(array))
    at = F.array_position(tail, EOS).cast("int")
    return F.when(at > 0, F.slice(tail, F.lit(1), F.greatest(at - 1, F.lit(0)))).otherwise(tail)
