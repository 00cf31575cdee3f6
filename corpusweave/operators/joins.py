"""Joins of functions, tests, translations, snippets and vocabularies."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import id_from_class_name
from .containment import contains_join, select_specific  # noqa: F401  part of this module's interface


def join_tests(tests: DataFrame, functions: DataFrame, class_column: str = "TARGET_CLASS", func_id: str = "func_id") -> DataFrame:
    """Inner equi-join on the function id that the test class name carries."""
    return tests.withColumn(func_id, id_from_class_name(class_column)).join(functions, func_id)


# --- token and lookup joins -------------------------------------------------------------


def append_next_token(prefixes: DataFrame, tokens: DataFrame, index: str, prefix: str, token: str, source: str) -> DataFrame:
    """Extend prefix *i* by token *i*. No prefix: the token alone; no token: a trailing
    blank; neither: the empty string. Rows without a source go, their indexes stay."""
    joined = prefixes.join(tokens.select(index, F.col(token).alias("__token")), index, "left")
    added = F.coalesce(F.col("__token"), F.lit(""))
    text = F.when(F.col(prefix).isNull(), added).otherwise(F.concat(F.col(prefix), F.lit(" "), added))
    return joined.filter(F.col(source).isNotNull()).withColumn(prefix, text).drop("__token")


def lookup_or(df: DataFrame, dimension: DataFrame, key: str, value: str, default: str, missing: str = "missing") -> DataFrame:
    """Left lookup; absent keys and the marker `missing` give the default."""
    clean = dimension.select(key, F.when(F.col(value) != missing, F.col(value)).alias(value))
    return df.join(clean, key, "left").withColumn(value, F.coalesce(F.col(value), F.lit(default)))


def success_failure_pairs(runs: DataFrame, func_id: str = "func_id", beam: str = "beam", status: str = "status", code: str = "code") -> DataFrame:
    """First successful candidate × every failed one of the same function. Time-outs and
    compile errors make no pair."""
    best = runs.filter(F.col(status) == "success").groupBy(func_id).agg(F.min_by(code, beam).alias("success"))
    failed = runs.filter(F.col(status) == "failure").select(func_id, F.col(beam).alias("failed_beam"), F.col(code).alias("failure"))
    return failed.join(best, func_id)


def all_pairs(views: Column | str) -> Column:
    """Array of struct(left, right) for all i < j of one row's views (a handful)."""
    items = F.col(views) if isinstance(views, str) else views
    return F.flatten(
        F.transform(
            items,
            lambda left, i: F.transform(
                F.slice(items, i + 2, F.size(items)),
                lambda right: F.struct(left.alias("left"), right.alias("right")),
            ),
        )
    )


def align_vocab(a: DataFrame, b: DataFrame, token: str = "token", id_column: str = "id", unk: int = 3) -> DataFrame:
    """Id in vocabulary B for every id of A, unknown words to `unk`."""
    other = b.select(token, F.col(id_column).alias("other_id"))
    return a.select(token, id_column).join(other, token, "left").withColumns(
        {"known": F.col("other_id").isNotNull(), "other_id": F.coalesce("other_id", F.lit(unk))}
    )


def vocab_coverage(aligned: DataFrame) -> DataFrame:
    known = F.count_if(F.col("known"))
    return aligned.agg(known.alias("known"), F.count(F.lit(1)).alias("total"), (known / F.count(F.lit(1))).alias("coverage"))


def canonical_pairs(df: DataFrame, lang_a: str, lang_b: str, a: str, b: str) -> DataFrame:
    """Columns swapped where needed so that the languages are in alphabetical order."""
    straight = F.col(lang_a) <= F.col(lang_b)
    pick = lambda x, y: F.when(straight, F.col(x)).otherwise(F.col(y))
    return df.select(
        *[c for c in df.columns if c not in {lang_a, lang_b, a, b}],
        pick(lang_a, lang_b).alias("lang1"), pick(lang_b, lang_a).alias("lang2"),
        pick(a, b).alias("text1"), pick(b, a).alias("text2"),
    )


def both_successful(a: DataFrame, b: DataFrame, lang_a: str, lang_b: str, func_id: str = "func_id", code: str = "code") -> DataFrame:
    """Functions with a successful translation into both languages, in canonical order."""
    left = a.select(func_id, F.lit(lang_a).alias("la"), F.col(code).alias("ca"))
    right = b.select(func_id, F.lit(lang_b).alias("lb"), F.col(code).alias("cb"))
    return canonical_pairs(left.join(right, func_id), "la", "lb", "ca", "cb")


def choose_candidate(beams, neighbours, constrained: bool = False, restricted: bool = True) -> Column:
    """Pick one translation from arrays of struct(code, compiles).

    Beam 0 if it compiles; else (constrained) the first later beam that compiles; else a
    neighbour candidate — the first, or the first that compiles in constrained mode; else
    beam 0. Unrestricted mode takes the neighbour candidate even if beam 0 compiles.
    Result: struct(code, origin)."""
    f = F.col(beams) if isinstance(beams, str) else beams
    n = F.col(neighbours) if isinstance(neighbours, str) else neighbours
    first = F.get(f, F.lit(0))
    later = F.get(F.filter(F.slice(f, F.lit(2), F.size(f)), lambda c: c["compiles"]), F.lit(0))
    usable = F.filter(n, lambda c: c["compiles"]) if constrained else n
    neighbour = F.get(usable, F.lit(0))
    tagged = lambda c, origin: F.struct(c["code"].alias("code"), F.lit(origin).alias("origin"))
    broken = ~first["compiles"]
    may_use = broken if restricted else F.lit(True)
    by_neighbour = F.when(may_use & neighbour.isNotNull(), tagged(neighbour, "neighbour")).otherwise(tagged(first, "beam0"))
    if not constrained:
        return by_neighbour
    return F.when(broken & later.isNotNull(), tagged(later, "constrained")).otherwise(by_neighbour)


def invert_groups(df: DataFrame, group: str, members: str) -> DataFrame:
    """`group → [repos]` rows to (repo, group); a repository in two groups is an error."""
    return df.select(F.explode(members).alias("repo"), F.col(group).alias("group"))


def repeated_members(inverted: DataFrame) -> DataFrame:
    return inverted.groupBy("repo").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def merge_datastores(*stores: DataFrame) -> DataFrame:
    """Union; repeated rows stay."""
    return reduce(DataFrame.unionByName, stores)


def flatten_tokens(df: DataFrame, row_id: str, tokens: str) -> DataFrame:
    """One row per token plus one blank row at the end of every line."""
    return df.select(row_id, F.posexplode(F.array_append(tokens, F.lit(""))).alias("pos", "token"))


def beam_columns(df: DataFrame, prefix: str) -> list[str]:
    """`prefix0, prefix1, …` as long as the numbers are consecutive."""
    names, i = [], 0
    while f"{prefix}{i}" in df.columns:
        names.append(f"{prefix}{i}")
        i += 1
    return names


def beams_to_long(df: DataFrame, keys: list[str], prefix: str, value: str = "value") -> DataFrame:
    wide = beam_columns(df, prefix)
    long = df.unpivot(keys, wide, "__name", value)
    return long.withColumn("beam", F.regexp_extract("__name", rf"^{re.escape(prefix)}(\d+)$", 1).cast("int")).drop("__name")


def beams_to_wide(df: DataFrame, keys: list[str], n_beams: int, prefix: str, value: str = "value") -> DataFrame:
    picks = [F.max(F.when(F.col("beam") == i, F.col(value))).alias(f"{prefix}{i}") for i in range(n_beams)]
    return df.groupBy(*keys).agg(*picks)
