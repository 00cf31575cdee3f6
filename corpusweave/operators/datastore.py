"""Token-level datastore: building, cutting down, fragments, identifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import EOS, UNK
from ..functions.binding import let
from ..functions.text import NAME_PREFIXES, format_dictionary, parse_dictionary, words
from .vocab import lookup_tokens

END_WORD = "</s>"  # fixed value


def build_datastore(
    pairs: DataFrame, vocab: DataFrame, pair_id: str = "pair_id", source: str = "source", target: str = "target",
    features: str | None = None, model_max: int = 512,
) -> DataFrame:
    """One row per target token and one for the end mark: (pair, pos, value, source, prefix,
    key). `features` holds one vector per position.

    A target is cut to `min(model max, 3·(source + 2) + 10)` positions whose last is the end
    mark, so every pair ends in exactly one end row."""
    body = _body(source, target, model_max)
    kept = [c for c in pairs.columns if c not in {pair_id, source, target, features}]
    rows = pairs.select(
        pair_id, *kept, source, body.alias("__t"), *([features] if features else []),
    ).select("*", F.posexplode(F.array_append("__t", F.lit(END_WORD))).alias("pos", "token"))
    prefix = F.array_join(F.slice("__t", F.lit(1), F.col("pos")), " ")
    wanted = rows.select(
        pair_id, *kept, "pos", "token", source, prefix.alias("prefix"),
        *([F.get(features, F.col("pos")).alias("key")] if features else []),
    )
    joined = lookup_tokens(wanted, "token", vocab, "__id")
    return joined.withColumn("value", F.coalesce("__id", F.lit(UNK))).drop("__id")


def eos_rows(store: DataFrame, value: str = "value") -> DataFrame:
    return store.filter(F.col(value) == EOS)


def _neighbours(store: DataFrame, pair_id: str, pos: str, value: str) -> DataFrame:
    """Value of the next position. A pair has at most `model max` rows, so its window is small."""
    order = Window.partitionBy(pair_id).orderBy(pos)
    return store.withColumn("__next", F.lead(value).over(order))


def pre_eos_rows(store: DataFrame, pair_id: str = "pair_id", pos: str = "pos", value: str = "value") -> DataFrame:
    """Rows whose next value is the end mark and that are no end rows themselves."""
    near = _neighbours(store, pair_id, pos, value)
    return near.filter((F.col(value) != EOS) & (F.col("__next") == EOS)).drop("__next")


def eos_context(store: DataFrame, pair_id: str = "pair_id", pos: str = "pos", value: str = "value") -> DataFrame:
    """Every end row and, once per end row, the row before it. Consecutive end rows of two
    pairs make the first one appear twice, as the last row before the second."""
    columns = store.columns
    near = _neighbours(store, pair_id, pos, value)
    ends = near.filter(F.col(value) == EOS).select(*columns)
    before = near.filter(F.col("__next") == EOS).select(*columns)
    # a pair that starts with its end row is preceded by the end row of the pair before it
    starts = store.filter((F.col(value) == EOS) & (F.col(pos) == 0)).select(F.col(pair_id).alias("__after"))
    ids = store.select(pair_id).distinct()
    previous = starts.join(_previous_ids(ids, pair_id), "__after").select(pair_id)
    across = ends.join(previous, pair_id)
    return ends.unionByName(before).unionByName(across.select(*columns))


def _previous_ids(ids: DataFrame, pair_id: str) -> DataFrame:
    """(pair, following pair) in global order, by two equi-joined row indexes."""
    from .ordering import with_row_index

    numbered = with_row_index(ids, [pair_id], "__n")
    following = numbered.select((F.col("__n") - 1).alias("__n"), F.col(pair_id).alias("__after"))
    return numbered.join(following, "__n").select(pair_id, "__after")


def _body(source: str, target: str, model_max: int) -> Column:
    """Target tokens that a pair's rows stand for, without the end mark."""
    tokens = words(target)
    limit = F.least(F.lit(model_max), 3 * (F.size(words(source)) + 2) + 10)
    return F.slice(tokens, F.lit(1), F.least(F.size(tokens), limit - 1))


def fragment_pairs_of(pairs: DataFrame, source: str = "source", target: str = "target", model_max: int = 512) -> DataFrame:
    """What `fragment_pairs` gives for the (source, prefix) rows of a datastore, cut by position
    from the tokens of each pair: a text is split once, not once per row made of it."""
    tokens = pairs.select(words(source).alias("f"), _body(source, target, model_max).alias("t")).filter(F.size("f") > 0)

    def at(f: Column, t: Column, n: Column) -> Column:
        short = n <= 4
        return F.struct(
            F.when(short, f).otherwise(F.slice(f, F.greatest(n - 3, F.lit(1)), F.lit(8))).alias("f"),
            F.when(short, F.slice(t, F.lit(1), n)).otherwise(F.slice(t, F.greatest(n - 3, F.lit(1)), F.lit(4))).alias("s"),
        )

    # prefixes beyond the source's end have nothing to stand against
    last = F.least(F.size("t"), F.greatest(F.lit(4), F.size("f") + 3))
    cut = tokens.withColumn("n", F.explode(F.sequence(F.lit(0), last))).select(at(F.col("f"), F.col("t"), F.col("n")).alias("c"))
    cut = cut.filter(F.size("c.f") > 0)
    return cut.select(
        F.array_join("c.f", " ").alias("fail_fragment"), F.array_join("c.s", " ").alias("succ_fragment")
    ).dropDuplicates()


def fragment_pairs(df: DataFrame, fail: str = "fail_input", success: str = "succ_prefix") -> DataFrame:
    """Distinct (fail, success) fragments. Success of up to four tokens: both sides whole;
    longer: its last four tokens and the fail tokens `n−4 … n+3` of the same place."""
    f, s = words(fail), words(success)
    n = F.size("s")
    tokens = df.select(f.alias("f"), s.alias("s")).filter(F.size("f") > 0)
    window = F.when(n <= 4, F.col("f")).otherwise(F.slice("f", n - 3, F.lit(8)))
    last = F.when(n <= 4, F.col("s")).otherwise(F.slice("s", -4, 4))
    cut = tokens.select(window.alias("f"), last.alias("s")).filter(F.size("f") > 0)
    return cut.select(
        F.array_join("f", " ").alias("fail_fragment"), F.array_join("s", " ").alias("succ_fragment")
    ).dropDuplicates()


PLACEHOLDER = r"((?:VAR|FUNC|CLASS)_\d+)"


def renumber_identifiers(df: DataFrame, row_id: str, code: str, dictionary: str) -> DataFrame:
    """Dense new numbers per prefix in order of first appearance; dictionary re-keyed.

    All work is inside the row: distinct placeholders keep first-appearance order, and a new
    number is the position among those with the same prefix."""
    marks = F.regexp_extract_all(code, F.lit(PLACEHOLDER), F.lit(1))
    # the text between placeholders, so that each placeholder is replaced exactly once
    between = F.split(code, PLACEHOLDER.replace("((?:", "(?:").removesuffix(")"), -1)

    def numbered(found: Column, prefix: str) -> Column:
        same = F.filter(found, lambda name: name.startswith(prefix))
        return F.transform(same, lambda name, i: F.struct(name.alias("old"), F.concat(F.lit(prefix), i).alias("new")))

    def names_of(found: Column) -> Column:
        return F.map_from_entries(F.concat(*[numbered(found, prefix) for prefix in NAME_PREFIXES]))

    def rewrite(names: Column) -> Column:
        text = let(
            marks,
            lambda m: F.transform(
                between, lambda part, i: F.concat(part, F.coalesce(F.try_element_at(names, F.get(m, i)), F.lit("")))
            ),
        )
        fresh = let(
            parse_dictionary(dictionary),
            lambda old: F.map_from_entries(
                F.transform(F.map_entries(names), lambda e: F.struct(e["value"], F.try_element_at(old, e["key"])))
            ),
        )
        return F.struct(F.array_join(text, "").alias("code"), format_dictionary(fresh).alias("dictionary"))

    renamed = let(let(F.array_distinct(marks), names_of), rewrite)
    return df.select(row_id, renamed.alias("__r")).select(row_id, "__r.code", "__r.dictionary")
