"""Row filters, quality reports and corpus checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.code import assert_count, too_many_identifiers
from ..functions.hashing import _col


def _all(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def ingest_status(payload, repo, timed_out: Column, filtered: Column, multiline: Column | None = None) -> Column:
    """One status per document: timeout, error (no payload or repository), multiline,
    filtered, ok."""
    text, name = _col(payload), _col(repo)
    broken = text.isNull() | (F.length(text) == 0) | name.isNull()
    lines = text.contains("\n") if multiline is None else multiline
    return (
        F.when(timed_out, "timeout").when(broken, "error").when(lines, "multiline")
        .when(filtered, "filtered").otherwise("ok")
    )


def ingest_report(
    df: DataFrame, lang: str, payload: str, repo: str, timed_out: Column | None = None, filtered: Column | None = None
) -> DataFrame:
    """Count and share of every status per language."""
    none = F.lit(False)
    status = ingest_status(payload, repo, none if timed_out is None else timed_out, none if filtered is None else filtered)
    counts = df.groupBy(lang, status.alias("status")).agg(F.count(F.lit(1)).alias("n"))
    per_lang = Window.partitionBy(lang)  # five statuses per language
    return counts.withColumn("ratio", F.col("n") / F.sum("n").over(per_lang))


def valid_parallel(df: DataFrame, views: list[str]) -> DataFrame:
    """Keep rows whose views are all present and have equally many items."""
    present = [F.col(v).isNotNull() for v in views]
    same = [F.size(views[0]) == F.size(v) for v in views[1:]]
    return df.filter(_all(present + same))


def drop_identifier_outliers(df: DataFrame, dictionary: str) -> DataFrame:
    """Drop documents with too many placeholders; for an array of dictionaries (one per
    function) any one of them drops the whole document."""
    if dict(df.dtypes)[dictionary].startswith("array"):
        return df.filter(~F.exists(dictionary, too_many_identifiers))
    return df.filter(~too_many_identifiers(dictionary))


def strong_tests(
    df: DataFrame, score: str, above: float | None = None, at_least: float | None = None,
    asserts: str | None = None, min_asserts: int = 0,
) -> DataFrame:
    """`above` is the strict selection threshold, `at_least` the inclusive training one."""
    conditions = [F.col(score).isNotNull()]
    if above is not None:
        conditions.append(F.col(score) > above)
    if at_least is not None:
        conditions.append(F.col(score) >= at_least)
    if asserts is not None:
        conditions.append(F.col(asserts) >= min_asserts)
    return df.filter(_all(conditions))


def multi_assert(df: DataFrame, python_test: str) -> DataFrame:
    """Rows whose Python test asserts more than once; other languages share the row."""
    return df.filter(assert_count(python_test) > 1)


def removed_share(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: rows before, rows after, share removed."""
    counts = before.select(F.lit(1).alias("b"), F.lit(0).alias("a")).unionByName(
        after.select(F.lit(0).alias("b"), F.lit(1).alias("a"))
    )
    total = counts.agg(F.sum("b").alias("before"), F.sum("a").alias("after"))
    return total.withColumn("removed_share", 1 - F.col("after") / F.col("before"))


def filter_lengths(df: DataFrame, arrays: list[str], max_len: int) -> DataFrame:
    """Every given sequence must be non-empty and, unless `max_len` is 0, short enough."""
    conditions = [F.size(a) > 0 for a in arrays]
    if max_len > 0:
        conditions += [F.size(a) <= max_len for a in arrays]
    return df.filter(_all(conditions))


def drop_identical_pairs(df: DataFrame, original: str, translated: str) -> DataFrame:
    return df.filter(F.trim(original) != F.trim(translated))


def guard_length(result, n_tokens: Column, max_len: int) -> Column:
    message = F.concat(F.lit("Error: input too long: "), n_tokens)
    return F.when(n_tokens + 2 > max_len, message).otherwise(_col(result))


def keep_existing(df: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    return df.join(existing.select(key), key, "left_semi")


def missing_report(df: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    known = existing.select(key).distinct().withColumn("__known", F.lit(1))
    joined = df.select(key).join(known, key, "left")
    total, found = F.count(F.lit(1)), F.count("__known")
    return joined.agg(
        total.alias("total"), (total - found).alias("missing"), ((total - found) / total).alias("missing_share")
    )


# Checks return one row per violation: (rule, detail). An empty result means a sound corpus.


def check_line_counts(tables: dict[str, DataFrame]) -> DataFrame:
    sides = [df.select(F.lit(name).alias("name")) for name, df in tables.items()]
    counts = reduce(DataFrame.unionByName, sides).groupBy("name").count()
    summary = counts.agg(
        F.array_sort(F.collect_list(F.concat_ws("=", "name", "count"))).alias("parts"),
        F.countDistinct("count").alias("sizes"),
        F.count(F.lit(1)).alias("tables"),
    )
    return summary.filter((F.col("sizes") > 1) | (F.col("tables") < len(tables))).select(
        F.lit("line_count").alias("rule"), F.array_join("parts", " ").alias("detail")
    )


def check_known_keys(df: DataFrame, known: DataFrame, key: str) -> DataFrame:
    missing = df.select(key).distinct().join(known.select(key), key, "left_anti")
    return missing.select(F.lit("unknown_key").alias("rule"), F.col(key).cast("string").alias("detail"))


def check_label_lengths(df: DataFrame, row_id: str, tokens: Column, labels: Column) -> DataFrame:
    wrong = df.filter(F.size(tokens) != F.size(labels))
    return wrong.select(F.lit("label_length").alias("rule"), F.col(row_id).cast("string").alias("detail"))


def check_vocab(vocab: DataFrame, first_ordinary: int) -> DataFrame:
    """Ids must be dense from zero and counts must not rise from `first_ordinary` on.

    Each row meets its neighbour by an equi-join on the id, so no global window is needed."""
    following = vocab.select((F.col("id") - 1).alias("id"), F.col("count").alias("next_count"))
    rising = vocab.filter(F.col("id") >= first_ordinary).join(following, "id").filter(
        F.col("next_count") > F.col("count")
    )
    size = vocab.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("d"), F.min("id").alias("lo"), F.max("id").alias("hi"))
    gaps = size.filter((F.col("d") != F.col("n")) | (F.col("lo") != 0) | (F.col("hi") != F.col("n") - 1))
    return rising.select(
        F.lit("count_rises").alias("rule"), F.col("id").cast("string").alias("detail")
    ).unionByName(gaps.select(F.lit("ids_not_dense").alias("rule"), F.concat_ws(" ", "lo", "hi", "n").alias("detail")))
