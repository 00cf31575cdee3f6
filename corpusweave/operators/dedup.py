"""Exact duplicate removal.

All variants aggregate on a fixed-width hash with map-side combine, so that a text copied a
billion times still reaches its reducer as a few partial rows; texts themselves move at most
once, in the semi join on the unique row id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import content_id


def _winners(df: DataFrame, keys: list, row_id: str, order: Column | None) -> DataFrame:
    first = F.min(row_id) if order is None else F.min_by(F.col(row_id), order)
    return df.groupBy(*keys).agg(first.alias(row_id)).select(row_id)


def dedup_by_key(df: DataFrame, keys: list, row_id: str, order: Column | None = None) -> DataFrame:
    """Keep, for every key, the row that comes first (lowest `row_id`, or lowest `order`)."""
    return df.join(_winners(df, keys, row_id, order), row_id, "left_semi")


def dedup_content(
    df: DataFrame,
    text: str,
    row_id: str,
    scope: list[str] | None = None,
    order: Column | None = None,
) -> DataFrame:
    """Keep the first row of every distinct text inside each scope (language, view)."""
    return dedup_by_key(df, [*(scope or []), content_id(text).alias("__hash")], row_id, order)


def split_repo_line(df: DataFrame, line: str) -> DataFrame:
    """`repo | content` lines → columns `repo`, `content`, cut at the first `|`.

    Lines without `|`, or without `/` before it, carry no id and are dropped. Both parts
    keep the blanks around the bar."""
    value = F.col(line)
    at = F.instr(value, "|")
    repo = F.substring(value, F.lit(1), at - 1)
    return df.filter((at > 0) & repo.contains("/")).withColumns(
        {"repo": repo, "content": F.substring(value, at + 1, F.length(value))}
    )


def dedup_lines(
    df: DataFrame, line: str, row_id: str, scope: list[str] | None = None, order: Column | None = None
) -> DataFrame:
    """`dedup_content` on the content part of `repo | content` lines."""
    return dedup_content(split_repo_line(df, line), "content", row_id, scope, order)


def dedup_parallel(
    df: DataFrame, lead: str, row_id: str, scope: list[str] | None = None, order: Column | None = None
) -> DataFrame:
    """Views of a document sit in one row, so dropping a duplicate of the lead view drops
    the same line of every other view."""
    return dedup_content(df, lead, row_id, scope, order)


def dedup_pairs(df: DataFrame, source: str, target: str, row_id: str, scope: list[str] | None = None) -> DataFrame:
    """Drop pairs with an empty side, then keep the first of equal `source‖target` texts.
    There is no separator in the hash: ("ab","c") and ("a","bc") are one pair."""
    full = df.filter((F.col(source) != "") & (F.col(target) != ""))
    key = content_id(F.concat(F.col(source), F.col(target))).alias("__hash")
    return dedup_by_key(full, [*(scope or []), key], row_id)


def distinct_rows(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    return df.select(*columns).dropDuplicates() if columns else df.dropDuplicates()


def dedup_report(df: DataFrame, text: str, group: list[str]) -> DataFrame:
    """Rows before, after and removed per group; two levels keep hot groups spread out."""
    per_hash = df.groupBy(*group, content_id(text).alias("__hash")).agg(F.count(F.lit(1)).alias("n"))
    return per_hash.groupBy(*group).agg(
        F.sum("n").alias("before"),
        F.count(F.lit(1)).alias("after"),
        (F.sum("n") - F.count(F.lit(1))).alias("duplicates"),
    )
