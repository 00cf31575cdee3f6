"""Right/wrong pairs from candidates and test outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import dedup, evaluate, filters, joins, splits


def translation_pairs(functions: DataFrame, runs: DataFrame, source_lang: str, target_lang: str) -> DataFrame:
    """Source functions beside their shortest passing translation, languages in order."""
    best = evaluate.shortest_success(runs).withColumnRenamed("code", "translated")
    both = functions.select("func_id", "code").join(best, "func_id").select(
        "func_id", F.lit(source_lang).alias("a"), F.lit(target_lang).alias("b"), "code", "translated"
    )
    return joins.canonical_pairs(both, "a", "b", "code", "translated")


def _padded(column: str, width: int) -> Column:
    """Digits in order of value; a longer id is kept whole."""
    text = F.col(column).cast("string")
    return F.lpad(text, F.greatest(F.length(text), F.lit(width)), F.lit("0"))


def correction_pairs(runs: DataFrame, train_share: float = 0.6) -> DataFrame:
    """Failed candidates beside the first passing one: unchanged and repeated pairs go, the
    first share in (function, candidate) order is `train`."""
    found = joins.success_failure_pairs(runs)
    changed = filters.drop_identical_pairs(found, "failure", "success")
    keyed = changed.withColumn("pair_id", F.concat_ws("-", _padded("func_id", 12), _padded("failed_beam", 6)))
    unique = dedup.dedup_pairs(keyed, "failure", "success", "pair_id")
    return splits.split_ordered(unique, ["pair_id"], train_share)
