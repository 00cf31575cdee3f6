"""Global positions and running totals against sorted lists."""

import itertools

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusweave.operators import ordering

ROWS = [(i, f"g{i % 3}" if i % 7 else None, (i * 37) % 101, None if i % 11 == 0 else i % 5, f"text {i}") for i in range(200)]
SCHEMA = "id long, g string, k int, v int, text string"


def _expected(rows, key, group=None):
    out, ordered = {}, sorted(rows, key=key)
    if group is None:
        groups = [ordered]
    else:
        groups = [list(own) for _, own in itertools.groupby(sorted(ordered, key=lambda r: (group(r) is not None, group(r) or "")), key=group)]
    for own in groups:
        total, most = 0, None
        for rank, r in enumerate(own):
            total += r[3] or 0
            most = r[3] if most is None else most if r[3] is None else max(most, r[3])
            out[r[0]] = (rank, total, most)
    return out


@pytest.mark.parametrize("group", [None, "g"])
@pytest.mark.parametrize("columns", [["id", "g", "k", "v", "text"], ["id", "k", "v"]])
def test_running_values(spark, group, columns):
    if group and "g" not in columns:
        columns = [*columns, "g"]
    df = spark.createDataFrame(ROWS, SCHEMA).repartition(5).select(*columns)
    own = ordering.with_running(df, ["k", "id"], [group] if group else None, {"s": F.col("v")}, {"m": F.col("v")}, "r", "n")
    assert own.columns == [*columns, "s", "m", "r", "n"]
    found = {r.id: (r.r, r.s, r.m) for r in own.collect()}
    assert found == _expected(ROWS, lambda r: (r[2], r[0]), (lambda r: r[1]) if group else None)
    assert {r.n for r in own.collect()} == {len(ROWS)}


def test_texts_do_not_move_with_the_order(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    plan = ordering.with_row_index(df, ["id"], "i")._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan  # it ran before, on narrow rows
    assert [r.text for r in ordering.with_row_index(df, ["id"], "i").orderBy("i").collect()] == [r[4] for r in ROWS]


def test_repeated_keys_keep_every_row(spark):
    rows = [(i % 4, None, 1, 2, f"text {i}") for i in range(40)] + [(None, None, 1, 2, None)] * 2
    found = ordering.with_running(spark.createDataFrame(rows, SCHEMA), ["id"], sums={"s": F.col("v")}, rank="r", total="n").collect()
    assert sorted(r.r for r in found) == list(range(42)) and sorted(r.s for r in found) == [2 * i for i in range(1, 43)]
    assert sorted(str(r.text) for r in found) == sorted(str(r[4]) for r in rows) and found[0].n == 42


def test_expressions_and_falling_order(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    rising = {r.id: r.i for r in ordering.with_row_index(df, [F.xxhash64("id"), "id"], "i").collect()}
    falling = {r.id: r.i for r in ordering.with_row_index(df, [F.desc("id")], "i").collect()}
    assert sorted(rising.values()) == list(range(200)) and falling == {i: 199 - i for i in range(200)}
    none = ordering.with_row_index(df.limit(0), ["id"], "i", "n")
    assert none.count() == 0 and none.columns[-2:] == ["i", "n"]


@pytest.mark.parametrize("combine", [np.add, np.maximum])
def test_runs_that_begin_anew(combine):
    draw = np.random.default_rng(1)
    for _ in range(200):
        values = draw.integers(-9, 9, draw.integers(1, 30))
        starts = np.flatnonzero(draw.random(len(values)) < 0.2)
        carry = np.int64(draw.integers(-9, 9))
        expected, now = [], carry
        for i, v in enumerate(values):
            now = v if i in starts else combine(now, v)
            expected.append(now)
        assert list(ordering._accumulate(values, starts, carry, combine)) == expected


def test_changes_between_rows():
    column = pa.array([1.0, 1.0, None, None, float("nan"), float("nan"), 2.0])
    assert list(ordering._differs(column, None)) == [False, False, True, False, True, False, True]
    assert list(ordering._differs(pa.array(["a", "b"]), pa.array(["a"]))) == [False, True]
