"""Outcomes of test runs, read from printed text. Text is parsed, never evaluated."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .hashing import _col

# Line beginnings printed by the unit-test tools, and the script marker.
GTEST_TOTAL = r"\[==========\] "
GTEST_PASSED = r"[  PASSED  ]"
GTEST_FAILED = "FAILED TEST"
RESULT_MARK = "#Results:"


def _outcome(status: Column, tests: Column, failures: Column) -> Column:
    return F.struct(
        status.alias("status"), tests.cast("int").alias("n_tests"), failures.cast("int").alias("n_failures")
    )


def _lines(text: Column) -> Column:
    """Lines without the empty piece behind a final line break."""
    return F.split(F.regexp_replace(text, r"\r?\n\z", ""), r"\r?\n")


def parse_python_run(stderr) -> Column:
    """Last line `OK` or `FAILED (errors=k)`, third-last `Ran n tests in …`."""
    lines = _lines(_col(stderr))
    last, third = F.get(lines, F.size(lines) - 1), F.get(lines, F.size(lines) - 3)
    tests = F.regexp_extract(third, r"^Ran (\d+) ", 1)
    failed = F.regexp_extract(last, r"^FAILED \((?:errors|failures)=.*?(\d+)\)?$", 1)
    long_enough = F.size(lines) > 2
    return F.when(
        long_enough & last.startswith("OK") & (tests != ""),
        _outcome(F.lit("success"), tests, F.lit(0)),
    ).when(
        long_enough & (failed != "") & (tests != ""), _outcome(F.lit("failure"), tests, failed)
    ).otherwise(_outcome(F.lit("error"), F.lit(None), F.lit(None)))


def parse_cpp_run(stdout) -> Column:
    """Last line says passed or counts failed tests; the last total line gives n."""
    lines = _lines(_col(stdout))
    last = F.get(lines, F.size(lines) - 1)
    totals = F.filter(lines, lambda l: l.rlike(f"^{GTEST_TOTAL}"))
    tests = F.regexp_extract(F.get(totals, F.size(totals) - 1), rf"^{GTEST_TOTAL}(\d+)", 1)
    failed = F.regexp_extract(last, r"^\s*(\d+)\s", 1)
    known = (F.size(lines) > 2) & (F.size(totals) > 0)
    return F.when(
        known & last.startswith(GTEST_PASSED), _outcome(F.lit("success"), tests, F.lit(0))
    ).when(
        known & last.contains(GTEST_FAILED) & (failed != ""),
        _outcome(F.lit("failure"), tests, failed),
    ).otherwise(_outcome(F.lit("error"), F.lit(None), F.lit(None)))


def parse_script_run(stdout) -> Column:
    """`#Results:a,b` at the end: success when a = b."""
    text = _col(stdout)
    tail = F.substring_index(text, RESULT_MARK, -1)
    good = F.regexp_extract(tail, r"^\s*(-?\d+)\s*,\s*(-?\d+)\s*$", 1)
    total = F.regexp_extract(tail, r"^\s*(-?\d+)\s*,\s*(-?\d+)\s*$", 2)
    failures = total.try_cast("int") - good.try_cast("int")
    status = (
        F.when(total == "", F.lit("error"))
        .when(failures == 0, F.lit("success"))
        .otherwise(F.lit("failure"))
    )
    return _outcome(status, total.try_cast("int"), failures)


def parse_outcome(text, flavour: str) -> Column:
    return {"python": parse_python_run, "cpp": parse_cpp_run, "script": parse_script_run}[flavour](text)


def parse_result_tuple(value) -> Column:
    """`('success', 3, 0)` → struct(status, n_tests, detail); the detail may be any text."""
    pattern = r"(?s)^\s*\(\s*['\"]([^'\"]*)['\"]\s*,\s*([^,]*?)\s*,\s*(.*?)\s*\)\s*$"
    text = _col(value)
    detail = F.regexp_extract(text, pattern, 3)
    return F.struct(
        F.regexp_extract(text, pattern, 1).alias("status"),
        F.regexp_extract(text, pattern, 2).try_cast("int").alias("n_tests"),
        F.regexp_replace(detail, r"(?s)^(['\"])(.*)\1$", "$2").alias("detail"),
    )
