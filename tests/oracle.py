"""Run registered queries next to their SQL twins in DuckDB and compare whole results."""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(sf_dir: str):
    db = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return db


def _norm(value):
    if value is None:
        return "∅"
    if isinstance(value, float):
        if math.isnan(value):
            return "NaN"
        return repr(round(value, 9) + 0.0)
    if isinstance(value, bool):
        return str(value)
    if type(value).__name__ == "Decimal":
        return f"decimal:{value}"
    return f"{type(value).__name__}:{value}"


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_norm(r[i]) for i in order) for r in rows)


def compare(spark, db, name, fn, sql, sf_dir):
    """Return (message or None, seconds, rows)."""
    start = time.time()
    df = fn(spark, sf_dir)
    data = df.collect()
    seconds = time.time() - start
    if sql is None:
        return (None if data else "no rows"), seconds, len(data)
    cursor = db.execute(sql)
    names = [d[0] for d in cursor.description]
    expected = cursor.fetchall()
    left, right = rows_of(df.columns, data), rows_of(names, expected)
    if left[0] != right[0]:
        return f"columns {left[0]} vs {right[0]}", seconds, len(data)
    if len(left[1]) != len(right[1]):
        return f"{len(left[1])} rows vs {len(right[1])}", seconds, len(data)
    wrong = [(a, b) for a, b in zip(left[1], right[1]) if a != b]
    if wrong:
        return f"{len(wrong)} rows differ, first {str(wrong[0][0])[:600]} | {str(wrong[0][1])[:600]}", seconds, len(data)
    return None, seconds, len(data)


def main():
    import re

    import __spark_entry__ as entry
    from corpusweave.session import build_session

    pattern = sys.argv[1] if len(sys.argv) > 1 else "."
    sf_dir = f"/root/testdata/sf{sys.argv[2] if len(sys.argv) > 2 else '0.01'}"
    spark, db = build_session("oracle", 8), connect(sf_dir)
    oracles, bad = entry.oracle_sql(), 0
    for name, fn in entry.queries().items():
        if pattern.startswith("mod:"):
            if fn.__module__.rsplit(".", 1)[-1] not in pattern[4:].split(","):
                continue
        elif not re.search(pattern, name):
            continue
        try:
            message, seconds, rows = compare(spark, db, name, fn, oracles.get(name), sf_dir)
        except Exception as error:  # report and go on with the next query
            message, seconds, rows = f"{type(error).__name__}: {str(error)[:1500]}", 0.0, 0
        bad += message is not None
        kind = "sql " if name in oracles else "rows"
        print(f"{'ok  ' if message is None else 'FAIL'} {kind} {name:32s} {rows:8d} rows {seconds:7.2f}s {message or ''}", flush=True)
    print("failures:", bad)


if __name__ == "__main__":
    main()
