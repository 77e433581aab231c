"""Runs a query on Spark and its SQL on DuckDB over the same files and compares the rows."""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb


def connect(root: str):
    connection = duckdb.connect()
    for path in glob.glob(f"{root}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return connection


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9)
    if hasattr(value, "normalize") and not isinstance(value, str):
        return float(value)
    return value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_cell(row[i]) for i in order) for row in rows), key=repr), sorted(columns)


def compare(spark, connection, name, function, sql, root):
    """(spark row count, problem or None)."""
    df = function(spark, root)
    got, got_columns = _rows(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return len(got), None
    cursor = connection.execute(sql)
    names = [d[0] for d in cursor.description]
    want, want_columns = _rows(names, cursor.fetchall())
    if got_columns != want_columns:
        return len(got), f"columns {got_columns} != {want_columns}"
    if len(got) != len(want):
        extra = [r for r in got if r not in want][:2]
        lack = [r for r in want if r not in got][:2]
        return len(got), f"{len(got)} rows, expected {len(want)}; extra {extra} lacking {lack}"
    for mine, theirs in zip(got, want):
        if mine != theirs:
            return len(got), f"{got_columns}: {mine} != {theirs}"
        if any(isinstance(x, bool) != isinstance(y, bool) for x, y in zip(mine, theirs)):
            return len(got), f"types {mine} {theirs}"
    return len(got), None


def main(root: str, wanted: list[str]):
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from cartorio.session import build_session

    spark = build_session("check", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false", spark__driver__memory="8g", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    connection = connect(root)
    queries, sqls = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in queries:
        if wanted and not any(name == w or (w.endswith("*") and name.startswith(w[:-1])) for w in wanted):
            continue
        start = time.time()
        try:
            count, problem = compare(spark, connection, name, queries[name], sqls.get(name), root)
        except Exception as error:  # noqa: BLE001
            count, problem = -1, f"{type(error).__name__}: {str(error)[:700]}"
        bad += problem is not None
        print(f"{'OK ' if problem is None else 'BAD'} {name:32} {count:8} {time.time() - start:6.2f}s {'' if name in sqls else '(rows only)'} {problem or ''}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2:])
