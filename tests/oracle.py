"""Runs registered queries next to their DuckDB text and compares columns, types and rows.

``python -m tests.oracle [--sf DIR] [name ...]`` checks the named queries (default: all).
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import sys
import time
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def kind(value) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "bool"
    if isinstance(value, int):
        return "int"
    if isinstance(value, (float, decimal.Decimal)):
        return "float" if isinstance(value, float) else "decimal"
    if isinstance(value, (dt.datetime, dt.date, str)):
        return type(value).__name__
    return type(value).__name__


def plain(value):
    if isinstance(value, float) and math.isnan(value):
        return "NaN"
    if isinstance(value, float) and value == 0:
        return 0.0
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    names = [columns[i] for i in order]
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    kinds = {n: sorted({kind(r[j]) for r in out} - {"null"}) for j, n in enumerate(names)}
    return names, kinds, Counter(out)


def compare(df, con, sql: str) -> str | None:
    """None when equal, else what differs."""
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    result = con.execute(sql)
    want = rows_of([d[0] for d in result.description], result.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}"
    if got[1] != want[1]:
        return f"types {[(k, v, want[1][k]) for k, v in got[1].items() if v != want[1][k]]}"
    if got[2] != want[2]:
        extra, missing = got[2] - want[2], want[2] - got[2]
        return f"rows {sum(got[2].values())} vs {sum(want[2].values())}; only spark {list(extra)[:3]}; only duckdb {list(missing)[:3]}"
    if not got[2]:
        return "empty"
    return None


def main(argv: list[str]) -> int:
    import __spark_entry__ as entry

    from seacast.session import build_session

    sf = "/root/testdata/sf0.01"
    if argv and argv[0] == "--sf":
        sf, argv = argv[1], argv[2:]
    spark = build_session(
        master="local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false", spark__ui__showConsoleProgress="false", spark__driver__memory="8g"
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    bad = 0
    for name, fn in entry.queries().items():
        if argv and name not in argv:
            continue
        start = time.time()
        try:
            df = fn(spark, sf)
            sql = entry.oracle_sql().get(name)
            problem = compare(df, con, sql) if sql else (f"rows {df.count()}" if df.count() == 0 else None)
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        bad += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} {time.time() - start:.2f}s {problem or ('' if sql else '(rows only)')}", flush=True)
    print(f"{bad} failed")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
