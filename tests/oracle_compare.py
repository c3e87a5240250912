"""Runs registered queries beside their SQL in DuckDB and compares the rows."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import sys
import time

import duckdb

from tablewright.session import TABLES, local_session


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return 0.0 if value == 0 else float(f"{value:.12g}")
    if isinstance(value, decimal.Decimal):
        return ("dec", str(value.normalize()))
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, dt.date):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, sf_dir, run, sql):
    """None when equal, else a short description of the first difference."""
    df = run(spark, sf_dir)
    got_cols, got = df.columns, [tuple(r) for r in df.collect()]
    if sql is None:
        return None if got else "no rows"
    rel = con.sql(sql)
    want_cols, want = rel.columns, rel.fetchall()
    if sorted(got_cols) != sorted(want_cols):
        return f"columns {sorted(got_cols)} != {sorted(want_cols)}"
    a, b = normal(got_cols, got), normal(want_cols, want)
    if a == b:
        return None if a else "both sides are empty"
    if len(a) != len(b):
        extra = [r for r in a if r not in set(b)][:2] if len(a) < 50000 else []
        missing = [r for r in b if r not in set(a)][:2] if len(b) < 50000 else []
        return f"{len(a)} rows != {len(b)}; extra {extra}; missing {missing}"
    for x, y in zip(a, b):
        if x != y:
            return f"[{sorted(got_cols)}]\n   spark {str(x)[:600]}\n   sql   {str(y)[:600]}"


def main(argv):
    import __spark_entry__ as entry

    sf = "0.01"
    if argv and argv[0].startswith("sf"):
        sf, argv = argv[0][2:], argv[1:]
    sf_dir = f"/root/testdata/sf{sf}"
    spark, con = local_session(), connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    names = [n for n in queries if not argv or any(n == a or (a.endswith("*") and n.startswith(a[:-1])) for a in argv)]
    bad = 0
    for name in names:
        start = time.time()
        try:
            problem = compare(spark, con, sf_dir, queries[name], oracles.get(name))
        except Exception as error:  # report and go on to the next query
            problem = f"{type(error).__name__}: {str(error)[:900]}"
        took = time.time() - start
        bad += problem is not None
        mark = "ok  " if problem is None else "FAIL"
        kind = "" if name in oracles else " (rows only)"
        print(f"{mark} {name}{kind} {took:.2f}s" + (f"\n   {problem}" if problem else ""), flush=True)
    print(f"{len(names) - bad} ok, {bad} failed, {len([n for n in names if n in oracles])} with SQL")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
