"""Compare registered queries with their SQL twins."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return con


def normal(value):
    if value is None or value is pd.NA or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, (int, float)):
        return round(float(value), 9)
    return str(value)


def sort_key(row):
    return tuple((v is None, str(type(v)), v if v is not None else 0) for v in row)


def compare(spark, con, name, plan, sql, folder) -> tuple[str | None, float]:
    """A message on the first difference, or None; and the seconds Spark took."""
    start = time.time()
    df = plan(spark, folder)
    columns = sorted(df.columns)
    ours = df.select(*[f"`{c}`" for c in columns]).toPandas()
    took = time.time() - start
    if sql is None:
        return (None if len(ours) else "no rows"), took
    theirs = con.execute(sql).df()
    if sorted(theirs.columns) != columns:
        return f"columns {columns} / {sorted(theirs.columns)}", took
    theirs = theirs[columns]
    # whole numbers with gaps come as floats on one side and as nullable integers on the other
    gaps = lambda c: ours[c].isna().any() and {ours[c].dtype.kind, theirs[c].dtype.kind} <= {"f", "i"}
    kinds = [(c, ours[c].dtype.kind, theirs[c].dtype.kind) for c in columns if ours[c].dtype.kind != theirs[c].dtype.kind and not gaps(c)]
    if kinds and len(ours):
        return f"types {kinds}", took
    a = sorted((tuple(map(normal, r)) for r in ours.itertuples(index=False)), key=sort_key)
    b = sorted((tuple(map(normal, r)) for r in theirs.itertuples(index=False)), key=sort_key)
    if len(a) != len(b):
        return f"rows {len(a)} / {len(b)}", took
    for x, y in zip(a, b):
        if x != y:
            return f"{x} / {y}", took
    return None, took


def main(names: list[str]) -> None:
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from stockloom.session import local_session

    folder = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark, con = local_session(), connect(folder)
    bad = 0
    plans, twins = entry.queries(), entry.oracle_sql()
    for name, plan in plans.items():
        if names and not any(name.startswith(n) for n in names):
            continue
        try:
            message, took = compare(spark, con, name, plan, twins.get(name), folder)
        except Exception as error:
            message, took = f"{type(error).__name__}: {str(error)[:1500]}", 0.0
        bad += message is not None
        kind = "sql" if name in twins else "rows"
        print(f"{'ok  ' if message is None else 'BAD '} {took:6.2f}s {kind:4} {name} {message or ''}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main(sys.argv[1:])
