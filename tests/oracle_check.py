"""Run registered queries next to their SQL and compare: ``python tests/oracle_check.py [sf] [name ...]``."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float) and math.isnan(value):
        return None
    return value


def rows_of(columns, rows):
    """Column names and rows in a fixed order."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, sf_dir: str, query, sql: str) -> tuple[int, str | None]:
    """Rows returned, and the first difference if there is one."""
    got = query(spark, sf_dir)
    got_columns, got_rows = rows_of(got.columns, [tuple(r) for r in got.collect()])
    want = con.sql(sql)
    want_columns, want_rows = rows_of(want.columns, want.fetchall())
    if got_columns != want_columns:
        return len(got_rows), f"columns {got_columns} != {want_columns}"
    if len(got_rows) != len(want_rows):
        return len(got_rows), f"{len(got_rows)} rows, expected {len(want_rows)}"
    for a, b in zip(got_rows, want_rows):
        if a != b:
            return len(got_rows), f"{a} != {b}"
    types = {c: t for c, t in got.dtypes}
    theirs = {c: str(t) for c, t in zip(want.columns, want.types)}
    known = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP"}
    odd = {c: (types[c], theirs[c]) for c in types if known.get(types[c]) != theirs[c]}
    return len(got_rows), f"types {odd}" if odd else None


if __name__ == "__main__":
    from __spark_entry__ import oracle_sql, queries
    from fleetlens.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    spark, directory = local_session(), f"/root/testdata/sf{sf}"
    con, oracles = connect(directory), oracle_sql()
    names = sys.argv[2:] or list(queries())
    bad = 0
    for name in names:
        begun = time.time()
        try:
            if name in oracles:
                n, diff = compare(spark, con, directory, queries()[name], oracles[name])
            else:
                n, diff = queries()[name](spark, directory).count(), "no SQL"
        except Exception as error:  # report and go on with the next query
            n, diff = -1, f"{type(error).__name__}: {str(error)[:900]}"
        bad += diff is not None
        print(f"{name:36s} {n:8d} rows {time.time() - begun:6.2f} s  {diff or 'same'}", flush=True)
    sys.exit(bad > 0)
