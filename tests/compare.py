"""Run queries next to their SQL oracle and compare whole results.

    python -m tests.compare [sf] [query ...]
"""

import math
import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

DATA = Path("/root/testdata")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def duck(sf_dir):
    con = duckdb.connect()
    for table in TABLES:
        path = Path(sf_dir) / f"{table}.parquet"
        if path.exists():
            con.sql(f"create view {table} as select * from '{path}'")
    return con


def plain(value):
    """Engine-neutral text of one value; doubles in full, so nothing is rounded away here."""
    if value is None or value is pd.NaT or (isinstance(value, float) and math.isnan(value)):
        return "NULL"
    if isinstance(value, bool):
        return str(value)
    if hasattr(value, "isoformat"):
        return value.isoformat()
    if isinstance(value, (float, int)):
        return repr(float(value))
    return str(value)


def table_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(plain(row[i]) for i in order) for row in rows)


def compare(df, con, sql):
    """(same, message)"""
    result = con.sql(sql)
    want_cols, want = table_of(result.columns, result.fetchall())
    have_cols, have = table_of(df.columns, [tuple(r) for r in df.collect()])
    if have_cols != want_cols:
        return False, f"columns {have_cols} != {want_cols}"
    types = dict(zip(result.columns, map(str, result.types)))
    kinds = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE",
             "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP"}
    odd = [(c, k, types[c]) for c, k in df.dtypes if kinds.get(k) != types[c]]
    if len(have) != len(want):
        return False, f"{len(have)} rows, oracle has {len(want)}"
    if have != want:
        bad = [(h, w) for h, w in zip(have, want) if h != w]
        return False, f"{len(bad)} of {len(have)} rows differ, first {have_cols}: {bad[:2]}"
    return not odd, f"{len(have)} rows" + (f", types {odd}" if odd else "")


def main(sf="0.01", *names):
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    import __spark_entry__ as entry
    from kickstand.session import build_session

    spark = build_session("local[8]", shuffle_partitions=8, spark__ui__enabled="false", spark__driver__memory="8g",
                          spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir, oracles = str(DATA / f"sf{sf}"), entry.oracle_sql()
    con, failed = duck(sf_dir), []
    for name, query in entry.queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            same, message = compare(query(spark, sf_dir), con, oracles[name])
        except Exception as error:  # report every query, not just the first failure
            same, message = False, f"{type(error).__name__}: {str(error)[:700]}"
        failed += [] if same else [name]
        print(f"{'ok  ' if same else 'FAIL'} {name}: {message} [{time.time() - start:.1f}s]", flush=True)
    print("failed:", failed or "none")


if __name__ == "__main__":
    main(*sys.argv[1:])
