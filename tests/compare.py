"""Runs registered queries beside their SQL and reports the first difference."""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def plain(value: object) -> object:
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, float) and math.isnan(value):
        return "nan"
    if isinstance(value, float):
        return round(value, 9) + 0.0
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return value


KINDS = {
    "BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean",
    "TIMESTAMP": "timestamp_ntz", "DATE": "date", "BLOB": "binary", "FLOAT": "float",
}


def compare(spark, name: str, folder: str, con: duckdb.DuckDBPyConnection) -> str | None:
    """None when equal, else what differs."""
    from docwarden.plans import all_queries

    queries, oracles = all_queries()
    df = queries[name](spark, folder)
    cols = sorted(df.columns, key=lambda c: (not c.endswith("_id"), c))
    mine = [tuple(plain(r[c]) for c in cols) for r in df.collect()]
    if name not in oracles:
        return None if cols else "no columns"
    rel = con.sql(oracles[name])
    if sorted(rel.columns) != sorted(cols):
        return f"columns {cols} != {sorted(rel.columns)}"
    kinds = dict(zip(rel.columns, (str(t) for t in rel.types)))
    for c, t in df.dtypes:
        if KINDS.get(kinds[c], kinds[c]) != t:
            return f"type of {c}: {t} != {kinds[c]}"
    at = [rel.columns.index(c) for c in cols]
    theirs = [tuple(plain(r[i]) for i in at) for r in rel.fetchall()]
    if len(mine) != len(theirs):
        return f"rows {len(mine)} != {len(theirs)}"
    key = lambda row: [(v is not None, str(type(v)), v) for v in row]
    for a, b in zip(sorted(mine, key=key), sorted(theirs, key=key)):
        if a != b:
            bad = [(c, x, y) for c, x, y in zip(cols, a, b) if x != y]
            return f"values {str(bad)[:600]} in {str(a)[:300]}"
    return None


def main() -> None:
    from docwarden.session import build_session

    folder = sys.argv[1]
    from docwarden.plans import all_queries

    names = sys.argv[2:] or list(all_queries()[0])
    spark = build_session("compare", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(folder)
    failed = 0
    for name in names:
        start = time.time()
        try:
            trouble = compare(spark, name, folder, con)
        except Exception as error:
            trouble = f"{type(error).__name__}: {str(error)[:900]}"
        failed += trouble is not None
        print(f"{'ok  ' if trouble is None else 'FAIL'} {name} {time.time() - start:.2f}s {trouble or ''}", flush=True)
    print(f"{len(names) - failed} of {len(names)} ok")


if __name__ == "__main__":
    main()
