"""Run catalog queries and their SQL side by side and compare the values."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return db


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, int):
        return value
    return str(value)


def rows_by_name(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple(_plain(row[i]) for i in order) for row in rows]
    return [columns[i] for i in order], sorted(plain, key=repr)


def differences(df, db, sql: str) -> str | None:
    """None when names, types of values, row count and values agree."""
    found = rows_by_name(df.columns, [tuple(r) for r in df.collect()])
    result = db.execute(sql)
    wanted = rows_by_name([c[0] for c in result.description], result.fetchall())
    if found[0] != wanted[0]:
        return f"columns {found[0]} != {wanted[0]}"
    if len(found[1]) != len(wanted[1]):
        return f"{len(found[1])} rows != {len(wanted[1])}"
    bad = [(f, w) for f, w in zip(found[1], wanted[1]) if f != w]
    if not bad:
        bad = [
            (f, w) for f, w in zip(found[1], wanted[1]) if list(map(type, f)) != list(map(type, w))
        ]
    return f"{len(bad)} rows differ, first: {bad[0][0]} != {bad[0][1]}" if bad else None


def main(folder: str, names: list[str]) -> None:
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as e
    from patronlens.session import local_session

    spark = local_session(8)
    db = connect(folder)
    sql = e.oracle_sql()
    total = 0.0
    for name, run in e.queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            df = run(spark, folder)
            if name in sql:
                text = differences(df, db, sql[name]) or "ok"
            else:
                text = f"no sql, {len(df.collect())} rows"
        except Exception as error:  # report and go on with the next query
            text = f"ERROR {str(error)[:600]}"
        spent = time.time() - start
        total += spent
        print(f"{name:28s} {spent:6.2f}s {text}", flush=True)
    print(f"total {total:.1f}s; sql without query: {sorted(set(sql) - set(e.queries()))}")


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2:])
