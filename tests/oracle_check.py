"""Runs queries and their DuckDB statements side by side: python tests/oracle_check.py FOLDER [name ...]"""

from __future__ import annotations

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from sparkwarden.catalog.inputs import BASE_TABLES  # noqa: E402


def normal(value):
    return round(value, 6) if isinstance(value, float) else value


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(normal(r[i]) for i in order) for r in data), key=repr)


def duck(folder: str):
    import duckdb

    con = duckdb.connect()
    for t in BASE_TABLES:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return con


def compare(spark, con, folder, query, sql):
    """None if equal, else a short account of the difference."""
    df = query(spark, folder)
    ours = rows(df.columns, [tuple(r) for r in df.collect()])
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    theirs = rows(columns, result.fetchall())
    if sorted(df.columns) != sorted(columns):
        return f"columns {sorted(df.columns)} / {sorted(columns)}"
    if not ours:
        return "no rows"
    if ours == theirs:
        return None
    extra, missing = list(set(ours) - set(theirs))[:2], list(set(theirs) - set(ours))[:2]
    return f"{len(ours)} / {len(theirs)} rows; ours {extra}; duckdb {missing}"


if __name__ == "__main__":
    import __spark_entry__ as entry_points
    from sparkwarden.session import local_session

    spark = local_session()
    folder, names = sys.argv[1], sys.argv[2:]
    con, sql, bad = duck(folder), entry_points.oracle_sql(), 0
    for name, query in entry_points.queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            problem = "no oracle" if name not in sql else compare(spark, con, folder, query, sql[name])
        except Exception as e:  # report and go on
            problem = f"{type(e).__name__}: {e}"[:1500]
        bad += problem is not None
        print(f"{name:28s} {time.time() - start:6.1f}s {'ok' if problem is None else problem}", flush=True)
    print("failed:", bad)
