"""Run registered queries against their SQL in DuckDB and compare schemas' names and values, order aside."""

from __future__ import annotations

import datetime as dt
import decimal
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    db.execute("SET TimeZone='UTC'")
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return db


def plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, (float, decimal.Decimal)):
        return round(float(value), 6)
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def compare(df, db: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """None when equal, otherwise what differs."""
    names = sorted(df.columns)
    ours = [tuple(plain(row[n]) for n in names) for row in df.collect()]
    cursor = db.execute(sql)
    header = [c[0] for c in cursor.description]
    if sorted(header) != names:
        return f"columns {names} against {sorted(header)}"
    index = [header.index(n) for n in names]
    theirs = [tuple(plain(row[i]) for i in index) for row in cursor.fetchall()]
    if not ours and not theirs:
        return None
    left, right = sorted(ours, key=repr), sorted(theirs, key=repr)
    if left == right:
        return None
    extra = sorted(set(left) - set(right), key=repr)[:3]
    missing = sorted(set(right) - set(left), key=repr)[:3]
    return f"{len(left)} rows against {len(right)}; columns {names}; ours only {extra}; theirs only {missing}"


if __name__ == "__main__":
    sys.path.insert(0, ".")
    import __spark_entry__ as entry
    from pressroom.session import local_session

    folder = sys.argv[1]
    only = sys.argv[2:]
    spark = local_session()
    db = connect(folder)
    queries, sql = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in queries.items():
        if only and not any(name.startswith(o) for o in only):
            continue
        start = time.time()
        try:
            if name in sql:
                result = compare(fn(spark, folder), db, sql[name])
            else:
                result = None if fn(spark, folder).count() > 0 else "no rows"
        except Exception as error:  # noqa: BLE001
            result = f"{type(error).__name__}: {str(error)[:1500]}"
        bad += result is not None
        print(f"{'FAIL' if result else 'ok  '} {name} {time.time() - start:.1f}s {result or ('' if name in sql else '(rows only)')}", flush=True)
    print(f"{bad} failed")
