"""Order-insensitive comparison of a Spark result with the SQL engine's."""

from collections import Counter
from datetime import datetime
from decimal import Decimal

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def oracle(folder):
    db = duckdb.connect()
    for table in TABLES:
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet')")
    return db


def plain(value):
    if isinstance(value, Decimal):
        return str(value.normalize())
    if isinstance(value, datetime):
        return value.replace(tzinfo=None).isoformat()
    return value


def bag(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), Counter(tuple(plain(r[i]) for i in order) for r in rows)


def difference(frame, db, sql):
    """Empty text when both results hold the same rows, else a short report."""
    got_columns, got = bag(frame.columns, [tuple(r) for r in frame.collect()])
    result = db.execute(sql)
    want_columns, want = bag([d[0] for d in result.description], result.fetchall())
    if got_columns != want_columns:
        return f"columns {got_columns} / {want_columns}"
    if got == want:
        return ""
    extra, missing = got - want, want - got
    return (f"{sum(got.values())} rows / {sum(want.values())}; only Spark {sum(extra.values())}: "
            f"{list(extra)[:3]}; only SQL: {list(missing)[:3]}; columns {got_columns}")
