"""Comparison of a registered query with its SQL."""

import datetime
import decimal
from pathlib import Path

FOLDER = Path("/root/testdata/sf0.001")


def connect(folder=FOLDER):
    import duckdb

    db = duckdb.connect()
    db.execute("SET timezone = 'UTC'")
    for f in folder.glob("*.parquet"):
        db.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return db


def _plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return f"{float(v):.10g}"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


def assert_same(spark, db, run, sql, folder=FOLDER):
    df = run(spark, str(folder))
    names = sorted(df.columns)
    result = db.execute(sql)
    given = [d[0] for d in result.description]
    assert sorted(given) == names
    want = sorted(tuple(_plain(r[given.index(n)]) for n in names) for r in result.fetchall())
    assert sorted(tuple(_plain(r[n]) for n in names) for r in df.collect()) == want
