"""Every registered analytic query against its SQL, and the sequential ones against plain models."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import amounts, dates, grouping, lifecycle, linking, periods, views
from ledgerlens.plans import catalogue
from tests.oracle import FOLDER, assert_same, connect

SQL = catalogue.oracle_sql()
needs_data = pytest.mark.skipif(not FOLDER.exists(), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    return connect()


@needs_data
@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, db, name):
    run = catalogue.queries()[name]
    if name in SQL:
        assert_same(spark, db, run, SQL[name])
    else:
        assert run(spark, str(FOLDER)).count() > 0


@needs_data
def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() >= 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def model_groups(rows, bands, days, gap):
    """The greedy rule on plain tuples (id, day, value)."""
    out, used = [], set()
    rows = sorted(rows, key=lambda r: (r[1], r[0]))
    for b, _ in sorted(bands, reverse=True):
        small = [r for r in rows if r[2] < b]
        for a in small:
            if a[0] in used:
                continue
            m = [r for r in small if r[0] not in used and a[1] <= r[1] <= a[1] + days]
            far = all(y[1] - x[1] >= gap for x, y in zip(m, m[1:]))
            if len(m) >= 2 and round(sum(r[2] for r in m), 2) >= b and not far:
                used |= {r[0] for r in m}
                out.append((a[0], tuple(r[0] for r in m)))
    return sorted(out)


def test_rolling_groups(spark):
    rng = random.Random(1)
    rows = [(k % 3, k, rng.randint(0, 900), float(rng.randint(1, 90))) for k in range(90)]
    bands = [(150.0, 1), (80.0, 1)]
    df = spark.createDataFrame(rows, "key int, id long, day long, value double")
    for shuffled in (df, df.orderBy(F.rand(3))):
        out = grouping.rolling_groups(shuffled, "key", "id", "day", "value", bands=bands, days=365).collect()
        got = sorted((r.anchor_id, tuple(r.member_ids)) for r in out)
        assert got == sorted(x for k in range(3) for x in model_groups([r[1:] for r in rows if r[0] == k], bands, 365, 300))


def test_greedy_one_to_one(spark):
    day = lambda d: dt.datetime(2026, 1, d)
    left = spark.createDataFrame([("a", 1, 100.0, day(1)), ("a", 2, 100.0, day(1)), ("a", 3, 0.0, day(1)), ("b", 4, 100.0, day(1))], "k string, id long, v double, d timestamp")
    right = spark.createDataFrame([("a", 10, 100.5, day(2)), ("a", 11, 100.0, day(3)), ("a", 12, 100.0, day(9)), ("b", 13, 102.0, day(1))], "k string, id long, v double, d timestamp")
    out = linking.greedy_one_to_one(left, right, "k", ("id", "v", "d"), ("id", "v", "d"), 0.01, 3)
    assert sorted(map(tuple, out.collect())) == [(1, 10), (2, 11)]


@pytest.mark.parametrize("rows", [0, 300])
def test_greedy_one_to_one_on_one_frame(spark, rows, tmp_path):
    """Both sides cut from one frame, whatever columns the consumer needs; held against a plain model."""
    rng = random.Random(2)
    data = [(k % 4, k, float(rng.randint(80, 120)), dt.datetime(2026, 1, 1) + dt.timedelta(days=rng.randint(0, 400))) for k in range(rows)]
    df = spark.createDataFrame(data, "k int, id long, v double, d timestamp")
    out = linking.greedy_one_to_one(df.where("id % 2 = 1"), df.where("id % 2 = 0"), "k", ("id", "v", "d"), ("id", "v", "d"), 0.1, 20)
    want, used = [], set()
    for k, i, v, d in data:
        near = [(abs(x[3] - d).days, abs(x[2] - v), x[1]) for x in data if x[1] % 2 == 0 and x[0] == k and x[1] not in used and abs(x[2] - v) <= 0.1 * v and abs(x[3] - d).days <= 20]
        if i % 2 and near:
            want.append((i, min(near)[2]))
            used.add(min(near)[2])
    assert sorted(map(tuple, out.collect())) == sorted(want)
    assert out.count() == len(want) and sorted(r.left_id for r in out.select("left_id").collect()) == sorted(i for i, _ in want)
    out.write.parquet(f"file://{tmp_path}/out")


def test_dates(spark):
    at = lambda *a: F.lit(dt.datetime(*a))
    r = spark.range(1).select(
        dates.floor_days(at(2026, 1, 1, 23), at(2026, 1, 2)).alias("minus_one_hour"),
        dates.floor_days(at(2026, 1, 3), at(2026, 1, 1, 1)).alias("under_two"),
        dates.local_date(at(2026, 9, 17, 21)).cast("string").alias("sofia"),
        dates.net_date(F.lit("/Date(1700000000000+0300)/")).cast("long").alias("net"),
        dates.net_date(F.lit("x")).alias("none"),
        dates.previous_period(F.lit("2026-01")).alias("previous"),
    ).first()
    assert tuple(r) == (-1, 1, "2026-09-18", 1700000000, None, "2025-12")


def test_lifecycle(spark):
    store = spark.createDataFrame([("r", "a", 1, "2026-01-01", "2026-01-01", None), ("r", "b", 1, "2026-01-01", "2026-01-01", None), ("q", "c", 1, "2026-01-01", "2026-01-01", None), ("r", "d", 1, "2026-01-01", "2026-01-01", "2026-01-05")], "rule string, subject_key string, v int, first_seen_at string, last_seen_at string, resolved_at string")
    new = spark.createDataFrame([("r", "a", 2), ("r", "d", 2), ("r", "e", 2)], "rule string, subject_key string, v int")
    out = {r.subject_key: r for r in lifecycle.merge_findings(store, new, ["r"], F.lit("2026-02-01")).collect()}
    assert {k: r.change for k, r in out.items()} == {"a": "updated", "b": "resolved", "c": "unchanged", "d": "updated", "e": "new"}
    assert out["d"].resolved_at is None and out["d"].first_seen_at == "2026-01-01" and out["b"].resolved_at == "2026-02-01"


def test_upsert_keys_and_cents(spark):
    old = spark.createDataFrame([(None, "x", 1.0), (1, "x", 1.0), (2, "x", None)], "id int, k string, v double")
    new = spark.createDataFrame([(None, "x", 1.004), (1, "x", 1.01), (2, "x", None), (3, "y", 2.0)], "id int, k string, v double")
    out = {r.id: r.change for r in lifecycle.upsert(old, new, ["id", "k"], ["v"]).collect()}
    assert out == {None: "same", 1: "updated", 2: "same", 3: "inserted"}
    kept = lifecycle.survivors(old, spark.createDataFrame([(1,)], "id int"), "id")
    assert {r.id for r in kept.collect()} == {None, 1}


def test_empty_inputs(spark):
    e = spark.createDataFrame([], "k string, v double, d timestamp, p string")
    assert amounts.share_of_total(e, "k", "v").count() == 0
    assert periods.jumps(e, ["k"], "p", "v", 1.5, 1).count() == 0
    assert dates.renewal_gaps(e, "k", "d").count() == 0
    assert views.peer_median(e, "k", "p", "v").count() == 0
    assert linking.first_by(e, ["k"], "v").count() == 0
    assert grouping.components(e.select(F.lit(1).alias("a"), F.lit(2).alias("b"))).count() == 0


def test_representative_period(spark):
    df = spark.createDataFrame([("2024-03",), ("2024-12",), ("2025-06",), ("2025-03",)], "p string")
    assert sorted(map(tuple, periods.representative_period(df, "p").collect())) == [("2024", "2024-12", False), ("2025", "2025-06", True)]


def test_related_party_makes_no_pairs_of_equal_balances(spark, tmp_path):
    """Sixty customers and sixty suppliers of one nation and balance: each customer meets one supplier by name, not all sixty."""
    from pyspark.sql import functions as F

    from ledgerlens.operators import linking
    from ledgerlens.plans import entity_queries
    from ledgerlens.plans.base import Tables

    k = spark.range(60)
    k.select((F.col("id") + 100).alias("c_custkey"), F.lit(1).alias("c_nationkey"), F.lit(10.0).alias("c_acctbal")).write.parquet(f"file://{tmp_path}/customer.parquet")
    k.select(F.col("id").alias("s_suppkey"), F.lit(1).alias("s_nationkey"), F.lit(20.0).alias("s_acctbal")).write.parquet(f"file://{tmp_path}/supplier.parquet")
    ranked, first_by = [], linking.first_by
    linking.first_by = lambda rows, *a: ranked.append(rows.count()) or first_by(rows, *a)
    try:
        out = entity_queries.related_party(Tables(spark, f"file://{tmp_path}")).collect()
    finally:
        linking.first_by = first_by
    assert ranked == [60]
    assert sorted(tuple(r) for r in out) == [(100 + i, 0, "name") for i in range(60)]


def test_unmatched_leaves_out_documents_without_text(spark, tmp_path):
    """Empty and missing texts are no documents without a match, as in the SQL; texts too long for any item are."""
    folder = f"file://{tmp_path}"
    rows = [(1, "sewer works in north quarter"), (2, ""), (3, None), (4, "bread and milk for schools"), (5, "sewer works in north quarter " * 9)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(7, "works on sewer in north quarter")], "item_id long, text string").coalesce(1).write.parquet(f"{folder}/benchmark.parquet")
    import duckdb

    db = duckdb.connect()
    for name in ("documents", "benchmark"):
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    for name in ("unmatched", "fuzzy_best_match"):
        assert_same(spark, db, catalogue.queries()[name], SQL[name], folder)
    assert sorted(r.object_id for r in catalogue.queries()["unmatched"](spark, folder).collect()) == [4, 5]
