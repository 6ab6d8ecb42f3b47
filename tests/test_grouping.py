"""Components over long chains."""

from ledgerlens.operators import grouping, linking


def test_components_of_long_chains(spark):
    edges = [(k, k + 1) for k in range(130)] + [(1000, 1001), (2000, 2000)]
    out = dict(map(tuple, grouping.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert out == {k: 0 for k in range(131)} | {1000: 1000, 1001: 1000, 2000: 2000}


def test_components_of_ten_thousand_nodes(spark):
    edges = spark.range(10_000).selectExpr("id AS a", "id + 1 AS b")
    out = grouping.components(edges)
    assert out.count() == 10_001 and out.select("component").distinct().count() == 1


def test_a_hot_key_without_gaps(spark):
    """One key of 300,000 rows, a row a quarter of an hour: a group is a window's rows, whatever lies around it."""
    rows = spark.range(300_000).selectExpr("1 AS key", "id", "id DIV 96 AS day", "CASE WHEN id % 1000 < 3 THEN 60.0 ELSE 0.01 END AS value", "id % 2 AS level")
    out = grouping.rolling_groups(rows, "key", "id", "day", "value", bands=[(100.0, 1)], level="level", days=2, min_members=2).collect()
    used, n = set(), 0
    for r in out:
        assert r.total >= 100 and r.n == len(r.member_ids) and r.last_day - r.first_day <= 2 and not used & set(r.member_ids)
        assert all(i % 2 == 0 and r.first_day <= i // 96 <= r.last_day for i in r.member_ids)
        used |= set(r.member_ids)
        n += 1
    assert n > 200
    left = spark.range(200_000).selectExpr("7 AS k", "id", "100.0D + id % 50 AS v", "timestamp_seconds(id * 600) AS d")
    matched = linking.greedy_one_to_one(left, left, "k", ("id", "v", "d"), ("id", "v", "d"), 0.0, 3).collect()
    assert len(matched) == 200_000 and all(r.left_id == r.right_id for r in matched)


def test_groups_of_null_keys(spark):
    rows = spark.createDataFrame([(None, 1, 0, 90.0), (None, 2, 5, 90.0), ("a", 3, 1, 90.0), ("a", 4, 2, None), ("a", 5, None, 90.0)], "key string, id long, day long, value double")
    out = grouping.rolling_groups(rows, "key", "id", "day", "value", bands=[(150.0, 1)]).collect()
    assert [(r.group_key, r.anchor_id, r.member_ids) for r in out] == [(None, 1, [1, 2])]
