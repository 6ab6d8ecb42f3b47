"""Contract-style findings bound to orders and line items."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import amounts as A
from ..operators import dates as D
from ..operators import grouping as G
from .base import FLOOR_DAYS, NET_BY_ORDER, Tables, net_by_order, query


def share_of_total(t: Tables):
    lines = t.lineitem.select("l_suppkey", "l_extendedprice", "l_shipdate")
    newest = lines.agg(F.max("l_shipdate").alias("newest"))
    recent = lines.join(F.broadcast(newest), F.col("l_shipdate") >= F.col("newest") - F.expr("INTERVAL 730 DAYS"))  # one row
    out = A.share_of_total(recent, "l_suppkey", "l_extendedprice", min_count=3, min_share=0.01)
    return out.select("l_suppkey", "n", "total", F.round("share", 9).alias("share"))


SHARE_OF_TOTAL = """
WITH k AS (SELECT l_suppkey, count(*) AS n, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS s FROM lineitem
  WHERE l_shipdate >= (SELECT max(l_shipdate) FROM lineitem) - INTERVAL 730 DAY AND l_extendedprice <> 0 GROUP BY 1),
a AS (SELECT *, CAST(s AS DOUBLE) / CAST(sum(s) OVER () AS DOUBLE) AS share FROM k)
SELECT l_suppkey, n, CAST(s AS DOUBLE) AS total, round(share, 9) AS share FROM a WHERE n >= 3 AND share >= 0.01"""


def missing_value(t: Tables):
    rows = A.missing_value(t.lineitem, ["l_discount", "l_tax"])
    return rows.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice")


MISSING_VALUE = "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice FROM lineitem WHERE coalesce(l_discount, 0) = 0 AND coalesce(l_tax, 0) = 0"


def late_publication(t: Tables):
    joined = t.orders.select("o_orderkey", "o_orderdate").join(t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey", "l_linenumber", "l_shipdate"), "o_orderkey")
    out = D.late(joined, "l_shipdate", "o_orderdate", deadline=30, grace=7, warning=14, high=60)
    return out.select("o_orderkey", "l_partkey", "l_linenumber", "days", "late", "severity")


LATE_PUBLICATION = f"""
WITH j AS (SELECT o_orderkey, l_partkey, l_linenumber, {FLOOR_DAYS.format(a="l_shipdate", b="o_orderdate")} AS days
  FROM orders JOIN lineitem ON l_orderkey = o_orderkey)
SELECT *, days - 30 AS late, CASE WHEN days - 30 > 60 THEN 'high' WHEN days - 30 > 14 THEN 'warning' ELSE 'info' END AS severity FROM j WHERE days - 30 > 7"""


def _grown(low: float, high: float):
    def build(t: Tables):
        joined = t.orders.select("o_orderkey", "o_totalprice").join(net_by_order(t), "o_orderkey")
        return A.growth_band(joined, "o_totalprice", "net", low, high).select("o_orderkey", "o_totalprice", "net", F.round("ratio", 9).alias("ratio"))

    sql = f"""SELECT o_orderkey, o_totalprice, net, round(net / o_totalprice, 9) AS ratio FROM orders JOIN ({NET_BY_ORDER}) USING (o_orderkey)
WHERE o_totalprice > 0 AND net > 0 AND net > {low} * o_totalprice AND net <= {high} * o_totalprice"""
    return query(build), sql


def single_member(t: Tables):
    lines = A.sole_member(t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), "l_extendedprice"), "o_orderkey")
    return lines.where("l_extendedprice >= 10000").withColumn("severity", A.severity(F.col("l_extendedprice"), 50_000))


SINGLE_MEMBER = """SELECT l_orderkey AS o_orderkey, any_value(l_extendedprice) AS l_extendedprice,
CASE WHEN any_value(l_extendedprice) >= 50000 THEN 'high' ELSE 'warning' END AS severity
FROM lineitem GROUP BY 1 HAVING count(*) = 1 AND any_value(l_extendedprice) >= 10000"""

CLASSES = [("1-URGENT", "exceptional", 10, 5), ("2-HIGH", "exceptional", 20, 10), ("3-MEDIUM", "ordinary", 30, 15), ("5-LOW", "ordinary", 30, 15)]
_CLASS_SQL = "(VALUES " + ", ".join(str(r) for r in CLASSES) + ") AS c(o_orderpriority, class, legal, bare)"


def _classes(t: Tables):
    return A.dimension(t.spark, ["o_orderpriority", "class", "legal", "bare"], CLASSES)


def lookup_exceptional(t: Tables):
    """Exceptional priorities of customers without an ordinary one (precedence), by value; fulfilled orders are info."""
    o = A.lookup(t.orders, "o_orderpriority", _classes(t), "inner")
    ordinary = o.where("class = 'ordinary' AND o_orderstatus = 'F'").select("o_custkey").distinct()
    rows = o.where("class = 'exceptional'").join(ordinary, "o_custkey", "left_anti")
    level = F.when(F.col("o_orderstatus").rlike("^[Ff]"), "info").otherwise(A.severity(F.col("o_totalprice"), 200_000, 100_000))
    return rows.select("o_orderkey", "o_custkey", "o_totalprice", level.alias("severity"))


LOOKUP_EXCEPTIONAL = f"""
WITH o AS (SELECT * FROM orders JOIN {_CLASS_SQL} USING (o_orderpriority))
SELECT o_orderkey, o_custkey, o_totalprice, CASE WHEN o_orderstatus LIKE 'F%' OR o_orderstatus LIKE 'f%' THEN 'info'
  WHEN o_totalprice >= 200000 THEN 'high' WHEN o_totalprice >= 100000 THEN 'warning' ELSE 'info' END AS severity
FROM o WHERE class = 'exceptional' AND NOT EXISTS (SELECT 1 FROM o p WHERE p.o_custkey = o.o_custkey AND p.class = 'ordinary' AND p.o_orderstatus = 'F')"""


def short_deadline(t: Tables):
    first = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_shipdate").alias("shipped"))
    o = A.lookup(t.orders, "o_orderpriority", _classes(t), "inner").join(first, "o_orderkey")
    o = o.withColumn("days", F.datediff(D.local_date(F.col("shipped")), D.local_date(F.col("o_orderdate"))).cast("long"))
    return D.short_deadline(o, "days", "legal", "bare").select("o_orderkey", "o_orderpriority", "days", "tier")


SHORT_DEADLINE = f"""
WITH f AS (SELECT l_orderkey AS o_orderkey, min(l_shipdate) AS shipped FROM lineitem GROUP BY 1),
d AS (SELECT o_orderkey, o_orderpriority, legal, bare, CAST(date_diff('day',
    CAST(timezone('Europe/Sofia', timezone('UTC', CAST(o_orderdate AS TIMESTAMP))) AS DATE),
    CAST(timezone('Europe/Sofia', timezone('UTC', CAST(shipped AS TIMESTAMP))) AS DATE)) AS BIGINT) AS days
  FROM orders JOIN {_CLASS_SQL} USING (o_orderpriority) JOIN f USING (o_orderkey))
SELECT o_orderkey, o_orderpriority, days, CASE WHEN days < bare THEN 'violation' ELSE 'signal' END AS tier FROM d WHERE days >= 0 AND days < legal + 5"""


def at_ceiling(t: Tables):
    lines = t.lineitem.join(t.part.select(F.col("p_partkey").alias("l_partkey"), "p_retailprice"), "l_partkey").withColumn("estimate", F.col("p_retailprice") * F.col("l_quantity"))
    out = A.at_ceiling(lines, "l_extendedprice", "estimate")
    return out.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.round("ratio", 9).alias("ratio"))


AT_CEILING = """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round(l_extendedprice / (p_retailprice * l_quantity), 9) AS ratio
FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_retailprice * l_quantity > 0 AND l_extendedprice / (p_retailprice * l_quantity) BETWEEN 0.98 AND 1.05"""

BANDS = (50_000.0, 100_000.0, 273_812.0, 450_000.0)


def near_threshold(t: Tables):
    return A.near_threshold(t.orders, "o_totalprice", BANDS).select("o_orderkey", "o_totalprice", "band")


NEAR_THRESHOLD = f"""SELECT o_orderkey, o_totalprice, min(band) AS band FROM orders JOIN (SELECT unnest({list(BANDS)}::DOUBLE[]) AS band)
ON o_totalprice >= 0.95 * band AND o_totalprice < band GROUP BY 1, 2"""

BOUNDARY = 300_000.0


def anchor_windows(t: Tables):
    small = t.orders.where(F.col("o_totalprice") < BOUNDARY).select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    summed = D.forward_window_sum(small, "o_custkey", "o_orderdate", "o_totalprice", 365)
    return summed.where((F.col("window_sum") >= BOUNDARY) & (F.col("window_n") >= 2)).select("o_orderkey", "o_custkey", "window_sum", "window_n")


ANCHOR_WINDOWS = f"""
WITH s AS (SELECT o_orderkey, o_custkey, date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS d, CAST(o_totalprice AS DECIMAL(18,2)) AS v FROM orders WHERE o_totalprice < {BOUNDARY}),
w AS (SELECT o_orderkey, o_custkey, CAST(sum(v) OVER x AS DOUBLE) AS window_sum, count(*) OVER x AS window_n FROM s
  WINDOW x AS (PARTITION BY o_custkey ORDER BY d RANGE BETWEEN CURRENT ROW AND 365 FOLLOWING))
SELECT * FROM w WHERE window_sum >= {BOUNDARY} AND window_n >= 2"""


def splitting_greedy(t: Tables):
    day = F.datediff("o_orderdate", F.lit("1970-01-01").cast("date")).cast("long")
    units = t.orders.where("o_totalprice IS NOT NULL").select("o_custkey", "o_orderkey", day.alias("day"), "o_totalprice")
    groups = G.rolling_groups(units, "o_custkey", "o_orderkey", "day", "o_totalprice", bands=[(BOUNDARY, 1)])
    return groups.select(F.col("group_key").alias("o_custkey"), "anchor_id", "n", "total", F.array_join(F.transform("member_ids", lambda x: x.cast("string")), ",").alias("members"))


SPLITTING = f"""
WITH RECURSIVE l AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY d, id) AS n FROM (
  SELECT o_custkey AS k, o_orderkey AS id, o_totalprice AS v, date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS d FROM orders WHERE o_totalprice < {BOUNDARY})),
m AS (SELECT k, CAST(0 AS BIGINT) AS n, CAST([] AS BIGINT[]) AS used, CAST(NULL AS BIGINT) AS anchor_id, CAST(NULL AS BIGINT[]) AS ids, CAST(NULL AS DOUBLE) AS total FROM (SELECT DISTINCT k FROM l)
UNION ALL
SELECT k, n, CASE WHEN ok THEN list_concat(used, g.ids) ELSE used END, id, CASE WHEN ok THEN g.ids END, g.total FROM (
  SELECT *, NOT list_contains(used, id) AND len(g.ids) >= 2 AND g.total >= {BOUNDARY} AND len(list_filter(range(1, len(g.ds)), lambda x: g.ds[x + 1] - g.ds[x] < 300)) > 0 AS ok FROM (
    SELECT l.k, l.n, m.used, l.id, (SELECT {{'ids': list(r.id ORDER BY r.d, r.id), 'ds': list(r.d ORDER BY r.d, r.id), 'total': CAST(sum(CAST(r.v AS DECIMAL(18,2))) AS DOUBLE)}}
      FROM l r WHERE r.k = l.k AND r.d BETWEEN l.d AND l.d + 365 AND NOT list_contains(m.used, r.id)) AS g
    FROM m JOIN l ON l.k = m.k AND l.n = m.n + 1)))
SELECT k AS o_custkey, anchor_id, len(ids) AS n, total, array_to_string(ids, ',') AS members FROM m WHERE ids IS NOT NULL"""


def renewal_gaps(t: Tables):
    return D.renewal_gaps(t.orders, "o_custkey", "o_orderdate")


RENEWAL_GAPS = """
WITH g AS (SELECT o_custkey, date_diff('day', CAST(lag(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate) AS DATE), CAST(o_orderdate AS DATE)) AS gap FROM orders)
SELECT o_custkey, count(*) AS n, CAST(min(gap) AS BIGINT) AS min_gap FROM g GROUP BY 1 HAVING count(*) >= 2 AND min(gap) >= 300"""

QUERIES = {
    "share_of_total": (query(share_of_total), SHARE_OF_TOTAL),
    "missing_value": (query(missing_value), MISSING_VALUE),
    "late_publication": (query(late_publication), LATE_PUBLICATION),
    "growth_band": _grown(1.10, 1.5),
    "growth_over_cap": _grown(1.5, 5.0),
    "single_member": (query(single_member), SINGLE_MEMBER),
    "lookup_exceptional": (query(lookup_exceptional), LOOKUP_EXCEPTIONAL),
    "short_deadline": (query(short_deadline), SHORT_DEADLINE),
    "at_ceiling": (query(at_ceiling), AT_CEILING),
    "near_threshold": (query(near_threshold), NEAR_THRESHOLD),
    "anchor_windows": (query(anchor_windows), ANCHOR_WINDOWS),
    "splitting_greedy": (query(splitting_greedy), SPLITTING),
    "renewal_gaps": (query(renewal_gaps), RENEWAL_GAPS),
}
