"""Links, identities, entity-level findings and keyed stores bound to the star schema."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import amounts as A
from ..operators import dates as D
from ..operators import grouping as G
from ..operators import lifecycle as C
from ..operators import linking as L
from .base import NET_BY_ORDER, Tables, net_by_order, query


def closest_link(t: Tables):
    """Orders and the line of the same order whose price is closest to a quarter of the total."""
    left = t.orders.select("o_orderkey", (F.col("o_totalprice") / 4).alias("quarter"))
    right = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), (F.col("l_partkey") * 1_000_000 + F.col("l_suppkey") * 100 + F.col("l_linenumber")).alias("line_id"), "l_extendedprice")
    out = L.closest_link(left, right, ["o_orderkey"], "o_orderkey", "line_id", "quarter", "l_extendedprice")
    return out.select("o_orderkey", "n_candidates", "l_extendedprice")


CLOSEST_LINK = """
WITH p AS (SELECT o_orderkey, l_extendedprice, o_totalprice / 4 AS quarter, abs(o_totalprice / 4 - l_extendedprice) AS delta,
  l_partkey * 1000000 + l_suppkey * 100 + l_linenumber AS line_id FROM orders JOIN lineitem ON l_orderkey = o_orderkey),
r AS (SELECT *, count(*) OVER (PARTITION BY o_orderkey) AS n_candidates, row_number() OVER (PARTITION BY o_orderkey ORDER BY delta, line_id) AS k FROM p)
SELECT o_orderkey, n_candidates, l_extendedprice FROM r WHERE k = 1 AND (n_candidates = 1 OR delta <= 0.02 * quarter)"""


def greedy_one_to_one(t: Tables):
    """Odd orders matched to even orders of the same customer by value within 30 % and 90 days."""
    o = t.orders.select("o_custkey", F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("v"), F.col("o_orderdate").alias("d"))
    return L.greedy_one_to_one(o.where("id % 2 = 1"), o.where("id % 2 = 0"), "o_custkey", ("id", "v", "d"), ("id", "v", "d"), 0.3, 90)


GREEDY = """
WITH RECURSIVE o AS (SELECT o_custkey AS k, o_orderkey AS id, o_totalprice AS v, o_orderdate AS d FROM orders),
l AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY id) AS n FROM o WHERE id % 2 = 1),
r AS (SELECT * FROM o WHERE id % 2 = 0),
m AS (SELECT k, CAST(0 AS BIGINT) AS n, CAST([] AS BIGINT[]) AS used, CAST(NULL AS BIGINT) AS left_id, CAST(NULL AS BIGINT) AS right_id FROM (SELECT DISTINCT k FROM l)
UNION ALL
SELECT k, n, CASE WHEN pick IS NULL THEN used ELSE list_append(used, pick) END, id, pick FROM (
  SELECT l.k, l.n, m.used, l.id, (SELECT arg_min(r.id, (abs(date_diff('day', r.d, l.d)), abs(r.v - l.v), r.id)) FROM r WHERE r.k = l.k AND abs(r.v - l.v) <= 0.3 * l.v AND abs(date_diff('day', r.d, l.d)) <= 90 AND NOT list_contains(m.used, r.id)) AS pick
  FROM m JOIN l ON l.k = m.k AND l.n = m.n + 1))
SELECT left_id, right_id FROM m WHERE right_id IS NOT NULL"""


def identity_explode(t: Tables):
    """Orders with their suppliers' keys joined into one text, split again into canonical identifiers."""
    joined = t.lineitem.groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_set(F.col("l_suppkey").cast("string"))), "; ").alias("ids"))
    return L.explode_ids(joined, "ids").select("l_orderkey", "entity_id")


IDENTITY = "SELECT DISTINCT l_orderkey, CASE WHEN length(CAST(l_suppkey AS VARCHAR)) < 9 THEN lpad(CAST(l_suppkey AS VARCHAR), 9, '0') ELSE CAST(l_suppkey AS VARCHAR) END AS entity_id FROM lineitem"


def person_concentration(t: Tables):
    """Nations behind two suppliers or more."""
    revenue = t.lineitem.groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count(F.lit(1)).alias("c"), F.sum(A.money("l_extendedprice")).cast("double").alias("t"))
    links = t.supplier.select("s_suppkey", "s_nationkey").join(revenue, "s_suppkey")
    out = G.concentration(links, "s_nationkey", "s_suppkey", "c", "t", min_count=2000, min_total=5e7, high_count=4000, high_total=1.5e8)
    return out.select("s_nationkey", "n_entities", "n", "total", "severity")


CONCENTRATION = """
WITH r AS (SELECT s_nationkey, s_suppkey, count(*) AS c, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS t FROM supplier JOIN lineitem ON l_suppkey = s_suppkey GROUP BY 1, 2),
g AS (SELECT s_nationkey, count(*) AS n_entities, CAST(sum(c) AS BIGINT) AS n, CAST(sum(t) AS DOUBLE) AS total FROM r GROUP BY 1)
SELECT *, CASE WHEN n >= 4000 OR total >= 1.5e8 THEN 'high' ELSE 'warning' END AS severity FROM g WHERE n_entities >= 2 AND (n >= 2000 OR total >= 5e7)"""


def related_party(t: Tables):
    """Customers and suppliers related by key number (declared) or by nation and balance (name); one basis per pair of nation and customer."""
    c = t.customer.select("c_custkey", "c_nationkey", F.floor(F.col("c_acctbal") / 50).alias("band"))
    s = t.supplier.select("s_suppkey", "s_nationkey", F.floor(F.col("s_acctbal") / 50).alias("band"))
    declared = c.join(s, c["c_custkey"] == s["s_suppkey"]).select("c_custkey", "c_nationkey", "s_suppkey", F.lit(2).alias("rank"))
    first = s.groupBy("s_nationkey", "band").agg(F.min("s_suppkey").alias("s_suppkey"))  # the one that wins among a nation's equal balances
    named = c.join(first, (c["c_nationkey"] == first["s_nationkey"]) & (c["band"] == first["band"])).select("c_custkey", "c_nationkey", "s_suppkey", F.lit(1).alias("rank"))
    best = L.first_by(declared.unionByName(named), ["c_custkey"], F.desc("rank"), "s_suppkey")
    return best.select("c_custkey", "s_suppkey", F.when(F.col("rank") == 2, "declaration").otherwise("name").alias("basis"))


RELATED = """
WITH u AS (SELECT c_custkey, s_suppkey, 2 AS rank FROM customer JOIN supplier ON c_custkey = s_suppkey UNION ALL
 SELECT c_custkey, s_suppkey, 1 FROM customer JOIN supplier ON c_nationkey = s_nationkey AND floor(c_acctbal / 50) = floor(s_acctbal / 50))
SELECT c_custkey, s_suppkey, CASE rank WHEN 2 THEN 'declaration' ELSE 'name' END AS basis FROM u
QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY rank DESC, s_suppkey) = 1"""


def young_entity(t: Tables):
    """Large orders within a year of the customer's first one, for segments that start with A or B."""
    first = t.orders.groupBy("o_custkey").agg(F.min("o_orderdate").alias("since"))
    named = t.customer.where(F.substring("c_mktsegment", 1, 1).isin("A", "B")).select(F.col("c_custkey").alias("o_custkey"))
    age = F.datediff(D.local_date(F.col("o_orderdate")), D.local_date(F.col("since"))).cast("long")
    rows = t.orders.where("o_totalprice >= 50000").join(first, "o_custkey").join(named, "o_custkey", "left_semi").withColumn("age_days", age)
    level = F.when((F.col("o_totalprice") >= 200_000) | (F.col("age_days") <= 183), "high").otherwise("warning")
    return rows.where(F.col("age_days").between(0, 365)).select("o_orderkey", "age_days", level.alias("severity"))


YOUNG = """
WITH f AS (SELECT o_custkey, min(o_orderdate) AS since FROM orders GROUP BY 1),
j AS (SELECT o_orderkey, o_totalprice, CAST(date_diff('day', CAST(timezone('Europe/Sofia', timezone('UTC', CAST(since AS TIMESTAMP))) AS DATE), CAST(timezone('Europe/Sofia', timezone('UTC', CAST(o_orderdate AS TIMESTAMP))) AS DATE)) AS BIGINT) AS age_days
 FROM orders JOIN f USING (o_custkey) WHERE o_totalprice >= 50000 AND EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND left(c_mktsegment, 1) IN ('A', 'B')))
SELECT o_orderkey, age_days, CASE WHEN o_totalprice >= 200000 OR age_days <= 183 THEN 'high' ELSE 'warning' END AS severity FROM j WHERE age_days BETWEEN 0 AND 365"""


def entity_status(t: Tables):
    """Customers with an open order long after their last fulfilled one, or without any fulfilled one."""
    year = F.year("o_orderdate")
    per = t.orders.groupBy("o_custkey").agg(F.max(F.when(F.col("o_orderstatus") == "F", year)).alias("filed"), F.max(year).alias("latest"), F.sum(A.money("o_totalprice")).cast("double").alias("total"), F.max(F.when(F.col("o_orderstatus") == "P", 1).otherwise(0)).alias("pending"))
    stale = (F.col("total") >= 100_000) & (F.col("filed").isNull() | (F.col("filed") < F.col("latest") - 2))
    rows = per.withColumn("reasons", A.reasons(pending=F.col("pending") == 1, stale=stale))
    kept = rows.where(F.array_contains("reasons", "stale"))
    return kept.select("o_custkey", F.col("filed").cast("long").alias("filed"), F.col("latest").cast("long").alias("latest"), "total", F.array_join("reasons", ",").alias("reasons"))


STATUS = """
WITH p AS (SELECT o_custkey, max(year(o_orderdate)) FILTER (o_orderstatus = 'F') AS filed, max(year(o_orderdate)) AS latest,
 CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total, bool_or(o_orderstatus = 'P') AS pending FROM orders GROUP BY 1)
SELECT o_custkey, CAST(filed AS BIGINT) AS filed, CAST(latest AS BIGINT) AS latest, total, concat_ws(',', CASE WHEN pending THEN 'pending' END, 'stale') AS reasons
FROM p WHERE total >= 100000 AND (filed IS NULL OR filed < latest - 2)"""

PAIRS = [("PROMO", "1", "promotion", 0), ("PROMO", "2", "promotion", 1), ("ECONOMY", "1", "economy", 2), ("SMALL", "3", "small", 3), ("LARGE", "4", "large", 4)]
_PAIRS_SQL = "(VALUES " + ", ".join(str(p) for p in PAIRS) + ") AS v(kind, maker, reason, ord)"


def pair_mismatch(t: Tables):
    """Parts whose type and brand are an incompatible pair; the first pair in list order names the reason."""
    pairs = A.dimension(t.spark, ["kind", "maker", "reason", "ord"], PAIRS)
    p = t.part.withColumn("kind", F.split("p_type", " ")[0]).withColumn("maker", F.substring(F.regexp_replace("p_brand", "[^0-9]", ""), 1, 1))
    hit = p.join(F.broadcast(pairs), ["kind", "maker"])
    return hit.groupBy("p_partkey").agg(F.min_by("reason", "ord").alias("reason"))


PAIR = f"SELECT p_partkey, min_by(reason, ord) AS reason FROM part JOIN {_PAIRS_SQL} ON kind = split_part(p_type, ' ', 1) AND maker = left(regexp_replace(p_brand, '[^0-9]', '', 'g'), 1) GROUP BY 1"


def _findings(t: Tables):
    """rule and order key of three rules."""
    o = t.orders.select("o_orderkey", "o_totalprice", "o_orderdate")
    grown = A.growth_band(o.join(net_by_order(t), "o_orderkey"), "o_totalprice", "net", 1.1, 1.5)
    near = A.near_threshold(o, "o_totalprice", (50_000.0, 100_000.0, 273_812.0))
    single = A.sole_member(t.lineitem.select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey")
    parts = [d.select(F.lit(name).alias("rule"), "o_orderkey") for name, d in (("growth", grown), ("near", near), ("single", single))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_FINDINGS = f"""SELECT 'growth' AS rule, o_orderkey FROM orders JOIN ({NET_BY_ORDER}) USING (o_orderkey) WHERE o_totalprice > 0 AND net > 0 AND net > 1.1 * o_totalprice AND net <= 1.5 * o_totalprice
UNION ALL SELECT 'near', o_orderkey FROM orders WHERE (o_totalprice >= 0.95 * 50000.0 AND o_totalprice < 50000.0) OR (o_totalprice >= 0.95 * 100000.0 AND o_totalprice < 100000.0) OR (o_totalprice >= 0.95 * 273812.0 AND o_totalprice < 273812.0)
UNION ALL SELECT 'single', l_orderkey FROM lineitem GROUP BY l_orderkey HAVING count(*) = 1"""


def meta_flags(t: Tables):
    """Orders of one market segment with any finding: their rules."""
    funded = t.orders.join(t.customer.where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey")), "o_custkey", "left_semi").select("o_orderkey")
    rules = _findings(t).groupBy("o_orderkey").agg(F.array_sort(F.collect_set("rule")).alias("r")).join(funded, "o_orderkey", "left_semi")
    return rules.select("o_orderkey", F.array_join("r", ",").alias("rules"), F.size("r").cast("long").alias("n_rules"))


META = f"""WITH f AS ({_FINDINGS}) SELECT o_orderkey, string_agg(DISTINCT rule, ',' ORDER BY rule) AS rules, count(DISTINCT rule) AS n_rules
FROM f WHERE o_orderkey IN (SELECT o_orderkey FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_mktsegment = 'BUILDING') GROUP BY 1"""

CUT1, CUT2 = "1998-06-01", "1999-06-01"


def _large_at(t: Tables, cut: str):
    last = t.orders.where(F.col("o_orderdate") < cut).groupBy("o_custkey").agg(F.max_by("o_totalprice", F.struct("o_orderdate", "o_orderkey")).alias("value"))
    return last.where("value >= 250000").select(F.lit("large_last").alias("rule"), F.col("o_custkey").cast("string").alias("subject_key"), "value")


def lifecycle_merge(t: Tables):
    """Customers whose last order is large, at two dates: what is new, updated and resolved at the second."""
    seen = F.lit(CUT1).cast("date")
    stored = _large_at(t, CUT1).select("*", seen.alias("first_seen_at"), seen.alias("last_seen_at"), F.lit(None).cast("date").alias("resolved_at"))
    merged = C.merge_findings(stored, _large_at(t, CUT2), ["large_last"], F.lit(CUT2).cast("date"))
    text = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
    return merged.select("rule", "subject_key", "value", text("first_seen_at"), text("last_seen_at"), text("resolved_at"), "change")


LIFECYCLE = f"""
WITH a AS (SELECT o_custkey, max_by(o_totalprice, (o_orderdate, o_orderkey)) AS v FROM orders WHERE o_orderdate < '{CUT1}' GROUP BY 1 HAVING v >= 250000),
b AS (SELECT o_custkey, max_by(o_totalprice, (o_orderdate, o_orderkey)) AS v FROM orders WHERE o_orderdate < '{CUT2}' GROUP BY 1 HAVING v >= 250000)
SELECT 'large_last' AS rule, CAST(coalesce(b.o_custkey, a.o_custkey) AS VARCHAR) AS subject_key, coalesce(b.v, a.v) AS value,
 CASE WHEN a.o_custkey IS NOT NULL THEN '{CUT1}' ELSE '{CUT2}' END AS first_seen_at, CASE WHEN b.o_custkey IS NOT NULL THEN '{CUT2}' ELSE '{CUT1}' END AS last_seen_at,
 CASE WHEN b.o_custkey IS NULL THEN '{CUT2}' END AS resolved_at, CASE WHEN a.o_custkey IS NULL THEN 'new' WHEN b.o_custkey IS NULL THEN 'resolved' ELSE 'updated' END AS change
FROM a FULL JOIN b ON a.o_custkey = b.o_custkey"""


def upsert_cent_tolerant(t: Tables):
    """Customers' balances against a later copy: noise below a cent on some, real changes on others, new and missing keys."""
    base = t.customer.select("c_custkey", "c_mktsegment", "c_acctbal")
    stored = base.where("c_custkey % 10 <> 9")
    later = base.where("c_custkey % 10 <> 8").select("c_custkey", "c_mktsegment", F.when(F.col("c_custkey") % 10 == 0, F.col("c_acctbal") + 1).when(F.col("c_custkey") % 10 == 1, F.col("c_acctbal") + 0.001).otherwise(F.col("c_acctbal")).alias("c_acctbal"))
    return C.upsert(stored, later, ["c_custkey"], cents=["c_acctbal"]).groupBy("change").agg(F.count(F.lit(1)).alias("n"))


UPSERT = """SELECT CASE WHEN c_custkey % 10 = 9 THEN 'inserted' WHEN c_custkey % 10 = 0 THEN 'updated' ELSE 'same' END AS change, count(*) AS n FROM customer GROUP BY 1"""


def delete_orphans(t: Tables):
    """Lines whose order's customer exists: what a NOT IN delete leaves."""
    valid = t.orders.where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("l_orderkey"))
    left = C.survivors(t.lineitem.select("l_orderkey", "l_partkey"), valid, "l_orderkey")
    return left.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))


ORPHANS = "SELECT l_orderkey, count(*) AS n FROM lineitem WHERE NOT (l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O')) OR l_orderkey IS NULL GROUP BY 1"

QUERIES = {
    "closest_link": (query(closest_link), CLOSEST_LINK),
    "greedy_one_to_one": (query(greedy_one_to_one), GREEDY),
    "identity_explode": (query(identity_explode), IDENTITY),
    "person_concentration": (query(person_concentration), CONCENTRATION),
    "related_party": (query(related_party), RELATED),
    "young_entity": (query(young_entity), YOUNG),
    "entity_status": (query(entity_status), STATUS),
    "pair_mismatch": (query(pair_mismatch), PAIR),
    "meta_flags": (query(meta_flags), META),
    "lifecycle_merge": (query(lifecycle_merge), LIFECYCLE),
    "upsert_cent_tolerant": (query(upsert_cent_tolerant), UPSERT),
    "delete_orphans": (query(delete_orphans), ORPHANS),
}
