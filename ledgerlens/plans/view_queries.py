"""Read-side views bound to suppliers, orders, customers and embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import amounts as A
from ..operators import grouping as G
from ..operators import message as M
from ..operators import views as V
from .base import Tables, query


def contractor_profile(t: Tables):
    single = F.when(F.col("l_linenumber") <= 6, F.col("l_linenumber") == 1)
    out = V.profile(t.lineitem, "l_suppkey", "l_extendedprice", single, "l_shipdate")
    return out.select("l_suppkey", "n", "total", F.round("share", 9).alias("share"), "n_known", "n_flagged", F.round("flagged_share", 9).alias("flagged_share"), "first_date", "last_date")


PROFILE = """
WITH g AS (SELECT l_suppkey, count(*) AS n, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS s, count(CASE WHEN l_linenumber <= 6 THEN 1 END) AS n_known,
 count(*) FILTER (l_linenumber = 1) AS n_flagged, strftime(min(l_shipdate), '%Y-%m-%d') AS first_date, strftime(max(l_shipdate), '%Y-%m-%d') AS last_date FROM lineitem GROUP BY 1)
SELECT l_suppkey, n, CAST(s AS DOUBLE) AS total, round(CAST(s AS DOUBLE) / CAST(sum(s) OVER () AS DOUBLE), 9) AS share, n_known, n_flagged,
 round(n_flagged / CAST(nullif(n_known, 0) AS DOUBLE), 9) AS flagged_share, first_date, last_date FROM g"""


def by_year(t: Tables):
    return t.orders.groupBy(F.year("o_orderdate").cast("long").alias("year")).agg(F.count(F.lit(1)).alias("n"), F.sum(A.money("o_totalprice")).cast("double").alias("total"))


BY_YEAR = "SELECT year(o_orderdate) AS year, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM orders GROUP BY 1"


def top_preview(t: Tables):
    """Five orders: the largest of each priority first, then the largest of the rest."""
    out = V.one_per_group_then_fill(t.orders, "o_orderpriority", [F.desc("o_totalprice"), F.col("o_orderkey")], 5)
    return out.select("o_orderkey", "o_orderpriority", "o_totalprice")


TOP_PREVIEW = """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) = 1 AS f FROM orders)
SELECT o_orderkey, o_orderpriority, o_totalprice FROM r ORDER BY f DESC, o_totalprice DESC, o_orderkey LIMIT 5"""


def top_ranked(t: Tables):
    """The twelve largest customers by order value."""
    sums = t.orders.groupBy("o_custkey").agg(F.sum(A.money("o_totalprice")).cast("double").alias("total"))
    return sums.orderBy(F.desc("total"), "o_custkey").limit(12)


TOP_RANKED = "SELECT o_custkey, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM orders GROUP BY 1 ORDER BY total DESC, o_custkey LIMIT 12"


def message_remainder(t: Tables):
    """Counts by priority of the orders that a message with the ten largest leaves out."""
    _, rest = V.top_with_remainder(t.orders.select("o_orderkey", "o_orderpriority", "o_totalprice"), [F.desc("o_totalprice"), F.col("o_orderkey")], "o_orderpriority", 10)
    return rest


REMAINDER = """WITH r AS (SELECT o_orderpriority, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders)
SELECT o_orderpriority, count(*) AS n FROM r WHERE k > 10 GROUP BY 1"""

PRIORITIES = [("1-URGENT",), ("2-HIGH",), ("3-MEDIUM",), ("4-NOT SPECIFIED",), ("5-LOW",), ("6-NONE",)]
STATUSES = [("F",), ("O",), ("P",), ("X",)]


def histogram_zero_filled(t: Tables):
    return V.histogram(t.orders, ("o_orderpriority", A.dimension(t.spark, ["o_orderpriority"], [(p,) for (p,) in PRIORITIES])), ("o_orderstatus", A.dimension(t.spark, ["o_orderstatus"], STATUSES)))


HISTOGRAM = f"""SELECT p AS o_orderpriority, s AS o_orderstatus, count(o_orderkey) AS n FROM (VALUES {", ".join(f"('{p}')" for (p,) in PRIORITIES)}) AS a(p) CROSS JOIN (VALUES {", ".join(f"('{s}')" for (s,) in STATUSES)}) AS b(s)
LEFT JOIN orders ON o_orderpriority = p AND o_orderstatus = s GROUP BY 1, 2"""


def peer_median(t: Tables):
    return V.peer_median(t.customer, "c_nationkey", "c_custkey", "c_acctbal")


PEER_MEDIAN = """WITH m AS (SELECT c_nationkey, median(c_acctbal) AS peer_median, count(c_acctbal) AS n_peers FROM customer GROUP BY 1)
SELECT c_nationkey, c_custkey, c_acctbal, peer_median, n_peers, c_acctbal > peer_median AS above FROM customer JOIN m USING (c_nationkey)"""


def worst_status(t: Tables):
    return V.worst(t.orders, ["o_custkey"], "o_orderstatus", {"F": 0, "O": 1, "P": 2})


WORST = "SELECT o_custkey, max_by(o_orderstatus, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 WHEN 'P' THEN 2 ELSE -1 END) AS o_orderstatus FROM orders GROUP BY 1"


def partition_reconcile(t: Tables):
    """Order value by first settlement-like label; what has none is a bucket of its own."""
    label = F.when(F.col("o_orderpriority").rlike("^[12]"), F.col("o_orderpriority"))
    return V.assignment_totals(t.orders, label, "o_totalprice")


RECONCILE = """SELECT CASE WHEN o_orderpriority LIKE '1%' OR o_orderpriority LIKE '2%' THEN o_orderpriority ELSE '(unassigned)' END AS label, count(*) AS n,
CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM orders GROUP BY 1"""


def _coordinates(t: Tables):
    one = lambda k: F.col("embedding")[k].cast("decimal(18,9)")
    return t.embeddings.select("vec_id", "label", one(0).alias("x"), one(1).alias("y"))


def centroid_nearest(t: Tables):
    """Per label the vector nearest to the mean of the first two coordinates."""
    e = _coordinates(t)
    mean = e.groupBy("label").agg((F.sum("x").cast("double") / F.count("x")).alias("mx"), (F.sum("y").cast("double") / F.count("y")).alias("my"))
    d = e.join(mean, "label").withColumn("d", (F.col("x").cast("double") - F.col("mx")) * (F.col("x").cast("double") - F.col("mx")) + (F.col("y").cast("double") - F.col("my")) * (F.col("y").cast("double") - F.col("my")))
    return d.groupBy("label").agg(F.min_by("vec_id", F.struct("d", "vec_id")).alias("nearest"), F.round(F.min("mx"), 6).alias("mx"), F.round(F.min("my"), 6).alias("my"))


CENTROID = """
WITH e AS (SELECT vec_id, label, CAST(embedding[1] AS DECIMAL(18,9)) AS x, CAST(embedding[2] AS DECIMAL(18,9)) AS y FROM embeddings),
m AS (SELECT label, CAST(sum(x) AS DOUBLE) / count(x) AS mx, CAST(sum(y) AS DOUBLE) / count(y) AS my FROM e GROUP BY 1),
d AS (SELECT label, vec_id, mx, my, (CAST(x AS DOUBLE) - mx) * (CAST(x AS DOUBLE) - mx) + (CAST(y AS DOUBLE) - my) * (CAST(y AS DOUBLE) - my) AS d FROM e JOIN m USING (label))
SELECT label, min_by(vec_id, (d, vec_id)) AS nearest, round(min(mx), 6) AS mx, round(min(my), 6) AS my FROM d GROUP BY 1"""


def components(t: Tables):
    """Vectors chained by gaps of at most 0.0004 in their first coordinate, per label: component and size."""
    from pyspark.sql import Window

    e = _coordinates(t)
    w = Window.partitionBy("label").orderBy("x", "vec_id")
    edges = e.withColumn("px", F.lag("x").over(w)).withColumn("a", F.lag("vec_id").over(w)).where("x - px <= 0.0004").select("a", F.col("vec_id").alias("b"))
    return G.components(edges).groupBy("component").agg(F.count(F.lit(1)).alias("n"))


COMPONENTS = """
WITH e AS (SELECT vec_id, label, CAST(embedding[1] AS DECIMAL(18,9)) AS x FROM embeddings),
l AS (SELECT vec_id, label, x, CASE WHEN x - lag(x) OVER w <= 0.0004 THEN 0 ELSE 1 END AS s FROM e WINDOW w AS (PARTITION BY label ORDER BY x, vec_id)),
g AS (SELECT vec_id, label, sum(s) OVER (PARTITION BY label ORDER BY x, vec_id) AS g FROM l)
SELECT min(vec_id) AS component, count(*) AS n FROM g GROUP BY label, g HAVING count(*) > 1"""


def grouped_messages(t: Tables):
    """One message for each order priority: the ten gravest orders, the counts of the rest."""
    k = F.col("o_orderkey")
    severity = F.when(k % 997 == 0, "high").when(k % 3 == 0, "warning").when(k % 3 == 1, "info").otherwise("unheard")
    flags = t.orders.select("o_orderpriority", "o_orderkey", severity.alias("severity"), F.concat(F.lit("Order <"), k.cast("string"), F.lit("> & co.")).alias("message"), "o_totalprice")
    return M.grouped_message(flags, ["o_orderpriority"], flag_id="o_orderkey", message="message", severity="severity", order=[F.desc("o_totalprice"), "o_orderkey"], base_url="http://x")


def _messages_sql() -> str:
    emoji = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in M.EMOJI.items())
    rest = ", ".join(f"CASE WHEN count(*) FILTER (r > 10 AND severity = '{k}') > 0 THEN '{M.EMOJI[k]} ' || count(*) FILTER (r > 10 AND severity = '{k}') || ' {M.NAMES[k]}' END" for k in sorted(M.EMOJI))
    return f"""WITH f AS (SELECT o_orderpriority, o_orderkey AS k, o_totalprice AS v, CASE WHEN o_orderkey % 997 = 0 THEN 'high' WHEN o_orderkey % 3 = 0 THEN 'warning' WHEN o_orderkey % 3 = 1 THEN 'info' ELSE 'unheard' END AS severity FROM orders),
p AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY CASE severity WHEN 'high' THEN 0 WHEN 'warning' THEN 1 WHEN 'info' THEN 2 ELSE 9 END, v DESC, k) AS r FROM f)
SELECT o_orderpriority, count(*) AS n, rtrim('<b>Нови сигнали — ' || count(*) || ' нов(и) сигнал(и)</b>' || chr(10) || chr(10)
  || string_agg(CASE severity {emoji} ELSE '•' END || ' Order &lt;' || k || '&gt; &amp; co.' || chr(10) || '<a href="http://x/flags/#' || k || '">http://x/flags/#' || k || '</a>' || chr(10), chr(10) ORDER BY r) FILTER (r <= 10)
  || CASE WHEN count(*) > 10 THEN chr(10) || '{M.MORE}' || (count(*) - 10) || coalesce(': ' || nullif(concat_ws(', ', {rest}), ''), '') || '.' ELSE '' END, chr(10) || ' ') AS text FROM p GROUP BY 1"""


QUERIES = {
    "grouped_messages": (query(grouped_messages), _messages_sql()),
    "contractor_profile": (query(contractor_profile), PROFILE),
    "by_year": (query(by_year), BY_YEAR),
    "top_preview": (query(top_preview), TOP_PREVIEW),
    "top_ranked": (query(top_ranked), TOP_RANKED),
    "message_remainder": (query(message_remainder), REMAINDER),
    "histogram_zero_filled": (query(histogram_zero_filled), HISTOGRAM),
    "peer_median": (query(peer_median), PEER_MEDIAN),
    "worst_status": (query(worst_status), WORST),
    "partition_reconcile": (query(partition_reconcile), RECONCILE),
    "centroid_nearest": (query(centroid_nearest), CENTROID),
    "components": (query(components), COMPONENTS),
}
