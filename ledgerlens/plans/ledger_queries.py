"""Ledger-style findings bound to parts, orders over years and events over days."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import amounts as A
from ..operators import dates as D
from ..operators import linking as L
from ..operators import periods as P
from .base import Tables, query

DAYS = "SELECT user_id, event_type, strftime(ts, '%Y-%m-%d') AS day, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS v FROM events GROUP BY ALL"


def _daily(t: Tables, *keys: str):
    return t.events.groupBy(*keys, F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.sum(A.money("value")).cast("double").alias("v"))


def plan_jump(t: Tables):
    """Users whose daily value rose by half and more than 20 against their previous day of the same week."""
    week = F.date_format(F.date_trunc("week", F.to_date("day")), "yyyy-MM-dd")
    out = P.jumps(_daily(t, "user_id"), ["user_id"], "day", "v", 1.5, 20.0, same=week)
    return out.select("user_id", "previous_period", F.col("day").alias("period"), "previous", F.col("v").alias("current"))


PLAN_JUMP = """
WITH d AS (SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS v FROM events GROUP BY ALL),
l AS (SELECT user_id, day, v, lag(v) OVER w AS p, lag(day) OVER w AS pd FROM d WINDOW w AS (PARTITION BY user_id ORDER BY day))
SELECT user_id, pd AS previous_period, day AS period, p AS previous, v AS current FROM l
WHERE date_trunc('week', CAST(pd AS DATE)) = date_trunc('week', CAST(day AS DATE)) AND p > 0 AND v - p > 20 AND v >= 1.5 * p"""


def new_object(t: Tables):
    out = P.newcomers(_daily(t, "user_id", "event_type"), ["user_id", "event_type"], "day", "v", 30.0)
    return out.select("user_id", "event_type", F.col("day").alias("period"), "v")


NEW_OBJECT = f"""
WITH d AS ({DAYS}), r AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY day) AS k FROM d)
SELECT user_id, event_type, day AS period, v FROM r WHERE k = 1 AND day > (SELECT min(day) FROM d) AND v > 30"""


def _parts(t: Tables):
    """Per part: plan (retail price times 100), value spent before 1998 and from then on."""
    spent = A.money("l_extendedprice")
    early = F.col("l_shipdate") < "1998-01-01"
    sums = t.lineitem.groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.sum(F.when(early, spent).otherwise(0)).cast("double").alias("prior"), F.sum(F.when(~early, spent).otherwise(0)).cast("double").alias("spent"))
    return t.part.select("p_partkey", (F.col("p_retailprice") * 400).alias("plan")).join(sums, "p_partkey")


_PARTS = """SELECT p_partkey, p_retailprice * 400 AS plan, s.prior, s.spent FROM part JOIN (
 SELECT l_partkey, CAST(sum(CASE WHEN l_shipdate < '1998-01-01' THEN CAST(l_extendedprice AS DECIMAL(18,2)) ELSE 0 END) AS DOUBLE) AS prior,
  CAST(sum(CASE WHEN l_shipdate >= '1998-01-01' THEN CAST(l_extendedprice AS DECIMAL(18,2)) ELSE 0 END) AS DOUBLE) AS spent FROM lineitem GROUP BY 1) s ON l_partkey = p_partkey"""


def _reasons():
    plan, prior, spent = F.col("plan"), F.col("prior"), F.col("spent")
    return A.reasons(no_plan=(plan <= 362_000) & (spent >= 600_000), over_estimate=(plan > 0) & (prior + spent - 3 * plan >= 10_000))


def unplanned_spending(t: Tables):
    rows = _parts(t).withColumn("reasons", _reasons())
    return rows.where(F.size("reasons") > 0).select("p_partkey", "plan", "prior", "spent", F.array_join("reasons", ",").alias("reasons"))


_REASONS = "concat_ws(',', CASE WHEN plan <= 362000 AND spent >= 600000 THEN 'no_plan' END, CASE WHEN plan > 0 AND prior + spent - 3 * plan >= 10000 THEN 'over_estimate' END)"
UNPLANNED = f"WITH p AS ({_PARTS}), r AS (SELECT *, {_REASONS} AS reasons FROM p) SELECT p_partkey, plan, prior, spent, reasons FROM r WHERE reasons <> ''"


def overspend(t: Tables):
    rows = _parts(t).where((F.size(_reasons()) == 0) & (F.col("plan") > 0) & (F.col("spent") - F.lit(1.02) * F.col("plan") > 10_000))
    return rows.select("p_partkey", "plan", "spent", (F.col("spent") - F.col("plan")).alias("excess"))


OVERSPEND = f"WITH p AS ({_PARTS}), r AS (SELECT *, {_REASONS} AS reasons FROM p) SELECT p_partkey, plan, spent, spent - plan AS excess FROM r WHERE reasons = '' AND plan > 0 AND spent - 1.02 * plan > 10000"


def calendar_gap_day(t: Tables):
    """Users' days without an event."""
    days = t.events.select("user_id", F.to_date("ts").alias("day"))
    return D.missing_periods(days, ["user_id"], "day", "1 day").select("user_id", F.date_format("day", "yyyy-MM-dd").alias("day"))


CALENDAR_GAP_DAY = """
WITH h AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events), b AS (SELECT min(day) AS a, max(day) AS z FROM h),
c AS (SELECT CAST(unnest(generate_series(a, z, INTERVAL 1 DAY)) AS DATE) AS day FROM b)
SELECT user_id, strftime(day, '%Y-%m-%d') AS day FROM (SELECT DISTINCT user_id FROM h) CROSS JOIN c EXCEPT SELECT user_id, strftime(day, '%Y-%m-%d') FROM h"""


def calendar_gap_month(t: Tables):
    """Months of the whole span in which a market segment's nation placed no order."""
    joined = t.orders.join(t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_nationkey", "c_mktsegment"), "o_custkey")
    months = joined.select("c_nationkey", "c_mktsegment", F.trunc("o_orderdate", "month").alias("month"))
    gaps = D.missing_periods(months, ["c_nationkey", "c_mktsegment"], "month", "1 month")
    return gaps.select("c_nationkey", "c_mktsegment", F.date_format("month", "yyyy-MM").alias("month"))


CALENDAR_GAP_MONTH = """
WITH h AS (SELECT DISTINCT c_nationkey, c_mktsegment, CAST(date_trunc('month', o_orderdate) AS DATE) AS m FROM orders JOIN customer ON c_custkey = o_custkey),
c AS (SELECT CAST(unnest(generate_series(min(m), max(m), INTERVAL 1 MONTH)) AS DATE) AS m FROM h)
SELECT c_nationkey, c_mktsegment, strftime(m, '%Y-%m') AS month FROM (SELECT DISTINCT c_nationkey, c_mktsegment FROM h) CROSS JOIN c
EXCEPT SELECT c_nationkey, c_mktsegment, strftime(m, '%Y-%m') FROM h"""


def calendar_gap_year(t: Tables):
    """Years without a closing (December) order per nation; years start with the data's second one."""
    joined = t.orders.join(t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
    rows = joined.select("c_nationkey", F.trunc("o_orderdate", "year").alias("year"), (F.month("o_orderdate") == 12).alias("closing"))
    span = rows.agg(F.min("year").alias("year")).unionByName(rows.agg(F.max("year").alias("year")))
    gaps = D.missing_periods(rows.where("closing").drop("closing"), ["c_nationkey"], "year", "1 year", bounds=span)
    return gaps.select("c_nationkey", F.date_format("year", "yyyy").alias("year"))


CALENDAR_GAP_YEAR = """
WITH r AS (SELECT c_nationkey, year(o_orderdate) AS y, month(o_orderdate) = 12 AS closing FROM orders JOIN customer ON c_custkey = o_custkey),
c AS (SELECT unnest(generate_series(min(y), max(y))) AS y FROM r)
SELECT c_nationkey, CAST(y AS VARCHAR) AS year FROM (SELECT DISTINCT c_nationkey FROM r WHERE closing) CROSS JOIN c
EXCEPT SELECT c_nationkey, CAST(y AS VARCHAR) FROM r WHERE closing"""


def _monthly_orders(t: Tables):
    return t.orders.groupBy("o_custkey", D.year_month(F.col("o_orderdate")).alias("period")).agg(F.sum(A.money("o_totalprice")).cast("double").alias("total"))


_MONTHLY = "SELECT o_custkey, strftime(o_orderdate, '%Y-%m') AS period, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM orders GROUP BY ALL"


def year_end_rows(t: Tables):
    rows = _monthly_orders(t).withColumn("year", F.substring("period", 1, 4))
    return P.latest_rows(rows, "period", ["o_custkey", "year"]).select("o_custkey", "year", "period", "total")


YEAR_END = f"WITH m AS ({_MONTHLY}) SELECT o_custkey, left(period, 4) AS year, period, total FROM m QUALIFY period = max(period) OVER (PARTITION BY o_custkey, left(period, 4))"


def latest_period(t: Tables):
    return P.latest_rows(_monthly_orders(t), "period").select("o_custkey", "period", "total")


LATEST_PERIOD = f"WITH m AS ({_MONTHLY}) SELECT * FROM m WHERE period = (SELECT max(period) FROM m)"


def representative_period(t: Tables):
    return P.representative_period(_monthly_orders(t), "period")


REPRESENTATIVE = f"""WITH m AS ({_MONTHLY}) SELECT left(period, 4) AS year, coalesce(max(period) FILTER (period LIKE '%-12'), max(period)) AS period,
max(period) FILTER (period LIKE '%-12') IS NULL AS is_fallback FROM m GROUP BY 1"""


def period_changes(t: Tables):
    out = P.period_changes(_daily(t, "user_id", "event_type"), ["user_id", "event_type"], "day", "v", 0.5)
    return out.select("user_id", "event_type", F.col("day").alias("period"), "previous_period", "previous_amount", F.col("v").alias("amount"), F.round("delta", 6).alias("delta"))


PERIOD_CHANGES = f"""
WITH d AS ({DAYS}), r AS (SELECT *, dense_rank() OVER (ORDER BY day) AS k FROM d)
SELECT c.user_id, c.event_type, c.day AS period, p.day AS previous_period, p.v AS previous_amount, c.v AS amount, round(c.v - p.v, 6) AS delta
FROM r c JOIN r p ON p.user_id = c.user_id AND p.event_type = c.event_type AND p.k = c.k - 1 WHERE abs(c.v - p.v) > 0.5"""


def fill_down(t: Tables):
    """Every assistant turn with the last user text before it."""
    filled = P.fill_down(t.conversations, ["conv_id"], "turn", F.when(F.col("role") == "user", F.col("text")), "question", inclusive=False)
    return filled.where("role <> 'user'").select("conv_id", "turn", "role", F.md5("question").alias("question_md5"))


FILL_DOWN = """
SELECT conv_id, turn, role, md5(question) AS question_md5 FROM (SELECT *, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS)
  OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS question FROM conversations) WHERE role <> 'user'"""


def rollup_check(t: Tables):
    joined = t.customer.join(t.nation.select(F.col("n_nationkey").alias("c_nationkey"), "n_name", "n_regionkey"), "c_nationkey").join(t.region.select(F.col("r_regionkey").alias("n_regionkey"), "r_name"), "n_regionkey")
    return P.rollup_sums(joined, ["r_name", "n_name", "c_mktsegment"], "c_acctbal")


ROLLUP = """SELECT r_name, n_name, c_mktsegment, CAST(sum(CAST(c_acctbal AS DECIMAL(18,2))) AS DOUBLE) AS total, count(*) AS n,
CAST(3 - grouping(r_name) - grouping(n_name) - grouping(c_mktsegment) AS BIGINT) AS level
FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY ROLLUP (r_name, n_name, c_mktsegment)"""


def subtotal_mismatch(t: Tables):
    """Orders whose stated total differs from the sum of their lines by more than 1."""
    details = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), "l_extendedprice")
    out = P.subtotal_mismatches(details, t.orders.select("o_orderkey", "o_totalprice"), ["o_orderkey"], "l_extendedprice", "o_totalprice")
    return out.select("o_orderkey", F.col("summed").cast("double").alias("summed"), F.col("difference").cast("double").alias("difference"))


SUBTOTAL = """WITH s AS (SELECT l_orderkey AS o_orderkey, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS v FROM lineitem GROUP BY 1)
SELECT o_orderkey, CAST(v AS DOUBLE) AS summed, CAST(abs(v - CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS difference
FROM orders JOIN s USING (o_orderkey) WHERE abs(v - CAST(o_totalprice AS DECIMAL(18,2))) > 1"""


def rank_dedupe(t: Tables):
    """The longest document per language and source; ties go to the smaller id."""
    best = L.first_by(t.documents.select("doc_id", "lang", "source", "n_chars"), ["lang", "source"], F.desc("n_chars"), "doc_id")
    return best.select("lang", "source", "doc_id", "n_chars")


RANK_DEDUPE = "SELECT lang, source, doc_id, n_chars FROM documents QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY n_chars DESC, doc_id) = 1"

QUERIES = {
    "plan_jump": (query(plan_jump), PLAN_JUMP),
    "new_object": (query(new_object), NEW_OBJECT),
    "unplanned_spending": (query(unplanned_spending), UNPLANNED),
    "overspend": (query(overspend), OVERSPEND),
    "calendar_gap_day": (query(calendar_gap_day), CALENDAR_GAP_DAY),
    "calendar_gap_month": (query(calendar_gap_month), CALENDAR_GAP_MONTH),
    "calendar_gap_year": (query(calendar_gap_year), CALENDAR_GAP_YEAR),
    "year_end_rows": (query(year_end_rows), YEAR_END),
    "latest_period": (query(latest_period), LATEST_PERIOD),
    "representative_period": (query(representative_period), REPRESENTATIVE),
    "period_changes": (query(period_changes), PERIOD_CHANGES),
    "fill_down": (query(fill_down), FILL_DOWN),
    "rollup_check": (query(rollup_check), ROLLUP),
    "subtotal_mismatch": (query(subtotal_mismatch), SUBTOTAL),
    "rank_dedupe": (query(rank_dedupe), RANK_DEDUPE),
}
