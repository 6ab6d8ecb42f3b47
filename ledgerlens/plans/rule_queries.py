"""The rules themselves, and published views, on domain tables that are laid out from the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import Thresholds
from ..functions import display as D
from ..functions import text as X
from ..operators import publish as P
from ..operators.amounts import money
from ..rules import budget, companies, contracts
from ..rules.common import contracts_view
from ..schemas import PROCUREMENTS
from .base import Tables, query

T = Thresholds()
NOW = "1998-08-02"


def procurements(t: Tables) -> DataFrame:
    """Orders as contracts of two registers: values, annexes, publication dates and bids follow from the keys."""
    target = t.spark.createDataFrame([], PROCUREMENTS).schema
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    signed_ms = F.unix_millis(F.col("o_orderdate").cast("timestamp"))
    net = lambda ms: F.concat(F.lit("/Date("), ms.cast("string"), F.lit(")/"))
    contract = {
        "ContractDate": net(signed_ms),
        "TedPublishDate": net(signed_ms + (k % 120) * 86_400_000),
        "TenderNumber": F.concat(F.lit("T"), k.cast("string")),
        "TypeOfContract": (k % 3 + 1).cast("int"),
        "ContractValue": F.col("o_totalprice"),
        "Currency": F.lit(1),
        "CurrentContractValue": F.col("o_totalprice") * (1 + (k % 9) / 8.0),
        "CurrentContractCurrency": F.lit(1),
    }
    given = {
        "id": k,
        "source": F.when(k % 5 == 0, "sigma").otherwise("eop"),
        "source_id": k.cast("string"),
        "title": F.concat(F.lit("Order "), k.cast("string")),
        "cpv_code": F.concat(F.when(k % 2 == 0, "45").otherwise("79"), F.lit("000000")),
        "contract_value_eur": F.when(k % 17 != 0, F.col("o_totalprice")).cast("decimal(16,2)"),
        "contractor_name": F.concat(F.lit("Customer "), c.cast("string")),
        "contractor_eik": F.lpad((c + 200_000_000).cast("string"), 9, "0"),
        "bids_received": (k % 4).cast("int"),
        "contract_date": F.col("o_orderdate").cast("timestamp"),
    }

    def struct(kind, values):
        return F.struct(*[values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in kind.fields])

    raw = F.struct(*[(struct(f.dataType, contract) if f.name == "contract" else F.lit(None).cast(f.dataType)).alias(f.name) for f in target["raw"].dataType.fields])
    return t.orders.select(*[(raw if f.name == "raw" else given.get(f.name, F.lit(None)).cast(f.dataType)).alias(f.name) for f in target.fields])


def _view(t: Tables) -> DataFrame:
    return contracts_view(procurements(t))


def _found(flags: DataFrame) -> DataFrame:
    return flags.select("rule", "tier", "severity", "subject_id", "subject_key")


_C = """c AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN 'sigma' ELSE 'eop' END AS source, CASE WHEN o_orderkey % 17 <> 0 THEN o_totalprice END AS eur, o_totalprice AS before,
  o_totalprice * (1 + (o_orderkey % 9) / 8.0) AS after, o_orderkey % 4 AS bids, o_orderkey % 120 - 30 AS late, o_custkey, o_orderdate FROM orders),
s AS (SELECT *, source || ':' || id AS subject FROM c)"""


def _sql(rule: str, tier: str, severity: str, where: str) -> str:
    return f"WITH {_C} SELECT '{rule}' AS rule, '{tier}' AS tier, {severity} AS severity, subject AS subject_id, subject AS subject_key FROM s WHERE {where}"


def rule_missing_value(t: Tables):
    return _found(contracts.missing_value(_view(t), T))


def rule_late_publication(t: Tables):
    return _found(contracts.late_publication(_view(t), T))


def rule_annex_growth(t: Tables):
    return _found(contracts.annex_growth(_view(t), T))


def rule_annex_over_cap(t: Tables):
    return _found(contracts.annex_over_cap(_view(t), T))


def rule_single_bidder(t: Tables):
    return _found(contracts.single_bidder(_view(t), T))


def rule_concentration(t: Tables):
    small = Thresholds(concentration_share=0.001, concentration_days=365)
    return _found(contracts.contractor_concentration(_view(t), F.lit(NOW).cast("timestamp"), small))


CONCENTRATION = f"""WITH {_C}, w AS (SELECT *, lpad(CAST(o_custkey + 200000000 AS VARCHAR), 9, '0') AS k FROM s WHERE source = 'eop' AND eur IS NOT NULL AND o_orderdate >= TIMESTAMP '{NOW}' - INTERVAL 365 DAY),
g AS (SELECT k, count(*) AS n, sum(CAST(eur AS DECIMAL(18,2))) AS v FROM w GROUP BY 1), a AS (SELECT *, sum(v) OVER () AS total FROM g)
SELECT 'contractor_concentration' AS rule, 'signal' AS tier, 'info' AS severity, k AS subject_id, k AS subject_key FROM a WHERE n >= 3 AND CAST(v AS DOUBLE) / CAST(total AS DOUBLE) >= 0.001"""


def _companies(t: Tables) -> DataFrame:
    """Customers as companies; keys decide on founding, standing, activity and reports."""
    k = F.col("c_custkey")
    return t.customer.select(
        (k + 200_000_000).cast("string").alias("eik"),
        F.col("c_name").alias("name"),
        F.when(k % 7 == 0, "ЕТ").otherwise("ООД").alias("legal_form"),
        F.when(k % 11 == 0, "insolvency").when(k % 13 == 0, "liquidation").otherwise("active").alias("status"),
        F.when(k % 2 == 0, "55.10").otherwise("62.01").alias("nkid_code"),
        F.lit("label").alias("nkid_label"),
        F.expr("timestamp_seconds(694224000 + c_custkey % 2000 * 86400)").alias("registered_at"),
        F.when(k % 3 == 0, 1990).otherwise(1997).alias("last_annual_report_year"),
        F.lit(None).cast("int").alias("last_no_activity_declaration_year"),
    )


_F = f"""{_C}, f AS (SELECT *, CAST(o_custkey + 200000000 AS VARCHAR) AS eik FROM s WHERE source = 'eop'),
p AS (SELECT eik, min(o_custkey) AS k, count(*) AS n, sum(CAST(eur AS DECIMAL(18,2))) AS v, max(o_orderdate) AS last_on FROM f GROUP BY 1)"""


def rule_company_status(t: Tables):
    return _found(companies.company_status(_view(t), _companies(t), F.lit(NOW).cast("timestamp"), T))


STATUS = f"""WITH {_F}, j AS (SELECT *, (k % 11 = 0 OR k % 13 = 0) AND last_on >= DATE '{NOW}' - INTERVAL 1095 DAY AS bad,
 k % 7 <> 0 AND v >= 100000 AND (CASE WHEN k % 3 = 0 THEN 1990 ELSE 1997 END) < year(last_on) - 2 AS stale FROM p)
SELECT 'company_status' AS rule, 'signal' AS tier, CASE WHEN bad AND k % 11 = 0 THEN 'high' ELSE 'warning' END AS severity, eik AS subject_id, 'company:' || eik AS subject_key FROM j WHERE bad OR stale"""


def rule_activity_mismatch(t: Tables):
    return _found(companies.activity_mismatch(_view(t), _companies(t), T))


MISMATCH = f"""WITH {_F} SELECT 'activity_mismatch' AS rule, 'signal' AS tier, 'warning' AS severity, subject AS subject_id, subject || ':' || eik AS subject_key
FROM f WHERE eur >= 50000 AND o_custkey % 2 = 0 AND id % 2 = 0"""


def rule_young_company(t: Tables):
    return _found(companies.young_company(_view(t), _companies(t), T))


YOUNG = f"""WITH {_F}, a AS (SELECT *, date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) - o_custkey % 2000 AS age FROM f WHERE eur >= 50000)
SELECT 'young_company' AS rule, 'signal' AS tier, CASE WHEN eur >= 200000 OR age <= 183 THEN 'high' ELSE 'warning' END AS severity, subject AS subject_id, subject || ':' || eik AS subject_key FROM a WHERE age BETWEEN 0 AND 365"""


def _objects(t: Tables) -> DataFrame:
    """Line items as budget objects: supplier and quarter give plan and spending."""
    month = F.add_months(F.trunc("l_shipdate", "quarter"), 2)
    rows = t.lineitem.groupBy((F.col("l_suppkey") % 10 + 5200).cast("string").alias("paragraph"), F.concat(F.lit("Object "), (F.col("l_suppkey") % 40).cast("string")).alias("object_name"), F.date_format(month, "yyyy-MM").alias("period"))
    sums = rows.agg(F.sum(money("l_quantity") * 1000).cast("decimal(18,2)").alias("plan_current"), F.sum(money("l_extendedprice")).cast("decimal(18,2)").alias("spent_period"), F.sum(money("l_quantity") * 1500).cast("decimal(18,2)").alias("estimated_total"), (F.sum(money("l_discount")) * 0).cast("decimal(18,2)").alias("spent_prior"))
    return budget.objects(sums.select("*", F.lit("Общо").alias("unit"), F.lit("object").alias("row_type")))


_O = """o AS (SELECT CAST(l_suppkey % 10 + 5200 AS VARCHAR) AS paragraph, 'Object ' || l_suppkey % 40 AS name, strftime(date_trunc('quarter', l_shipdate) + INTERVAL 2 MONTH, '%Y-%m') AS period,
  CAST(sum(l_quantity) * 1000 AS DOUBLE) AS plan, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS spent, CAST(sum(l_quantity) * 1500 AS DOUBLE) AS est FROM lineitem GROUP BY ALL),
k AS (SELECT *, paragraph || ':' || name AS key, left(period, 4) AS year FROM o)"""
_UNPLANNED = "((plan <= 0 AND spent >= 10000) OR (est > 0 AND spent - est >= 10000))"


def rule_unplanned_spending(t: Tables):
    return _found(budget.unplanned_spending(budget.year_end(_objects(t)), T))


UNPLANNED = f"""WITH {_O} SELECT 'unplanned_spending' AS rule, 'violation' AS tier, 'warning' AS severity, key AS subject_id, key || ':' || year AS subject_key
FROM k WHERE period = (SELECT max(period) FROM k z WHERE z.year = k.year) AND {_UNPLANNED}"""


def rule_overspend(t: Tables):
    return _found(budget.overspend(budget.latest(_objects(t)), T))


OVERSPEND = f"""WITH {_O} SELECT 'overspend_vs_plan' AS rule, 'signal' AS tier, 'warning' AS severity, key AS subject_id, key AS subject_key
FROM k WHERE period = (SELECT max(period) FROM k) AND plan > 0 AND NOT {_UNPLANNED} AND spent - 1.02 * plan > 10000"""


def rule_plan_jump(t: Tables):
    return _found(budget.plan_jump(_objects(t), T))


JUMP = f"""WITH {_O}, w AS (SELECT *, lag(plan) OVER q AS before, lag(period) OVER q AS from_period, lag(year) OVER q AS from_year, row_number() OVER q AS r FROM k WINDOW q AS (PARTITION BY paragraph, name ORDER BY period))
SELECT 'plan_jump' AS rule, 'signal' AS tier, 'warning' AS severity, key AS subject_id, key || ':' || from_period || '->' || period AS subject_key FROM w WHERE from_year = year AND before > 0 AND plan - before > 100000 AND plan >= 1.5 * before
UNION ALL SELECT 'plan_jump', 'signal', 'warning', key, key || ':new' FROM w WHERE r = 1 AND period > (SELECT min(period) FROM w) AND plan > 250000 AND period <> (SELECT min(period) FROM w z WHERE z.year = w.year)"""


def text_marks(t: Tables):
    """Tokens and distinctive tokens of every document."""
    listed = lambda a: F.array_join(F.array_sort(a), " ")
    return t.documents.select("doc_id", F.md5(listed(X.tokens(F.col("text")))).alias("tokens"), listed(X.distinctive(F.col("text"))).alias("marks"))


def display_values(t: Tables):
    """Orders as readers see them."""
    k, v = F.col("o_orderkey"), F.col("o_totalprice")
    word = F.element_at(F.array(*map(F.lit, ("Critical", "serious", "low", "unheard", " HIGH "))), (k % 5 + 1).cast("int"))
    own = F.when(k % 3 == 0, F.lit("Opacity"))
    rule = F.when(k % 2 == 0, F.lit("splitting")).otherwise(F.lit("unknown"))
    return t.orders.select(
        "o_orderkey",
        D.euro(v).alias("amount"),
        D.percent(F.round((k % 1000) / 1000.0, 3)).alias("share"),
        D.period(F.date_format("o_orderdate", "yyyy-MM")).alias("month"),
        D.quarter(F.concat(F.year("o_orderdate").cast("string"), F.lit(" Q"), F.quarter("o_orderdate").cast("string"))).alias("quarter"),
        D.severity(word).alias("severity"),
        D.tier(own, rule, word).alias("tier"),
    )


_MONTHS = "[" + ", ".join(f"'{m}'" for m in D.MONTHS) + "]"
DISPLAY = f"""WITH o AS (SELECT *, list_extract(['high', 'warning', 'info', 'warning', 'high'], o_orderkey % 5 + 1) AS severity FROM orders)
SELECT o_orderkey, format('{{:,}}', CAST(round_even(o_totalprice, 0) AS BIGINT)) || ' €' AS amount, printf('%.1f', (o_orderkey % 1000) / 10.0) || '%' AS share,
 list_extract({_MONTHS}, month(o_orderdate)) || ' ' || year(o_orderdate) AS month, list_extract(['I', 'II', 'III', 'IV'], quarter(o_orderdate)) || ' тримесечие на ' || year(o_orderdate) AS quarter, severity,
 CASE WHEN o_orderkey % 3 = 0 THEN 'opacity' WHEN o_orderkey % 2 = 0 THEN 'signal' ELSE CASE severity WHEN 'high' THEN 'violation' WHEN 'warning' THEN 'signal' ELSE 'opacity' END END AS tier FROM o"""


def settlement_years(t: Tables):
    """Nations as settlements: orders are objects, lines of large orders contracts, open orders findings."""
    c = t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    o = t.orders.join(c, "o_custkey").withColumn("year", F.year("o_orderdate"))
    both = F.when(F.col("c_nationkey") == 0, F.array().cast("array<string>")).otherwise(F.array(F.col("c_nationkey").cast("string"), ((F.col("c_nationkey") + 1) % 5).cast("string")))
    named = o.withColumn("settlements", both)
    lines = named.select("settlements", "year", F.col("o_totalprice").alias("plan"), F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice")).otherwise(0.0).alias("spent"))
    contracts_ = named.where("o_totalprice > 200000").select("settlements", "year", F.col("o_totalprice").alias("value"))
    return P.settlement_years(lines, contracts_, named.where("o_orderstatus = 'O'").select("settlements", "year"))


SETTLEMENT_YEARS = """WITH o AS (SELECT year(o_orderdate) AS year, o_totalprice AS v, o_orderstatus AS s, CASE WHEN c_nationkey = 0 THEN ['(unassigned)'] ELSE list_distinct([CAST(c_nationkey AS VARCHAR), CAST((c_nationkey + 1) % 5 AS VARCHAR)]) END AS places,
  CASE WHEN c_nationkey = 0 THEN '(unassigned)' ELSE CAST(c_nationkey AS VARCHAR) END AS first FROM orders JOIN customer ON c_custkey = o_custkey),
r AS (SELECT first AS settlement, year, v AS plan, CASE WHEN s = 'F' THEN v ELSE 0 END AS spent, 1 AS o, 0 AS c, 0.0 AS cv, 0 AS f FROM o
 UNION ALL SELECT unnest(places), year, 0, 0, 0, 1, v, 0 FROM o WHERE v > 200000 UNION ALL SELECT unnest(places), year, 0, 0, 0, 0, 0, 1 FROM o WHERE s = 'O')
SELECT settlement, year, CAST(sum(CAST(plan AS DECIMAL(18,2))) AS DOUBLE) AS plan, CAST(sum(CAST(spent AS DECIMAL(18,2))) AS DOUBLE) AS spent, CAST(sum(o) AS BIGINT) AS n_objects, CAST(sum(c) AS BIGINT) AS n_contracts,
 CAST(sum(CAST(cv AS DECIMAL(18,2))) AS DOUBLE) AS contracts_total, CAST(sum(f) AS BIGINT) AS n_flags FROM r GROUP BY GROUPING SETS ((settlement, year), (settlement))"""


def flags_with_contracts(t: Tables):
    """Lines as findings on their order, or on the order that their even twin stands for."""
    flags = t.lineitem.select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("flag"), F.when(F.col("l_linenumber") % 2 == 0, F.col("l_orderkey") + 1_000_000_000).otherwise(F.col("l_orderkey")).alias("procurement_id"))
    c = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("title"))
    links = t.orders.where("o_orderkey % 3 <> 0").select((F.col("o_orderkey") + 1_000_000_000).alias("twin_id"), F.col("o_orderkey").alias("id"))
    return P.flags_with_contracts(flags, c, links, ["title"]).select("flag", F.col("contract.id").alias("contract_id"), F.col("contract.title").alias("title"))


FLAGS_WITH = """SELECT concat_ws('-', l_orderkey, l_linenumber) AS flag, CASE WHEN l_linenumber % 2 = 1 OR l_orderkey % 3 <> 0 THEN o_orderkey END AS contract_id,
CASE WHEN l_linenumber % 2 = 1 OR l_orderkey % 3 <> 0 THEN o_orderpriority END AS title FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey"""


def object_years(t: Tables):
    """Customers' orders by year: the last order of the last month of a year counts."""
    rows = t.orders.select(F.concat(F.lit("Object "), F.col("o_custkey").cast("string")).alias("object_name"), F.date_format("o_orderdate", "yyyy-MM").alias("period"), F.col("o_totalprice").alias("plan_current"), F.lit(None).cast("double").alias("spent_period"), F.col("o_orderkey").alias("source_row"))
    latest = rows.groupBy(F.substring("period", 1, 4).alias("year")).agg(F.max("period").alias("period"))
    out = P.object_years(rows, latest)
    listed = F.transform(F.array_sort(F.map_entries("years")), lambda e: F.concat(e["key"], F.lit("="), F.format_string("%.2f", e["value"]["plan"]), F.lit("/"), F.format_string("%.0f", e["value"]["spent"])))
    return out.select("object_name", F.array_join(listed, " ").alias("years"), "latest_period")


OBJECT_YEARS = """WITH o AS (SELECT o_custkey, strftime(o_orderdate, '%Y-%m') AS period, o_totalprice AS v, o_orderkey AS k FROM orders),
m AS (SELECT left(period, 4) AS year, max(period) AS period FROM o GROUP BY 1), j AS (SELECT o_custkey, year, period, max_by(v, k) AS v FROM o JOIN m USING (period) GROUP BY ALL)
SELECT 'Object ' || o_custkey AS object_name, string_agg(year || '=' || printf('%.2f', v) || '/0', ' ' ORDER BY year) AS years, max(period) AS latest_period FROM j GROUP BY o_custkey"""


def ranked_findings(t: Tables):
    """The twenty gravest findings on orders: by tier, severity and value."""
    k = F.col("o_orderkey")
    flags = t.orders.select("o_orderkey", "o_totalprice", D.severity_rank(F.when(k % 4 == 0, "critical").otherwise("ok")).alias("s"), D.tier_rank(F.when(k % 3 == 0, "violation").otherwise("opacity")).alias("t"))
    order = F.row_number().over(Window.orderBy("t", "s", F.desc("o_totalprice"), "o_orderkey"))
    return P.ranked(flags, F.col("t"), F.col("s"), F.desc("o_totalprice"), F.col("o_orderkey")).limit(20).select("o_orderkey", "o_totalprice", order.cast("long").alias("place"))


RANKED = """SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_orderkey % 3 <> 0, o_orderkey % 4 <> 0, o_totalprice DESC, o_orderkey) AS place FROM orders QUALIFY place <= 20"""


def _marks_sql() -> str:
    from .text_queries import _MARKS, _TOKENS

    return f"SELECT doc_id, md5(array_to_string(list_sort({_TOKENS.replace('{c}', 'text')}), ' ')) AS tokens, array_to_string(list_sort({_MARKS.replace('{c}', 'text')}), ' ') AS marks FROM documents"


QUERIES = {
    "rule_missing_value": (query(rule_missing_value), _sql("missing_value", "opacity", "'warning'", "eur IS NULL OR eur = 0")),
    "rule_late_publication": (query(rule_late_publication), _sql("late_publication", "violation", "CASE WHEN late > 60 THEN 'high' WHEN late > 14 THEN 'warning' ELSE 'info' END", "source = 'eop' AND late > 7")),
    "rule_annex_growth": (query(rule_annex_growth), _sql("annex_growth", "signal", "'warning'", "source = 'eop' AND before > 0 AND after > 1.1 * before AND after <= 1.5 * before")),
    "rule_annex_over_cap": (query(rule_annex_over_cap), _sql("annex_over_cap", "violation", "'high'", "source = 'eop' AND before > 0 AND after > 1.5 * before AND after <= 5 * before")),
    "rule_single_bidder": (query(rule_single_bidder), _sql("single_bidder", "signal", "CASE WHEN eur >= 500000 THEN 'high' ELSE 'warning' END", "bids = 1 AND eur >= 100000")),
    "rule_concentration": (query(rule_concentration), CONCENTRATION),
    "rule_company_status": (query(rule_company_status), STATUS),
    "rule_activity_mismatch": (query(rule_activity_mismatch), MISMATCH),
    "rule_young_company": (query(rule_young_company), YOUNG),
    "rule_unplanned_spending": (query(rule_unplanned_spending), UNPLANNED),
    "rule_overspend": (query(rule_overspend), OVERSPEND),
    "rule_plan_jump": (query(rule_plan_jump), JUMP),
    "text_marks": (query(text_marks), _marks_sql()),
    "display_values": (query(display_values), DISPLAY),
    "settlement_years": (query(settlement_years), SETTLEMENT_YEARS),
    "flags_with_contracts": (query(flags_with_contracts), FLAGS_WITH),
    "object_years": (query(object_years), OBJECT_YEARS),
    "ranked_findings": (query(ranked_findings), RANKED),
}
