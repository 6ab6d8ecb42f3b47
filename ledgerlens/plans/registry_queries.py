"""All rules on contracts in one pass, over contracts in two registers that are laid out from the orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import PEG, Thresholds
from ..rules import contracts
from ..rules.common import contracts_view
from ..rules.registry import RULES, evaluate
from ..schemas import PROCUREMENTS
from ..storage import spread
from .base import Tables, query

T = Thresholds(near_from="1993-01-01", near_share=0.3)
SECOND = 10_000_000_000
TYPES = ("OpenProcedure", "PublicCompetition", "CollectingOffersWithNotice", "DirectNegotiation", "NegotiatedProcedure")
LONG = "A description that goes on about the needs of the schools and about what all of the paper in it will be used for by them."
#: The third states a quantity, the fourth leaves it open, the last one only repeats the tender's name.
DESCRIPTIONS = ("<p>Supply</p>", LONG, "100 бр. папки", "по заявка", None, "Supply of goods")
NAME = "Supply of goods"


def two_registers(t: Tables) -> DataFrame:
    """Every order in the first register, every other one in the second too. Three orders share a tender and a contractor, each seventh has its own tender."""
    target = t.spark.createDataFrame([], PROCUREMENTS).schema
    k, price = F.col("o_orderkey"), F.col("o_totalprice")
    day = 86_400_000
    signed = F.unix_millis(F.col("o_orderdate").cast("timestamp"))
    noticed = signed - (k % 40) * day
    net = lambda ms: F.concat(F.lit("/Date("), ms.cast("string"), F.lit(")/"))
    of = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (n % len(values) + 1).cast("int"))
    tender = F.when(k % 7 == 0, F.concat(F.lit("S"), k.cast("string"))).otherwise(F.concat(F.lit("T"), F.floor(k / 3).cast("string")))
    contract = {
        "ContractDate": net(signed), "TedPublishDate": net(signed + (k % 120) * day), "TenderNumber": tender, "TypeOfContract": (k % 3 + 1).cast("int"),
        "ContractValue": price, "Currency": F.lit(1), "CurrentContractValue": price * (1 + (k % 9) / 8.0), "CurrentContractCurrency": F.lit(1),
    }
    procedure = {"EstimatedValue": F.when(k % 3 != 1, price), "Currency": F.lit(1)}
    detail = {"TenderName": F.lit(NAME), "TenderDescription": of(DESCRIPTIONS, k), "PublicationDate": net(noticed), "OfferPhaseEndDate": net(noticed + (k % 35) * day)}
    both = {
        "title": F.lit("Goods and services"), "cpv_code": of(("45000000", "79100000", "30200000", "09100000"), k), "procedure_type": of(TYPES, k),
        "contractor_name": F.concat(F.lit("Customer "), F.floor(k / 3).cast("string")), "contractor_eik": F.lpad(F.floor(k / 3).cast("string"), 9, "0"), "contract_date": F.col("o_orderdate").cast("timestamp"),
    }
    first = both | {"id": k, "source": F.lit("eop"), "source_id": k.cast("string"), "contract_value_eur": F.when(k % 17 != 0, price), "bids_received": F.when(k % 4 != 0, k % 4)}
    unknown = F.when(k % 10 == 4, F.concat(F.lit("X"), k.cast("string"))).otherwise(tender)
    second = both | {"id": k + SECOND, "source": F.lit("sigma"), "source_id": F.concat(F.lit("s"), k.cast("string")), "contract_value_eur": price * (1 + (k % 5) / 100.0), "bids_received": k % 3}
    raws = ({"contract": contract, "procedure": procedure, "tender_detail": detail}, {"sigma": {"unp": unknown, "eu_funded": F.lit(False)}})

    def struct(kind, values):
        return F.struct(*[values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in kind.fields])

    def part(f):
        """A source's record, in the rows of its register."""
        sets = [F.when(again == F.lit(n == 1), struct(f.dataType, raw[f.name])) for n, raw in enumerate(raws) if f.name in raw]
        return (sets[0] if sets else F.lit(None).cast(f.dataType)).alias(f.name)

    def column(f):
        if f.name == "raw":
            return F.struct(*map(part, f.dataType.fields)).alias("raw")
        ours, theirs = (v.get(f.name, F.lit(None)).cast(f.dataType) for v in (first, second))
        return (ours if first.get(f.name) is second.get(f.name) else F.when(again, theirs).otherwise(ours)).alias(f.name)

    # only the register is exploded, so that no column is laid out which the query doesn't read
    again = F.col("again")
    rows = spread(t.orders).select("*", F.explode(F.array(F.lit(False), F.when(k % 2 == 0, True))).alias("again"))
    return rows.where("again IS NOT NULL").select(*map(column, target.fields))


def contract_rules(t: Tables) -> DataFrame:
    """The findings of all rules on contracts, and the kinds of their sources."""
    return evaluate(contracts_view(two_registers(t)), RULES.row_rules.values(), T, apart=True, of=_with_kinds)


def _with_kinds(f: Column) -> Column:
    named = [f[n].alias(n) for n in ("rule", "tier", "severity", "subject_id", "subject_key")]
    return F.struct(*named, F.array_join(f["sources"]["kind"], "+").alias("kinds"))


def contract_rule_sources(t: Tables) -> DataFrame:
    """Everything that the findings on prices at the estimate cite."""
    flags = contracts.bid_at_ceiling(contracts_view(two_registers(t)), T)
    return flags.select("subject_key", "details", F.to_json("sources").alias("sources"))


def _band(kind: str, level: str) -> str:
    cases = [f"WHEN {kind} = '{c}' AND {level} = {required - 1} THEN {bgn / PEG!r}" for c, rows in (("works", T.works_bands_bgn), ("supplies", T.supplies_bands_bgn), ("annex2", T.annex2_bands_bgn)) for bgn, required in rows]
    return "CASE " + " ".join(cases) + " END"


_ROWS = f"""
o AS (SELECT o_orderkey AS k, o_totalprice AS price, CAST(o_orderdate AS DATE) AS d, CASE WHEN o_orderkey % 7 = 0 THEN 'S' || o_orderkey ELSE 'T' || o_orderkey // 3 END AS tender,
  list_extract({list(TYPES)}, o_orderkey % 5 + 1) AS ptype, list_extract(['45000000', '79100000', '30200000', '09100000'], o_orderkey % 4 + 1) AS cpv, o_orderkey // 3 AS firm FROM orders),
e AS (SELECT *, 'eop:' || k AS subject, CASE WHEN k % 17 <> 0 THEN CAST(CAST(price AS DECIMAL(16,2)) AS DOUBLE) END AS eur, CASE WHEN k % 4 <> 0 THEN k % 4 END AS bids, CASE WHEN k % 3 <> 1 AND price > 0 THEN price END AS estimate,
  k % 3 + 1 AS kind, k % 6 AS text, count(*) OVER (PARTITION BY tender) AS n, row_number() OVER (PARTITION BY tender ORDER BY k) AS r,
  CAST(sum(CASE WHEN k % 17 <> 0 THEN CAST(price AS DECIMAL(16,2)) END) OVER (PARTITION BY tender) AS DOUBLE) AS spent FROM o),
s AS (SELECT k, 'sigma:s' || k AS subject, CASE WHEN k % 10 = 4 THEN 'X' || k ELSE tender END AS tender, firm, ptype, cpv, CAST(CAST(price * (1 + (k % 5) / 100.0) AS DECIMAL(16,2)) AS DOUBLE) AS eur, k % 3 AS bids FROM o WHERE k % 2 = 0),
pairs AS (SELECT e.k, s.k AS twin, s.bids AS twin_bids, s.tender AS unp, coalesce(e.eur, 0) AS v, abs(coalesce(e.eur, 0) - s.eur) AS delta, count(*) OVER (PARTITION BY e.k) AS candidates,
  row_number() OVER (PARTITION BY e.k ORDER BY abs(coalesce(e.eur, 0) - s.eur), s.k) AS r FROM e JOIN s ON e.tender = s.tender AND e.firm = s.firm),
twins AS (SELECT * FROM pairs WHERE r = 1 AND (candidates = 1 OR (v > 0 AND delta <= 0.02 * v))),
ceiling_ AS (SELECT e.*, twin, twin_bids, unp FROM e LEFT JOIN twins USING (k) WHERE n = 1 AND eur / estimate BETWEEN 0.98 AND 1.05 AND eur >= 100000 AND coalesce(coalesce(bids, twin_bids) < 2, true)),
near AS (SELECT *, coalesce(estimate, spent) AS value, CASE WHEN kind = 3 OR cpv LIKE '45%' THEN 'works' WHEN kind = 1 AND cpv LIKE '791%' THEN 'annex2' ELSE 'supplies' END AS category,
  CASE ptype WHEN 'OpenProcedure' THEN 3 WHEN 'PublicCompetition' THEN 2 WHEN 'CollectingOffersWithNotice' THEN 1 WHEN 'DirectNegotiation' THEN 2 ELSE 3 END AS level FROM e WHERE r = 1 AND d - CAST(k % 40 AS INTEGER) >= DATE '1993-01-01'),
offers AS (SELECT *, k % 40 AS days, k % 35 AS offer_days, CASE ptype WHEN 'OpenProcedure' THEN 30 WHEN 'PublicCompetition' THEN 20 ELSE 10 END AS legal, CASE ptype WHEN 'OpenProcedure' THEN 15 ELSE 10 END AS bare FROM e WHERE k % 5 < 3),
late AS (SELECT *, k % 120 - 30 AS late FROM e)"""
_LEVEL = "CASE WHEN cpv LIKE '091%' THEN 'info' WHEN coalesce(eur, 0) >= 500000 THEN 'high' WHEN coalesce(eur, 0) >= 100000 THEN 'warning' ELSE 'info' END"
_EXCEPTIONAL = "ptype IN ('DirectNegotiation', 'NegotiatedProcedure')"
_PARTS = [
    ("missing_value", "opacity", "'warning'", "'eop_contract'", "e WHERE eur IS NULL OR eur = 0"),
    ("missing_value", "opacity", "'warning'", "'sigma'", "s WHERE eur = 0"),
    ("late_publication", "violation", "CASE WHEN late > 60 THEN 'high' WHEN late > 14 THEN 'warning' ELSE 'info' END", "'eop_contract'", "late WHERE late > 7"),
    ("annex_growth", "signal", "'warning'", "'eop_contract'", "e WHERE price > 0 AND price * (1 + (k % 9) / 8.0) > 1.1 * price AND price * (1 + (k % 9) / 8.0) <= 1.5 * price"),
    ("annex_over_cap", "violation", "'high'", "'eop_contract'", "e WHERE price > 0 AND price * (1 + (k % 9) / 8.0) > 1.5 * price"),
    ("single_bidder", "signal", "CASE WHEN eur >= 500000 THEN 'high' ELSE 'warning' END", "'eop_contract+eop_tender'", "e WHERE bids = 1 AND eur >= 100000"),
    ("single_bidder", "signal", "CASE WHEN eur >= 500000 THEN 'high' ELSE 'warning' END", "'sigma'", "s WHERE bids = 1 AND eur >= 100000"),
    ("exceptional_procedure", "signal", _LEVEL, "'eop_contract+eop_tender'", f"e WHERE {_EXCEPTIONAL}"),
    ("exceptional_procedure", "signal", _LEVEL, "'sigma'", f"s WHERE {_EXCEPTIONAL} AND tender NOT IN (SELECT tender FROM e)"),
    ("short_offer_deadline", "signal", "'warning'", "'eop_contract+eop_tender'", "offers WHERE (days < legal + 5 OR offer_days < legal) AND (ptype = 'CollectingOffersWithNotice' OR NOT (days < bare OR offer_days < bare))"),
    ("short_offer_deadline", "violation", "'high'", "'eop_contract+eop_tender'", "offers WHERE ptype <> 'CollectingOffersWithNotice' AND (days < bare OR offer_days < bare)"),
    ("price_unverifiable", "opacity", "CASE WHEN eur >= 100000 THEN 'warning' ELSE 'info' END", "'eop_contract+eop_tender'", "e WHERE eur >= 20000 AND kind IN (2, 3) AND text IN (0, 4, 5)"),
    ("missing_quantity", "opacity", "CASE WHEN eur >= 500000 THEN 'high' WHEN eur >= 100000 THEN 'warning' ELSE 'info' END", "'eop_contract+eop_tender'", "e WHERE eur >= 20000 AND kind = 2 AND text = 1"),
    ("bid_at_ceiling", "signal", "CASE WHEN eur >= 500000 THEN 'high' ELSE 'warning' END", "'eop_contract+eop_tender' || CASE WHEN bids IS NULL AND twin_bids IS NOT NULL THEN '+sigma' ELSE '' END", "ceiling_"),
]
_NEAR = f"SELECT 'near_threshold', 'opacity', 'info', 'eop-tender:' || tender, 'eop-tender:' || tender, CASE WHEN estimate IS NULL THEN 'eop_contract' ELSE 'eop_tender' END FROM near WHERE value >= 0.7 * {_band('category', 'level')} AND value < {_band('category', 'level')}"
UNION = f"WITH {_ROWS} " + " UNION ALL ".join([f"SELECT '{rule}' AS rule, '{tier}' AS tier, {severity} AS severity, subject AS subject_id, subject AS subject_key, {kinds} AS kinds FROM {rows}" for rule, tier, severity, kinds, rows in _PARTS] + [_NEAR])


def _json_fields(*fields: tuple[str, str]) -> str:
    return " || ',' || ".join(f"""'{{"name":"{n}","value":"' || {v} || '"' || {eur} || '}}'""" for n, v, eur in ((f[0], f[1], f"""',"value_eur":' || {f[2]}""" if len(f) > 2 else "''") for f in fields))


_PRICE = "CAST(price AS VARCHAR)"
SOURCES = f"""WITH {_ROWS} SELECT subject AS subject_key, '{{"ratio":' || CAST(eur / estimate AS VARCHAR) || coalesce(',"bids":' || coalesce(bids, twin_bids), '') || '}}' AS details,
'[{{"kind":"eop_contract","label":"contract ' || k || ' of ' || tender || '","fields":[' || {_json_fields(("ContractNumber", "k"), ("TenderNumber", "tender"), ("ContractValue", _PRICE, _PRICE), ("Currency", "'EUR'"), ("SupplierName", "'Customer ' || firm"))} || ']}},'
|| '{{"kind":"eop_tender","label":"procedure ' || tender || '","fields":[' || {_json_fields(("ProcedureType", "ptype"), ("EstimatedValue", _PRICE, _PRICE), ("Currency", "'EUR'"), ("PublicationDate", "CAST(d - CAST(k % 40 AS INTEGER) AS VARCHAR)"))} || ']}}'
|| CASE WHEN bids IS NULL AND twin_bids IS NOT NULL THEN ',{{"kind":"sigma","label":"row s' || twin || '","fields":[' || {_json_fields(("id", "'s' || twin"), ("unp", "unp"), ("bids_received", "twin_bids"))} || ']}}' ELSE '' END || ']' AS sources FROM ceiling_"""

QUERIES = {"contract_rules": (query(contract_rules), UNION), "contract_rule_sources": (query(contract_rule_sources), SOURCES)}
