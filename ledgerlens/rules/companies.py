"""Rules on companies, the people behind them, and officials."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Thresholds
from ..functions import text as X
from ..operators import amounts as A
from ..operators import grouping as G
from ..operators import linking as L
from ..operators.dates import local_date
from ..schemas import SOURCE
from . import provenance as V
from .common import cited, findings
from .contracts import signed_contractors
from .registry import RULES

ROLES = ("manager", "owner", "partner", "board")
#: Legal form of a sole trader, who files no annual report.
SOLE_TRADER = "ЕТ"


def _totals(view: DataFrame) -> DataFrame:
    return signed_contractors(view).groupBy("eik").agg(F.count(F.lit(1)).alias("n"), F.sum(A.money("eur")).cast("double").alias("total"), F.max("signed_on").alias("last_on"))


def _cited(view: DataFrame, found: DataFrame) -> DataFrame:
    """found (eik, ...) with the contracts of each company, by date and subject."""
    members = signed_contractors(view).join(found.select("eik").distinct(), "eik", "left_semi")
    return found.join(cited(members, ["eik"], V.contract_sources(V.MEMBER, []), ["signed_on", "subject"]), "eik", "left")


def _with_company(found: DataFrame, companies: DataFrame, *fields: str) -> DataFrame:
    """found (eik, ...) with the company's entry in the register, with the fields that were read."""
    entry = V.registry(F.col("eik"), F.col("name"), F.col("source_url"), **{f: F.col(f) for f in fields})
    has = [c for c in ("source_url", *fields) if c not in companies.columns]
    full = companies.withColumns({c: F.lit(None).cast("string") for c in has})
    return found.join(full.select("eik", entry.alias("company_entry")), "eik", "left")


def _listed(*entries: str) -> Column:
    """Single entries first, then the cited contracts."""
    return F.concat(F.array_compact(F.array(*entries)), F.coalesce("cited", F.array().cast(f"array<{SOURCE}>")))


def _full_name(c: Column) -> Column:
    return F.size(F.split(c, " ")) >= 3


@RULES.table_rule("related_party", reads=("contracts", "companies", "people", "officials"))
def related_party(view: DataFrame, companies: DataFrame, people: DataFrame, officials: DataFrame, t: Thresholds) -> DataFrame:
    """Contractors whose current people share an official's full name, or which an official declared.

    A declaration outranks a name, and the later of an official's declarations the earlier.
    """
    totals = _totals(view)
    o = officials.select("name", "name_normalized", "mandate", "document_url", "declared_interests").where(_full_name(F.col("name_normalized")))
    p = people.where(F.col("is_current") & F.col("role").isin(*ROLES)).select("eik", "name_normalized").distinct()
    named = p.join(o, "name_normalized").select("eik", "name_normalized", "mandate", "name", "document_url", F.lit(None).cast("string").alias("declared"), F.lit(1).alias("rank"), F.lit(0).alias("pos"))
    interests = o.select("name_normalized", "mandate", "name", "document_url", F.posexplode("declared_interests").alias("pos", "i"))
    keyed = interests.select("name_normalized", "mandate", "name", "document_url", "pos", F.col("i.raw").alias("declared"), F.col("i.eik").alias("eik"), X.name_key(F.col("i.company_name")).alias("company_key"))
    c = companies.select("eik", X.name_key(F.col("name")).alias("company_key"))
    by_eik = keyed.drop("company_key").join(c.select("eik"), "eik")
    by_name = keyed.drop("eik").join(c, "company_key")
    kept = ["eik", "name_normalized", "mandate", "name", "document_url", "declared", F.lit(2).alias("rank"), "pos"]
    declared = by_eik.select(*kept).unionByName(by_name.select(*kept))
    best = L.first_by(named.unionByName(declared), ["eik", "name_normalized", "mandate"], F.desc("rank"), F.desc("pos"), "document_url", "declared")
    rows = _cited(view, _with_company(best.join(totals, "eik"), companies, "status"))
    by_name_only = F.when(F.col("rank") == 1, F.lit("Matched by name only: to be checked in the document."))
    rows = rows.withColumn("declaration_entry", V.declaration(F.col("name"), F.col("mandate"), F.col("document_url"), F.col("declared"), by_name_only))
    level = F.when((F.col("rank") == 2) | (F.col("total") >= t.related_high), "high").otherwise("warning")
    basis = F.when(F.col("rank") == 2, "declaration").otherwise("name")
    return findings(rows, "related_party", severity=level, message=F.concat(F.lit("Related to an official: "), "eik"), subject_type="contractor", subject_id=F.col("eik"), key=F.concat_ws(":", "eik", "name_normalized", "mandate"), details={"basis": basis, "n": F.col("n"), "total": F.col("total")}, sources=_listed("company_entry", "declaration_entry"))


@RULES.table_rule("person_concentration", reads=("contracts", "companies", "people"))
def person_concentration(view: DataFrame, companies: DataFrame, people: DataFrame, t: Thresholds) -> DataFrame:
    """People behind several contractors; the sources are each company's entry and the contracts of all of them, by date."""
    current = people.where("is_current").where(_full_name(F.col("name_normalized"))).select("eik", "name_normalized").distinct()
    links = current.join(_totals(view), "eik")
    rows = G.concentration(links, "name_normalized", "eik", "n", "total", min_count=t.person_count, min_total=t.person_total, high_count=t.person_high_count, high_total=t.person_high_total)
    behind = links.join(rows.select("name_normalized"), "name_normalized", "left_semi").select("name_normalized", "eik")
    entries = cited(_with_company(behind, companies), ["name_normalized"], F.array("company_entry"), ["eik"]).withColumnRenamed("cited", "company_entries")
    members = behind.join(signed_contractors(view), "eik")
    rows = rows.join(entries, "name_normalized", "left").join(cited(members, ["name_normalized"], V.contract_sources(V.MEMBER, []), ["signed_on", "subject", "eik"]), "name_normalized", "left")
    return findings(rows, "person_concentration", severity=F.col("severity"), message=F.concat(F.lit("One person stands behind several contractors: "), "name_normalized"), subject_type="person", subject_id=F.concat(F.lit("person:"), "name_normalized"), details={"n_companies": F.col("n_entities"), "n": F.col("n"), "total": F.col("total")}, sources=F.concat(*(F.coalesce(c, F.array().cast(f"array<{SOURCE}>")) for c in ("company_entries", "cited"))))


@RULES.table_rule("young_company", reads=("contracts", "companies"))
def young_company(view: DataFrame, companies: DataFrame, t: Thresholds) -> DataFrame:
    c = companies.select("eik", local_date(F.col("registered_at")).alias("registered_on"))
    rows = signed_contractors(view).where(F.col("eik").startswith("2") & (F.col("eur") >= t.young_value)).join(c, "eik").withColumn("age", F.datediff("signed_on", "registered_on")).where(F.col("age").between(0, t.young_days))
    rows = _with_company(rows, companies, "registered_at")
    level = F.when((F.col("eur") >= t.young_high_value) | (F.col("age") <= t.young_high_days), "high").otherwise("warning")
    return findings(rows, "young_company", severity=level, message=F.concat(F.lit("Won soon after it was founded: "), "short_title"), subject_type="contract", subject_id=F.col("subject"), key=F.concat_ws(":", "subject", "eik"), procurement_id=F.col("id"), details={"age": F.col("age")}, sources=F.concat(F.array_compact(F.array("company_entry")), V.contract_sources(V.MEMBER, [])))


@RULES.table_rule("company_status", reads=("contracts", "companies", "now"))
def company_status(view: DataFrame, companies: DataFrame, now: Column, t: Thresholds) -> DataFrame:
    """Contractors in liquidation or the like, and contractors that stopped filing long before their last contract."""
    rows = companies.join(_totals(view), "eik")
    recent = F.col("last_on") >= F.date_sub(F.to_date(now), 365 * t.status_years)
    bad = F.col("status").isin("liquidation", "insolvency", "deregistered") & recent
    filed = F.greatest("last_annual_report_year", "last_no_activity_declaration_year")
    stale = (F.coalesce("legal_form", F.lit("")) != SOLE_TRADER) & (F.col("total") >= t.status_value) & (filed.isNull() | (filed < F.year("last_on") - t.status_lag_years))
    hit = rows.withColumn("reasons", A.reasons(status=bad, filing=stale)).where(F.size("reasons") > 0)
    hit = _cited(view, _with_company(hit, companies, "status", "last_annual_report_year", "last_no_activity_declaration_year"))
    level = F.when(F.array_contains("reasons", "status") & F.col("status").isin("insolvency", "deregistered"), "high").otherwise("warning")
    return findings(hit, "company_status", severity=level, message=F.concat(F.lit("The contractor's standing is in doubt: "), "name"), subject_type="contractor", subject_id=F.col("eik"), key=F.concat(F.lit("company:"), "eik"), details={"reasons": F.col("reasons"), "status": F.col("status")}, sources=_listed("company_entry"))


@RULES.table_rule("activity_mismatch", reads=("contracts", "companies"))
def activity_mismatch(view: DataFrame, companies: DataFrame, t: Thresholds) -> DataFrame:
    pairs = A.dimension(view.sparkSession, ["nkid2", "cpv2", "ord"], [(n, cpv, k) for k, (ns, cpv) in enumerate(t.mismatch_pairs) for n in ns])
    c = companies.select("eik", F.substring("nkid_code", 1, 2).alias("nkid2"), "nkid_label")
    rows = signed_contractors(view).where(F.col("eur") >= t.mismatch_value).withColumn("cpv2", F.substring("cpv_code", 1, 2)).join(c, "eik").join(F.broadcast(pairs), ["nkid2", "cpv2"])
    first = _with_company(L.first_by(rows, ["subject", "eik"], "ord"), companies, "nkid_code", "nkid_label")
    return findings(first, "activity_mismatch", severity=F.lit("warning"), message=F.concat(F.lit("The contractor's registered activity doesn't fit: "), "short_title"), subject_type="contract", subject_id=F.col("subject"), key=F.concat_ws(":", "subject", "eik"), procurement_id=F.col("id"), details={"activity": F.col("nkid_label"), "ord": F.col("ord")}, sources=F.concat(F.array_compact(F.array("company_entry")), V.contract_sources(V.MEMBER, [])))
