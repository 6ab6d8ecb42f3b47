"""What readers see: numbers, amounts, dates, periods, severities and tiers, years of events, links."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import PEG
from ..operators.dates import local_date

NONE = "—"
# Labels, orders and aliases of severities and tiers, names of months and quarters.
MONTHS = ("януари", "февруари", "март", "април", "май", "юни", "юли", "август", "септември", "октомври", "ноември", "декември")
QUARTERS = ("I", "II", "III", "IV")
SEVERITIES = {"high": "Висока", "warning": "Средна", "info": "Ниска"}
SEVERITY_ALIASES = {"critical": "high", "high": "high", "serious": "warning", "medium": "warning", "warning": "warning", "info": "info", "good": "info", "ok": "info", "low": "info"}
TIERS = {"violation": "Нарушение", "signal": "Сигнал", "opacity": "Непрозрачност"}
TIER_OF_SEVERITY = {"high": "violation", "warning": "signal", "info": "opacity"}
TIER_OF_RULE = {
    "late_publication": "violation", "missing_value": "violation", "annex_over_cap": "violation", "missing_annual_report": "violation",
    "annex_growth": "signal", "plan_jump": "signal", "overspend_vs_plan": "signal", "single_bidder": "signal", "contractor_concentration": "signal",
    "splitting": "signal", "exceptional_procedure": "signal", "short_offer_deadline": "signal", "bid_at_ceiling": "signal", "near_threshold": "signal",
    "eu_funded_irregularity": "signal", "unmatched_spending": "opacity", "missing_quantity": "opacity", "price_unverifiable": "opacity",
    "unplanned_spending": "opacity", "missing_monthly_report": "opacity",
}


def _lookup(names: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), key)


def number(value: Column, decimals: int = 0) -> Column:
    """Grouped by commas, halves to even; a dash where there is none."""
    v = F.bround(value.cast("decimal(38,6)"), decimals)
    return F.coalesce(F.format_number(v, decimals), F.lit(NONE))


def euro(value: Column) -> Column:
    return F.when(value.isNull(), NONE).otherwise(F.concat(number(value), F.lit(" €")))


def percent(share: Column, decimals: int = 1) -> Column:
    return F.when(share.isNull(), NONE).otherwise(F.concat(F.format_number(share.cast("double") * 100, decimals), F.lit("%")))


def date(value: Column) -> Column:
    """dd.mm.yyyy of the local day of a timestamp in UTC."""
    return F.coalesce(F.date_format(local_date(value), "dd.MM.yyyy"), F.lit(NONE))


def period(value: Column) -> Column:
    """'2026-08' as month and year; other texts stay."""
    month = F.get(F.array(*map(F.lit, MONTHS)), F.regexp_extract(value, r"^\d{4}-(\d{1,2})$", 1).try_cast("int") - 1)
    named = F.concat_ws(" ", month, F.substring(value, 1, 4))
    return F.when(F.coalesce(value, F.lit("")) == "", NONE).when(month.isNotNull(), named).otherwise(value)


def quarter(value: Column) -> Column:
    """'2026 Q2' in words; other texts stay."""
    roman = F.get(F.array(*map(F.lit, QUARTERS)), F.regexp_extract(value, r"^\d+ Q([1-4])$", 1).try_cast("int") - 1)
    return F.when(F.coalesce(value, F.lit("")) == "", NONE).when(roman.isNotNull(), F.concat(roman, F.lit(" тримесечие на "), F.substring_index(value, " ", 1))).otherwise(value)


def severity(value: Column) -> Column:
    """high, warning or info of any spelling; warning where it is unknown."""
    return F.coalesce(_lookup(SEVERITY_ALIASES, F.lower(F.trim(value))), F.lit("warning"))


def severity_rank(value: Column) -> Column:
    """0 for the gravest."""
    return F.array_position(F.array(*map(F.lit, SEVERITIES)), severity(value)) - 1


def tier(value: Column, rule: Column, level: Column) -> Column:
    """A finding's own tier, else its rule's, else its severity's."""
    own = F.lower(F.trim(value))
    return F.coalesce(F.when(own.isin(*TIERS), own), _lookup(TIER_OF_RULE, rule), _lookup(TIER_OF_SEVERITY, severity(level)))


def tier_rank(value: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, TIERS)), value) - 1


def label(names: dict[str, str], key: Column) -> Column:
    """The label of a key; the key where there is none."""
    return F.coalesce(_lookup(names, key), key)


def event_year(subject_type: Column, details: Column, contract_year: Column) -> Column:
    """Year in which what a finding is about happened; details is a JSON text."""
    at = lambda name: F.when(F.get_json_object(details, f"$.{name}") != "", F.get_json_object(details, f"$.{name}"))
    year = lambda c: F.regexp_extract(c, r"^(\d{4})", 1).try_cast("int")
    spent = year(F.coalesce(*map(at, ("period", "to_period", "first_period", "from_period"))))
    filed = F.coalesce(at("year").try_cast("int"), year(F.coalesce(at("period"), at("expected_period"))))
    return F.when(subject_type == "budget_object", spent).when(subject_type == "report", filed).otherwise(contract_year.cast("int"))


def leva(euro: Column) -> Column:
    """The leva that a euro amount was published as: whole where it is within a hundredth of a whole one."""
    v = euro.cast("double") * F.lit(PEG)
    return F.when(F.abs(v - F.bround(v)) <= 0.01, F.bround(v)).otherwise(F.bround(v, 2))


def href(url: Column) -> Column:
    """A url whose path and query are percent-encoded; what is encoded already stays, as do the characters that urls use."""
    head, rest = F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?", 0), F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", "")
    coded = lambda c: F.when(c.rlike(r"^[A-Za-z0-9/%:?#&=@!$'()*+,;._~-]$"), c).otherwise(F.regexp_replace(F.hex(F.encode(c, "UTF-8")), "(..)", "%$1"))
    return F.when(F.coalesce(url, F.lit("")) == "", "").otherwise(F.concat(head, F.array_join(F.transform(F.filter(F.split(rest, ""), lambda c: c != ""), coded), "")))
