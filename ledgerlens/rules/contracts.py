"""Rules on single contracts, contractors and tenders. Every rule takes contracts_view rows and thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import ANNEX2_PREFIXES, PEG, Thresholds
from ..functions import text as X
from ..operators import amounts as A
from ..operators import dates as D
from ..schemas import SOURCE
from . import provenance as V
from .common import cited, filled, finding, findings, framework, literal_map, to_eur, truthy
from .registry import RULES, Facts

# Procedure types with their regime level, offer periods (legal, shortest) and exceptional ones.
REGIMES = [
    ("CollectingOffersWithNotice", 1), ("Събиране на оферти с обява", 1), ("Събиране на оферти", 1),
    ("InvitationToSpecificEconomicOperators", 1), ("Покана до определени лица", 1), ("Договаряне с покана", 1),
    ("PublicCompetition", 2), ("Публично състезание", 2), ("Състезание", 2), ("DirectNegotiation", 2), ("Пряко договаряне", 2),
    ("OpenProcedure", 3), ("Открита процедура", 3), ("Открита", 3), ("NegotiatedProcedure", 3),
    ("Договаряне без предварително обявление", 3), ("Конкурс за проект - открит", 3),
]
OFFER_DAYS = [
    ("OpenProcedure", "open", 30, 15), ("Открита процедура", "open", 30, 15),
    ("PublicCompetition", "competition", 20, 10), ("Публично състезание", "competition", 20, 10),
    ("CollectingOffersWithNotice", "collecting", 10, 10), ("Събиране на оферти с обява", "collecting", 10, 10),
]
EXCEPTIONAL = ("NegotiatedProcedure", "Договаряне без предварително обявление", "DirectNegotiation", "Пряко договаряне", "Пряко / без обявление", "InvitationToSpecificEconomicOperators", "Покана до определени лица", "Договаряне с покана")
FUEL = "^(09000000|091)"
EXCHANGE = r"стоков\p{L}*\s+борс"


__all__ = ["framework"]

# Fields of the sources from which a rule's numbers come.
VALUE = ("ContractNumber", "TenderNumber", "ContractDate", "ContractValue", "Currency", "CurrentContractValue", "SupplierName")
PUBLICATION = ("ContractNumber", "TenderNumber", "ContractDate", "TedPublishDate", "SupplierName", "RegisterNumberList")
ANNEX = ("ContractNumber", "TenderNumber", "ContractValue", "Currency", "CurrentContractValue", "CurrentContractCurrency", "SupplierName")
PROCEDURE = ("ContractNumber", "TenderNumber", "ContractDate", "ContractValue", "Currency", "ProcedureType", "SupplierName")
DEADLINE = ("ContractNumber", "TenderNumber", "ContractDate", "SupplierName")
NOTICE = ("ProcedureType", "PublicationDate", "OfferPhaseStartDate", "OfferPhaseEndDate")
CEILING = ("ContractNumber", "TenderNumber", "ContractValue", "Currency", "SupplierName")
ESTIMATE = ("SpecialNumber", "ProcedureType", "EstimatedValue", "Currency", "PublicationDate", "OfferPhaseStartDate")
TEXTS = ("ContractNumber", "TenderNumber", "ContractSubject", "ContractValue", "Currency", "SupplierName")


def on_contract(rule: str, where: Column, severity: Column, message: Column, sources: Column, **more) -> Column:
    """A finding on the contract of a row, where the condition holds; else null."""
    return F.when(where, finding(rule, severity=severity, message=message, subject_type="contract", subject_id=F.col("subject"), procurement_id=F.col("id"), sources=sources, **more))


def _says(text: str) -> Column:
    return F.concat(F.lit(text), "short_title")


@RULES.row_rule("missing_value")
def missing_value(t: Thresholds) -> Column:
    where = F.col("signed") & A.absent(F.col("contract_value_eur")) & A.absent(F.col("contract_value_bgn"))
    return on_contract("missing_value", where, F.lit("warning"), _says("No value is published for: "), V.contract_sources(VALUE, [], V.SIGMA_CONTRACT))


@RULES.row_rule("late_publication")
def late_publication(t: Thresholds) -> Column:
    k = F.col("raw.contract")
    days = D.floor_days(D.net_date(k["TedPublishDate"]), D.net_date(k["ContractDate"]))
    late = days - t.late_deadline_days
    level = F.when(late > t.late_high_days, "high").when(late > t.late_warning_days, "warning").otherwise("info")
    message = F.concat(F.lit("Published "), late.cast("string"), F.lit(" days after the deadline: "), "short_title")
    return on_contract("late_publication", (F.col("source") == "eop") & (late > t.late_grace_days), level, message, V.contract_sources(PUBLICATION, []), details={"days": days, "late": late})


def _annex(t: Thresholds) -> tuple[Column, Column, Column, Column]:
    """Values before and after the annexes, whether they can be compared, and whether they pass the cap."""
    k = F.col("raw.contract")
    before, after = to_eur(k["ContractValue"], k["Currency"]), to_eur(k["CurrentContractValue"], k["CurrentContractCurrency"])
    plausible = (F.col("source") == "eop") & (before > 0) & (after > 0) & (after <= F.lit(t.annex_implausible_ratio) * before)
    over = k["Currency"].eqNullSafe(k["CurrentContractCurrency"]) & (after > F.lit(t.annex_cap_ratio) * before)
    return before, after, plausible, over


@RULES.row_rule("annex_growth")
def annex_growth(t: Thresholds) -> Column:
    before, after, plausible, over = _annex(t)
    where = plausible & ~over & (after > F.lit(t.annex_growth_ratio) * before)
    return on_contract("annex_growth", where, F.lit("warning"), _says("The value grew by annexes: "), V.contract_sources(ANNEX, []), details={"before": before, "after": after})


@RULES.row_rule("annex_over_cap")
def annex_over_cap(t: Thresholds) -> Column:
    before, after, plausible, over = _annex(t)
    return on_contract("annex_over_cap", plausible & over & (after > before), F.lit("high"), _says("Annexes exceed half of the original value: "), V.contract_sources(ANNEX, []), details={"before": before, "after": after})


@RULES.row_rule("single_bidder")
def single_bidder(t: Thresholds) -> Column:
    where = (F.col("bids_received") == 1) & (F.col("eur") >= t.single_bidder_value)
    return on_contract("single_bidder", where, A.severity(F.col("eur"), t.single_bidder_high), _says("One bid only: "), V.contract_sources(VALUE, None, (*V.SIGMA_CONTRACT, "bids_received")))


@RULES.row_rule("short_offer_deadline")
def short_offer_deadline(t: Thresholds) -> Column:
    at = F.col("procedure_type")
    family, legal, bare = (literal_map({row[0]: row[k] for row in OFFER_DAYS})[at] for k in (1, 2, 3))
    days, offer_days = F.datediff("signed_on", "noticed_on"), F.datediff("offers_until", "noticed_on")
    below = lambda d, bound: F.coalesce(d < bound, F.lit(False))
    exempt = (family == "collecting") & (F.col("noticed_on") < F.lit(t.collecting_from).cast("date"))
    violation = (below(days, bare) | below(offer_days, bare)) & ~exempt
    signal = below(days, legal + t.deadline_margin_days) | below(offer_days, legal)
    where = (F.col("source") == "eop") & F.col("signed") & F.col("noticed_on").isNotNull() & F.col("signed_on").isNotNull() & family.isNotNull() & (violation | signal)
    pick = lambda a, b: F.when(violation, a).otherwise(b)
    sources = V.contract_sources(DEADLINE, NOTICE, note=F.lit("The notice's date is the earlier one of publication and start of the offer phase."))
    message = F.concat(F.lit("Signed "), days.cast("string"), F.lit(" days after the notice: "), "short_title")
    return on_contract("short_offer_deadline", where, pick("high", "warning"), message, sources, tier=pick("violation", "signal"), details={"days": days, "offer_days": offer_days})


def _described(t: Thresholds) -> Column:
    """Signed contracts of some value whose texts state no quantity where they should."""
    return (F.col("source") == "eop") & F.col("signed") & F.col("raw.contract").isNotNull() & (F.col("eur") >= t.quantity_value) & F.col("quantity_open")


def _unverifiable(t: Thresholds) -> Column:
    return F.col("kind").isin(2, 3) & (F.col("description_chars") < t.price_text_chars)


@RULES.row_rule("price_unverifiable")
def price_unverifiable(t: Thresholds) -> Column:
    level = F.when(F.col("eur") >= t.quantity_warning, "warning").otherwise("info")
    sources = V.contract_sources(TEXTS, ("SpecialNumber", "TenderName", "TenderDescription"))
    return on_contract("price_unverifiable", _described(t) & _unverifiable(t), level, _says("The price can't be verified from the texts: "), sources, details={"longest": F.col("description_chars")})


def _quantity_level(value: Column, t: Thresholds) -> Column:
    return A.severity(value, t.quantity_high, t.quantity_warning)


@RULES.row_rule("missing_quantity")
def contract_quantity(t: Thresholds) -> Column:
    """Supplies without quantities."""
    where = _described(t) & (F.col("kind") == 2) & ~_unverifiable(t)
    return on_contract("missing_quantity", where, _quantity_level(F.col("eur"), t), _says("No quantity is stated: "), V.contract_sources(TEXTS, ("SpecialNumber", "TenderName")))


@RULES.table_rule("missing_quantity", reads=("newest",))
def object_quantity(objects: DataFrame, t: Thresholds) -> DataFrame:
    """Acquisitions in the ledger without quantities."""
    value = F.greatest(F.coalesce("plan_current", F.lit(0)), F.coalesce("spent_period", F.lit(0))).cast("double")
    named = objects.where((F.col("paragraph") == "5200") & (value >= t.quantity_value) & ~X.digits_before_unit(F.col("object_name")) & ~framework(F.col("object_name")))
    message = F.concat(F.lit("No quantity is stated: "), "object_name")
    return findings(named, "missing_quantity", severity=_quantity_level(value, t), message=message, subject_type="budget_object", subject_id=F.concat_ws(":", "paragraph", "object_name"), sources=F.array(V.budget_row(("plan_current", "spent_period"))))


def missing_quantity(view: DataFrame, objects: DataFrame, t: Thresholds) -> DataFrame:
    return contract_quantity(view, t).unionByName(object_quantity(objects, t))


@RULES.table_rule("contractor_concentration", reads=("contracts", "now"))
def contractor_concentration(view: DataFrame, now: Column, t: Thresholds) -> DataFrame:
    since = now - F.expr(f"INTERVAL {t.concentration_days} DAYS")
    eop = view.where("source = 'eop'")
    shares = A.share_of_total(eop, "contractor", "eur", since=since, at="contract_date", min_count=t.concentration_count, min_share=t.concentration_share)
    members = eop.where(~A.absent(F.col("eur")) & (F.col("contract_date") >= since)).join(shares.select("contractor"), "contractor", "left_semi")
    with_sources = shares.join(cited(members, ["contractor"], V.contract_sources(V.MEMBER, []), ["contract_date", "subject"]), "contractor", "left")
    message = F.concat(F.col("contractor"), F.lit(" holds a large share of all contracts"))
    return findings(with_sources, "contractor_concentration", severity=F.lit("info"), message=message, subject_type="contractor", subject_id=F.col("contractor"), details={"n": F.col("n"), "total": F.col("total"), "share": F.col("share")}, sources=F.col("cited"))


# rules on what the other contracts of a tender are


def _tender_columns(t: Thresholds) -> dict[str, Column]:
    """Contracts without a tender are alone."""
    in_tender = F.col("tender").isNotNull()
    second = (F.col("source") == "sigma") & in_tender & filled(F.col("contractor_eik"))
    return {
        "tender_key": F.coalesce("tender", F.concat(F.lit("#"), "subject")),
        "contractor_eik": F.col("contractor_eik"),
        "id": F.col("id"),
        "subject": F.col("subject"),
        "value": F.coalesce("eur", F.lit(0.0)),
        "first_register": (F.col("source") == "eop") & in_tender,
        "signed": F.col("signed"),
        "spent": F.when(F.col("source") == "eop", A.money("eur")),
        "second": F.when(second, F.struct(F.coalesce("eur", F.lit(0.0)).alias("value"), "id", "subject", "source_id", F.col("tender").alias("unp"), F.col("bids_received").alias("bids"))),
    }


def _tender_facts(rows: DataFrame, t: Thresholds) -> DataFrame:
    """known: contracts of the first register in the tender; alone: whether a row is its only signed one; lead: whether it speaks for the tender; tender_spent; twin: its row in the second register.

    The twin is the row of one tender and contractor with the closest value: a lone one in any case, else within the
    tolerance. The closest value is the last one in order from below or from above, so no list of candidates is made.
    """
    tender = Window.partitionBy("tender_key")
    pair = Window.partitionBy("tender_key", "contractor_eik")
    lead = tender.orderBy(F.desc("first_register"), F.desc("signed"), "id")
    ours = F.col("first_register") & F.col("signed")
    is_second = F.col("second").isNotNull()
    below, above = (F.last("second", ignorenulls=True).over(pair.orderBy(value, F.desc(is_second), F.desc("id")).rowsBetween(Window.unboundedPreceding, Window.currentRow)) for value in (F.asc("value"), F.desc("value")))
    out = rows.select(
        "*",
        F.count(F.when(F.col("first_register"), 1)).over(tender).alias("known"),
        (ours & (F.count(F.when(ours, 1)).over(tender) == 1)).alias("alone"),
        (F.col("first_register") & (F.row_number().over(lead) == 1)).alias("lead"),
        F.sum(F.when(ours, F.col("spent"))).over(tender).cast("double").alias("tender_spent"),
        F.count("second").over(pair).alias("seconds"),
        below.alias("below"),
        above.alias("above"),
    )
    down, up = F.col("value") - F.col("below.value"), F.col("above.value") - F.col("value")
    lower = F.col("above").isNull() | (down < up) | ((down == up) & (F.col("below.id") <= F.col("above.id")))
    closest = F.when(F.col("below").isNotNull() & lower, F.col("below")).otherwise(F.col("above"))
    near = (F.col("value") > 0) & (F.abs(F.col("value") - F.col("closest.value")) <= F.lit(t.twin_tolerance) * F.col("value"))
    twin = F.when(ours & filled(F.col("contractor_eik")) & ((F.col("seconds") == 1) | near), F.col("closest"))
    return out.withColumn("closest", closest).withColumn("twin", twin)


TENDER = Facts("tender_key", _tender_columns, _tender_facts)


def twins(view: DataFrame, t: Thresholds) -> DataFrame:
    """(eop, sigma, sigma_bids, eop_id, sigma_id) of the contracts that stand in both registers, by the tender's facts."""
    rows = view.select(*(c.alias(n) for n, c in _tender_columns(t).items())).repartition(TENDER.key)
    return _tender_facts(rows, t).where("twin IS NOT NULL").select(F.col("subject").alias("eop"), F.col("twin.subject").alias("sigma"), F.col("twin.bids").alias("sigma_bids"), F.col("id").alias("eop_id"), F.col("twin.id").alias("sigma_id"))


@RULES.row_rule("exceptional_procedure", facts=TENDER, settle=lambda f, t: F.when(F.col("first_register") | (F.col("known") == 0), f), at_once=lambda t: F.coalesce(F.col("source") == "eop", F.lit(False)) | F.col("tender").isNull())
def exceptional_procedure(t: Thresholds) -> Column:
    """Rows of the second register count only where the first one doesn't know the tender."""
    text = F.lower(F.concat_ws(" ", F.col("title"), F.array_join("descriptions", " ")))
    mild = text.rlike(EXCHANGE) | F.coalesce(F.col("cpv_code").rlike(FUEL), F.lit(False))
    level = F.when(mild, "info").otherwise(A.severity(F.coalesce("eur", F.lit(0.0)), t.exceptional_high, t.exceptional_warning))
    where = F.col("signed") & F.col("source").isin("eop", "sigma") & F.col("procedure_type").isin(*EXCEPTIONAL)
    sources = V.contract_sources(PROCEDURE, ("SpecialNumber", "ProcedureType", "TenderName"), (*V.SIGMA_CONTRACT, "procedure"))
    return on_contract("exceptional_procedure", where, level, _says("Awarded without a public notice: "), sources)


def _settle_ceiling(f: Column, t: Thresholds) -> Column:
    """The tender's only contract, with no second bid in either register; the second register is cited where it says so."""
    bids = F.coalesce("own_bids", "twin.bids")
    cited_twin = F.when(F.col("own_bids").isNull() & F.col("twin.bids").isNotNull(), F.array(V.sigma_twin(F.col("twin")))).otherwise(F.array().cast(f"array<{SOURCE}>"))
    kept = f.withField("details", F.to_json(F.struct(F.col("ceiling_ratio").alias("ratio"), bids.alias("bids")))).withField("sources", F.concat(f["sources"], cited_twin))
    return F.when(f.isNotNull() & F.col("alone") & (bids.isNull() | (bids < 2)), kept)


@RULES.row_rule("bid_at_ceiling", facts=TENDER, settle=_settle_ceiling, carries=lambda t: {"own_bids": F.col("bids_received"), "ceiling_ratio": F.col("eur") / F.col("estimate")})
def bid_at_ceiling(t: Thresholds) -> Column:
    ratio = F.col("eur") / F.col("estimate")
    where = (F.col("source") == "eop") & F.col("signed") & F.col("tender").isNotNull() & truthy(F.col("eur")) & (F.col("estimate") > 0) & ratio.between(t.ceiling_low, t.ceiling_high) & (F.col("eur") >= t.ceiling_value)
    return on_contract("bid_at_ceiling", where, A.severity(F.col("eur"), t.ceiling_high_value), _says("Priced at the estimate: "), V.contract_sources(CEILING, ESTIMATE))


# categories and regime bands


def category(kind: Column, cpv: Column) -> Column:
    """works, annex2 or supplies by type of contract and CPV prefix."""
    special = F.lit(False)
    for p in ANNEX2_PREFIXES:
        special = special | cpv.startswith(p)
    return F.when((kind == 3) | cpv.startswith("45"), "works").when((kind == 1) & special, "annex2").when(kind.isin(1, 2), "supplies")


def bands(t: Thresholds) -> list[tuple[str, float, int]]:
    """(category, boundary in euro, level required from there on)."""
    by = {"works": t.works_bands_bgn, "supplies": t.supplies_bands_bgn, "annex2": t.annex2_bands_bgn}
    return [(c, bgn / PEG, level) for c, rows in by.items() for bgn, level in rows]


def with_regime(view: DataFrame) -> DataFrame:
    return A.lookup(view, "procedure_type", A.dimension(view.sparkSession, ["procedure_type", "level"], REGIMES)).withColumn("category", category(F.col("kind"), F.col("cpv_code")))


def _boundary(t: Thresholds) -> Column:
    """The boundary from which the next stricter regime is required, of a row's category and procedure."""
    level = literal_map(dict(REGIMES))[F.col("procedure_type")]
    of = literal_map({f"{c}:{required - 1}": boundary for c, boundary, required in bands(t)})
    return of[F.concat_ws(":", category(F.col("kind"), F.col("cpv_code")), level.cast("string"))]


def _in_band(value: Column, boundary: Column, t: Thresholds) -> Column:
    return (value >= (1 - t.near_share) * boundary) & (value < boundary)


def _settle_near(f: Column, t: Thresholds) -> Column:
    """Of the row that speaks for its tender; its value is the estimate, else what the tender's contracts cost."""
    value = F.coalesce("own_estimate", "tender_spent")
    kept = f.withField("details", F.to_json(F.struct(value.alias("value"), F.col("near_boundary").alias("boundary"))))
    return F.when(f.isNotNull() & F.col("lead") & _in_band(value, F.col("near_boundary"), t), kept)


@RULES.row_rule("near_threshold", facts=TENDER, settle=_settle_near, carries=lambda t: {"own_estimate": F.col("estimate"), "near_boundary": _boundary(t)})
def tender_near_threshold(t: Thresholds) -> Column:
    """Tenders valued just below the boundary from which the next stricter regime is required."""
    boundary = _boundary(t)
    announced = F.coalesce("noticed_on", "signed_on") >= F.lit(t.near_from).cast("date")
    where = (F.col("source") == "eop") & F.col("tender").isNotNull() & announced & boundary.isNotNull() & (F.col("estimate").isNull() | _in_band(F.col("estimate"), boundary, t))
    sources = F.when(F.col("estimate").isNotNull(), V.contract_sources([], ESTIMATE)).otherwise(V.contract_sources(V.MEMBER, []))
    f = finding("near_threshold", severity=F.lit("info"), message=_says("Valued just below a legal boundary: "), subject_type="procedure", subject_id=F.concat(F.lit("eop-tender:"), "tender"), procurement_id=F.col("id"), sources=sources)
    return F.when(where, f)


def raise_split(flags: DataFrame, view: DataFrame, split_members: DataFrame) -> DataFrame:
    """flags, with near_threshold as a warning where a contract of the tender is a member of a split group (subject)."""
    tenders = view.where("source = 'eop' AND tender IS NOT NULL").join(split_members.select("subject").distinct(), "subject", "left_semi")
    hit = tenders.select(F.concat(F.lit("eop-tender:"), "tender").alias("subject_id"), F.lit("near_threshold").alias("rule")).distinct().withColumn("__split", F.lit(True))
    joined = flags.join(hit, ["rule", "subject_id"], "left")
    return joined.withColumn("severity", F.when(F.col("__split"), "warning").otherwise(F.col("severity"))).select(*flags.columns)


def near_threshold(view: DataFrame, t: Thresholds, split_members: DataFrame | None = None) -> DataFrame:
    flags = tender_near_threshold(view, t)
    return flags if split_members is None else raise_split(flags, view, split_members)


def signed_contractors(view: DataFrame) -> DataFrame:
    """One row per signed register contract and canonical identifier of its contractor."""
    return view.where("source = 'eop' AND signed").where(filled(F.col("contractor_eik"))).withColumn("eik", F.explode(X.canonical_ids(F.col("contractor_eik"))))
