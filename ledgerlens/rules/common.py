"""What all rules share: the finding builder and derived contract columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import PEG, tier_of
from ..functions import text as X
from ..operators.dates import local_date, net_date
from ..schemas import SOURCE


# Wordings of framework agreements.
FRAMEWORK = r"рамков|единични\s*цени|заявк|периодично\s*възлагане"
#: Contracts that a finding on many of them cites: the earliest ones by date and subject.
CITED = 100


def finding(rule: str, *, severity: Column, message: Column, subject_type: str, subject_id: Column, key: Column | None = None, tier: Column | None = None, procurement_id: Column | None = None, details: dict[str, Column] | None = None, sources: Column | None = None) -> Column:
    """A struct of the FLAGS schema; the subject key is the subject id where no other is given."""
    struct = F.struct(*[c.alias(k) for k, c in (details or {"none": F.lit(None).cast("string")}).items()])
    return F.struct(
        F.lit(rule).alias("rule"),
        (F.lit(tier_of(rule)) if tier is None else tier).alias("tier"),
        severity.alias("severity"),
        message.alias("message"),
        F.lit(subject_type).alias("subject_type"),
        subject_id.cast("string").alias("subject_id"),
        (subject_id if key is None else key).cast("string").alias("subject_key"),
        (F.lit(None) if procurement_id is None else procurement_id).cast("long").alias("procurement_id"),
        F.to_json(struct).alias("details"),
        (F.array() if sources is None else sources).cast(f"array<{SOURCE}>").alias("sources"),
    )


def findings(rows: DataFrame, rule: str, **parts) -> DataFrame:
    """rows as findings in the FLAGS schema; parts as ``finding`` takes them."""
    return rows.select(finding(rule, **parts).alias("f")).select("f.*")


def literal_map(pairs: dict) -> Column:
    """A lookup table of a few literals as a map."""
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


def cited(members: DataFrame, keys: Sequence[str], entries: Column, order: Sequence[Column | str], limit: int = CITED) -> DataFrame:
    """(keys, cited): the source entries of each key's first limit members in a documented order, as one array."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    some = members.select(*keys, entries.alias("entries"), place.alias("place")).where(F.col("place") <= limit)
    listed = F.sort_array(F.collect_list(F.struct("place", "entries")))
    return some.groupBy(*keys).agg(F.flatten(F.transform(listed, lambda m: m["entries"])).alias("cited"))


def framework(text: Column) -> Column:
    """Wording that leaves quantities open on purpose."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return low.rlike(FRAMEWORK) | (low.rlike("количеств") & low.rlike("прогнозн|ориентировъчн|индикативн"))


def to_eur(value: Column, code: Column) -> Column:
    """Euro by the record's own currency code; unknown codes are never guessed."""
    return F.when(code == 1, value.cast("double")).when(code == 3, value.cast("double") / F.lit(PEG))


def truthy(c: Column) -> Column:
    return c.isNotNull() & (c != 0)


def filled(c: Column) -> Column:
    return c.isNotNull() & (c != "")


def contracts_view(contracts: DataFrame) -> DataFrame:
    """contracts with subject, eur, tender, signed, dates, estimate, kind, texts and what the texts say of quantities derived once."""
    k, p, d, s = (F.col(f"raw.{x}") for x in ("contract", "procedure", "tender_detail", "sigma"))
    estimate = F.coalesce(to_eur(p["EstimatedValue"], p["Currency"]), F.col("estimated_value_eur").cast("double"))
    noticed = F.least(local_date(net_date(d["OfferPhaseStartDate"])), local_date(net_date(d["PublicationDate"])))
    kinds = [F.when(x["TypeOfContract"].isin(1, 2, 3), x["TypeOfContract"]) for x in (k, p)]
    view = contracts.select(
        "*",
        F.concat_ws(":", F.coalesce("source", F.lit("?")), F.coalesce("source_id", F.lit("?"))).alias("subject"),
        F.col("contract_value_eur").cast("double").alias("eur"),
        (filled(F.col("contractor_name")) | F.col("contract_date").isNotNull()).alias("signed"),
        F.when(F.col("source") == "sigma", s["unp"]).otherwise(F.coalesce(k["TenderNumber"], p["SpecialNumber"])).alias("tender"),
        F.coalesce(local_date(net_date(k["ContractDate"])), local_date(F.col("contract_date"))).alias("signed_on"),
        F.coalesce(noticed, local_date(F.col("published_at"))).alias("noticed_on"),
        local_date(net_date(d["OfferPhaseEndDate"])).alias("offers_until"),
        F.when(estimate > 0, estimate).alias("estimate"),
        F.coalesce(*kinds).alias("kind"),
        F.array_compact(F.array(X.strip_html(d["TenderDescription"]), X.strip_html(d["notice_text"]))).alias("descriptions"),
        F.coalesce("contractor_eik", "contractor_name", F.lit("?")).alias("contractor"),
        F.substring(F.coalesce("title", F.lit("a public procurement")), 1, 90).alias("short_title"),
        F.array_compact(F.array("title", k["ContractSubject"], d["TenderName"])).alias("titles"),
    )
    norm = lambda c: F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))
    bare = F.transform("descriptions", lambda x: F.length(F.trim(F.aggregate(F.transform("titles", norm), norm(x), lambda a, s: F.replace(a, s, F.lit(""))))))
    text = F.concat_ws(" ", "titles", "descriptions")
    return view.select(
        "*",
        (~X.digits_before_unit(text) & ~framework(text)).alias("quantity_open"),  # no quantity is stated, and none is left open on purpose
        F.coalesce(F.array_max(bare), F.lit(0)).alias("description_chars"),  # of the longest description without the titles
    )
