"""All rules over the domain tables, in order, and their lifecycle in the store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Thresholds
from ..functions import text as X
from ..operators import lifecycle
from . import budget, companies, contracts, splitting
from . import provenance as V
from .common import cited, contracts_view, findings
from .registry import RULES

__all__ = ["RULES", "budget", "companies", "eu_funded", "eu_wording", "inputs", "run_all", "update_store"]

# Wordings that mark European funding.
EU_WORDINGS = (
    "оперативна програма",
    "програма за развитие на селските райони",
    r"\bПРСР\b",
    "план(?:а)? за възстановяване и устойчивост",
    "механизъм(?:а)? за възстановяване",
    "interreg",
    "кохезионн",
    "европейски(?:я)? (?:фонд|земеделски фонд|социален фонд)",
    r"\bЕФРР\b",
    r"\bЕЗФРСР\b",
    "безвъзмездна финансова помощ",
    r"(?:съ)?финансиран\w*\s+(?:\S+\s+){0,4}(?:от|по)\s+(?:Европейския съюз|ЕС)\b",
)


def eu_wording(text: Column) -> Column:
    """Whether a text speaks of European funding, in any case; word bounds know all letters."""
    return F.coalesce(text.rlike("(?iuU)" + "|".join(EU_WORDINGS)), F.lit(False))


@RULES.table_rule("eu_funded_irregularity", reads=("contracts", "twins", "findings"))
def eu_funded(view: DataFrame, link: DataFrame, flags: DataFrame, t: Thresholds) -> DataFrame:
    """One finding per EU-funded contract that has any other finding, under its subject in the first register.

    The sources are the other findings, by rule and key, then what says that the contract is EU-funded in either
    register; of many findings the first CITED.
    """
    text = F.concat_ws(" ", F.col("raw.tender_detail.TenderName"), F.array_join("descriptions", " "))
    stated = F.coalesce("raw.procedure.IsEUFinanced", F.lit(False))
    own = F.when(F.col("source") == "sigma", F.coalesce("raw.sigma.eu_funded", F.lit(False))).otherwise(stated | eu_wording(text))
    why = F.when(F.col("source") == "sigma", F.array(V.sigma(("id", "unp", "eu_funded")))).otherwise(
        F.when(stated, F.array(V.eop_tender(("SpecialNumber", "IsEUFinanced")))).otherwise(F.array(V.eop_tender(("SpecialNumber", "TenderName"), F.lit("Known by the wording of the texts."))))
    )
    canonical = lambda rows: rows.join(link.select(F.col("sigma").alias("subject"), "eop"), "subject", "left").withColumn("subject", F.coalesce("eop", "subject")).drop("eop")
    funded = canonical(view.where(own).select("subject", "source", F.array_compact(why).alias("why"))).groupBy("subject").agg(F.sort_array(F.collect_list(F.struct("source", "why"))).alias("why"))  # one or two rows
    members = F.from_json("details", "struct<members: array<string>>")["members"]
    single = F.when(F.col("subject_type") == "contract", F.array("subject_id")).otherwise(F.array().cast("array<string>"))
    subjects = canonical(flags.select("rule", "subject_key", "message", F.explode(F.array_distinct(F.concat(single, F.coalesce(members, F.array().cast("array<string>"))))).alias("subject")))
    met = subjects.join(funded.select("subject"), "subject", "left_semi").dropDuplicates(["subject", "rule", "subject_key"])
    other = V.flag(F.col("rule"), F.col("subject_key"), X.truncate(F.col("message"), 140))
    rows = met.groupBy("subject").agg(F.array_sort(F.collect_set("rule")).alias("rules")).join(cited(met, ["subject"], F.array(other), ["rule", "subject_key"]), "subject").join(funded, "subject")
    reasons = F.flatten(F.transform("why", lambda w: w["why"]))
    return findings(rows, "eu_funded_irregularity", severity=F.lit("info"), message=F.concat(F.lit("EU-funded, with findings: "), F.array_join("rules", ", ")), subject_type="contract", subject_id=F.col("subject"), details={"rules": F.col("rules")}, sources=F.concat("cited", reasons))


def inputs(tables: dict[str, DataFrame], t: Thresholds, now: Column) -> dict:
    """What rules read, from procurements, ledger, reports, companies, people and officials."""
    view = contracts_view(tables["procurements"])
    obj = budget.objects(tables["ledger"], tables["reports"])
    rest = {k: tables[k] for k in ("reports", "companies", "people", "officials")}
    return rest | {"contracts": view, "twins": contracts.twins(view, t), "split_groups": splitting.split_groups(view, t), "objects": obj, "newest": budget.latest(obj), "closing": budget.year_end(obj), "now": now}


def run_all(tables: dict[str, DataFrame], t: Thresholds, now: Column, only=None) -> DataFrame:
    """Findings of every registered rule, or of those named. tables: procurements, ledger, reports, companies, people, officials."""
    given = inputs(tables, t, now)
    flags = RULES.run(given, t, only)
    return contracts.raise_split(flags, given["contracts"], splitting.split_subjects(given["split_groups"]))


def update_store(stored: DataFrame, flags: DataFrame, now: Column, ran=None, emitted: str | None = None) -> DataFrame:
    """The store after this run. Of findings with one key the first emitted is kept: by column emitted, where the caller has one, then by message and details."""
    order = F.struct(*([F.col(emitted)] if emitted else []), "message", "details")
    one = lifecycle.first_emitted(flags.withColumn("__order", order), "__order").drop("__order")
    return lifecycle.merge_findings(stored, one, RULES.names() if ran is None else ran, now)
