"""Rules on ledger objects and on published reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import PEG, Thresholds
from ..operators import amounts as A
from ..operators import linking as L
from ..operators import periods as P
from . import provenance as V
from .common import findings
from .registry import RULES

REPORT = "struct<url: string, file_path: string, period: string>"


def objects(lines: DataFrame, reports: DataFrame | None = None) -> DataFrame:
    """Object rows of the municipal total, with missing amounts as zero, the key paragraph:name and the report that they stand in."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("double").alias(c)
    kept = lines.where("unit = 'Общо' AND row_type = 'object'")
    rest = [c for c in lines.columns if c not in ("estimated_total", "spent_prior", "plan_current", "spent_period")]
    full = kept.select(*rest, *map(zero, ("estimated_total", "spent_prior", "plan_current", "spent_period")), F.concat_ws(":", "paragraph", "object_name").alias("object_key"))
    for name, kind in (("currency", "string"), ("source_sheet", "string"), ("source_row", "int")):
        if name not in full.columns:
            full = full.withColumn(name, F.lit(None).cast(kind))
    if reports is None:
        return full.withColumn("report", F.lit(None).cast(REPORT))
    files = reports.select(F.col("id").alias("report_id"), F.struct("url", "file_path", "period").alias("report"))
    return full.join(files, "report_id", "left")


def latest(obj: DataFrame) -> DataFrame:
    return P.latest_rows(obj, "period")


def year_end(obj: DataFrame) -> DataFrame:
    return P.latest_rows(obj.withColumn("year", F.substring("period", 1, 4)), "period", ["year"])


def unplanned_reasons(t: Thresholds) -> Column:
    est, prior, plan, spent = (F.col(c) for c in ("estimated_total", "spent_prior", "plan_current", "spent_period"))
    return A.reasons(no_plan=(plan <= 0) & (spent >= t.unplanned_spent), over_estimate=(est > 0) & (prior + spent - est >= t.unplanned_excess))


@RULES.table_rule("unplanned_spending", reads=("closing",))
def unplanned_spending(rows: DataFrame, t: Thresholds) -> DataFrame:
    """rows: year_end objects."""
    hit = rows.withColumn("reasons", unplanned_reasons(t)).where(F.size("reasons") > 0)
    return findings(hit, "unplanned_spending", severity=F.lit("warning"), message=F.concat(F.lit("Spent without or above its plan: "), "object_name"), subject_type="budget_object", subject_id=F.col("object_key"), key=F.concat_ws(":", "object_key", "year"), details={"reasons": F.col("reasons")}, sources=F.array(V.budget_row()))


@RULES.table_rule("overspend_vs_plan", reads=("newest",))
def overspend(rows: DataFrame, t: Thresholds) -> DataFrame:
    """rows: latest objects that aren't unplanned."""
    plan, spent = F.col("plan_current"), F.col("spent_period")
    hit = rows.where((plan > 0) & (F.size(unplanned_reasons(t)) == 0) & (spent - F.lit(t.overspend_ratio) * plan > t.overspend_abs))
    return findings(hit, "overspend_vs_plan", severity=F.lit("warning"), message=F.concat(F.lit("Spent more than planned: "), "object_name"), subject_type="budget_object", subject_id=F.col("object_key"), sources=F.array(V.budget_row(("plan_current", "spent_period"))))


@RULES.table_rule("plan_jump", reads=("objects",))
def plan_jump(obj: DataFrame, t: Thresholds) -> DataFrame:
    """Plans that jump within a year, and objects that appear with a large plan after the year's first period."""
    keys = ["paragraph", "object_name"]
    entry = V.budget_row(("plan_current",))
    rows = obj.withColumn("year", F.substring("period", 1, 4)).withColumn("before_entry", F.lag(entry).over(Window.partitionBy(*keys).orderBy("period")))
    rose = P.jumps(rows, keys, "period", "plan_current", t.jump_ratio, t.jump_delta, same=F.col("year"))
    a = findings(rose, "plan_jump", severity=F.lit("warning"), message=F.concat(F.lit("The plan jumped: "), "object_name"), subject_type="budget_object", subject_id=F.col("object_key"), key=F.concat("object_key", F.lit(":"), "previous_period", F.lit("->"), "period"), sources=F.array("before_entry", entry))
    starts = rows.groupBy("year").agg(F.min("period").alias("year_start"))
    new = P.newcomers(rows, keys, "period", "plan_current", t.new_object).join(F.broadcast(starts), "year").where("period <> year_start")
    # the period before, in whose file the object isn't; periods are few
    files = rows.groupBy("period").agg(F.min("report").alias("earlier")).withColumn("period", F.lead("period").over(Window.orderBy("period")))
    new = new.join(F.broadcast(files), "period", "left")
    absent = V.budget_file(F.lit("CAPITAL"), F.col("earlier.period"), F.col("earlier.url"), F.col("earlier.file_path"), F.concat(F.lit("Not in this file: "), "object_name"))
    b = findings(new, "plan_jump", severity=F.lit("warning"), message=F.concat(F.lit("New object with a large plan: "), "object_name"), subject_type="budget_object", subject_id=F.col("object_key"), key=F.concat("object_key", F.lit(":new")), sources=F.when(F.col("earlier").isNotNull(), F.array(absent, entry)).otherwise(F.array(entry)))
    return a.unionByName(b)


@RULES.table_rule("unmatched_spending", reads=("newest", "contracts"))
def unmatched_spending(rows: DataFrame, view: DataFrame, t: Thresholds) -> DataFrame:
    """Latest objects with spending of contract size to which no contract's title and value fit."""
    spent = rows.where(F.col("spent_period") >= t.direct_award_bgn / PEG)
    objects_ = spent.select(F.col("object_key").alias("object_id"), F.col("object_name").alias("text"), F.col("spent_period").alias("size"))
    contracts = view.where("contractor_name IS NOT NULL AND contractor_name <> '' AND eur <> 0").select(F.col("id").alias("candidate_id"), F.col("title").alias("text"), F.col("eur").alias("size"))
    matches = L.best_match(objects_, contracts, min_jaccard=t.match_jaccard, low=t.match_low, high=t.match_high)
    left = spent.join(matches.select(F.col("object_id").alias("object_key")), "object_key", "left_anti")
    return findings(left, "unmatched_spending", severity=F.lit("info"), message=F.concat(F.lit("No contract fits the spending on: "), "object_name"), subject_type="budget_object", subject_id=F.col("object_key"), sources=F.array(V.budget_row(("spent_period",), note=F.lit("Held against the titles and values of all contracts of both registers."))))


@RULES.table_rule("missing_annual_report", "missing_monthly_report", reads=("reports", "now"))
def missing_reports(reports: DataFrame, now: Column, t: Thresholds) -> DataFrame:
    """Months without a cash report, and years without a closing one; nothing where there are no reports at all."""
    have = reports.where(F.upper("kind").isin("B1", "B3")).select("period").distinct()
    span = reports.limit(1).select(F.lit(f"{t.reports_from}-01").cast("date").alias("a"), F.add_months(F.trunc(now, "month"), -2).alias("z"))
    months = span.where("z >= a").select(F.explode(F.expr("sequence(a, z, interval 1 month)")).alias("m")).select(F.date_format("m", "yyyy-MM").alias("period"))
    years = reports.limit(1).select(F.explode(F.sequence(F.lit(int(t.reports_from[:4])), F.year(now) - 1)).alias("y")).where(F.to_date(now) > F.make_date(F.col("y") + 1, F.lit(3), F.lit(31)))
    annual = years.select("y", F.concat(F.col("y").cast("string"), F.lit("-12")).alias("period")).join(have, "period", "left_anti")
    monthly = months.join(have, "period", "left_anti").join(annual, "period", "left_anti")
    files = reports.groupBy("period").agg(F.array_join(F.array_sort(F.collect_set(V.file_name(F.col("file_path"), F.col("url")))), ", ").alias("files"))  # a period's files are few
    looked = F.concat(F.lit("Looked for a file of kind B1 or B3. Found for this period: "), F.when(F.col("files") != "", F.col("files")).otherwise("none"), F.lit("."))
    page = F.array(V.reports_page(F.lit(t.reports_page or None).cast("string"), F.col("period"), looked))
    annual, monthly = (x.join(files, "period", "left").withColumn("files", F.coalesce("files", F.lit(""))) for x in (annual, monthly))
    a = findings(annual, "missing_annual_report", severity=F.lit("warning"), message=F.concat(F.lit("No closing report for "), F.col("y").cast("string")), subject_type="report", subject_id=F.concat(F.lit("annual:"), F.col("y").cast("string")), sources=page)
    b = findings(monthly, "missing_monthly_report", severity=F.lit("info"), message=F.concat(F.lit("No report for "), "period"), subject_type="report", subject_id=F.concat(F.lit("report:"), "period"), sources=page)
    return a.unionByName(b)
