"""Views of contracts, findings, people and budget objects as they are published."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .amounts import money

UNASSIGNED = "(unassigned)"


def open_findings(store: DataFrame) -> DataFrame:
    return store.where("resolved_at IS NULL")


def pending(store: DataFrame) -> DataFrame:
    """Open findings that nobody has been told of."""
    return open_findings(store).where("notified_at IS NULL")


def mark_notified(store: DataFrame, now: Column) -> DataFrame:
    """The store after its pending findings were sent."""
    sent = F.col("resolved_at").isNull() & F.col("notified_at").isNull()
    return store.withColumn("notified_at", F.when(sent, now).otherwise(F.col("notified_at")))


def search(rows: DataFrame, query: str, columns: Sequence[str], **equal: str) -> DataFrame:
    """Rows that hold query in any of the columns, in any case, and equal the given values."""
    out = rows.where(F.lower(F.concat_ws(" ", *columns)).contains(query.strip().lower()))
    for name, value in equal.items():
        out = out.where(F.col(name) == value)
    return out


def enriched(contracts: DataFrame, others: DataFrame, matches: DataFrame, fields: dict[str, str], key: str = "id") -> DataFrame:
    """contracts with fields (new name -> name) of the record in others that matches (left_id, right_id) them."""
    named = others.select(F.col(key).alias("right_id"), *[F.col(c).alias(n) for n, c in fields.items()])
    given = matches.join(named, "right_id", "left").select(F.col("left_id").alias(key), F.col("right_id").alias("match_id"), *fields)
    return contracts.join(given, key, "left")


def match_stats(left: DataFrame, right: DataFrame, matches: DataFrame, candidates: DataFrame, eligible: Column) -> DataFrame:
    """One row: eligible, matched, unmatched, multi_candidate, others and others_matched. candidates: (left_id, right_id) pairs."""
    several = candidates.groupBy("left_id").agg(F.count(F.lit(1)).alias("n")).agg(F.count_if(F.col("n") > 1).alias("multi_candidate"))
    one = left.agg(F.count_if(eligible).alias("eligible")).join(right.agg(F.count(F.lit(1)).alias("others")))
    out = one.join(matches.agg(F.count(F.lit(1)).alias("matched"), F.countDistinct("right_id").alias("others_matched"))).join(several)  # one row each
    return out.select("eligible", "matched", (F.col("eligible") - F.col("matched")).alias("unmatched"), "multi_candidate", "others", "others_matched")


def with_snapshot(lines: DataFrame, reports: DataFrame, fields: Sequence[str] = ("url", "file_path", "period")) -> DataFrame:
    """Lines with struct report of the report they come from."""
    return lines.join(reports.select(F.col("id").alias("report_id"), F.struct(*fields).alias("report")), "report_id", "left")


def with_people(companies: DataFrame, people: DataFrame, key: str = "eik") -> DataFrame:
    """Companies with their people as an array, ordered by role and name."""
    each = F.struct("role", "name", *[c for c in people.columns if c not in (key, "role", "name")])
    return companies.join(people.groupBy(key).agg(F.array_sort(F.collect_list(each)).alias("people")), key, "left").withColumn("people", F.coalesce("people", F.array()))


def also_at(people: DataFrame, pages: DataFrame, roles: Sequence[str], key: str = "eik") -> DataFrame:
    """(key, name_normalized, also_at): other companies' pages (key, slug, label) of current people with a full name, ordered by label.

    Names of fewer than three words say too little. A company's own pages are left out.
    """
    named = people.where("is_current").where(F.size(F.split("name_normalized", r"\s+")) >= 3)
    index = named.where(F.col("role").isin(*roles)).select(key, "name_normalized").distinct().join(pages, key)
    here = named.select(key, "name_normalized").distinct()
    other = index.select(F.col(key).alias("other"), "name_normalized", F.struct("label", "slug").alias("page"))
    own = pages.groupBy(key).agg(F.collect_set("slug").alias("own"))
    met = here.join(other, "name_normalized").where(F.col(key) != F.col("other")).join(own, key, "left")
    kept = met.where(F.coalesce(~F.array_contains("own", F.col("page.slug")), F.lit(True)))
    return kept.groupBy(key, "name_normalized").agg(F.array_sort(F.collect_set("page")).alias("also_at"))


def flags_with_contracts(flags: DataFrame, contracts: DataFrame, links: DataFrame, fields: Sequence[str]) -> DataFrame:
    """flags with struct contract: the one of their procurement_id, or of the twin (twin_id -> id) that it is."""
    c = contracts.select(F.col("id").alias("__id"), F.struct("id", *fields).alias("__contract"))
    direct = flags.join(c.withColumnRenamed("__contract", "__direct"), F.col("procurement_id") == F.col("__id"), "left").drop("__id")
    twins = links.join(c, links["id"] == c["__id"]).select("twin_id", F.col("__contract").alias("__twin"))
    both = direct.join(twins, F.col("procurement_id") == F.col("twin_id"), "left")
    return both.withColumn("contract", F.coalesce("__direct", "__twin")).drop("__direct", "__twin", "twin_id")


def ranked(rows: DataFrame, *order: Column) -> DataFrame:
    """rows in a total order; nulls come last."""
    return rows.orderBy(*order)


def settlement_years(lines: DataFrame, contracts: DataFrame, flags: DataFrame) -> DataFrame:
    """settlement, year, plan, spent, n_objects, n_contracts, contracts_total, n_flags; year null is all years together.

    lines (settlements, year, plan, spent) count once, in the first settlement named; contracts (settlements,
    year, value) and flags (settlements, year) count in every one. What names none is unassigned.
    """
    first = F.coalesce(F.get("settlements", 0), F.lit(UNASSIGNED)).alias("settlement")
    every = F.explode(F.when(F.size("settlements") > 0, F.array_distinct("settlements")).otherwise(F.array(F.lit(UNASSIGNED)))).alias("settlement")
    zero = F.lit(0).cast("decimal(18,2)")
    a = lines.select(first, "year", money("plan").alias("plan"), money("spent").alias("spent"), F.lit(1).alias("o"), F.lit(0).alias("c"), zero.alias("v"), F.lit(0).alias("f"))
    b = contracts.select(every, "year", zero.alias("plan"), zero.alias("spent"), F.lit(0).alias("o"), F.lit(1).alias("c"), money("value").alias("v"), F.lit(0).alias("f"))
    c = flags.select(every, "year", zero.alias("plan"), zero.alias("spent"), F.lit(0).alias("o"), F.lit(0).alias("c"), zero.alias("v"), F.lit(1).alias("f"))
    rows = a.unionByName(b).unionByName(c)
    both = rows.groupBy("settlement", "year").agg(*_sums()).unionByName(rows.groupBy("settlement").agg(*_sums()).withColumn("year", F.lit(None).cast(rows.schema["year"].dataType)))
    return both.select("settlement", "year", "plan", "spent", "n_objects", "n_contracts", "contracts_total", "n_flags")


def _sums() -> list[Column]:
    total = lambda c, n: F.coalesce(F.sum(c), F.lit(0)).cast("double").alias(n)
    return [total("plan", "plan"), total("spent", "spent"), F.sum("o").alias("n_objects"), F.sum("c").alias("n_contracts"), total("v", "contracts_total"), F.sum("f").alias("n_flags")]


def object_years(rows: DataFrame, representative: DataFrame) -> DataFrame:
    """object_name, years (year -> plan and spent of its representative period) and the latest of those periods.

    representative: (year, period). Where a name stands several times in a period, the last row counts.
    """
    at = rows.join(F.broadcast(representative.select("year", "period")), "period").where("object_name IS NOT NULL AND object_name <> ''")  # one row per year
    amount = F.struct(F.coalesce(F.col("plan_current").cast("double"), F.lit(0.0)).alias("plan"), F.coalesce(F.col("spent_period").cast("double"), F.lit(0.0)).alias("spent"))
    last = at.groupBy("object_name", "year", "period").agg(F.max_by(amount, "source_row").alias("amount"))
    return last.groupBy("object_name").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("year", "amount")))).alias("years"), F.max("period").alias("latest_period"))
