"""Readers that land source files as typed DataFrames. Fetching stays outside Spark: everything reads landed files.

Paths go to Spark's own readers, so any store that Spark knows will do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators.periods import fill_down
from ..schemas import PROCUREMENTS


def csv_contracts(spark: SparkSession, path: str) -> DataFrame:
    """The second register's CSV in the PROCUREMENTS schema; identifiers stay text, '123.0' becomes '123'."""
    raw = spark.read.option("header", True).csv(path)
    eik = F.regexp_replace("contractor_eik", r"\.0+$", "")
    sigma = F.struct(F.col("unp"), F.lower("eu_funded").isin("true", "1", "yes").alias("eu_funded"), F.col("procedure"))
    none = lambda t: F.lit(None).cast(t)
    empty = spark.createDataFrame([], PROCUREMENTS).schema
    given = {
        "id": F.col("id").try_cast("long"),
        "source": F.lit("sigma"),
        "source_id": F.col("id"),
        "title": F.col("subject"),
        "cpv_code": F.col("sector_code"),
        "procedure_type": F.col("procedure"),
        "contract_value_eur": F.col("value_eur").try_cast("decimal(16,2)"),
        "currency": F.lit("EUR"),
        "contractor_name": F.col("contractor"),
        "contractor_eik": F.when(eik != "", eik),
        "bids_received": F.col("bids_received").try_cast("double").cast("int"),
        "contract_date": F.col("signed_at").try_cast("timestamp"),
    }
    fields = {f.name: f.dataType for f in empty["raw"].dataType.fields}
    raw_struct = F.struct(*[(sigma.cast(t) if n == "sigma" else none(t)).alias(n) for n, t in fields.items()])
    return raw.select(*[(raw_struct if f.name == "raw" else given.get(f.name, none(f.dataType)).cast(f.dataType)).alias(f.name) for f in empty.fields])


def json_pages(spark: SparkSession, path: str, schema: str, rows: str = "Items") -> DataFrame:
    """Rows of landed response pages; pages that don't parse are in column corrupt of ``json_failures``."""
    page = spark.read.schema(f"{rows} array<{schema}>, HasMoreResults boolean, ResultsCount long").json(path, multiLine=True)
    return page.select(F.explode(rows).alias("r")).select("r.*")


def json_failures(spark: SparkSession, path: str) -> DataFrame:
    """Files that aren't JSON objects, beside the data and not instead of it."""
    pages = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    return pages.where(F.try_parse_json("value").isNull()).select("file")


def assemble(contracts: DataFrame, procedures: DataFrame, details: DataFrame, key: str = "TenderId") -> DataFrame:
    """One row per contract with its procedure and detail, and one per procedure without a contract."""
    p, d = procedures.select(key, F.struct("*").alias("procedure")), details.select(key, F.struct("*").alias("tender_detail"))
    c = contracts.select(key, F.struct("*").alias("contract"))
    signed = c.join(p, key, "left").join(d, key, "left")
    open_ = p.join(c, key, "left_anti").join(d, key, "left")
    return signed.unionByName(open_, allowMissingColumns=True)


DEED = "uic string, companyName string, legalForm int, deedStatus int, sections array<struct<subDeeds: array<struct<groups: array<struct<fields: array<struct<fieldIdent: string, htmlData: string, fieldOperation: int, fieldEntryDate: string, fieldActionDate: string, recordMinActionDate: string>>>>>>>>"


def deeds(spark: SparkSession, path: str) -> DataFrame:
    """Landed register deeds with their file; a file that isn't a deed has its text in column corrupt, from the same read."""
    return spark.read.schema(f"{DEED}, corrupt string").option("columnNameOfCorruptRecord", "corrupt").json(path, multiLine=True).withColumn("file", F.col("_metadata.file_path"))


def deed_failures(deeds: DataFrame) -> DataFrame:
    """file and reason of what is no deed."""
    reason = F.when(F.col("corrupt").isNotNull(), "not JSON").when(F.col("uic").isNull(), "no company number")
    return deeds.select("file", reason.alias("reason")).where("reason IS NOT NULL")


def deed_fields(deeds: DataFrame) -> DataFrame:
    """eik, name, legal_form, ident, text, op and dates of the fields of deeds; of repeated idents the last in document order, with the earliest action of all its company's fields in first_action."""
    flat = F.flatten(F.flatten(F.transform("sections", lambda s: F.transform(s["subDeeds"], lambda d: F.flatten(F.transform(d["groups"], lambda g: g["fields"]))))))
    rows = deeds.where("uic IS NOT NULL").select(F.col("uic").alias("eik"), F.col("companyName").alias("name"), F.col("legalForm").alias("legal_form"), F.col("file"), F.posexplode(flat).alias("pos", "f")).where("f.fieldIdent IS NOT NULL")
    by = Window.partitionBy("eik")
    action = F.coalesce("f.recordMinActionDate", "f.fieldActionDate")
    last = F.row_number().over(Window.partitionBy("eik", "f.fieldIdent").orderBy(F.desc("file"), F.desc("pos")))
    kept = rows.repartition("eik").withColumn("first_action", F.min(F.when(action.try_cast("timestamp").isNotNull(), action)).over(by)).withColumn("__last", last).where("__last = 1")
    return kept.select("eik", "name", "legal_form", F.col("f.fieldIdent").alias("ident"), X.strip_html(F.col("f.htmlData")).alias("text"), F.col("f.fieldOperation").alias("op"), F.col("f.fieldEntryDate").alias("entry_date"), F.col("f.fieldActionDate").alias("action_date"), "first_action")


def html_links(spark: SparkSession, path: str) -> DataFrame:
    """file, pos, heading, href and text of all links; the heading is the last h4 before the link."""
    pages = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    parts = F.regexp_extract_all("value", F.lit(r"(?is)(<h4[^>]*>.*?</h4>|<a\s[^>]*>.*?</a>)"), F.lit(1))
    rows = pages.select("file", F.posexplode(parts).alias("pos", "tag"))
    heading = F.when(F.lower("tag").startswith("<h4"), X.strip_html(F.col("tag")))
    filled = fill_down(rows, ["file"], "pos", heading, "heading").where(F.lower("tag").startswith("<a"))
    return filled.select("file", "pos", "heading", F.regexp_extract("tag", r"(?i)href\s*=\s*[\"']([^\"']*)", 1).alias("href"), X.strip_html(F.col("tag")).alias("text"))


def incremental(rows: DataFrame, known: DataFrame, since: str, period: str = "period", url: str = "url") -> DataFrame:
    """Rows of recent periods, and any whose url isn't known yet."""
    return rows.where(F.col(period) >= since).unionByName(rows.where(F.coalesce(F.col(period) < since, F.lit(True))).join(known.select(url).distinct(), url, "left_anti").select(*rows.columns))


# Siblings of the cash forms, months by name, spreadsheets that are no ledgers, marks of monthly and quarterly ledgers.
SIBLINGS = ("DES", "DMP", "K33", "KSF", "RA")
MONTHS = ("януари", "февруари", "март", "април", "май", "юни", "юли", "август", "септември", "октомври", "ноември", "декември")
ENGLISH = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
SHORT = {"jan": 1, "feb": 2, "mar": 3, "apr": 4, "jun": 6, "jul": 7, "aug": 8, "sep": 9, "sept": 9, "oct": 10, "nov": 11, "dec": 12}
NO_LEDGER = ("budget_", "budget-", "naturi")
QUARTERLY = ("тримес", "3mese")
MONTHLY = ("месечен", "mesechen", "otchet", "ot4et")


def classify_filename(name: Column) -> Column:
    """struct<kind, year, month, quarter, confidence> of a report's file name.

    A cash form has its form, year and month (or quarter, whose last month counts) in its name, its siblings a suffix.
    A spreadsheet is a capital ledger, dated by a month's name or else by MMYY at the end, unless its name says
    that it is something else. Everything else is other.
    """
    low = F.lower(name)
    stem = F.when(low.contains("."), F.regexp_replace(low, r"\.[^.]*$", "")).otherwise(low)
    form = r"(?:^|_)i?b([13])_(\d{4})_(\d{1,2})_\d+"
    number = lambda k: F.regexp_extract(low, form, k).try_cast("int")
    suffix = F.upper(F.regexp_extract(stem, rf"_({'|'.join(SIBLINGS).lower()})$", 1))
    quarterly = number(1) == 3
    cash_kind = F.when(~low.startswith("ib"), F.concat(F.lit("B"), number(1).cast("string"))).when(suffix != "", F.concat(F.lit("IB"), number(1).cast("string"), F.lit("_"), suffix)).otherwise("other")
    cash_month = F.when(quarterly & number(3).between(1, 4), number(3) * 3).otherwise(number(3))
    none = F.lit(None).cast("int")
    made = lambda kind, year, month, sure, quarter=none: F.struct(kind.alias("kind"), year.cast("int").alias("year"), month.cast("int").alias("month"), quarter.cast("int").alias("quarter"), F.lit(sure).alias("confidence"))

    ledger = F.lit("capital_xlsx")
    year = F.regexp_extract(low, r"(20\d{2})", 1).try_cast("int")
    lookup = lambda names: F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    either = lambda names: "|".join(sorted(names, key=lambda m: (-len(m), m)))
    own = {m: k for k, m in enumerate(MONTHS, 1)}
    bulgarian = lookup(own)[F.regexp_extract(low, f"({either(own)})", 1)]
    names = {m: k for k, m in enumerate(ENGLISH, 1)} | SHORT
    word, tail = (F.regexp_extract(low, rf"({either(names)})[_\-]?(\d{{4}}|\d{{2}})(?!\d)", k) for k in (1, 2))
    english = lookup(names)[word]
    english_year = F.when(F.length(tail) == 4, tail.try_cast("int")).otherwise(2000 + tail.try_cast("int"))
    mm, yy = (F.regexp_extract(stem, r"(\d{2})(\d{2})$", k).try_cast("int") for k in (1, 2))
    other = low.rlike(r"^kp[\d._]")
    for prefix in NO_LEDGER:
        other = other | low.startswith(prefix)
    dated = (
        F.when(bulgarian.isNotNull() & year.isNotNull(), made(ledger, year, bulgarian, "high"))
        .when(english.isNotNull(), made(ledger, english_year, english, "medium"))
        .when(mm.between(1, 12), made(ledger, 2000 + yy, mm, "low"))
        .otherwise(made(ledger, none, none, "none"))
    )
    cash = made(cash_kind, number(2), cash_month, "high", F.when(quarterly, number(3)))
    return F.when(low.rlike(form), cash).when(low.endswith(".xlsx") & ~other, dated).otherwise(made(F.lit("other"), none, none, "none"))


def report_family(kind: Column) -> Column:
    """cash or capital; null for reports that aren't read."""
    return F.when(kind.isin("B1", "B3"), "cash").when(kind == "capital_xlsx", "capital")


def currency_of(marker: Column, period: Column) -> Column:
    """EUR or BGN by a marker text, else by the period: leva until the end of 2025, and where there is no period."""
    low = F.lower(marker)
    return F.when(low.rlike("евро|eur|€"), "EUR").when(low.rlike("лев|лв|bgn"), "BGN").when(period >= "2026-01", "EUR").otherwise("BGN")


CELLS = "file string, sheet string, row int, col int, value string"


def ledger_from_cells(cells: DataFrame, columns: dict[str, int]) -> DataFrame:
    """Ledger rows of cell grids (CELLS): code and name columns, headers filled down, amounts parsed.

    columns maps code, name and the amount fields to column numbers. A four-digit code with two trailing
    zeros starts a paragraph, another four-digit code a subparagraph, 'Функция' a function; other named rows are objects.
    """
    wide = cells.groupBy("file", "sheet", "row").agg(*[F.max(F.when(F.col("col") == k, F.trim("value"))).alias(n) for n, k in columns.items()])
    code = F.regexp_replace(F.coalesce("code", F.lit("")), r"\s+", "")
    is_function = F.coalesce(F.lower("name").startswith("функция"), F.lit(False))
    row_type = F.when(is_function, "function").when(code.rlike(r"^\d{2}00$"), "paragraph").when(code.rlike(r"^\d{4}$"), "subparagraph").when(F.col("name").isNotNull(), "object")
    typed = wide.withColumn("row_type", row_type)
    at = ["file", "sheet"]
    f = fill_down(typed, at, "row", F.when(F.col("row_type") == "function", F.regexp_extract("name", r"(\d+)", 1)), "function_code")
    p = fill_down(f, at, "row", F.when(F.col("row_type") == "paragraph", code).when(F.col("row_type") == "function", F.lit("")), "paragraph")
    s = fill_down(p, at, "row", F.when(F.col("row_type") == "subparagraph", code).when(F.col("row_type").isin("paragraph", "function"), F.lit("")), "subparagraph")
    blank = lambda c: F.when(F.col(c) != "", F.col(c)).alias(c)
    amounts = [X.parse_number(F.col(c)).cast("decimal(18,2)").alias(c) for c in columns if c not in ("code", "name")]
    return s.select("file", "sheet", "row", "row_type", "function_code", blank("paragraph"), blank("subparagraph"), F.col("name").alias("object_name"), *amounts)


def best_reports(reports: DataFrame) -> DataFrame:
    """The report to read of each family and period, from reports (id, period, kind, file_path, mtime).

    Of cash reports the quarterly form comes first; of ledgers those named as monthly, then unmarked ones, then quarterly
    ones. Then an original before a copy '... (1)', the newest file, and the largest id. Without a period every report
    stays; other kinds go.
    """
    name = F.lower(F.coalesce(X.basename(F.col("file_path")), F.lit("")))
    has = lambda words: F.coalesce(*(F.when(name.contains(w), F.lit(True)) for w in words), F.lit(False))
    ledger = F.when(has(QUARTERLY), 2).when(has(MONTHLY), 0).otherwise(1)
    first = F.when(F.col("kind") == "B3", 0).when(F.col("kind") == "B1", 1).otherwise(ledger)
    copy = F.regexp_replace(name, r"\.[^.]*$", "").rlike(r"\(\d+\)\s*$")
    family = report_family(F.col("kind"))
    key = F.coalesce("period", F.concat(F.lit("id:"), F.col("id").cast("string")))
    rank = F.row_number().over(Window.partitionBy("__family", key).orderBy(first, copy, F.desc(F.coalesce("mtime", F.lit(0.0))), F.desc("id")))
    return reports.withColumn("__family", family).where("__family IS NOT NULL").withColumn("__rank", rank).where("__rank = 1").drop("__rank", "__family")
