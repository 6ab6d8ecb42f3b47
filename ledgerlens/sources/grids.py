"""Reports landed as cell grids (file, sheet, row, col, value; rows and columns from 0; dates as ISO texts)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import PEG
from ..functions import text as X
from ..functions.display import MONTHS
from ..operators.periods import fill_down, subtotal_mismatches
from .readers import currency_of

# The cash report's sheet, its header's labels, its columns and its sections in order.
CASH_SHEET, HEADER, TOTAL = "OTCHET", ("§§", "под-§§"), "ВСИЧКО"
CASH_COLUMNS = {"plan_total": 4, "plan_state": 5, "plan_local": 6, "plan_cofinance": 7, "actual_state": 8, "actual_local": 9, "actual_cofinance": 10, "actual_total": 11}
SECTIONS = ("приходи", "разходи")
HEAD_ROWS = 25
PERIOD_LABEL = "за периода"


def code(value: Column) -> Column:
    """A code cell as text: '100.0' is '100'; blanks are null."""
    bare = F.regexp_replace(F.trim(value), r"^(\d+)\.0+$", "$1")
    return F.when(bare != "", bare)


def iso_month(value: Column) -> Column:
    return F.when(value.rlike(r"^\d{4}-\d{2}-\d{2}"), F.substring(value, 1, 7))


def cash_period(cells: DataFrame) -> DataFrame:
    """(file, period): the month of the date within two rows below 'до', else the latest date of the first head row that has one."""
    head = cells.where((F.col("sheet") == CASH_SHEET) & (F.col("row") < HEAD_ROWS))
    dates = head.select("file", "row", "col", iso_month(F.col("value")).alias("month"), "value").where("month IS NOT NULL")
    label = head.where(F.lower(F.trim("value")) == "до").select("file", F.col("row").alias("at"), "col")
    below = dates.join(label, ["file", "col"]).where(F.col("row").between(F.col("at") + 1, F.col("at") + 2))
    first = below.groupBy("file").agg(F.min_by("month", F.struct("at", "col", "row")).alias("below"))
    rows = dates.groupBy("file", "row").agg(F.max_by("month", "value").alias("month")).groupBy("file").agg(F.min_by("month", "row").alias("latest"))
    return rows.join(first, "file", "left").select("file", F.coalesce("below", "latest").alias("period"))


def cash_currency(cells: DataFrame, periods: DataFrame) -> DataFrame:
    """(file, currency): by the first head cell that names one, else by the period."""
    low = F.lower("value")
    names = F.when(low.rlike(r"(?<!\p{L})eur(?!\p{L})|евро"), "евро").when(low.rlike(r"(?<!\p{L})лв(?!\p{L})|(?<!\p{L})лев"), "лева")
    head = cells.where((F.col("sheet") == CASH_SHEET) & (F.col("row") < HEAD_ROWS)).withColumn("marker", names).where("marker IS NOT NULL")
    marked = head.groupBy("file").agg(F.min_by("marker", F.struct("row", "col")).alias("marker"))
    files = cells.select("file").distinct().join(periods, "file", "left").join(marked, "file", "left")
    return files.select("file", currency_of(F.coalesce("marker", F.lit("")), F.col("period")).alias("currency"))


def cash_lines(cells: DataFrame) -> DataFrame:
    """file, period, section, paragraph, name, row_type, parent_paragraph, amounts in euro and source_row of cash reports.

    The first two tables are income and spending, each from two rows below its header to its total. A code in
    the first column is a paragraph, one in the second a subparagraph of the paragraph above it.
    """
    sheet = cells.where(F.col("sheet") == CASH_SHEET)
    at = {"major": 1, "sub": 2, "third": 3} | CASH_COLUMNS
    wide = sheet.groupBy("file", "row").agg(*[F.max(F.when(F.col("col") == k, F.trim("value"))).alias(n) for n, k in at.items()])
    w = Window.partitionBy("file").orderBy("row")
    is_header = F.coalesce((F.col("major") == HEADER[0]) & (F.col("sub") == HEADER[1]), F.lit(False))
    blocks = wide.withColumn("header", is_header).withColumn("block", F.sum(F.col("header").cast("int")).over(w)).where(F.col("block").between(1, len(SECTIONS)))
    b = Window.partitionBy("file", "block").orderBy("row")
    is_total = F.coalesce(F.upper("major") == TOTAL, F.lit(False))
    placed = blocks.withColumn("first", F.min("row").over(Window.partitionBy("file", "block"))).withColumn("total", is_total)
    inside = placed.withColumn("past", F.coalesce(F.sum(F.col("total").cast("int")).over(b.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).where("past = 0 AND row >= first + 2")
    major, sub = F.when(~F.col("total"), code(F.col("major"))), code(F.col("sub"))
    kind = F.when(F.col("total"), "section_total").when(major.isNotNull(), "paragraph").when(sub.isNotNull(), "subparagraph")
    typed = inside.withColumn("row_type", kind).where("row_type IS NOT NULL").withColumn("code1", major).withColumn("code2", sub)
    parent = fill_down(typed, ["file", "block"], "row", F.col("code1"), "parent")
    periods = cash_period(cells)
    known = parent.join(periods, "file", "left").join(cash_currency(cells, periods), "file", "left")
    amount = lambda c: F.round(F.when(F.col("currency") == "EUR", X.parse_number(F.col(c))).otherwise(X.parse_number(F.col(c)) / F.lit(PEG)), 2).cast("decimal(18,2)").alias(c)
    is_major = F.col("row_type") == "paragraph"
    return known.select(
        "file",
        "period",
        F.get(F.array(*map(F.lit, SECTIONS)), F.col("block").cast("int") - 1).alias("section"),
        F.when(is_major, F.col("code1")).when(F.col("total"), F.coalesce("code2", F.lit(TOTAL))).otherwise(F.col("code2")).alias("paragraph"),
        F.when(is_major, F.col("sub")).otherwise(F.col("third")).alias("name"),
        "row_type",
        F.when(F.col("row_type") == "subparagraph", F.col("parent")).alias("parent_paragraph"),
        *map(amount, CASH_COLUMNS),
        (F.col("row") + 1).alias("source_row"),
    )


def period_in_words(value: Column) -> Column:
    """'… 2022 юни' or 'юни 2022' as 2022-06; null where a text holds neither."""
    low = F.lower(F.regexp_replace(value, r"\s+", " "))
    names = "|".join(MONTHS)
    year = F.coalesce(*[F.when(x != "", x) for x in (F.regexp_extract(low, rf"(\d{{4}}) ?г?\.? ?(?:{names})", 1), F.regexp_extract(low, rf"(?:{names}) (\d{{4}})", 1))])
    month = F.array_position(F.array(*map(F.lit, MONTHS)), F.regexp_extract(low, rf"({names})", 1))
    return F.when(year.between("1990", "2100") & (month > 0), F.concat(year, F.lit("-"), F.lpad(month.cast("string"), 2, "0")))


def ledger_period(cells: DataFrame, primary: str = "Общо", rows: int = 10) -> DataFrame:
    """(file, period) of capital ledgers: the period in or right of the first 'за периода' cell, else the latest date right of it, else any head cell's period; the primary sheet first."""
    head = cells.where(F.col("row") < rows).withColumn("words", period_in_words(F.col("value"))).withColumn("month", iso_month(F.col("value")))
    label = head.where(F.lower("value").contains(PERIOD_LABEL)).select("file", "sheet", "row", F.col("col").alias("at"))
    right = head.join(label, ["file", "sheet", "row"]).where("col >= at")
    named = right.groupBy("file", "sheet").agg(F.min_by("words", F.when(F.col("words").isNotNull(), F.struct("row", "at", "col"))).alias("a"), F.max(F.when(F.col("col") > F.col("at"), F.col("month"))).alias("b"))
    loose = head.where("words IS NOT NULL").groupBy("file", "sheet").agg(F.min_by("words", F.struct("row", "col")).alias("c"))
    found = named.join(loose, ["file", "sheet"], "full_outer").select("file", "sheet", F.coalesce("a", "b", "c").alias("period")).where("period IS NOT NULL")
    return found.groupBy("file").agg(F.min_by("period", F.struct(F.col("sheet") != primary, "sheet")).alias("period"))


def located_columns(cells: DataFrame, labels: dict[str, str]) -> DataFrame:
    """(file, sheet, header_row, field, col): where each field's label (a pattern on the lower-case header text) first stands.

    The header row is the first one that holds the first field's label.
    """
    text = cells.withColumn("t", F.lower(F.trim(F.regexp_replace("value", r"\s+", " "))))
    first = next(iter(labels.values()))
    header = text.where(F.col("t").rlike(first)).groupBy("file", "sheet").agg(F.min("row").alias("header_row"))
    fields = F.array_compact(F.array(*[F.when(F.col("t").rlike(p), F.lit(n)) for n, p in labels.items()]))
    at = text.join(header, ["file", "sheet"]).where("row = header_row").select("file", "sheet", "header_row", "col", F.explode(fields).alias("field"))
    return at.groupBy("file", "sheet", "header_row", "field").agg(F.min("col").alias("col"))


def indicators(cells: DataFrame, wanted: Sequence[str], own_code: int) -> DataFrame:
    """title, label, own, median, n of the wanted indicators: head groups run right from their title, the last column of a group is the latest quarter."""
    titles = cells.where((F.col("row") == 0) & (F.col("col") >= 2) & (F.trim("value") != "")).select("file", F.col("col").alias("start"), F.col("value").alias("title"))
    ends = titles.withColumn("next", F.lead("start").over(Window.partitionBy("file").orderBy("start")))
    widest = cells.groupBy("file").agg(F.max("col").alias("widest"))
    latest = ends.join(widest, "file").select("file", "title", F.coalesce(F.col("next") - 1, "widest").alias("col"), "start")
    chosen = [latest.where(F.col("title").startswith(w)).groupBy("file").agg(F.min_by(F.struct("title", "col"), "start").alias("g")).select("file", "g.*", F.lit(k).alias("ord")) for k, w in enumerate(wanted)]
    groups = chosen[0]
    for g in chosen[1:]:
        groups = groups.unionByName(g)
    label = cells.where("row = 1").select("file", "col", F.col("value").alias("label"))
    codes = cells.where("row >= 2 AND col = 0").select("file", "row", F.col("value").try_cast("double").cast("int").alias("code")).where("code IS NOT NULL")
    values = cells.where("row >= 2").select("file", "row", "col", F.col("value").try_cast("double").alias("v")).where("v IS NOT NULL").join(codes, ["file", "row"])
    joined = groups.join(values, ["file", "col"])
    out = joined.groupBy("file", "title", "col", "ord").agg(F.max(F.when(F.col("code") == own_code, F.col("v"))).alias("own"), F.median("v").alias("median"), F.count(F.lit(1)).alias("n"))
    return out.where("own IS NOT NULL").join(label, ["file", "col"], "left").select("file", "ord", "title", "label", "own", "median", "n")


def pins(spark: SparkSession, path: str) -> DataFrame:
    """Exact places given by hand; rows without coordinates that are numbers are left out."""
    raw = spark.read.option("header", True).csv(path)
    blank = lambda c: F.when(F.trim(c) != "", F.trim(c)).alias(c)
    names = ("period", "cadastral_id", "verified_by", "source_note", "verified_at")
    out = raw.select(F.coalesce(F.trim("object_name"), F.lit("")).alias("object_name"), F.trim("lat").try_cast("double").alias("lat"), F.trim("lon").try_cast("double").alias("lon"), *map(blank, names))
    return out.where("lat IS NOT NULL AND lon IS NOT NULL")


# capital ledgers with funding groups

# The ledger's header labels, its total, cosmetic group rows, and the places of the funding groups' columns right of the last amount.
LEDGER_LABELS = {"estimated_total": "сметна стойност", "spent_prior": "усвоено до", "plan_current": "уточнен план", "spent_period": "усвоено към", "name": "информация за наименованието", "years": "година начало", "code": "^§$"}
GRAND_TOTAL, FUNCTION = "ОБЩО", "функция"
GROUP_ROWS = ("Обект", "ППР", "ППР за сграда", "инженеринг", "сграда чрез изграждане")
FUNDING = {
    "targeted_subsidies": ("note", "plan", "plan_subset", "actual", "actual_subset"),
    "carryover_targeted_subsidies": ("note", "plan", "actual"),
    "own_funds": ("plan", "actual"),
    "other_sources": ("note", "plan", "actual"),
    "eu_funds": ("note", "plan", "actual"),
}
LEDGER_HEAD, TOTAL_WITHIN = 15, 20
AMOUNTS = ("estimated_total", "spent_prior", "plan_current", "spent_period")
DEFAULT_COLUMNS = {"code": 0, "name": 1, "years": 2}


def ledger_columns(cells: DataFrame) -> DataFrame:
    """(file, sheet, header_row, at): at is a struct of the column of each ledger field, by its label; amounts without a label follow the first one, the rest stand at the left edge."""
    located = located_columns(cells.where(F.col("row") < LEDGER_HEAD), LEDGER_LABELS)
    of = lambda f: F.max(F.when(F.col("field") == f, F.col("col"))).alias(f)
    wide = located.groupBy("file", "sheet", "header_row").agg(*map(of, LEDGER_LABELS))
    first = F.col("estimated_total")
    beyond = lambda f, k: F.when(F.col(f) > first, F.col(f)).otherwise(first + k).alias(f)
    rest = [F.coalesce(f, F.lit(k)).alias(f) for f, k in DEFAULT_COLUMNS.items()]
    return wide.select("file", "sheet", "header_row", F.struct(first, *(beyond(f, k) for k, f in enumerate(AMOUNTS[1:], 1)), *rest).alias("at"))


def funding_columns(cells: DataFrame, columns: DataFrame) -> DataFrame:
    """(file, sheet, col, group, field) of the funding groups: a span join of columns to the group headers above them.

    Where the header row names all groups right of the last amount, each name spans the columns up to the next one, and
    the labels below tell plan, actual ('в т.ч.' as a part of the one before) and notes. Else the groups
    stand at their fixed places.
    """
    after = columns.select("file", "sheet", "header_row", F.col("at.spent_period").alias("last"))
    near = cells.where(F.trim("value") != "").join(after, ["file", "sheet"]).where(F.col("col") > F.col("last"))
    w = Window.partitionBy("file", "sheet").orderBy("col")
    heads = near.where(F.col("row") == F.col("header_row")).select("file", "sheet", "header_row", F.col("col").alias("start"), F.coalesce(F.lead("col").over(w), F.lit(1 << 30)).alias("stop"), F.row_number().over(w).alias("k"))
    named = heads.withColumn("n", F.max("k").over(Window.partitionBy("file", "sheet"))).where(F.col("n") == len(FUNDING))
    below = near.where(F.col("row") == F.col("header_row") + 1).select("file", "sheet", "col", F.lower(F.trim("value")).alias("label"))
    spans = below.join(named, ["file", "sheet"]).where((F.col("col") >= F.col("start")) & (F.col("col") < F.col("stop")))
    part = F.col("label").contains("в т.ч")
    whole = F.when(~part & F.col("label").contains("план"), "plan").when(~part & F.col("label").rlike("отчет|усвоено|изпълнение"), "actual").when(~part, "note")
    filled = fill_down(spans.withColumn("whole", whole), ["file", "sheet", "k"], "col", F.when(F.col("whole").isin("plan", "actual"), F.col("whole")), "over")
    keys = F.array(*map(F.lit, FUNDING))
    labelled = filled.select("file", "sheet", "col", F.get(keys, F.col("k") - 1).alias("group"), F.when(part, F.concat("over", F.lit("_subset"))).otherwise(F.col("whole")).alias("field"))
    places = [(g, f) for g, fields in FUNDING.items() for f in fields]
    fixed = F.posexplode(F.array(*[F.struct(F.lit(g).alias("group"), F.lit(f).alias("field")) for g, f in places])).alias("k", "p")
    unnamed = after.join(named.select("file", "sheet").distinct(), ["file", "sheet"], "left_anti").select("file", "sheet", "last", fixed)
    return labelled.where("field IS NOT NULL").unionByName(unnamed.select("file", "sheet", (F.col("last") + 1 + F.col("k")).alias("col"), "p.group", "p.field"))


def ledger_currency(cells: DataFrame, periods: DataFrame) -> DataFrame:
    """(file, sheet, currency): by the first cell of the head that names one, else by the file's period."""
    low = F.lower("value")
    names = F.when(low.rlike(r"(?<!\p{L})eur(?!\p{L})|евро"), "евро").when(low.rlike(r"(?<!\p{L})лв(?!\p{L})|(?<!\p{L})лев"), "лева")
    head = cells.where("row < 8 AND col < 6").withColumn("marker", names).where("marker IS NOT NULL")
    marked = head.groupBy("file", "sheet").agg(F.min_by("marker", F.struct("row", "col")).alias("marker"))
    sheets = cells.select("file", "sheet").distinct().join(periods, "file", "left").join(marked, ["file", "sheet"], "left")
    return sheets.select("file", "sheet", "period", currency_of(F.coalesce("marker", F.lit("")), F.col("period")).alias("currency"))


def capital_ledger(cells: DataFrame) -> DataFrame:
    """Rows of capital ledgers: file, period, unit (the sheet), row_type, function_code, paragraph, subparagraph, object_code, object_name, years, amounts in euro, group_label, funding, currency, source_sheet and source_row.

    Columns are found by their labels, so shifted ones do. Rows count from the grand total, which stands close below the
    header. A code of two trailing zeros starts a paragraph, 'Функция NN' a function, a code of the paragraph's first two
    digits a subparagraph; other four-digit codes are objects, with their funding by group. A row without a code that
    names a kind of object labels the objects below it; other rows hold nothing.
    """
    columns = ledger_columns(cells)
    placed = cells.where(F.trim("value") != "").join(columns, ["file", "sheet"]).where(F.col("row") > F.col("header_row"))
    names = ("code", "name", "years", *AMOUNTS)
    wide = placed.groupBy("file", "sheet", "row").agg(F.first("header_row").alias("header_row"), *[F.max(F.when(F.col("col") == F.col(f"at.{n}"), F.trim("value"))).alias(n) for n in names])
    own = code(F.col("code"))
    total = own.isNull() & (F.col("name") == GRAND_TOTAL)
    start = wide.where(total & (F.col("row") <= F.col("header_row") + TOTAL_WITHIN)).groupBy("file", "sheet").agg(F.min("row").alias("start"))
    rows = wide.join(start, ["file", "sheet"]).where(F.col("row") >= F.col("start"))
    four = own.rlike(r"^\d{4}$")
    is_function = F.lower(own).startswith(FUNCTION)
    kind = F.when(total, "grand_total").when(is_function, "function_subtotal").when(four & own.endswith("00"), "paragraph_subtotal").when(own.isNull() & F.col("name").isin(*GROUP_ROWS), "group").when(four, "coded")
    typed = rows.withColumn("kind", kind).where("kind IS NOT NULL").withColumn("own", own)
    at, k = ["file", "sheet"], F.col("kind")
    starts = lambda *kinds: k.isin(*kinds)
    p = fill_down(typed, at, "row", F.when(starts("paragraph_subtotal"), F.col("own")), "paragraph")
    sub = (F.col("kind") == "coded") & (F.left("own", F.lit(2)) == F.left("paragraph", F.lit(2)))
    p = p.withColumn("kind", F.when(sub, "subparagraph_subtotal").when(starts("coded"), "object").otherwise(k))
    f = fill_down(p, at, "row", F.when(starts("function_subtotal"), F.regexp_extract("own", r"(\d+)", 1)).when(starts("paragraph_subtotal"), F.lit("")), "function_code")
    s = fill_down(f, at, "row", F.when(starts("subparagraph_subtotal"), F.col("own")).when(starts("paragraph_subtotal", "function_subtotal"), F.lit("")), "subparagraph")
    g = fill_down(s, at, "row", F.when(starts("group"), F.col("name")).when(starts("paragraph_subtotal", "function_subtotal", "subparagraph_subtotal"), F.lit("")), "group_label")
    known = g.where("kind <> 'group'").join(ledger_currency(cells, ledger_period(cells)), at, "left")
    amount = lambda c: F.round(F.when(F.col("currency") == "EUR", X.parse_number(c)).otherwise(X.parse_number(c) / F.lit(PEG)), 2).cast("decimal(18,2)")

    parts = cells.where(F.trim("value") != "").join(funding_columns(cells, columns), ["file", "sheet", "col"])
    of = lambda name: F.max(F.when(F.col("field") == name, F.trim("value"))).alias(name)
    groups = parts.groupBy("file", "sheet", "row", "group").agg(*map(of, ("note", "plan", "plan_subset", "actual", "actual_subset")))
    listed = groups.groupBy("file", "sheet", "row").agg(F.sort_array(F.collect_list(F.struct("group", "note", "plan", "plan_subset", "actual", "actual_subset"))).alias("parts"))  # at most five
    full = known.join(listed, ["file", "sheet", "row"], "left")
    blank = lambda c: F.when(F.col(c) != "", F.col(c)).alias(c)
    is_object = F.col("kind") == "object"
    funding = F.transform("parts", lambda x: F.struct(x["group"].alias("group"), x["note"].alias("note"), *(amount(x[c]).alias(c) for c in ("plan", "plan_subset", "actual", "actual_subset"))))
    inside = F.col("kind") != "grand_total"
    return full.select(
        "file", "period", F.col("sheet").alias("unit"), F.col("kind").alias("row_type"),
        F.when(inside & (F.col("function_code") != ""), F.col("function_code")).alias("function_code"),
        F.when(inside, F.col("paragraph")).alias("paragraph"), blank("subparagraph"),
        F.when(is_object, F.col("own")).when(~inside, F.lit(GRAND_TOTAL)).alias("object_code"), F.col("name").alias("object_name"), "years",
        *(amount(F.col(c)).alias(c) for c in AMOUNTS), F.when(is_object & (F.col("group_label") != ""), F.col("group_label")).alias("group_label"),
        F.when(is_object, funding).alias("funding"), "currency", F.col("sheet").alias("source_sheet"), (F.col("row") + 1).alias("source_row"),
    )


def unread_sheets(cells: DataFrame) -> DataFrame:
    """(file, sheet, reason) of sheets that are no ledger: no labelled header, or no grand total below it."""
    columns = ledger_columns(cells).select("file", "sheet", F.lit(True).alias("has_header"))
    read = capital_ledger(cells).select("file", F.col("unit").alias("sheet"), F.lit(True).alias("has_rows")).distinct()
    every = cells.select("file", "sheet").distinct().join(columns, ["file", "sheet"], "left").join(read, ["file", "sheet"], "left")
    return every.where("has_rows IS NULL").select("file", "sheet", F.when(F.col("has_header"), "no grand total").otherwise("no header").alias("reason"))


def function_mismatches(ledger: DataFrame, tolerance: float = 1.0) -> DataFrame:
    """Function subtotals of a capital_ledger whose estimate differs from the sum of their objects by more than tolerance."""
    keys = ["file", "unit", "paragraph", "function_code"]
    rows = ledger.select(*(F.coalesce(c, F.lit("")).alias(c) for c in keys), "row_type", F.coalesce("estimated_total", F.lit(0)).cast("double").alias("estimated_total"))
    subtotals = rows.where("row_type = 'function_subtotal'").select(*keys, F.col("estimated_total").alias("subtotal"))
    details = rows.where("row_type = 'object'").select(*keys, "estimated_total").unionByName(subtotals.select(*keys, F.lit(0.0).alias("estimated_total")))  # a subtotal without objects sums to zero
    return subtotal_mismatches(details, subtotals, keys, "estimated_total", "subtotal", tolerance)
