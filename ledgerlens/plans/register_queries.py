"""Register operators on generic tables: name resolution, preference among reports, sections of texts."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from ..functions import registry as G
from ..functions import sections
from ..sources import markup, paged
from ..sources import readers as R
from ..storage import materialize, new_path, remove_path
from .base import Tables, query


def name_resolution(t: Tables):
    """Parts as people: short names of a first and a last word, or more, against the full names."""
    group = F.floor(F.col("p_partkey") / 7).cast("string")
    named = t.part.select("p_partkey", F.concat_ws(" ", "p_name", "p_brand", group).alias("full_name"), F.split("p_name", " ")[0].alias("first"), "p_brand", group.alias("group"))
    short = F.when(F.col("p_partkey") % 3 == 0, F.concat_ws("  ", F.upper("first"), "group")).when(F.col("p_partkey") % 3 == 1, F.concat_ws("-", "first", "p_brand", "group")).otherwise(F.col("first"))
    return G.resolve_names(named.select(short.alias("short_name")), named.select("full_name"))


_KEY = r"string_split(trim(regexp_replace(lower({c}), '[^\p{L}\p{N}]+', ' ', 'g')), ' ')"
NAMES = rf"""WITH p AS (SELECT p_partkey AS k, p_name || ' ' || p_brand || ' ' || p_partkey // 7 AS full_name, split_part(p_name, ' ', 1) AS first, p_brand AS b, p_partkey // 7 AS g FROM part),
s AS (SELECT DISTINCT CASE k % 3 WHEN 0 THEN upper(first) || '  ' || g WHEN 1 THEN first || '-' || b || '-' || g ELSE first END AS short_name FROM p),
sw AS (SELECT short_name, {_KEY.replace("{c}", "short_name")} AS w FROM s), rw AS (SELECT DISTINCT full_name, {_KEY.replace("{c}", "full_name")} AS w FROM p),
m AS (SELECT short_name, full_name FROM sw LEFT JOIN rw ON len(sw.w) > 1 AND rw.w[1] = sw.w[1] AND len(rw.w) >= len(sw.w) AND rw.w[len(rw.w) - len(sw.w) + 2:] = sw.w[2:])
SELECT short_name, CASE WHEN count(full_name) = 1 THEN min(full_name) END AS full_name FROM m GROUP BY 1"""


def report_preference(t: Tables):
    """Orders as reports: the one to read of each family and month."""
    k = F.col("o_orderkey")
    of = lambda *values: F.element_at(F.array(*map(F.lit, values)), (k % len(values) + 1).cast("int"))
    rows = t.orders.select(
        k.alias("id"),
        F.when(k % 50 != 0, F.date_format("o_orderdate", "yyyy-MM")).alias("period"),
        of("B1", "B3", "capital_xlsx", "capital_xlsx", "IB1_DES", "B1").alias("kind"),
        F.concat(F.lit("/reports/"), of("Месечен%20отчет", "Тримесечен отчет", "42022", "m-otchet", "3mesechen-mart"), of("", "(1)", " (2)"), F.lit(".xlsx")).alias("file_path"),
        F.when(k % 11 != 0, F.col("o_totalprice")).alias("mtime"),
    )
    return R.best_reports(rows).select("id", "period", "kind")


PREFERENCE = """WITH r AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 50 <> 0 THEN strftime(o_orderdate, '%Y-%m') END AS period, list_extract(['B1', 'B3', 'capital_xlsx', 'capital_xlsx', 'IB1_DES', 'B1'], o_orderkey % 6 + 1) AS kind,
  list_extract([0, 2, 1, 0, 2], o_orderkey % 5 + 1) AS ledger, o_orderkey % 3 > 0 AS copy, CASE WHEN o_orderkey % 11 <> 0 THEN o_totalprice ELSE 0 END AS mtime FROM orders),
f AS (SELECT *, CASE WHEN kind IN ('B1', 'B3') THEN 'cash' ELSE 'capital' END AS family, CASE kind WHEN 'B3' THEN 0 WHEN 'B1' THEN 1 ELSE ledger END AS first FROM r WHERE kind <> 'IB1_DES')
SELECT id, period, kind FROM f QUALIFY row_number() OVER (PARTITION BY family, coalesce(period, 'id:' || id) ORDER BY first, copy, mtime DESC, id DESC) = 1"""


def section_entries(t: Tables):
    """Lines of all documents in sections that other lines open and close."""

    def heading(line: Column) -> Column:
        first = F.lower(F.left(line, F.lit(1)))
        return F.when(first.between("a", "e"), "early").when(first.between("f", "l"), "middle").when(first == "t", "")

    def extract(section: Column, line: Column) -> Column:
        return F.when(section == "early", F.length(line).cast("string")).when(line.contains(","), F.split(line, ",")[0])

    found = sections.entries(F.col("text"), heading, extract, "string")
    return t.documents.select("doc_id", F.explode(found).alias("e")).select("doc_id", "e.pos", "e.section", "e.entry")


_TRIM = "trim({c}, chr(32) || chr(9) || chr(11) || chr(12))"
SECTIONS = rf"""WITH s AS (SELECT doc_id, row_number() OVER () AS r, string_split_regex(coalesce(text, ''), '\r\n|\r|\n') AS ls FROM documents),
l AS (SELECT doc_id, r, unnest(ls) AS x, generate_subscripts(ls, 1) - 1 AS pos FROM s), c AS (SELECT doc_id, r, pos, {_TRIM.replace("{c}", "x")} AS line FROM l),
h AS (SELECT *, CASE WHEN lower(left(line, 1)) BETWEEN 'a' AND 'e' THEN 'early' WHEN lower(left(line, 1)) BETWEEN 'f' AND 'l' THEN 'middle' WHEN lower(left(line, 1)) = 't' THEN '' END AS mark FROM c),
w AS (SELECT *, last_value(mark IGNORE NULLS) OVER (PARTITION BY r ORDER BY pos) AS section FROM h)
SELECT doc_id, CAST(pos AS INTEGER) AS pos, section, CASE WHEN section = 'early' THEN CAST(length(line) AS VARCHAR) ELSE split_part(line, ',', 1) END AS entry
FROM w WHERE mark IS NULL AND section <> '' AND line <> '' AND (section = 'early' OR contains(line, ','))"""

def page_blocks(t: Tables):
    """Every page's text blocks with the headings above them."""
    return markup.page_blocks(t.pages.select("page_id", "html")).select("page_id", "position", F.md5("path").alias("path_md5"), F.md5("text").alias("text_md5"))


def _blocks_sql() -> str:
    from .text_queries import _ENTITIES

    names = "|".join(markup.BLOCKS)
    clean = f"trim(regexp_replace({_ENTITIES}, '[ \\t\\n\\r]+', ' ', 'g'), ' ')"
    levels = range(1, 7)
    last = ", ".join(f"max(CASE WHEN level = {k} THEN pos END) OVER w AS p{k}, last_value(CASE WHEN level = {k} THEN t END IGNORE NULLS) OVER w AS h{k}" for k in levels)
    alive = ", ".join(f"CASE WHEN p{k} IS NOT NULL {''.join(f'AND p{k} > coalesce(p{j}, -1) ' for j in range(1, k))}THEN h{k} END" for k in levels)
    return rf"""WITH k AS (SELECT page_id, regexp_extract_all(html || '<p>', '(?is)<!--.*?-->|<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|<[a-zA-Z/!?][^>]*>|[^<]+|<') AS l FROM pages WHERE html IS NOT NULL),
t AS (SELECT page_id, unnest(l) AS token, generate_subscripts(l, 1) AS i FROM k),
b AS (SELECT *, regexp_matches(token, '(?i)^</?({names})([^a-zA-Z0-9]|$)') AS is_block, NOT regexp_matches(token, '^<(?s).') AS is_text FROM t),
r AS (SELECT *, count(*) FILTER (is_block) OVER (PARTITION BY page_id ORDER BY i) AS run FROM b),
g AS (SELECT page_id, run, coalesce(string_agg(token, '' ORDER BY i) FILTER (is_text), '') AS t, max(CASE WHEN is_block THEN CAST(nullif(regexp_extract(token, '(?i)^<h([1-6])([^a-zA-Z0-9]|$)', 1), '') AS INTEGER) END) AS level FROM r GROUP BY 1, 2),
c AS (SELECT page_id, run, level, {clean} AS t FROM g), n AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY run) - 1 AS pos FROM c WHERE t <> ''),
s AS (SELECT page_id, pos, level, t, {last} FROM n WINDOW w AS (PARTITION BY page_id ORDER BY pos))
SELECT page_id, CAST(pos AS INTEGER) AS position, md5(concat_ws(' > ', {alive})) AS path_md5, md5(t) AS text_md5 FROM s WHERE level IS NULL"""


BLOCKS = _blocks_sql()

PAGE = 500


def land_pages(t: Tables, path: str) -> None:
    """events as the pages of sixteen registers, which end in four ways: they say so, give a count, stop short, or with an empty page."""
    r = F.pmod("user_id", F.lit(16))
    place = F.row_number().over(Window.partitionBy("resource").orderBy("event_id")) - 1
    rows = t.events.select(r.cast("string").alias("resource"), "event_id", F.to_json(F.struct("event_id", "user_id", "event_type", "value")).alias("item"))
    pages = rows.withColumn("p", F.floor(place / PAGE)).groupBy("resource", "p").agg(F.array_join(F.array_sort(F.collect_list("item")), ",").alias("items"), F.count(F.lit(1)).alias("n"))  # at most PAGE rows
    sizes = pages.groupBy("resource").agg(F.max("p").alias("last"), F.sum("n").alias("total"))
    kind = F.col("resource").cast("int") % 4
    beyond = sizes.where(kind.isin(2, 3)).select("resource", (F.col("last") + 1).alias("p"), F.lit("").alias("items"), F.lit(0).cast("long").alias("n"))
    more = F.when(kind == 0, (F.col("p") < F.col("last")).cast("string")).when(kind == 3, "true").otherwise("null")
    text = F.concat(F.lit('{"CurrentPageResults":['), "items", F.lit('],"HasMoreResults":'), more, F.when(kind == 1, F.concat(F.lit(',"ResultsCount":'), F.col("total").cast("string"))).otherwise(""), F.lit("}"))
    every = pages.unionByName(beyond).join(sizes, "resource").select("resource", (F.col("p") * PAGE + 1).alias("start"), text.alias("value"))
    every.repartition("resource", "start").write.partitionBy("resource", "start").text(path)


def paged_events(t: Tables):
    """All events, read through the paging source from the pages that they were landed as."""
    path = new_path(t.spark, "pages")
    land_pages(t, path)
    items = paged.read_pages(t.spark, path=path, pagesize=str(PAGE)).where("failure IS NULL")
    out = items.select(F.from_json("item", "event_id long, user_id long, event_type string, value double").alias("e")).select("e.*")
    kept = materialize(out, "paged-events")
    remove_path(t.spark, path)
    return kept


QUERIES = {
    "paged_events": (query(paged_events), "SELECT event_id, user_id, event_type, value FROM events"),
    "page_blocks": (query(page_blocks), BLOCKS),
    "name_resolution": (query(name_resolution), NAMES),
    "report_preference": (query(report_preference), PREFERENCE),
    "section_entries": (query(section_entries), SECTIONS),
}
