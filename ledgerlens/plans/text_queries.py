"""Text operators bound to documents, benchmark, pages, conversations and event properties."""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import linking as L
from ..operators.gazetteer import settlements_of_many
from ..operators.places import settlements
from .base import Tables, query

_TOKENS = (
    "list_distinct(list_concat(list_filter(regexp_split_to_array(regexp_replace(lower({c}), '" + X.PARCEL + "', ' ', 'g'), '[^a-zа-я]+'), lambda w: length(w) >= 3 AND NOT list_contains("
    + str(list(X.STOP_WORDS)) + ", w)), list_transform(regexp_extract_all(lower({c}), '" + X.PARCEL + "'), lambda p: 'CAD:' || p)))"
)
_MARKS = (
    "list_distinct(list_concat(list_transform(regexp_extract_all(lower({c}), '" + X.PARCEL + "'), lambda p: 'CAD:' || p), list_filter(regexp_split_to_array(lower({c}), '[^a-zа-я]+'), lambda w: list_contains("
    + str(list(X.PLACE_NAMES)) + ", w)), list_transform(list_filter(regexp_extract_all(lower({c}), '" + X.STREET + "', 1), lambda s: NOT list_contains(" + str(list(X.STOP_WORDS)) + ", s)), lambda s: 'ST:' || s)))"
)


def _sized(df, key: str, name: str):
    return df.select(F.col(key).alias(name), "text", F.length("text").alias("size"))


def _documents(t: Tables):
    return _sized(t.documents, "doc_id", "object_id")


def _fuzzy(t: Tables):
    return L.best_match(_documents(t), _sized(t.benchmark, "item_id", "candidate_id"), min_jaccard=0.1, low=0.5, high=4.0)


def fuzzy_best_match(t: Tables):
    """Documents and the benchmark item that shares most of their tokens, or a distinctive one, at a length ratio within [0.5, 4]."""
    return _fuzzy(t).select("object_id", "best_id", F.round("jaccard", 9).alias("jaccard"))


_FUZZY = f"""
d AS (SELECT doc_id, length(text) AS n, {_TOKENS.replace("{c}", "text")} AS ts, {_MARKS.replace("{c}", "text")} AS ms FROM documents WHERE length(text) > 0),
b AS (SELECT item_id, length(text) AS n, {_TOKENS.replace("{c}", "text")} AS ts, {_MARKS.replace("{c}", "text")} AS ms FROM benchmark WHERE length(text) > 0),
p AS (SELECT doc_id, item_id, len(list_intersect(d.ts, b.ts)) AS k, len(d.ts) + len(b.ts) AS s, len(list_intersect(d.ms, b.ms)) > 0 AS marked FROM d JOIN b ON d.n >= 0.5 * b.n AND d.n <= 4 * b.n),
j AS (SELECT *, CASE WHEN k = 0 THEN 0.0 ELSE k / CAST(s - k AS DOUBLE) END AS jaccard FROM p),
m AS (SELECT doc_id AS object_id, item_id AS best_id, jaccard FROM j WHERE jaccard >= 0.1 OR marked QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY jaccard DESC, item_id) = 1)"""
FUZZY = f"WITH {_FUZZY} SELECT object_id, best_id, round(jaccard, 9) AS jaccard FROM m"


def unmatched(t: Tables):
    docs = _documents(t).where("size > 0")
    return L.unmatched(docs, _fuzzy(t)).select("object_id", F.col("size").cast("long").alias("size"))


UNMATCHED = f"WITH {_FUZZY} SELECT doc_id AS object_id, n AS size FROM d WHERE doc_id NOT IN (SELECT object_id FROM m)"


def quantity_text(t: Tables):
    """Documents by whether a quantity or a multiplication of numbers stands in them."""
    low = F.lower("text")
    has = low.rlike(r"[0-9][0-9 .,]*(kg|km|m2|pcs|tons?|л|кг|бр)([^\p{L}]|$)") | low.rlike(r"[0-9]+ ?[xх×*] ?[0-9]+")
    return t.documents.select("doc_id", has.alias("has_quantity"), low.rlike("[0-9]").alias("has_digit"))


QUANTITY = r"""SELECT doc_id, regexp_matches(lower(text), '[0-9][0-9 .,]*(kg|km|m2|pcs|tons?|л|кг|бр)([^\p{L}]|$)') OR regexp_matches(lower(text), '[0-9]+ ?[xх×*] ?[0-9]+') AS has_quantity,
regexp_matches(text, '[0-9]') AS has_digit FROM documents"""


def price_unverifiable(t: Tables):
    """Conversations whose longest turn, without the first turn's text, is short and names no number."""
    w = t.conversations
    first = w.groupBy("conv_id").agg(F.min_by("text", "turn").alias("title"))
    rest = w.join(first, "conv_id").select("conv_id", F.length(F.trim(F.replace(F.col("text"), F.col("title"), F.lit("")))).alias("n"), F.col("text").rlike("[0-9]").alias("numbers"))
    grouped = rest.groupBy("conv_id").agg(F.max("n").cast("long").alias("longest"), F.max("numbers").alias("numbers"))
    return grouped.where((F.col("longest") < 400) & ~F.col("numbers")).select("conv_id", "longest")


PRICE = """
WITH f AS (SELECT conv_id, min_by(text, turn) AS title FROM conversations GROUP BY 1)
SELECT conv_id, max(length(trim(replace(text, title, '')))) AS longest FROM conversations JOIN f USING (conv_id) GROUP BY 1
HAVING max(length(trim(replace(text, title, '')))) < 400 AND NOT bool_or(regexp_matches(text, '[0-9]'))"""


def html_strip(t: Tables):
    text = X.strip_html(F.col("html"))
    return t.pages.select("page_id", F.length(text).cast("long").alias("n_chars"), F.md5(text).alias("text_md5"))


_ENTITIES = "t"
for _e, _c in [("&#39;", "'"), *((f"&{n};", chr(c) if n != "nbsp" else " ") for n, c in sorted(name2codepoint.items(), key=lambda x: x[0] == "amp"))]:
    _ENTITIES = f"replace({_ENTITIES}, '{_e}', '{_c.replace(chr(39), chr(39) * 2)}')"
HTML_STRIP = f"""
WITH s AS (SELECT page_id, regexp_replace(html, '<[^>]*>', ' ', 'g') AS t FROM pages),
u AS (SELECT page_id, trim(regexp_replace({_ENTITIES}, '[ \\t\\n\\r]+', ' ', 'g'), ' ') AS t FROM s)
SELECT page_id, length(t) AS n_chars, md5(t) AS text_md5 FROM u"""


def html_links(t: Tables):
    links = F.regexp_extract_all("html", F.lit('<a [^>]*href="([^"]*)"'), F.lit(1))
    rows = t.pages.select("page_id", F.posexplode(links).alias("pos", "href"))
    return rows.select("page_id", (F.col("pos") + 1).cast("long").alias("pos"), "href")


HTML_LINKS = """SELECT page_id, generate_subscripts(l, 1) AS pos, unnest(l) AS href FROM (SELECT page_id, regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1) AS l FROM pages)"""


def page_fields(t: Tables):
    """Title, language and number of list items of every page."""
    items = F.size(F.regexp_extract_all("html", F.lit("(<li>)"), F.lit(1))).cast("long")
    return t.pages.select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_extract("html", '<html lang="([a-z]+)"', 1).alias("lang"), items.alias("n_items"))


PAGE_FIELDS = """SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(html, '<html lang="([a-z]+)"', 1) AS lang,
len(regexp_extract_all(html, '<li>')) AS n_items FROM pages"""


def json_path(t: Tables):
    k = F.get_json_object("props", "$.k").cast("long")
    return t.events.groupBy("event_type").agg(F.sum(k).alias("sum_k"), F.count_if(k.isNull()).alias("n_missing"), F.max(k).alias("max_k"))


JSON_PATH = """SELECT event_type, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS sum_k, count(*) FILTER (json_extract(props, '$.k') IS NULL) AS n_missing, max(CAST(json_extract(props, '$.k') AS BIGINT)) AS max_k FROM events GROUP BY 1"""

PLACES = [("bgs", "the"), ("bgs", "and"), ("var", "which"), ("sof", "her"), ("plo", "there"), ("rus", "die"), ("rus", "der")]


def settlement_detect(t: Tables):
    """Places whose aliases stand in a text as whole words, in the order of their first positions; one alias doesn't count after two words."""
    found = settlements(F.col("text"), PLACES, {}, "and", ("the", "of"))
    return t.documents.select("doc_id", F.array_join(found, ",").alias("places")).where("places <> ''")


def settlement_automaton(t: Tables):
    """The same by the automaton for large lists of names."""
    found = settlements_of_many("text", PLACES, {}, "and", ("the", "of"))
    return t.documents.select("doc_id", F.array_join(found, ",").alias("places")).where("places <> ''")


SETTLEMENT = rf"""
WITH t AS (SELECT doc_id, ' ' || regexp_replace(regexp_replace(lower(text), '(the|of)(\s{{0,9}})and', '\1\2_', 'g'), '[^\p{{L}}\p{{N}}_]+', '  ', 'g') || ' ' AS t FROM documents),
h AS (SELECT doc_id, place, min(instr(t, ' ' || alias || ' ')) AS pos FROM t, (VALUES {", ".join(map(str, PLACES))}) AS a(place, alias) WHERE instr(t, ' ' || alias || ' ') > 0 GROUP BY 1, 2)
SELECT doc_id, string_agg(place, ',' ORDER BY pos, place) AS places FROM h GROUP BY 1"""


def name_keys(t: Tables):
    return t.customer.select("c_custkey", X.name_key(F.col("c_name")).alias("name_key"), X.slug(F.col("c_name")).alias("slug"))


NAME_KEYS = r"""SELECT c_custkey, trim(regexp_replace(lower(c_name), '[^\p{L}\p{N}]+', ' ', 'g')) AS name_key,
left(regexp_replace(regexp_replace(lower(c_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 80) AS slug FROM customer"""

QUERIES = {
    "fuzzy_best_match": (query(fuzzy_best_match), FUZZY),
    "unmatched": (query(unmatched), UNMATCHED),
    "quantity_text": (query(quantity_text), QUANTITY),
    "price_unverifiable": (query(price_unverifiable), PRICE),
    "html_strip": (query(html_strip), HTML_STRIP),
    "html_links": (query(html_links), HTML_LINKS),
    "page_fields": (query(page_fields), PAGE_FIELDS),
    "json_path": (query(json_path), JSON_PATH),
    "settlement_detect": (query(settlement_detect), SETTLEMENT),
    "settlement_automaton": (query(settlement_automaton), SETTLEMENT),
    "name_keys": (query(name_keys), NAME_KEYS),
}
