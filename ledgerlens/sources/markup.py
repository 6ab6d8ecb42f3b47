"""Markup to rows: pages cut into text blocks under their headings, and procurement notices into fields.

Both parsers are table functions that Spark joins laterally: a page is parsed where its row is, row by row, and gives as
many rows as it has blocks. What is then made of the rows is DataFrame operations.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.entities import html5
from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(r"<!--.*?-->|<(script|style)\b[^>]*>.*?</\1\s*>|<[a-zA-Z/!?][^>]*>|[^<]+|<", re.S | re.I)
TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9]*)")
REFERENCE = re.compile(r"&(#[0-9]{1,8}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);")
BLANKS = re.compile(r"[ \t\n\r]+")
#: Elements that start and end blocks of text; all others stand within a line.
BLOCKS = (
    "address", "article", "aside", "blockquote", "body", "br", "caption", "dd", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6",
    "head", "header", "hr", "html", "legend", "li", "main", "nav", "ol", "option", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "title", "tr", "ul",
)
_NAMED = {k[:-1]: v for k, v in html5.items() if k.endswith(";")} | {"nbsp": " "}
_BLOCK_SET = frozenset(BLOCKS)


def _resolved(m: re.Match) -> str:
    name = m[1]
    if name[0] != "#":
        return _NAMED.get(name, m[0])
    code = int(name[2:], 16) if name[1] in "xX" else int(name[1:])
    return chr(code) if 0 < code < 0xD800 or 0xE000 <= code <= 0x10FFFF else "�"


def clean(text: str) -> str:
    """Character references resolved, white space collapsed."""
    return BLANKS.sub(" ", REFERENCE.sub(_resolved, text)).strip(" ")


class PageBlocks:
    """(position, path, text) of a page's blocks that aren't headings; path: the headings above, outermost first.

    A block is the text between two block tags; a heading is one right after the start of h1 to h6 and ends the path's
    entries of its own and lower ranks. Comments, scripts and styles hold no text. Positions count all blocks.
    """

    def eval(self, html: str) -> Iterator[tuple[int, str, str]]:
        if html is None:
            return
        stack: list[tuple[int, str]] = []
        parts: list[str] = []
        level = position = 0
        for m in TOKEN.finditer(html + "<p>"):
            token = m[0]
            tag = TAG.match(token)
            if tag is None or m[1]:
                if token[0] != "<" or token == "<":
                    parts.append(token)
                continue
            name = tag[2].lower()
            if name not in _BLOCK_SET:
                continue
            if text := clean("".join(parts)):
                if level:
                    while stack and stack[-1][0] >= level:
                        stack.pop()
                    stack.append((level, text))
                else:
                    yield position, " > ".join(t for _, t in stack), text
                position += 1
            parts = []
            level = int(name[1]) if not tag[1] and name[0] == "h" and name[1:].isdigit() else 0


class _Rows(HTMLParser):
    """The rows of a notice's tables with the texts of their marked divisions, in document order."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows: list[dict] = []
        self.open: list[tuple[str, str, dict | None]] = []  # (tag, class, row) of open elements
        self.form: str | None = None

    def handle_starttag(self, tag: str, attrs):
        kind = dict(attrs).get("class") or ""
        if tag == "tr":
            self.open.append((tag, kind, {"cells": []}))
            self.rows.append(self.open[-1][2])
        elif tag == "td":
            row = next((x[2] for x in reversed(self.open) if x[0] == "tr"), None)
            cell = {"class": kind.split(), "divs": []}
            if row is not None:
                row["cells"].append(cell)
            self.open.append((tag, kind, cell))
        elif tag in ("div", "p"):
            cell = next((x[2] for x in reversed(self.open) if x[0] == "td"), None)
            made = {"class": kind.split(), "text": []}
            if cell is not None:
                cell["divs"].append(made)
            self.open.append((tag, kind, made))

    def handle_endtag(self, tag: str):
        at = next((k for k in range(len(self.open) - 1, -1, -1) if self.open[k][0] == tag), None)
        if at is not None and tag in ("tr", "td", "div", "p"):
            if tag == "p" and self.form is None and "header__form" in self.open[at][1].split():
                self.form = " ".join(" ".join(self.open[at][2]["text"]).split())
            del self.open[at:]

    def handle_data(self, data: str):
        for tag, _, x in self.open:
            if tag in ("div", "p"):
                x["text"].append(data)


def _texts(cell: dict, kind: str) -> list[str]:
    return [" ".join(d["text"]) for d in cell["divs"] if kind in d["class"]]


class NoticeValues:
    """(section, place, heading, label, value) of a notice's fields; one row with section -1 has the notice's type as its value.

    A row whose first cell is marked starts a section under its heading; every row below it gives one value, all
    paragraphs joined, with its label if it has one. Place counts a section's values.
    """

    def eval(self, html: str) -> Iterator[tuple[int, int, str, str | None, str]]:
        if not html:
            return
        parser = _Rows()
        parser.feed(html)
        parser.close()
        one = lambda parts: " ".join(" ".join(parts).split())
        if parser.form:
            yield -1, 0, "", None, parser.form
        section, place, heading = -1, 0, ""
        for row in parser.rows:
            cells = row["cells"]
            if not cells:
                continue
            if "first__coll" in cells[0]["class"]:
                named = [t for c in cells for t in _texts(c, "section__name")]
                section, place, heading = section + 1, 0, one(named[:1])
                continue
            cell = cells[min(1, len(cells) - 1)]
            values, labels = _texts(cell, "name"), _texts(cell, "label__name")
            if section >= 0 and values:
                yield section, place, heading, one(labels[:1]) if labels else None, one(values)
                place += 1


def page_blocks(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages with position, path and text of every block of column html."""
    cut = F.udtf(PageBlocks, returnType="position int, path string, text string")
    return pages.lateralJoin(cut(F.col(html).outer()))


def notice_values(notices: DataFrame, html: str = "html") -> DataFrame:
    cut = F.udtf(NoticeValues, returnType="section int, place int, heading string, label string, value string")
    return notices.lateralJoin(cut(F.col(html).outer()))


# Headings of the older form, starts of labels of the newer one, and the words that mark codes and values.
CPV_HEADING, CPV_LABEL = "Основен CPV код", "Основна класификация(BT-262-Procedure"
SHORT_HEADING, SHORT_LABEL = "Кратко описание", "Описание(BT-24-Procedure"
LOT_HEADING, LOT_LABEL = "Описание на обществената поръчка", "Описание(BT-24-Lot"
CPV_WORDS, ESTIMATE_WORDS, CURRENCY_WORD = ("cpv", "класификация"), ("прогнозна", "стойност"), "валута"


def _first(rows: Column, of: Column | None = None) -> Column:
    return F.when(F.size(rows) > 0, rows[0]["value"])


def notice_fields(notices: DataFrame, key: str, html: str = "html") -> DataFrame:
    """key, notice_type, cpv_main, cpv_codes, short_description, lot_descriptions, estimated_value of notices (key, html).

    Codes keep their order without repeats; lots give one description each. A notice's values are gathered in its row.
    """
    values = notice_values(notices.select(key, html), html)
    row = F.struct("section", "place", "heading", F.coalesce("label", F.lit("")).alias("label"), "value")
    grouped = values.groupBy(key).agg(F.max(F.when(F.col("section") < 0, F.col("value"))).alias("notice_type"), F.sort_array(F.collect_list(F.when(F.col("section") >= 0, row))).alias("rows"))
    low = lambda c: F.lower(c)

    def codes(r: Column) -> Column:
        words = low(F.concat_ws(" ", r["heading"], r["label"]))
        found = F.regexp_extract_all(r["value"], F.lit(r"(?<![\p{L}\p{N}_])(\d{8}(?:-\d)?)(?![\p{L}\p{N}_])"), F.lit(1))
        return F.when(words.contains(CPV_WORDS[0]) | words.contains(CPV_WORDS[1]), found).otherwise(F.array().cast("array<string>"))

    def estimated(c: Column) -> Column:
        a, b = (F.locate(w, low(c)) for w in ESTIMATE_WORDS)
        return (a > 0) & (F.locate(ESTIMATE_WORDS[1], F.substring(low(c), a + 1, F.length(c))) > 0) & (b > 0)

    rows = F.col("rows")
    main = F.filter(rows, lambda r: ((r["heading"] == CPV_HEADING) | r["label"].startswith(CPV_LABEL)) & (F.size(codes(r)) > 0))
    short = F.filter(rows, lambda r: ((r["heading"] == SHORT_HEADING) & (r["place"] == 0)) | ((r["heading"] != SHORT_HEADING) & r["label"].startswith(SHORT_LABEL)))
    lots = F.filter(rows, lambda r: ((r["heading"] == LOT_HEADING) & (r["place"] == 0)) | ((r["heading"] != LOT_HEADING) & r["label"].startswith(LOT_LABEL)))
    labelled = F.transform(F.filter(rows, lambda r: estimated(r["label"])), lambda r: F.struct(r["section"].alias("section"), F.lit(0).alias("kind"), r["value"].alias("value")))
    headed = F.transform(F.filter(rows, lambda r: estimated(r["heading"]) & (r["place"] == 0)), lambda r: F.struct(r["section"].alias("section"), F.lit(1).alias("kind"), F.concat_ws(" ", r["value"], _first(F.filter(rows, lambda x: (x["section"] == r["section"]) & (x["place"] > 0) & low(x["label"]).startswith(CURRENCY_WORD)))).alias("value")))
    estimates = F.concat(F.slice(labelled, 1, 1), headed)
    best = F.array_sort(estimates, lambda a, b: F.when(a["section"] != b["section"], a["section"] - b["section"]).otherwise(a["kind"] - b["kind"]))
    return grouped.select(
        key,
        "notice_type",
        F.when(F.size(main) > 0, codes(main[0])[0]).alias("cpv_main"),
        F.array_distinct(F.flatten(F.transform(rows, codes))).alias("cpv_codes"),
        _first(short).alias("short_description"),
        F.transform(lots, lambda r: r["value"]).alias("lot_descriptions"),
        _first(best).alias("estimated_value"),
    )


def with_notices(details: DataFrame, key: str = "TenderId", notices: str = "TenderPublicationDetails") -> DataFrame:
    """details with cpv_code (the first notice's that has one) and notice_text (descriptions of all notices, in order, without repeats) in place of the notices' HTML."""
    each = details.select(key, F.posexplode(notices).alias("__n", "__notice")).select(key, "__n", F.struct(key, "__n").alias("__key"), F.col("__notice.HtmlPreview").alias("html"))
    fields = notice_fields(each, "__key")
    texts = F.concat(F.array("short_description"), "lot_descriptions")
    listed = F.sort_array(F.collect_list(F.struct(F.col("__key.__n").alias("n"), "cpv_main", texts.alias("texts"))))
    joined = fields.groupBy(F.col(f"__key.{key}").alias(key)).agg(listed.alias("l"))
    with_code = F.filter("l", lambda x: x["cpv_main"].isNotNull())
    text = F.array_join(F.filter(F.array_distinct(F.flatten(F.transform("l", lambda x: x["texts"]))), lambda t: t.isNotNull() & (t != "")), " ")
    made = joined.select(key, F.when(F.size(with_code) > 0, with_code[0]["cpv_main"]).alias("cpv_code"), F.when(text != "", text).alias("notice_text"))
    return details.drop(notices).join(made, key, "left")
