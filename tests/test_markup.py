"""Pages and notices to rows, by hand-made cases and an independent walk over the same markup."""

from html import unescape

import pytest
from pyspark.sql import functions as F

from ledgerlens.sources import markup as M

PAGE = """<!DOCTYPE html><html><head><title>A &amp; B</title><style>p{}</style><script>var x = "<p>no</p>";</script></head><body><!-- <p>no</p> -->
<nav>Home</nav><h1>One <b>bold</b></h1><p>First
para<br>second <i>line</i></p><h3>Deep</h3><div>x &euro; &unknown; &#65;&#x42;</div><H2 class=k>Two</H2><ul><li>a</li><li> </li><li>b</li></ul>
<h1>Next</h1>tail < 5 <p>unclosed"""


def test_page_blocks(spark):
    df = spark.createDataFrame([(1, PAGE), (2, None), (3, ""), (4, "plain"), (5, "<h2>only</h2>")], "page_id long, html string")
    got = [(r.page_id, r.position, r.path, r.text) for r in M.page_blocks(df).orderBy("page_id", "position").collect()]
    assert got == [
        (1, 0, "", "A & B"), (1, 1, "", "Home"), (1, 3, "One bold", "First para"), (1, 4, "One bold", "second line"), (1, 6, "One bold > Deep", "x € &unknown; AB"),
        (1, 8, "One bold > Two", "a"), (1, 9, "One bold > Two", "b"), (1, 11, "Next", "tail < 5"), (1, 12, "Next", "unclosed"), (4, 0, "", "plain"),
    ]


def field(heading, *values):
    rows = "".join(f'<tr><td style="w"></td><td class="td__border">{f"<div class=label__name>{label}</div>" if label else ""}{"".join(f"<div class=name> {v}</div>" for v in parts)}</td></tr>' for label, *parts in values)
    return f'<tr><td class="first__coll"></td><td><div class="section__name">{heading}</div></td></tr>{rows}'


LEGACY = (
    '<p class="header__form">Обявление за\n поръчка</p><table>'
    + "<tr><td></td><td><div class=name>before any section</div></td></tr>"
    + field("Основен CPV код", (None, "71521000 Надзор"))
    + field("Кратко описание", (None, "ОП №1 &ndash; надзор", "и още"), (None, "not this"))
    + field("Прогнозна обща стойност", ("Стойност, без да се включва ДДС", "72450"), ("Валута:", "BGN"))
    + field("Допълнителни CPV кодове", (None, "71520000-9; 71521000"), (None, "x"))
    + field("Описание на обществената поръчка", (None, "Lot one", "more of it"))
    + field("Описание на обществената поръчка", (None, "Lot two"))
    + "</table>"
)
EFORMS = (
    "<p class=header__form>Обявление &#8211; стандартен режим</p><table>"
    + field("Описание", ("Описание(BT-24-Procedure)", "доставка на гуми"))
    + field("Основна класификация", ("Основна класификация(BT-262-Procedure)", "34350000 - Външни гуми"))
    + field("Обхват", ("Прогнозна стойност, без да се включва ДДС(BT-27-Procedure)", "650000.00 BGN"), ("Описание(BT-24-Lot)", "50 гуми"))
    + "</table>"
)


def test_notice_fields(spark):
    df = spark.createDataFrame([(1, LEGACY), (2, EFORMS), (3, "<p>nothing</p>"), (4, None)], "id long, html string")
    got = {r.id: tuple(r)[1:] for r in M.notice_fields(df, "id").collect()}
    assert got == {
        1: ("Обявление за поръчка", "71521000", ["71521000", "71520000-9"], "ОП №1 – надзор и още", ["Lot one more of it", "Lot two"], "72450 BGN"),
        2: ("Обявление – стандартен режим", "34350000", ["34350000"], "доставка на гуми", ["50 гуми"], "650000.00 BGN"),
    }


def test_notices_of_tenders(spark):
    n = [(None,), (LEGACY,), (EFORMS,), (EFORMS,)]
    df = spark.createDataFrame([(7, "a", n), (8, "b", []), (9, "c", None)], "TenderId long, name string, TenderPublicationDetails array<struct<HtmlPreview: string>>")
    got = {r.TenderId: (r.name, r.cpv_code, r.notice_text) for r in M.with_notices(df).collect()}
    assert got == {7: ("a", "71521000", "ОП №1 – надзор и още Lot one more of it Lot two доставка на гуми 50 гуми"), 8: ("b", None, None), 9: ("c", None, None)}


def test_pages_keep_all_text(spark):
    """Every page's blocks and headings, joined, are the page's text without its tags."""
    from pathlib import Path

    from ledgerlens.functions import text as X

    folder = Path("/root/testdata/sf0.001")
    if not folder.exists():
        pytest.skip("no test tables")
    pages = spark.read.parquet(f"{folder}/pages.parquet").where("html IS NOT NULL")
    bare = F.regexp_replace("html", r"(?is)<!--.*?-->|<(script|style)\b[^>]*>.*?</\1\s*>", "")
    whole = {r.page_id: r.t for r in pages.select("page_id", F.regexp_replace(X.strip_html(bare), " ", "").alias("t")).collect()}
    blocks = M.page_blocks(pages).groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct("position", "text"))).alias("b"), F.max("path").alias("path")).collect()
    assert len(blocks) == len(whole)
    for r in blocks:
        text, at = whole[r.page_id], 0
        for b in r.b:
            part = b.text.replace(" ", "")
            at = text.index(part, at) + len(part)
        assert at == len(text) and unescape(r.path) == r.path
