"""Readers, cell grids, sinks and the streaming extension on small files."""

import json

from pyspark.sql import functions as F

from ledgerlens.sources import readers as R
from ledgerlens.sources import sinks as K
from ledgerlens.streaming import events as S


def test_csv_contracts(spark, tmp_path):
    p = tmp_path / "c.csv"
    p.write_text("id,unp,subject,authority,authority_eik,contractor,contractor_eik,kind,sector_code,procedure,signed_at,value_eur,eu_funded,bids_received\n1,U1,Paper,A,1,Firm,123456789.0,x,30000000,Открита,2026-01-02,10.5,true,2.0\n2,U2,Road,A,1,,,x,,,,abc,,\n")
    a, b = R.csv_contracts(spark, f"file://{p}").orderBy("id").collect()
    assert (a.contractor_eik, float(a.contract_value_eur), a.bids_received, a.raw.sigma.eu_funded, str(a.contract_date)[:10]) == ("123456789", 10.5, 2, True, "2026-01-02")
    assert b.contract_value_eur is None and b.contractor_eik is None


def test_json_and_assembly(spark, tmp_path):
    (tmp_path / "p").mkdir()
    (tmp_path / "p/a.json").write_text(json.dumps({"Items": [{"TenderId": 1, "v": 5.0}], "HasMoreResults": False}))
    (tmp_path / "p/b.json").write_text("not json")
    rows = R.json_pages(spark, f"file://{tmp_path}/p", "struct<TenderId: long, v: double>")
    assert [tuple(r) for r in rows.collect()] == [(1, 5.0)]
    assert [r.file.rsplit("/", 1)[1] for r in R.json_failures(spark, f"file://{tmp_path}/p").collect()] == ["b.json"]
    c = spark.createDataFrame([(1, "x"), (1, "y")], "TenderId long, n string")
    p = spark.createDataFrame([(1, "p"), (2, "q")], "TenderId long, p string")
    d = spark.createDataFrame([(2, "d")], "TenderId long, d string")
    out = R.assemble(c, p, d)
    assert out.count() == 3 and out.where("contract IS NULL").first().procedure.p == "q"


def deed(eik, *fields, name="Firm", form=10):
    f = lambda i, h, op=1, at=None: {"fieldIdent": i, "htmlData": h, "fieldOperation": op, "fieldEntryDate": at, "fieldActionDate": at, "recordMinActionDate": None}
    return {"uic": eik, "companyName": name, "legalForm": form, "deedStatus": 1, "sections": [{"subDeeds": [{"groups": [{"fields": [f(*x) for x in fields]}]}]}]}


def test_deeds(spark, tmp_path):
    from ledgerlens.functions import registry as G

    files = {
        "a.json": deed("123456789", ("00061", "<p>Група по НКИД: 55.10 <br/>Клас по НКИД: Хотели &euro; &ndash; caf&eacute;</p>"), ("00310", "5000.00 лв."), ("00070", "СТАР УПРАВИТЕЛ, Държава: БЪЛГАРИЯ", 1, "2009-01-05T00:00:00"), ("00070", "НОВ УПРАВИТЕЛ, Държава: БЪЛГАРИЯ"), ("10019B", "Година: 2021 г. Година: 2022 г."), ("1001BI", "Година: 2023"), ("00020", "Фирма в ликвидация", 2), ("00510", "ликвидация на клон")),
        "b.json": deed("223456789", ("00230", "ИЗТРИТ СОБСТВЕНИК, Държава: БЪЛГАРИЯ", 2), ("00030", "ЕООД"), ("00020", "&bdquo;Б&ldquo; - в несъстоятелност")),
        "d.json": deed(None, ("a", "x")),
    }
    for name, d in files.items():
        (tmp_path / name).write_text(json.dumps(d))
    (tmp_path / "c.json").write_text("{broken")
    deeds = R.deeds(spark, f"file://{tmp_path}")
    assert {(r.file.rsplit("/", 1)[1], r.reason) for r in R.deed_failures(deeds).collect()} == {("c.json", "not JSON"), ("d.json", "no company number")}
    fields = R.deed_fields(deeds)
    c = {r.eik: r for r in G.company_records(fields).collect()}
    a = c["123456789"]
    assert (a.legal_form, a.status, a.nkid_code, a.nkid_label, a.last_annual_report_year, a.last_no_activity_declaration_year, str(a.registered_at)[:10]) == ("Еднолично дружество с ограничена отговорност", "active", "55.10", "Хотели € – café", 2022, 2023, "2009-01-05")
    assert round(a.capital_eur, 2) == 2556.46 and a.source_url.endswith("?uic=123456789")
    assert (c["223456789"].status, c["223456789"].legal_form) == ("insolvency", "ЕООД") and set(c) == {"123456789", "223456789"}
    assert [(r.eik, r.name, r.is_current) for r in G.people(fields).collect()] == [("123456789", "НОВ УПРАВИТЕЛ", True)]


def test_html_links_and_names(spark, tmp_path):
    (tmp_path / "i.html").write_text("<h4>May 2026</h4><a href='x/B1_2026_05.xls'>one</a><h4>June</h4><A class=k HREF=\"y.pdf\">two <b>b</b></A>")
    rows = R.html_links(spark, f"file://{tmp_path}/i.html").orderBy("pos").collect()
    assert [(r.heading, r.href, r.text) for r in rows] == [("May 2026", "x/B1_2026_05.xls", "one"), ("June", "y.pdf", "two b")]
    names = spark.createDataFrame([("B1_2026_05.xls",), ("kapitalovi 06.2025.xlsx",), ("other.txt",)], "n string")
    out = [tuple(r.c) for r in names.select(R.classify_filename(F.col("n")).alias("c")).collect()]
    assert [x[:3] for x in out] == [("other", None, None), ("capital_xlsx", None, None), ("other", None, None)]
    want = {
        "B1_2019_3_5206.xls": ("B1", 2019, 3, None, "high"), "B3_2019_1_5206.xls": ("B3", 2019, 3, 1, "high"), "B3_2018_4_5206.xls": ("B3", 2018, 12, 4, "high"), "IB3_2019_1_5206_K33.xls": ("IB3_K33", 2019, 3, 1, "high"),
        "IB1_2026_8_5206_DES.xls": ("IB1_DES", 2026, 8, None, "high"), "IB1_2026_8_5206.xls": ("other", 2026, 8, None, "high"), "august2026.xlsx": ("capital_xlsx", 2026, 8, None, "medium"), "june26.xlsx": ("capital_xlsx", 2026, 6, None, "medium"),
        "Месечен отчет за 2022 Юни 5206 Несебър.xlsx": ("capital_xlsx", 2022, 6, None, "high"), "m-otchet-0822.xlsx": ("capital_xlsx", 2022, 8, None, "low"), "otchet.xlsx": ("capital_xlsx", None, None, None, "none"),
        "Budget_2018_5206.xlsx": ("other", None, None, None, "none"), "NaturiPokazateli_2019_5206.xlsx": ("other", None, None, None, "none"), "kp01.01.16.xlsx": ("other", None, None, None, "none"), "regUV2019.pdf": ("other", None, None, None, "none"),
    }
    names = spark.createDataFrame([(n,) for n in want], "n string")
    assert {r.n: tuple(r.c) for r in names.select("n", R.classify_filename(F.col("n")).alias("c")).collect()} == want
    cur = spark.createDataFrame([("хил. лева", None), (None, "2026-01"), (None, "2025-12"), ("EUR", "2020-01"), (None, None)], "m string, p string")
    assert [r.c for r in cur.select(R.currency_of(F.col("m"), F.col("p")).alias("c")).collect()] == ["BGN", "EUR", "BGN", "EUR", "BGN"]


def test_cells(spark):
    grid = [("", "Функция 06", None), ("5100", "Repairs", "1 000,50"), ("5101", "Roads", None), ("", "Main street", "500"), ("5200", "Purchases", ""), ("", "Truck", "1 234 567,89")]
    cells = [("f", "s", r, c, v) for r, row in enumerate(grid) for c, v in enumerate(row) if v is not None]
    out = R.ledger_from_cells(spark.createDataFrame(cells, R.CELLS), {"code": 0, "name": 1, "plan": 2}).orderBy("row").collect()
    assert [(r.row_type, r.function_code, r.paragraph, r.subparagraph) for r in out] == [("function", "06", None, None), ("paragraph", "06", "5100", None), ("subparagraph", "06", "5100", "5101"), ("object", "06", "5100", "5101"), ("paragraph", "06", "5200", None), ("object", "06", "5200", None)]
    assert [None if r.plan is None else float(r.plan) for r in out] == [None, 1000.5, None, 500.0, None, 1234567.89]


def test_reports_and_incremental(spark):
    at = lambda i, kind, name, period="2022-06", mtime=0.0: (i, period, kind, f"/cache/2022/07/{name}", mtime)
    cash = [at(10, "B1", "B1_2022_6_5206.xls", mtime=50.0), at(11, "B3", "B3_2022_2_5206.xls", mtime=1.0), at(12, "B1", "B1_2022_7_5206.xls", "2022-07"), at(14, "B1", "B1_x.xls", None), at(16, "B3", "B3_x.xls", None), at(15, "IB3_DES", "IB3_2022_2_5206_DES.xls"), at(13, "capital_xlsx", "Месечен отчет.xlsx")]
    frame = lambda rows: spark.createDataFrame(rows, "id long, period string, kind string, file_path string, mtime double")
    assert sorted(r.id for r in R.best_reports(frame(cash)).collect()) == [11, 12, 13, 14, 16]
    k = "capital_xlsx"
    order = [at(7, k, "m-otchet-5206.xlsx", mtime=200.0), at(6, k, "m-otchet-aug.xlsx", mtime=100.0), at(5, k, "otchet2022dec5206.xlsx"), at(1, k, "Месечен отчет за 2022 Юни 5206 Несебър (1).xlsx", mtime=900.0), at(4, k, "42022.xlsx", mtime=900.0), at(3, k, "3mesechen-mart.xlsx"), at(2, k, "Тримесечен отчет за 2022 Юни 5206 Несебър.xlsx")]
    while order:
        assert [r.id for r in R.best_reports(frame(order)).collect()] == [order[0][0]]
        order.pop(0)
    new = spark.createDataFrame([("2026-01", "a"), ("2025-01", "b"), ("2025-01", "c"), (None, "d")], "period string, url string")
    known = spark.createDataFrame([("a",), ("b",)], "url string")
    assert sorted(r.url for r in R.incremental(new, known, "2026-01").collect()) == ["a", "c", "d"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(2, "x", [1, 2], 27.7, 42.6), (1, "y", [], 1.0, 2.0)], "id long, place string, tags array<int>, lon double, lat double")
    K.to_csv(df, f"file://{tmp_path}/c", ["id"])
    assert spark.read.option("header", True).csv(f"file://{tmp_path}/c").count() == 2
    f = [json.loads(r.feature) for r in K.features(df, K.point(F.col("lon"), F.col("lat")), ["id", "place"]).collect()]
    assert {x["properties"]["id"]: x["geometry"]["coordinates"] for x in f} == {2: [27.7, 42.6], 1: [1.0, 2.0]}
    K.replace_partitions(df, f"file://{tmp_path}/p", "place")
    K.replace_partitions(df.where("place = 'x'").withColumn("id", F.lit(9).cast("long")), f"file://{tmp_path}/p", "place")
    assert {(r.id, r.place) for r in spark.read.parquet(f"file://{tmp_path}/p").collect()} == {(9, "x"), (1, "y")}


def test_streams(spark, tmp_path):
    import datetime as dt

    at = lambda m: dt.datetime(2024, 1, 1, 0, m)
    rows = [(k, at(m), u, "click", 1.5, "{}") for k, (m, u) in enumerate([(0, 1), (10, 1), (50, 1), (55, 2)])]
    spark.createDataFrame(rows, S.EVENTS).write.parquet(f"file://{tmp_path}/e")
    events = S.read_events(spark, f"file://{tmp_path}/e")
    for name, df in (("w", S.windowed(events, "30 minutes")), ("s", S.sessions(events))):
        df.writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", f"file://{tmp_path}/ck-{name}").trigger(availableNow=True).start().awaitTermination()
    assert sorted((r.n, float(r.total)) for r in spark.table("w").collect()) == [(2, 3.0), (2, 3.0)]
    assert sorted((r.user_id, r.n) for r in spark.table("s").collect()) == [(1, 1), (1, 2), (2, 1)]
    seen = []
    S.feed_store(events.select("event_id"), lambda df, i: seen.append((i, df.count())), f"file://{tmp_path}/ck-f").awaitTermination()
    assert seen == [(0, 4)]
