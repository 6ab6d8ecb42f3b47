"""Display functions, published views, stores of officials and reports, people of deeds, cell grids."""

import datetime as dt

from pyspark.sql import functions as F

from ledgerlens.functions import display as D
from ledgerlens.functions import registry
from ledgerlens.functions import text as X
from ledgerlens.operators import lifecycle, linking, places, publish
from ledgerlens.rules import engine
from ledgerlens.sources import grids


def one(spark, *columns):
    return tuple(spark.range(1).select(*[c.alias(f"c{k}") for k, c in enumerate(columns)]).first())


def test_display(spark):
    n = lambda x: F.lit(x).cast("double")
    assert one(spark, D.number(n(12347905.4)), D.number(n(2.5)), D.number(F.lit(None)), D.euro(n(1234.6)), D.percent(n(0.784))) == ("12,347,905", "2", "—", "1,235 €", "78.4%")
    assert one(spark, D.period(F.lit("2026-08")), D.period(F.lit("x")), D.quarter(F.lit("2026 Q2")), D.quarter(F.lit(None).cast("string"))) == ("август 2026", "x", "II тримесечие на 2026", "—")
    assert one(spark, D.date(F.lit(dt.datetime(2025, 10, 19, 21))), D.severity(F.lit(" Serious ")), D.severity(F.lit(None).cast("string")), D.severity_rank(F.lit("critical"))) == ("20.10.2025", "warning", "warning", 0)
    t = lambda a, b, c: D.tier(F.lit(a).cast("string"), F.lit(b), F.lit(c))
    assert one(spark, t("Violation", "x", "info"), t(None, "splitting", "info"), t("meta", "unheard", "low")) == ("violation", "signal", "opacity")
    y = lambda kind, d: D.event_year(F.lit(kind), F.lit(d), F.lit(2020))
    assert one(spark, y("budget_object", '{"to_period": "2024-03"}'), y("report", '{"year": 2021}'), y("report", '{"expected_period": "2022-05"}'), y("contract", "{}"), y("budget_object", "{}")) == (2024, 2021, 2022, 2020, None)
    assert one(spark, D.leva(n(100 / 1.95583)), D.leva(n(10.01))) == (100.0, 19.58)
    assert one(spark, D.href(F.lit("https://a.bg/x y/Б.pdf?q=а%20b#z")), D.href(F.lit(None).cast("string"))) == ("https://a.bg/x%20y/%D0%91.pdf?q=%D0%B0%20b#z", "")


def test_tokens_and_distinctive(spark):
    t = "Основен ремонт на ул. „Отец Паисий“ в с. Равда, ПИ 61056.501.4 и улично осветление"
    got = one(spark, X.tokens(F.lit(t)), X.distinctive(F.lit(t)), X.tokens(F.lit(None).cast("string")), X.distinctive(F.lit("")))
    assert sorted(got[0]) == sorted(["отец", "паисий", "равда", "CAD:61056.501.4", "улично", "осветление"])
    assert sorted(got[1]) == sorted(["CAD:61056.501.4", "равда", "ST:отец"]) and got[2] == [] and got[3] == []


def test_best_match_by_overlap_or_mark(spark):
    objects = spark.createDataFrame([(1, "Тръбопровод дъждовна вода", 100.0), (2, "Алея Равда осветление", 100.0), (3, "Стадион кошове", 100.0), (4, "Стадион кошове", 0.0), (5, None, 10.0)], "object_id int, text string, size double")
    contracts = spark.createDataFrame([(10, "Тръбопровод дъждовна", 120.0), (11, "Детска площадка Равда", 60.0), (12, "Стадион кошове", 900.0), (13, "Равда плаж", 70.0)], "candidate_id int, text string, size double")
    got = {r.object_id: (r.best_id, round(r.jaccard, 3)) for r in linking.best_match(objects, contracts).collect()}
    assert got == {1: (10, round(2 / 3, 3)), 2: (13, 0.25)}  # 13: largest overlap among those that share the place


def test_best_match_tokenises_sizes_that_can_match(spark, monkeypatch):
    """Texts without a candidate in the ratio of sizes are not tokenised; both ends of the ratio are."""
    text = "sewer works in north quarter"
    objects = spark.createDataFrame([(k, text, size) for k, size in enumerate([0, 4, 5, 20, 21, 40, 49, 50, 200, 201, 10**6])], "object_id int, text string, size int")
    candidates = spark.createDataFrame([(1, text, 10), (2, text, 100)], "candidate_id int, text string, size int")
    read, write = {}, linking.materialize

    def watched(df, label):
        out = write(df, label)
        read[label] = out.columns[0] == "object_id" and {r.object_id for r in out.collect()}
        return out

    monkeypatch.setattr(linking, "materialize", watched)
    got = {r.object_id: (r.best_id, r.jaccard) for r in linking.best_match(objects, candidates, min_jaccard=0.1, low=0.5, high=2.0).collect()}
    assert got == {2: (1, 1.0), 3: (1, 1.0), 7: (2, 1.0), 8: (2, 1.0)}
    assert read["match-object_id"] == set(got)


def test_best_match_against_brute_force(spark):
    import random

    rng = random.Random(4)
    words = [f"{a}{b}" for a in "абвгд" for b in ("ро", "ка", "ти", "лен")] + ["равда", "обзор"]
    make = lambda n: [(k, " ".join(rng.choices(words, k=rng.randint(1, 9))), float(rng.randint(50, 400))) for k in range(n)]
    a, b = make(120), make(80)
    def sets(t):
        w = {x for x in t.split() if len(x) > 2}
        return w, {x for x in t.split() if x in X.PLACE_NAMES}
    want = {}
    for i, t, s in a:
        best = None
        for j, u, z in b:
            (x, mx), (y, my) = sets(t), sets(u)
            score = len(x & y) / len(x | y) if x and y else 0.0
            if 0.5 <= s / z <= 2 and (score >= 0.35 or mx & my) and (best is None or score > best[1]):
                best = (j, score)
        if best:
            want[i] = (best[0], round(best[1], 9))
    got = linking.best_match(spark.createDataFrame(a, "object_id int, text string, size double"), spark.createDataFrame(b, "candidate_id int, text string, size double"))
    assert {r.object_id: (r.best_id, round(r.jaccard, 9)) for r in got.collect()} == want and len(want) > 30


def test_european_wording(spark):
    yes = ["по ПРСР 2014", "Механизъм за възстановяване", "средства от ЕФРР", "ЕЗФРСР", "финансирана със средства от Европейския съюз", "съфинансиран от ЕС", "КОХЕЗИОННИЯ фонд", "Interreg V-A"]
    no = ["на територията на Европейския съюз", "ПРСРА", "ремонт"]
    df = spark.createDataFrame([(t,) for t in yes + no], "t string")
    assert [r[0] for r in df.select(engine.eu_wording(F.col("t"))).collect()] == [True] * len(yes) + [False] * len(no)


ALIASES = [("nesebar", "Несебър"), ("nesebar", "гр. Несебър"), ("vlas", "Св. Влас"), ("ravda", "Равда"), ("bryag", "Слънчев бряг")]


def test_settlements(spark):
    s = lambda t: places.settlements(F.lit(t).cast("string"), ALIASES, {"61056": "ravda"}, "Несебър")
    assert one(spark, s("Ремонт в Св.Влас и в РАВДА, после св.  влас"), s("Община Несебър, Слънчев бряг"), s("общ.Несебър, гр.Несебър"), s("ПИ 61056.501.4 в Несебър"), s("Равдаа"), s(None)) == (["vlas", "ravda"], ["bryag"], ["nesebar"], ["ravda", "nesebar"], [], [])
    o = lambda t: places.object_settlements(F.lit(t), ALIASES, None, "Несебър")
    assert one(spark, o("Път Слънчев бряг - Равда, Равда"), o("Път Равда, до Слънчев бряг и Св. Влас")) == (["ravda", "bryag"], ["ravda", "bryag", "vlas"])


def test_views(spark):
    c = spark.createDataFrame([(1, "A", 2020), (2, "B", 2021)], "id long, title string, year int")
    flags = spark.createDataFrame([("r", 1), ("s", 20), ("t", None), ("u", 30)], "rule string, procurement_id long")
    links = spark.createDataFrame([(20, 2)], "twin_id long, id long")
    got = {r.rule: r.contract and r.contract.title for r in publish.flags_with_contracts(flags, c, links, ["title"]).collect()}
    assert got == {"r": "A", "s": "B", "t": None, "u": None}
    others = spark.createDataFrame([(7, 3), (8, 1)], "id long, bids int")
    m = spark.createDataFrame([(1, 7)], "left_id long, right_id long")
    assert {r.id: r.bids_received for r in publish.enriched(c, others, m, {"bids_received": "bids"}).collect()} == {1: 3, 2: None}
    pairs = spark.createDataFrame([(1, 7), (1, 8), (2, 8)], "left_id long, right_id long")
    assert tuple(publish.match_stats(c, others, m, pairs, F.col("year") > 0).first()) == (2, 1, 1, 1, 2, 1)
    p = [("1", "a b c", "manager", True), ("2", "a b c", "partner", True), ("3", "a b c", "manager", False), ("1", "a b", "manager", True), ("2", "a b", "manager", True)]
    people = spark.createDataFrame(p, "eik string, name_normalized string, role string, is_current boolean")
    pages = spark.createDataFrame([("1", "one", "One"), ("2", "two", "Two"), ("2", "duo", "Duo"), ("3", "three", "Three")], "eik string, slug string, label string")
    also = {r.eik: [x.slug for x in r.also_at] for r in publish.also_at(people, pages, ["manager", "partner"]).collect()}
    assert also == {"1": ["duo", "two"], "2": ["one"]}
    store = spark.createDataFrame([("a", None, None), ("b", "x", None), ("c", None, "y")], "k string, resolved_at string, notified_at string")
    assert [r.k for r in publish.pending(store).collect()] == ["a"] and publish.open_findings(store).count() == 2
    assert {r.k: r.notified_at for r in publish.mark_notified(store, F.lit("now")).collect()} == {"a": "now", "b": None, "c": "y"}
    assert [r.id for r in publish.search(c, " b ", ["title"]).collect()] == [2] and publish.search(c, "", ["title"], title="A").count() == 1
    firms = spark.createDataFrame([("1",), ("9",)], "eik string")
    assert {r.eik: [x.name_normalized for x in r.people] for r in publish.with_people(firms, people.withColumn("name", F.col("name_normalized"))).collect()} == {"1": ["a b", "a b c"], "9": []}


def test_settlement_years_and_object_years(spark):
    lines = spark.createDataFrame([(["r", "v"], 2020, 10.0, 5.0), ([], 2020, 1.0, 1.0)], "settlements array<string>, year int, plan double, spent double")
    contracts = spark.createDataFrame([(["r", "v"], 2021, 100.0)], "settlements array<string>, year int, value double")
    flags = spark.createDataFrame([(["v"], 2020), (None, 2020)], "settlements array<string>, year int")
    out = {(r.settlement, r.year): tuple(r)[2:] for r in publish.settlement_years(lines, contracts, flags).collect()}
    assert out[("r", 2020)] == (10.0, 5.0, 1, 0, 0.0, 0) and out[("v", 2020)] == (0.0, 0.0, 0, 0, 0.0, 1) and out[("v", None)] == (0.0, 0.0, 0, 1, 100.0, 1)
    assert out[(publish.UNASSIGNED, 2020)] == (1.0, 1.0, 1, 0, 0.0, 1) and out[("r", None)] == (10.0, 5.0, 1, 1, 100.0, 0)
    rows = spark.createDataFrame([("p", "2020-12", 1.0, None, 1), ("p", "2020-12", 2.0, 1.0, 2), ("p", "2021-06", 3.0, 2.0, 1), ("", "2021-06", 9.0, 9.0, 2)], "object_name string, period string, plan_current double, spent_period double, source_row int")
    rep = spark.createDataFrame([("2020", "2020-12"), ("2021", "2021-06")], "year string, period string")
    (r,) = publish.object_years(rows, rep).collect()
    assert r.object_name == "p" and r.latest_period == "2021-06" and {k: tuple(v) for k, v in r.years.items()} == {"2020": (2.0, 1.0), "2021": (3.0, 2.0)}


def test_official_and_report_stores(spark):
    ddl = "name string, short_name string, role string, mandate string, name_source_url string, document_url string"
    stored = spark.createDataFrame([("Иван Петров Иванов", "Иван Иванов", "кмет", "2023", "u", "d0"), ("Мария Колева", None, "кмет", "2023", None, "d0")], ddl)
    incoming = spark.createDataFrame([("Иван Иванов", None, "кмет", "2023", None, "d1"), ("Мария Петрова Колева", "Мария Колева", "кмет", "2023", "w", "d2"), ("Нов Човек", None, "кмет", "2023", None, "d3"), ("Иван Иванов", None, "съветник", "2023", None, "d4")], ddl)
    out = {(r.short_name, r.role): (r.name, r.name_source_url, r.document_url) for r in lifecycle.upsert_officials(stored, incoming).collect()}
    assert out == {
        ("Иван Иванов", "кмет"): ("Иван Петров Иванов", "u", "d1"),
        ("Мария Колева", "кмет"): ("Мария Петрова Колева", "w", "d2"),
        ("Нов Човек", "кмет"): ("Нов Човек", None, "d3"),
        ("Иван Иванов", "съветник"): ("Иван Иванов", None, "d4"),
    }
    s = spark.createDataFrame([("a", "2019-03", "B3", "content", None, None, "f", "t0"), ("b", "2019-01", "B1", None, None, None, "f", "t0")], "url string, period string, kind string, period_source string, kind_source string, heading_period string, file_path string, fetched_at string")
    i = spark.createDataFrame([("a", "2019-04", "B1", None, "t1"), ("b", "2019-02", None, "g", "t1"), ("c", "2020-01", "B1", "h", "t1")], "url string, period string, kind string, file_path string, fetched_at string")
    out = {r.url: (r.period, r.kind, r.heading_period, r.file_path, r.fetched_at) for r in lifecycle.upsert_reports(s, i).collect()}
    assert out == {"a": ("2019-03", "B1", "2019-04", "f", "t1"), "b": ("2019-02", "B1", None, "g", "t1"), "c": ("2020-01", "B1", None, "h", "t1")}


def test_people_of_deeds(spark):
    rows = [
        ("1", "00190", "Дата на изтичане на мандата: 01.02.2027 г. ИВАН ПЕТРОВ ИВАНОВ, Държава: БЪЛГАРИЯ, Размер на дяловото участие: 50,00 лв. АННА СМИТ, Държава: ВЕЛИКА БРИТАНИЯ"),
        ("2", "00230", '"ХОЛДИНГ" АД, ЕИК/ПИК 205127270'),
        ("3", "00070", "Заличен управител"),
        ("4", "00500", "НЯКОЙ ДРУГ, Държава: БЪЛГАРИЯ"),
        ("5", "00070", None),
    ]
    out = sorted((r.eik, r.name, r.role, r.share_text, r.person_eik) for r in registry.people(spark.createDataFrame(rows, "eik string, ident string, text string")).collect())
    assert out == [("1", "АННА СМИТ", "partner", None, None), ("1", "ИВАН ПЕТРОВ ИВАНОВ", "partner", "50,00 лв.", None), ("2", '"ХОЛДИНГ" АД', "sole_owner", None, "205127270")]


def cells(spark, rows, file="f", sheet="OTCHET"):
    data = [(file, sheet, r, c, str(v)) for r, row in rows.items() for c, v in row.items()]
    return spark.createDataFrame(data, "file string, sheet string, row int, col int, value string")


def test_cash_report(spark):
    grid = cells(spark, {
        1: {3: "за периода от", 5: "до"}, 2: {3: "2019-01-01", 5: "2019-03-31"}, 3: {2: "(в лева)"},
        5: {1: "§§", 2: "под-§§", 3: "НАИМЕНОВАНИЕ"}, 6: {1: "(1)"}, 7: {1: "100.0", 2: "Данъци", 4: "195.583", 11: "19.5583"}, 8: {2: "101", 3: "Окончателен", 11: "9.77915"},
        9: {3: "в т.ч."}, 10: {1: "Всичко", 2: "99-99", 3: "Приходи", 11: "391.166"}, 11: {1: "900", 2: "after"},
        12: {1: "§§", 2: "под-§§"}, 14: {1: "200", 2: "Заплати", 11: "1.95583"}, 15: {1: "§§", 2: "под-§§"}, 17: {1: "300", 2: "no"},
    })
    got = [(r.period, r.section, r.paragraph, r.name, r.row_type, r.parent_paragraph, r.plan_total and float(r.plan_total), float(r.actual_total), r.source_row) for r in grids.cash_lines(grid).orderBy("source_row").collect()]
    assert got == [
        ("2019-03", "приходи", "100", "Данъци", "paragraph", None, 100.0, 10.0, 8),
        ("2019-03", "приходи", "101", "Окончателен", "subparagraph", "100", None, 5.0, 9),
        ("2019-03", "приходи", "99-99", "Приходи", "section_total", None, None, 200.0, 11),
        ("2019-03", "разходи", "200", "Заплати", "paragraph", None, None, 1.0, 15),
    ]
    assert grids.cash_lines(grid.where("false")).count() == 0


def test_ledger_period_columns_indicators_pins(spark, tmp_path):
    a = cells(spark, {1: {0: "план/отчет за периода:  2022 Юни"}}, "a", "X").unionByName(cells(spark, {1: {0: "Отчет Май 2020"}}, "a", "Общо"))
    b = cells(spark, {2: {0: "за периода:", 1: "от", 2: "2016-01-01", 3: "2016-03-31"}}, "b", "X")
    assert dict(map(tuple, grids.ledger_period(a.unionByName(b)).collect())) == {"a": "2020-05", "b": "2016-03"}
    head = cells(spark, {0: {0: "title"}, 3: {1: "Код", 2: "Наименование  на обекта", 5: "Сметна стойност"}}, "a", "Общо")
    cols = {r.field: (r.header_row, r.col) for r in grids.located_columns(head, {"estimated_total": "сметна", "name": "наименование на", "code": "^код$"}).collect()}
    assert cols == {"estimated_total": (3, 5), "name": (3, 2), "code": (3, 1)}
    grid = cells(spark, {0: {2: "Дял А", 4: "Дял Б"}, 1: {2: "2025 Q4", 3: "2026 Q1", 4: "2026 Q1"}, 2: {0: "1", 2: "9", 3: "1.0", 4: "5"}, 3: {0: "2", 3: "3", 4: "6"}, 4: {0: "3", 3: "8"}, 5: {0: "all", 3: "100"}}, sheet="s")
    got = [(r.title, r.label, r.own, r.median, r.n) for r in grids.indicators(grid, ["Дял А", "Дял Б", "Дял В"], 2).orderBy("ord").collect()]
    assert got == [("Дял А", "2026 Q1", 3.0, 3.0, 3), ("Дял Б", "2026 Q1", 6.0, 5.5, 2)]
    f = tmp_path / "pins.csv"
    f.write_text("object_name,period,lat,lon,cadastral_id,verified_by,source_note,verified_at\nA,,42.6,27.7,,x,,\nB,2020-01,,27,,,,\nC,,north,27,,,,\n")
    assert [(r.object_name, r.lat, r.period) for r in grids.pins(spark, f"file://{f}").collect()] == [("A", 42.6, None)]


def test_parcels_kept_by_reference(spark):
    p = [("1.1.1", "1", "ул. Роза", "За второстепенна улица"), ("1.1.2", "1", "ул. Роза", "Къща"), ("1.1.3", "1", "", "Къща")]
    parcels = spark.createDataFrame(p, "cadnum string, ekatte string, street string, usetype string")
    out = places.referenced(parcels, spark.createDataFrame([("1.1.3",)], "cadnum string"), spark.createDataFrame([("1", "роза")], "ekatte string, street_key string"), ["За второстепенна улица"])
    assert sorted(r.cadnum for r in out.collect()) == ["1.1.1", "1.1.3"]


def test_character_references(spark):
    import html as h

    texts = ["a &amp;lt; b", "&eacute;&Eacute;&euro;&hellip;", "&#39;&#x27;&#X1F600;&#1087;", "R&D & more", "&unheard; &;", "&#0;&#xD800;&#99999999;", "plain", "", "x&nbsp;y"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(X.unescape(F.col("t"))).collect()]
    assert got == [h.unescape(t).replace("\xa0", " ") for t in texts[:5]] + ["\ufffd\ufffd\ufffd", "plain", "", "x y"]
    assert one(spark, X.strip_html(F.lit("<p>a&nbsp;&amp;\n<b>b</b></p>")))[0] == "a & b"


def test_threshold_overrides(tmp_path, monkeypatch):
    from ledgerlens import config

    t = config.thresholds({"RULES_LATE_PUBLICATION_DEADLINE_DAYS": "45", "RULES_ZOP_WORKS_BOUNDS_BGN": "[1, 2, 3]", "RULES_REPORTS_FIRST_PERIOD": "2020-02", "RULES_SPLITTING_DAYS": "10"})
    assert (t.late_deadline_days, t.works_bands_bgn, t.reports_from, t.splitting_days) == (45, ((1, 1), (2, 2), (3, 3)), "2020-02", 10)
    (tmp_path / ".env").write_text("# local\nRULES_OVERSPEND_ABS_EUR=7\n")
    monkeypatch.chdir(tmp_path)
    assert config.thresholds().overspend_abs == 7


def test_provenance(spark):
    from ledgerlens.rules import common, provenance
    from ledgerlens.schemas import PROCUREMENTS

    none = {"sigma": None, "procedure": None, "tender_detail": None}
    contract = {"ContractDate": "/Date(1700000000000)/", "TenderNumber": "00-1", "TypeOfContract": 2, "ContractValue": 195.583, "Currency": 3, "CurrentContractValue": 100.0, "CurrentContractCurrency": 1}
    base = dict.fromkeys(("title", "cpv_code", "procedure_type", "currency", "contractor_name", "contractor_eik", "bids_received", "published_at", "contract_date", "url"))
    rows = [base | {"id": 1, "source": "eop", "source_id": "7", "url": "http://e/7", "raw": none | {"contract": contract}}, base | {"id": 2, "source": "sigma", "source_id": "9", "bids_received": 1, "raw": none | {"contract": None, "sigma": {"unp": "00-1"}}}]
    view = common.contracts_view(spark.createDataFrame(rows, PROCUREMENTS))
    got = {r.id: r.s for r in view.select("id", provenance.contract_sources().alias("s")).collect()}
    (e,) = got[1]
    assert (e.kind, e.label, e.url) == ("eop_contract", "contract 7 of 00-1", "http://e/7")
    values = {f.name: (f.value, f.value_eur) for f in e.fields}
    assert values["ContractValue"] == ("195.583", 100.0) and values["ContractDate"] == ("2023-11-15", None) and "TedPublishDate" not in values
    (s,) = got[2]
    assert s.kind == "sigma" and {f.name: f.value for f in s.fields} == {"id": "9", "unp": "00-1", "bids_received": "1"}
    line = spark.createDataFrame([("BGN", 51.13, None, None, 100.0, "p", "2020-12", None, "Общо", 12, ("http://x/a%20b.xlsx", None, "2020-12"))], "currency string, estimated_total double, spent_prior double, plan_current double, spent_period double, object_name string, period string, source_sheet string, unit string, source_row int, report struct<url: string, file_path: string, period: string>")
    b = line.select(provenance.budget_row().alias("b")).first().b
    assert (b.file, b.sheet, b.row, b.period, b.label) == ("a b.xlsx", "Общо", 12, "2020-12", "CAPITAL, декември 2020: p")
    assert [(f.name, f.value, f.value_eur) for f in b.fields] == [("estimated_total", "100.0", 51.13), ("spent_period", "195.58", 100.0)]
    lit = lambda x: F.lit(x).cast("string")
    f, r, d, p = one(spark, provenance.flag(lit("r"), lit("k"), lit("l")), provenance.registry(lit("1"), lit("A"), lit("u"), status=lit("active")), provenance.declaration(lit("N"), lit("2023"), lit("u")), provenance.reports_page(lit("u"), lit("2020-01")))
    assert (f.kind, r.label, d.label, p.label) == ("flag", "A (1)", "N, 2023", "reports page, looked for януари 2020") and r.fields[0].value == "active"


def test_grouped_message(spark):
    from ledgerlens.operators import message as M

    rows = [(1, "warning", "A <b>bold</b> & more"), (2, "high", "Изисква обяснение."), (3, "info", "x"), (4, "warning", "y"), (5, None, "z")]
    df = spark.createDataFrame(rows, "id long, severity string, message string")
    make = lambda n, d=df: M.grouped_message(d, [], flag_id="id", message="message", severity="severity", order=["id"], base_url="http://s", shown=n).collect()
    (r,) = make(2)
    assert r.n == 5 and r.text.split("\n")[:4] == ["<b>Нови сигнали — 5 нов(и) сигнал(и)</b>", "", "\U0001f6a8 Изисква обяснение.", '<a href="http://s/flags/#2">http://s/flags/#2</a>']
    assert "A &lt;b&gt;bold&lt;/b&gt; &amp; more" in r.text and r.text.endswith("...и още 3: ℹ️ 1 информация, ⚠️ 1 предупреждение.")
    (r,) = make(10)
    assert r.text.endswith('• z\n<a href="http://s/flags/#5">http://s/flags/#5</a>') and "още" not in r.text
    assert [tuple(x) for x in make(3, df.where("false"))] == [(0, M.NOTHING)]
