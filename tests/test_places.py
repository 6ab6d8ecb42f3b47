"""Parcels, streets, resolution, centroids and register fields."""

import pytest
from pyspark.sql import functions as F

from ledgerlens.functions import declarations as N
from ledgerlens.functions import registry as G
from ledgerlens.functions import text as X
from ledgerlens.operators import places as P

KNOWN = ["51500", "11538"]


def one(spark, value, *columns):
    return tuple(spark.createDataFrame([(value,)], "t string").select(*[c.alias(f"c{k}") for k, c in enumerate(columns)]).first())


def test_parcels(spark):
    ids = lambda t: one(spark, t, P.parcel_ids(F.col("t"), KNOWN))[0]
    assert ids("ПИ 51500.505.12, 13, 14 и 11538.1.2.3") == ["51500.505.12", "51500.505.13", "51500.505.14", "11538.1.2.3", "11538.1.2"]
    assert ids("99999.1.2 and 515001.1.2") == [] and ids(None) == []
    assert one(spark, "11538.1.2.3", P.lookup_keys(P.parcel_ids(F.col("t"), KNOWN)))[0] == ["11538.1.2"]


def test_streets(spark):
    got = lambda t: one(spark, t, P.streets(F.col("t")))[0]
    assert got("ул. Морска и ул.Лозарска гр.Варна") == ["Морска", "Лозарска"]
    assert got("ул. „Ген. Гурко, изток“, и ул. Трета в участък от о.т.7") == ["Ген. Гурко, изток", "Трета"]
    assert got("улицата е дълга") == [] and got(None) == []
    assert one(spark, "ул. Ген.Гурко", P.street_key(F.col("t")))[0] == one(spark, "ген. Гурко", P.street_key(F.col("t")))[0]


def test_resolve(spark):
    row = lambda c, e, s, lat, lon: (c, e, None, s, None, None, None, lat, lon, None, None)
    from ledgerlens import schemas

    parcels = spark.createDataFrame(
        [row("51500.1.1", "51500", None, 42.6, 27.7), row("51500.2.1", "51500", "ул. Лозарска", 42.600, 27.7), row("51500.2.2", "51500", "Лозарска", 42.604, 27.7), row("51500.2.3", "51500", "Лозарска", 42.606, 27.7), row("51500.3.1", "51500", "Първа", 42.6, 27.7), row("51500.3.2", "51500", "Първа", 42.7, 27.7), row("11538.2.1", "11538", "Втора", 42.8, 27.8), row("51500.4.1", "51500", "Втора", 42.8, 27.7)],
        schemas.PARCELS,
    )
    texts = spark.createDataFrame([(1, "обект в 51500.1.1, ул. Лозарска"), (2, "ремонт на ул. Лозарска"), (3, "ул. Първа"), (4, "ул. Втора"), (5, "nothing")], "id long, text string")
    candidates = texts.select("id").crossJoin(spark.createDataFrame([("51500",), ("11538",)], "ekatte string"))
    out = {r.id: (r.precision, r.place, r.lat) for r in P.resolve(texts, candidates, parcels, KNOWN).collect()}
    assert out == {1: ("parcel", "51500.1.1", 42.6), 2: ("street", "Лозарска", 42.604)}


def test_centroid(spark):
    ring = F.array(*[F.struct(F.lit(float(x)).alias("lon"), F.lit(float(y)).alias("lat")) for x, y in ((0, 0), (4, 0), (4, 2), (0, 2), (0, 0))])
    r = spark.range(1).select(P.ring_centroid(ring).alias("c")).first().c
    assert (r.lon, r.lat, r.area) == pytest.approx((2, 1, 8))


def test_register_fields(spark):
    assert one(spark, "в ликвидация", G.status(F.col("t")))[0] == "liquidation"
    assert one(spark, "5000 лв.", G.capital_eur(F.col("t")))[0] == pytest.approx(2556.46)
    assert one(spark, "2 500,50 евро", G.capital_eur(F.col("t")))[0] == 500.5
    assert tuple(one(spark, "41.20 Строителство на сгради", G.activity(F.col("t")))[0]) == ("41.20", "Строителство на сгради")
    assert tuple(one(spark, "Група по НКИД: 55.10 Клас по НКИД: Хотели", G.activity(F.col("t")))[0]) == ("55.10", "Хотели")
    assert one(spark, "Основано 2019. Финансов отчет Година: 2014, Година: 2015 г., вписан на 03.04.2022", G.last_report_year(F.col("t")))[0] == 2015
    assert one(spark, "вписан на 03.04.2022", G.last_report_year(F.col("t")))[0] is None


def test_name_resolution(spark):
    roster = ["Александър Стоянов Стоянов", "Венета Танева Танева - Кючукова", "Георги Димитров Георгиев", "Георги Манолов Манолов", "Иван Петров Иванов", "Иван Георгиев Иванов", "Иван Георгиев Стоянов", "Мария Мария", "Ана Илиева"]
    want = {
        "Александър Стоянов": "Александър Стоянов Стоянов", "Венета Танева-Кючукова": "Венета Танева Танева - Кючукова", "Георги Георгиев": "Георги Димитров Георгиев", "георги  МАНОЛОВ": "Георги Манолов Манолов",
        "Иван Иванов": None, "Иван Петров Стоянов": None, "Мария": None, "Георги Непознатов": None, "Ана Илиева": "Ана Илиева", "": None, "Иван Петров Иванов": "Иван Петров Иванов",
    }
    s = spark.createDataFrame([(n,) for n in want], "short_name string")
    r = spark.createDataFrame([(n,) for n in roster], "full_name string")
    assert {x.short_name: x.full_name for x in G.resolve_names(s, r).collect()} == want


def test_name_keys_are_not_broadcast(spark):
    """However small the estimate of the roster is, its many keys stay off the driver."""
    s = spark.createDataFrame([("Ана Илиева",)], "short_name string")
    r = spark.createDataFrame([("Ана Петрова Илиева",)], "full_name string")
    assert "Broadcast" not in G.resolve_names(s, r)._jdf.queryExecution().executedPlan().toString()


DECLARATION = """ДЕКЛАРАЦИЯ
„Преди“ ООД, ЕИК 999999999 – съдружник
ЧАСТ ВТОРА. УЧАСТИЕ В   ТЪРГОВСКИ ДРУЖЕСТВА
Попълва се само ако е приложимо.

1. „Алфа Турс“ ЕООД, ЕИК 147025511 – едноличен собственик и управител
2. "Инвест Ко" ООД 1234567891234, съдружник
3) Бета Строй АД, ЕИК 203000001
Гама ООД без знак
Задължения над 5 000 лв. към банки
Банка „Делта“ ЕАД – кредит 25 000 лв.
Кредит без сума
Договори с лица, които извършват дейност в области
„Техно Билд“ ООД, ЕИК 203456789, доставка
дребен ред
ЧАСТ ПЕТА. ДРУГИ ОБСТОЯТЕЛСТВА
Служебен номер 222222222, нищо общо с дружество."""


def test_declared_interests(spark):
    d = spark.createDataFrame([(1, DECLARATION), (2, ""), (3, None), (4, "„Алфа“ ЕООД, ЕИК 111111111")], "id long, text string")
    got = [(x.id, x.section, x.company_name, x.eik, x.relation) for x in N.declared_interests(d).orderBy("id", "pos").collect()]
    assert got == [
        (1, "company", "Алфа Турс ЕООД", "147025511", "едноличен собственик; управител"),
        (1, "company", "Инвест Ко ООД", "1234567891234", "съдружник"),
        (1, "company", "Бета Строй АД", "203000001", N.SHARE),
        (1, "debt", "Делта ЕАД", None, N.DEBT),
        (1, "contract", "Техно Билд ООД", "203456789", N.CONTRACT),
    ]
    one_ = d.where("id = 1").select(N.interests(F.col("text")).alias("i")).first().i
    assert [i.company_name for i in one_] == [g[2] for g in got] and one_[0].raw.startswith("1. „Алфа")


def test_people_of_deed_fields(spark):
    f = [
        ("1", "00070", "Румен Стоянов Дивов, Държава: БЪЛГАРИЯ РУМЕН СТОЯНОВ ДИМОВ, Държава: БЪЛГАРИЯ", 1),
        ("1", "00190", "АНА ИВАНОВА, Държава: СЕВЕРНА МАКЕДОНИЯ, Размер на дяловото участие: 50250.00 лв. ИВО ПЕТРОВ, Държава: БЪЛГАРИЯ, Размер на дяловото участие: 10,5 €", 1),
        ("1", "00230", '"ДАРЗАЛА ХОЛДИНГ" АД, ЕИК/ПИК 205127270', None),
        ("1", "00120", "Дата на изтичане на мандата: 01.02.2027 г. ЯН НОВАК, Държава: АТЛАНТИДА ПЕТЪР К, Държава: ЧЕШКА РЕПУБЛИКА", None),
        ("1", "00132", "Заличено обстоятелство", 1), ("1", "00140", "ИЗТРИТ ЧОВЕК, Държава: БЪЛГАРИЯ", 2), ("1", "00999", "НЕ Е ЧОВЕК, Държава: БЪЛГАРИЯ", 1),
    ]
    rows = G.people(spark.createDataFrame(f, "eik string, ident string, text string, op int")).collect()
    got = {(r.field_ident, r.name, r.share_text, r.person_eik) for r in rows}
    assert got == {
        ("00070", "Румен Стоянов Дивов", None, None), ("00070", "РУМЕН СТОЯНОВ ДИМОВ", None, None), ("00190", "АНА ИВАНОВА", "50250.00 лв.", None), ("00190", "ИВО ПЕТРОВ", "10,5 €", None),
        ("00230", '"ДАРЗАЛА ХОЛДИНГ" АД', None, "205127270"), ("00120", "ЯН НОВАК, Държава: АТЛАНТИДА ПЕТЪР К", None, None),
    }
    assert {r.role for r in rows} == {"manager", "partner", "sole_owner", "board_member"}


def test_text_functions(spark):
    assert one(spark, "12; 123456789012, x 0000000012", X.canonical_ids(F.col("t")))[0] == ["000000012", "123456789012", "0000000012"]
    assert one(spark, "1 234,5", X.parse_number(F.col("t")))[0] == 1234.5 and one(spark, "x", X.parse_number(F.col("t")))[0] is None
    assert one(spark, "http://a/b%20c.xls?x", X.basename(F.col("t")))[0] == "b c.xls"
    assert one(spark, "Ремонт на УЛИЦА 51500.1.1", X.tokens(F.col("t")))[0] == ["улица", "CAD:51500.1.1"]
    assert one(spark, "abcdef", X.truncate(F.col("t"), 4))[0] == "abc…" and one(spark, "Море", X.slug(F.col("t")))[0] != ""
