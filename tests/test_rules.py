"""Each rule fires and stays silent on synthetic rows; boundaries on both sides."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from ledgerlens import schemas
from ledgerlens.config import Thresholds, thresholds
from ledgerlens.rules import budget, companies, contracts, engine, splitting
from ledgerlens.rules.common import contracts_view

T = Thresholds()
NOW = dt.datetime(2026, 10, 7)


def net(y, m, d, h=12):
    return f"/Date({int(dt.datetime(y, m, d, h, tzinfo=dt.UTC).timestamp() * 1000)}+0300)/"


def row(i, source="eop", **kw):
    base = dict.fromkeys(schemas.PROCUREMENTS.fieldNames()) | {"id": i, "source": source, "source_id": str(i), "title": f"Contract {i}", "contractor_name": "Firm", "contractor_eik": "123456789", "contract_date": dt.datetime(2026, 5, 1)}
    raw = {"contract": kw.pop("contract", {}), "procedure": kw.pop("procedure", {}), "tender_detail": kw.pop("detail", {}), "sigma": kw.pop("sigma", None)}
    out = base | kw | {"raw": raw}
    for k in ("contract_value_eur", "contract_value_bgn", "estimated_value_eur"):
        if out[k] is not None:
            from decimal import Decimal

            out[k] = Decimal(str(out[k]))
    return out


@pytest.fixture(scope="module")
def view(spark):
    def make(*rows):
        return contracts_view(spark.createDataFrame([tuple(r[f] for f in schemas.PROCUREMENTS.fieldNames()) for r in rows], schemas.PROCUREMENTS))

    return make


def ids(df):
    return sorted(r.subject_id for r in df.collect())


def test_missing_value(view):
    assert ids(contracts.missing_value(view(row(1), row(2, contract_value_eur=0), row(3, contract_value_bgn=5), row(4, contractor_name=None, contract_date=None)), T)) == ["eop:1", "eop:2"]


def test_late_publication(view):
    at = lambda days: {"ContractDate": net(2026, 1, 1), "TedPublishDate": net(*(dt.date(2026, 1, 1) + dt.timedelta(days)).timetuple()[:3])}
    out = contracts.late_publication(view(*[row(k, contract=at(d)) for k, d in enumerate((37, 38, 45, 91))]), T).collect()
    assert {(r.subject_id, r.severity) for r in out} == {("eop:1", "info"), ("eop:2", "warning"), ("eop:3", "high")}
    assert {r.tier for r in out} == {"violation"}


def test_annexes(view):
    k = lambda a, b, c=1: {"ContractValue": a, "Currency": 1, "CurrentContractValue": b, "CurrentContractCurrency": c}
    v = view(row(1, contract=k(100.0, 110.0)), row(2, contract=k(100.0, 120.0)), row(3, contract=k(100.0, 160.0)), row(4, contract=k(100.0, 600.0)), row(5, contract=k(100.0, 400.0, 3)), row(6, contract=k(100.0, 120.0, 2)))
    assert ids(contracts.annex_growth(v, T)) == ["eop:2", "eop:5"]
    assert ids(contracts.annex_over_cap(v, T)) == ["eop:3"]


def test_single_bidder(view):
    out = contracts.single_bidder(view(row(1, bids_received=1, contract_value_eur=100_000), row(2, bids_received=1, contract_value_eur=99_999), row(3, bids_received=2, contract_value_eur=900_000), row(4, bids_received=1, contract_value_eur=500_000)), T).collect()
    assert {(r.subject_id, r.severity) for r in out} == {("eop:1", "warning"), ("eop:4", "high")}


def test_concentration(view):
    rows = [row(k, contract_value_eur=100) for k in range(3)] + [row(9, contractor_eik="987654321", contract_value_eur=1000), row(10, contract_value_eur=10_000, contract_date=dt.datetime(2020, 1, 1))]
    assert ids(contracts.contractor_concentration(view(*rows), F.lit(NOW), T)) == ["123456789"]
    assert ids(contracts.contractor_concentration(view(*rows[1:]), F.lit(NOW), T)) == []


def test_exceptional_procedure(view):
    p = "DirectNegotiation"
    rows = [row(1, procedure_type=p, contract={"TenderNumber": "A"}, contract_value_eur=600_000), row(2, "sigma", procedure_type=p, sigma={"unp": "A"}), row(3, "sigma", procedure_type=p, sigma={"unp": "B"}), row(4, procedure_type=p, cpv_code="09134000", contract_value_eur=600_000), row(5, procedure_type="OpenProcedure")]
    out = contracts.exceptional_procedure(view(*rows), T).collect()
    assert {(r.subject_id, r.severity) for r in out} == {("eop:1", "high"), ("sigma:3", "info"), ("eop:4", "info")}


def test_short_offer_deadline(view):
    d = lambda a, signed, end=None, p="OpenProcedure": dict(procedure_type=p, detail={"PublicationDate": net(*a), "OfferPhaseEndDate": end and net(*end)}, contract={"ContractDate": net(*signed)})
    rows = [row(1, **d((2026, 1, 1), (2026, 1, 15))), row(2, **d((2026, 1, 1), (2026, 2, 4))), row(3, **d((2026, 1, 1), (2026, 2, 5))), row(4, **d((2026, 1, 1), (2026, 3, 1), (2026, 1, 10))), row(5, **d((2023, 12, 1), (2023, 12, 5), None, "CollectingOffersWithNotice"))]
    out = contracts.short_offer_deadline(view(*rows), T).collect()
    assert {(r.subject_id, r.tier) for r in out} == {("eop:1", "violation"), ("eop:2", "signal"), ("eop:4", "violation"), ("eop:5", "signal")}


def test_sofia_date(view):
    assert str(view(row(1, contract={"ContractDate": net(2026, 9, 17, 21)})).first().signed_on) == "2026-09-18"


def test_bid_at_ceiling(view):
    est = lambda v: {"EstimatedValue": v, "Currency": 1}
    rows = [
        row(1, contract={"TenderNumber": "A"}, procedure=est(100_000.0), contract_value_eur=100_000),
        row(2, contract={"TenderNumber": "B"}, procedure=est(100_000.0), contract_value_eur=100_000),
        row(3, contract={"TenderNumber": "B"}, procedure=est(100_000.0), contract_value_eur=100_000),
        row(4, contract={"TenderNumber": "C"}, procedure=est(200_000.0), contract_value_eur=195_000),
        row(5, contract={"TenderNumber": "D"}, procedure=est(200_000.0), contract_value_eur=200_000),
        row(6, "sigma", sigma={"unp": "D"}, bids_received=4, contract_value_eur=200_000),
    ]
    assert ids(contracts.bid_at_ceiling(view(*rows), T)) == ["eop:1"]


def split_row(i, tender, day, value, cpv="30200000", title="Office paper", eik="123456789", p="CollectingOffersWithNotice"):
    return row(i, contract={"TenderNumber": tender, "TypeOfContract": 2, "ContractDate": net(*day)}, cpv_code=cpv, title=title, contractor_eik=eik, procedure_type=p, contract_value_eur=value, detail={"PublicationDate": net(*day)})


def test_splitting_and_near_threshold(view):
    rows = [split_row(1, "A", (2026, 1, 10), 30_000), split_row(2, "B", (2026, 2, 10), 30_000), split_row(3, "C", (2026, 1, 20), 30_000, cpv="50000000", eik="5"), split_row(4, "D", (2026, 3, 1), 50_000, eik="6", cpv="60000000")]
    v = view(*rows)
    groups = splitting.split_groups(v, T)
    out = splitting.splitting(groups, v, T).collect()
    assert len(out) == 1 and out[0].subject_id == "123456789" and '"eop:1","eop:2"' in out[0].details
    far = view(rows[0], split_row(2, "B", (2026, 12, 20), 30_000))
    assert splitting.split_groups(far, T).count() == 0  # a yearly renewal isn't a split
    near = contracts.near_threshold(v, T, splitting.split_subjects(groups)).collect()
    assert {(r.subject_id, r.severity) for r in near} == {("eop-tender:D", "info")}


def test_texts(view):
    d = lambda text: {"TenderName": "Supply of paper", "TenderDescription": text}
    k = {"TypeOfContract": 2}
    long = "A description that goes on about the needs of the schools and what the paper will be used for in them."
    rows = [row(1, contract=k, detail=d("<p>Supply</p>"), contract_value_eur=20_000), row(2, contract=k, detail=d(long), contract_value_eur=20_000), row(3, contract=k, detail=d("100 бр. папки"), contract_value_eur=20_000), row(4, contract=k, detail=d("по заявка"), contract_value_eur=20_000), row(5, contract=k, detail=d(""), contract_value_eur=19_999)]
    v = view(*rows)
    none = v.sparkSession.createDataFrame([], schemas.LEDGER_LINES)
    assert ids(contracts.price_unverifiable(v, T)) == ["eop:1"]
    assert ids(contracts.missing_quantity(v, budget.objects(none), T)) == ["eop:2"]


def ledger(spark, *rows):
    names = schemas.LEDGER_LINES.fieldNames()
    from decimal import Decimal

    full = []
    for period, para, name, est, prior, plan, spent in rows:
        d = dict.fromkeys(names) | {"period": period, "unit": "Общо", "row_type": "object", "paragraph": para, "object_name": name}
        d |= {k: None if v is None else Decimal(v) for k, v in zip(("estimated_total", "spent_prior", "plan_current", "spent_period"), (est, prior, plan, spent))}
        full.append(tuple(d[n] for n in names))
    return budget.objects(spark.createDataFrame(full, schemas.LEDGER_LINES))


def test_budget_rules(spark):
    obj = ledger(spark, ("2025-03", "5100", "Road", None, None, 100_000, 0), ("2025-06", "5100", "Road", None, None, 250_000, 0), ("2025-06", "5200", "Truck", None, None, 0, 10_000), ("2025-06", "5200", "Lamp", 5_000, 5_000, 100_000, 120_000), ("2025-06", "5300", "Hall", 0, 0, 100_000, 112_001), ("2025-06", "5300", "Park", 0, 0, 300_000, 0))
    assert ids(budget.unplanned_spending(budget.year_end(obj), T)) == ["5200:Lamp", "5200:Truck"]
    assert ids(budget.overspend(budget.latest(obj), T)) == ["5300:Hall"]
    keys = sorted(r.subject_key for r in budget.plan_jump(obj, T).collect())
    assert keys == ["5100:Road:2025-03->2025-06", "5300:Park:new"]


def test_unmatched_spending(spark, view):
    obj = ledger(spark, ("2025-06", "5100", "Renovation of the harbour promenade", 0, 0, 100_000, 90_000), ("2025-06", "5100", "Swimming pool", 0, 0, 100_000, 90_000))
    v = view(row(1, title="Renovation of the harbour promenade", contract_value_eur=100_000))
    assert ids(budget.unmatched_spending(budget.latest(obj), v, T)) == ["5100:Swimming pool"]


def test_missing_reports(spark):
    t = thresholds({"RULES_REPORTS_FROM": '"2025-01"'})
    reports = spark.createDataFrame([(i, p, k, None, None, None) for i, (p, k) in enumerate([("2025-01", "B1"), ("2025-03", "B3"), ("2025-02", "OTHER")])], schemas.REPORTS)
    out = budget.missing_reports(reports, F.lit(dt.datetime(2026, 4, 1)), t).collect()
    assert sorted(r.subject_id for r in out) == ["annual:2025"] + [f"report:{p}" for p in ("2025-02", *(f"2025-{m:02}" for m in range(4, 12)), "2026-01", "2026-02")]
    before = budget.missing_reports(reports, F.lit(dt.datetime(2026, 3, 31)), t).collect()
    assert "report:2025-12" in {r.subject_id for r in before} and not any(r.subject_id.startswith("annual") for r in before)
    assert budget.missing_reports(reports.where("false"), F.lit(NOW), t).count() == 0


def company(eik, **kw):
    d = dict.fromkeys(schemas.COMPANIES.fieldNames()) | {"eik": eik, "name": f"Firm {eik}", "last_annual_report_year": 2025} | kw
    return tuple(d.values())


def test_company_rules(spark, view):
    c = spark.createDataFrame([company("200000001", registered_at=dt.datetime(2026, 1, 1), nkid_code="56.10"), company("100000002", status="insolvency"), company("100000003", last_annual_report_year=2020)], schemas.COMPANIES)
    people = spark.createDataFrame([(e, n, n, r, None, None, None, True) for e, n, r in [("200000001", "ana maria petrova", "manager"), ("100000002", "ana maria petrova", "owner"), ("100000003", "ivo ivov", "owner")]], schemas.COMPANY_PEOPLE)
    off = spark.createDataFrame([("Ana", "ana maria petrova", "mayor", "2023", None, None, [("Firm 100000003", None, None, None)]), ("Ivo", "ivo ivov", "mayor", "2023", None, None, [])], schemas.OFFICIALS)
    v = view(row(1, contractor_eik="200000001; 100000002", contract_value_eur=100_000, cpv_code="45000000"), row(2, contractor_eik="100000003", contract_value_eur=100_000), row(3, contractor_eik="100000002", contract_value_eur=49_999))
    assert sorted(r.subject_key for r in companies.young_company(v, c, T).collect()) == ["eop:1:200000001"]
    assert sorted(r.subject_key for r in companies.activity_mismatch(v, c, T).collect()) == ["eop:1:200000001"]
    assert {(r.subject_id, r.severity) for r in companies.company_status(v, c, F.lit(NOW), T).collect()} == {("100000002", "high"), ("100000003", "warning")}
    out = {(r.subject_id, r.severity) for r in companies.related_party(v, c, people, off, T).collect()}
    assert out == {("200000001", "high"), ("100000002", "high"), ("100000003", "high")}
    assert [r.subject_id for r in companies.person_concentration(v, c, people, T).collect()] == ["person:ana maria petrova"]


def test_engine_and_lifecycle(spark, view):
    rows = [row(1, procedure={"IsEUFinanced": True}), row(2, contract_value_eur=5)]
    tables = {"procurements": spark.createDataFrame([tuple(r[f] for f in schemas.PROCUREMENTS.fieldNames()) for r in rows], schemas.PROCUREMENTS), "ledger": spark.createDataFrame([], schemas.LEDGER_LINES), "reports": spark.createDataFrame([], schemas.REPORTS), "companies": spark.createDataFrame([], schemas.COMPANIES), "people": spark.createDataFrame([], schemas.COMPANY_PEOPLE), "officials": spark.createDataFrame([], schemas.OFFICIALS)}
    flags = engine.run_all(tables, T, F.lit(NOW)).cache()
    assert sorted((r.rule, r.subject_key) for r in flags.collect()) == [("eu_funded_irregularity", "eop:1"), ("missing_value", "eop:1")]
    empty = flags.where("false").select("*", *[F.lit(None).cast("timestamp").alias(c) for c in ("first_seen_at", "last_seen_at", "resolved_at")])
    first = engine.update_store(empty, flags, F.lit(NOW))
    assert {r.change for r in first.collect()} == {"new"}
    second = engine.update_store(first.drop("change"), flags.where("rule = 'missing_value'"), F.lit(NOW + dt.timedelta(7)))
    assert {(r.rule, r.change) for r in second.collect()} == {("missing_value", "updated"), ("eu_funded_irregularity", "resolved")}
    idle = engine.update_store(first.drop("change"), flags.where("false"), F.lit(NOW), ran=["missing_value"])
    assert {(r.rule, r.change) for r in idle.collect()} == {("missing_value", "resolved"), ("eu_funded_irregularity", "unchanged")}
    again = engine.update_store(second.drop("change"), flags, F.lit(NOW + dt.timedelta(14))).where("rule = 'eu_funded_irregularity'").first()
    assert again.change == "updated" and again.resolved_at is None and again.first_seen_at == NOW


def test_thresholds_from_environment():
    t = thresholds({"RULES_WORKS_BANDS_BGN": "[[1, 2]]", "RULES_YOUNG_DAYS": "7", "OTHER": "1"})
    assert t.works_bands_bgn == ((1, 2),) and t.young_days == 7
