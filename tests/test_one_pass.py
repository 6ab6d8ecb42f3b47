"""Rules by decorator, the one pass over contracts, twins from facts, and sources on every finding."""

import datetime as dt

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerlens import schemas
from ledgerlens.config import Thresholds
from ledgerlens.rules import contracts, engine
from ledgerlens.rules.registry import RULES, Facts, Registry, evaluate
from tests.test_rules import NOW, T, company, net, row, split_row, view  # noqa: F401


def test_own_rules_by_decorator(view):  # noqa: F811
    own = Registry()

    @own.row_rule("round_value")
    def round_value(t):
        return contracts.on_contract("round_value", F.col("eur") % 1000 == 0, F.lit("info"), F.lit("round"), F.array())

    by_firm = Facts("firm", lambda t: {"firm": F.col("contractor_eik")}, lambda rows, t: rows.withColumn("of_firm", F.count(F.lit(1)).over(Window.partitionBy("firm"))))

    @own.row_rule("busy_firm", facts=by_firm, settle=lambda f, t: F.when(F.col("of_firm") > 1, f))
    def busy_firm(t):
        return contracts.on_contract("busy_firm", F.lit(True), F.lit("info"), F.lit("busy"), F.array())

    @own.table_rule("many", reads=("contracts", "least"))
    def many(rows, least, t):
        return contracts.findings(rows.agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least), "many", severity=F.lit("info"), message=F.lit("many"), subject_type="all", subject_id=F.lit("all"))

    @own.table_rule("any", reads=("findings",))
    def any_(flags, t):
        return contracts.findings(flags.select("rule").distinct(), "any", severity=F.lit("info"), message=F.col("rule"), subject_type="rule", subject_id=F.col("rule"))

    v = view(row(1, contract_value_eur=5000), row(2, contract_value_eur=5), row(3, contractor_eik="1", contract_value_eur=7))
    out = own.run({"contracts": v, "least": 3}, T)
    assert sorted((r.rule, r.subject_id) for r in out.collect()) == [("any", "busy_firm"), ("any", "many"), ("any", "round_value"), ("busy_firm", "eop:1"), ("busy_firm", "eop:2"), ("many", "all"), ("round_value", "eop:1")]
    assert {r.rule for r in own.run({"contracts": v, "least": 4}, T, only=["many", "round_value"]).collect()} == {"round_value"}
    assert busy_firm(v, T).count() == 2 and own.names() == ("round_value", "busy_firm", "many", "any")
    with pytest.raises(ValueError):
        own.row_rule("round_value")(round_value.build)


def test_one_scan_and_one_shuffle(view):  # noqa: F811
    """All rules on contracts together read the table once and move it by one key."""
    plan = evaluate(view(row(1)), RULES.row_rules.values(), T)._jdf.queryExecution().executedPlan().toString()
    assert len(RULES.row_rules) == 11
    assert plan.count("Scan ") == 1 and plan.count("Exchange ") == 1
    alone = evaluate(view(row(1)), [r for r in RULES.row_rules.values() if r.facts is None], T)._jdf.queryExecution().executedPlan().toString()
    assert alone.count("Scan ") == 1 and "Exchange" not in alone


def test_findings_are_compiled(view):  # noqa: F811
    """No lambda holds a finding or a source: what stands inside one is interpreted row by row."""
    plan = evaluate(view(row(1)), RULES.row_rules.values(), T)._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in plan.split("lambdafunction(")[1:] if x.startswith("isnotnull(lambda x") and "struct" in x[:200]]
    assert "filter(array(if" not in plan and "filter(array(CASE" not in plan and "filter(array(struct" not in plan


def test_findings_without_facts_stay_out_of_the_shuffle(spark, view):  # noqa: F811
    """contract_rules moves what facts need and candidates as far as they are asked for; evaluated apart, the findings are the same."""
    from ledgerlens.plans.registry_queries import QUERIES

    def nodes(p):
        yield p
        for i in range(p.children().size()):
            yield from nodes(p.children().apply(i))

    plan = QUERIES["contract_rules"][0](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan()
    moved = [n for n in nodes(plan) if n.nodeName() == "RepartitionByExpression"]
    columns = {str(m.output().apply(i).name()): str(m.output().apply(i).dataType().simpleString()) for m in moved for i in range(m.output().size())}
    assert len(moved) == 1 and not [c for c in columns if c.startswith(("__found", "__message", "__details"))]
    assert not [c for c, kind in columns.items() if "fields" in kind or "label" in kind]

    k = lambda n, **x: {"contract": {"TenderNumber": n}, "contract_value_eur": 600_000, "bids_received": 1, "procedure_type": "DirectNegotiation"} | x
    s = lambda i, n, **x: row(i, "sigma", sigma={"unp": n}, **({"contract_value_eur": 600_000, "procedure_type": "DirectNegotiation"} | x))
    estimated = {"procedure": {"EstimatedValue": 600_000.0, "Currency": 1}}
    rows = [row(1, **k("A")), row(2, **k("A", contract_value_eur=None)), s(3, "A"), s(4, "B"), row(5, **k(None)), row(6, **k("C", bids_received=None), **estimated), s(7, "C", bids_received=0), row(8, **k("D", source=None)), s(9, None)]
    together, apart = ([tuple(r) for r in evaluate(view(*rows), RULES.row_rules.values(), T, apart=x).collect()] for x in (False, True))
    assert sorted(map(str, together)) == sorted(map(str, apart))
    exceptional = [r[5] for r in apart if r[0] == "exceptional_procedure"]
    assert sorted(exceptional) == ["eop:1", "eop:2", "eop:5", "eop:6", "sigma:4", "sigma:9"]
    assert [s.kind for r in apart if r[0] == "bid_at_ceiling" for s in r[9]] == ["eop_contract", "eop_tender", "sigma"]
    kinds = evaluate(view(*rows), RULES.row_rules.values(), T, apart=True, of=lambda f: F.struct(f["rule"].alias("rule"), f["subject_id"].alias("id"), f["sources"]["kind"].alias("kinds"))).collect()
    assert sorted((r.rule, r.id, r.kinds) for r in kinds) == sorted((r[0], r[5], [x.kind for x in r[9]]) for r in together)


def test_partitions_grow_with_the_rows(spark):
    from ledgerlens.storage import dealt

    rows = spark.range(1000)
    assert dealt(rows, "id", 100).rdd.getNumPartitions() == 80 and dealt(rows, "id", 1 << 20).count() == 1000
    assert sorted(r.id for r in dealt(rows, "id", 100).collect()) == list(range(1000))


def test_twins_by_facts(view):  # noqa: F811
    """The closest value of one tender and contractor; a lone one in any case, else within two per cent."""
    k = lambda n: {"contract": {"TenderNumber": n}}
    s = lambda i, n, v: row(i, "sigma", sigma={"unp": n}, contract_value_eur=v)
    rows = [row(1, **k("A"), contract_value_eur=100), s(11, "A", 900), row(2, **k("B"), contract_value_eur=100), s(12, "B", 101), s(13, "B", 99), s(14, "B", 100.5)]
    rows += [row(3, **k("C"), contract_value_eur=100), s(15, "C", 90), s(16, "C", 110), row(4, **k("D"), contract_value_eur=100), s(18, "D", 100), s(17, "D", 100), row(5, contract_value_eur=1), row(6, **k("E"), contractor_eik="5", contract_value_eur=1), s(19, "E", 1)]
    rows += [row(7, **k("F"), contract_value_eur=100), s(21, "F", 99), s(20, "F", 101)]
    got = {(r.eop, r.sigma) for r in contracts.twins(view(*rows), T).collect()}
    assert got == {("eop:1", "sigma:11"), ("eop:2", "sigma:14"), ("eop:4", "sigma:17"), ("eop:7", "sigma:20")}


def test_every_finding_has_sources(spark, view):  # noqa: F811
    from decimal import Decimal

    long = "A description that goes on about the needs of the schools and what the paper will be used for in them."
    k = lambda **x: {"TenderNumber": "T", "TypeOfContract": 2, "ContractDate": net(2026, 1, 1)} | x
    rows = [
        row(1, contract=k(TenderNumber="A", TedPublishDate=net(2026, 6, 1))),
        row(2, contract=k(TenderNumber="B", ContractValue=100.0, Currency=1, CurrentContractValue=130.0, CurrentContractCurrency=1), contract_value_eur=100_000, bids_received=1, procedure={"IsEUFinanced": True, "EstimatedValue": 100_000.0, "Currency": 1}, procedure_type="DirectNegotiation"),
        row(3, contract=k(TenderNumber="C", ContractValue=100.0, Currency=1, CurrentContractValue=160.0, CurrentContractCurrency=1), detail={"TenderDescription": long}, contract_value_eur=30_000),
        row(4, contract=k(TenderNumber="D"), detail={"TenderDescription": "x", "PublicationDate": net(2025, 12, 30)}, procedure_type="OpenProcedure", contract_value_eur=30_000),
        row(5, "sigma", sigma={"unp": "B", "eu_funded": True}, contract_value_eur=100_000, bids_received=1),
        split_row(6, "G", (2026, 1, 10), 30_000, eik="6"),
        split_row(7, "H", (2026, 2, 10), 50_000, eik="6"),
        row(8, contractor_eik="200000008", contract_value_eur=90_000, cpv_code="45000000", contract=k(TenderNumber="I")),
        row(9, contractor_eik="100000009", contract_value_eur=150_000, contract=k(TenderNumber="J")),
    ]
    ledger = []
    for period, para, name, plan, spent in (("2025-03", "5100", "Road", 100_000, 0), ("2025-06", "5100", "Road", 250_000, 260_000), ("2025-06", "5200", "Truck", 0, 30_000), ("2025-06", "5300", "Hall", 300_000, 330_000)):
        d = dict.fromkeys(schemas.LEDGER_LINES.fieldNames()) | {"report_id": int(period[-1]), "period": period, "unit": "Общо", "row_type": "object", "paragraph": para, "object_name": name, "plan_current": Decimal(plan), "spent_period": Decimal(spent), "currency": "EUR"}
        ledger.append(tuple(d.values()))
    reports = [(3, "2025-03", "CAPITAL", "http://x/a.xlsx", None, None), (6, "2025-06", "CAPITAL", "http://x/b.xlsx", None, None), (7, "2025-01", "B1", "http://x/c.xls", None, None)]
    people = [(e, "ana maria petrova", "ana maria petrova", "manager", None, None, None, True) for e in ("200000008", "100000009")]
    tables = {
        "procurements": spark.createDataFrame([tuple(r[f] for f in schemas.PROCUREMENTS.fieldNames()) for r in rows], schemas.PROCUREMENTS),
        "ledger": spark.createDataFrame(ledger, schemas.LEDGER_LINES),
        "reports": spark.createDataFrame(reports, schemas.REPORTS),
        "companies": spark.createDataFrame([company("200000008", registered_at=dt.datetime(2025, 12, 1), nkid_code="56.10"), company("100000009", status="insolvency")], schemas.COMPANIES),
        "people": spark.createDataFrame(people, schemas.COMPANY_PEOPLE),
        "officials": spark.createDataFrame([("Ana", "ana maria petrova", "mayor", "2023", None, "http://d", [])], schemas.OFFICIALS),
    }
    flags = engine.run_all(tables, Thresholds(concentration_count=1, concentration_share=0.01, reports_from="2025-01", reports_page="http://x/reports"), F.lit(NOW)).collect()
    assert {r.rule for r in flags} == set(RULES.names())
    for r in flags:
        assert r.sources and all(s.kind and s.label for s in r.sources), r.rule
    by = {r.rule: r for r in flags}
    assert [s.kind for s in by["eu_funded_irregularity"].sources if s.kind != "flag"] == ["eop_tender", "sigma"]
    assert {"flag"} < {s.kind for s in by["eu_funded_irregularity"].sources}
    assert [s.label for s in by["splitting"].sources] == ["contract 6 of G", "contract 7 of H"]
    assert {s.kind for s in by["related_party"].sources} == {"registry", "declaration", "eop_contract"}
    jump = next(r for r in flags if r.rule == "plan_jump" and "->" in r.subject_key)
    assert [(s.period, s.file) for s in jump.sources] == [("2025-03", "a.xlsx"), ("2025-06", "b.xlsx")]
    new = next(r for r in flags if r.subject_key == "5300:Hall:new")
    assert [(s.period, s.file) for s in new.sources] == [("2025-03", "a.xlsx"), ("2025-06", "b.xlsx")] and new.sources[0].note == "Not in this file: Hall"
    missing = next(r for r in flags if r.subject_key == "report:2025-03")
    assert missing.sources[0].kind == "reports_page" and missing.sources[0].url == "http://x/reports" and "a.xlsx" in missing.sources[0].note
    near = next(r for r in flags if r.rule == "near_threshold")
    assert near.severity == "warning" and near.sources[0].label == "contract 7 of H"
    ceiling = next(r for r in flags if r.rule == "bid_at_ceiling")
    assert [s.kind for s in ceiling.sources] == ["eop_contract", "eop_tender"]
