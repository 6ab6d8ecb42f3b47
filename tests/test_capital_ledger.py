"""Capital ledgers: shifted columns, funding groups by header or by place, totals that feed the subtotal check."""

import pytest

from ledgerlens.sources import grids as G
from ledgerlens.sources.readers import CELLS

GROUPS = ["Целеви субсидии", "Преходен остатък", "Собствени средства", "Други", "Средства от ЕС"]
SUBS = ["основание", "План", "в т.ч. план", "Отчет", "в т.ч. аванс", "основание", "план", "отчет", "план", "отчет", "вид", "план", "отчет", "програма", "план", "отчет"]
PLACES = [0, 5, 8, 10, 13]


def grid(shift=0, headers=True, currency="Сумите са в лева"):
    """Rows of (column, value); the ledger moved shift columns to the right."""
    head = ["§", "Информация за наименованието на обекта", "Година начало - край", "Сметна стойност", "Усвоено до края на 2021", "Уточнен план 2022", "Усвоено към 30.06.2022"]
    rows = [[(0, "План/отчет за периода: 2022 юни")], [(1, currency)], []]
    top = [(shift + k, t) for k, t in enumerate(head)]
    names = [(shift + 7 + at, g) for at, g in zip(PLACES, GROUPS)] if headers else []
    rows += [top + names, [(shift + 7 + k, s) for k, s in enumerate(SUBS)] if headers else []]
    line = lambda code, name, *values: [(shift + k, v) for k, v in ((0, code), (1, name)) if v is not None] + [(shift + 3 + k, v) for k, v in enumerate(values) if v is not None]
    rows += [
        line("", "above the total"), line(None, "ОБЩО", "3911.66"), line("5200", "Придобиване", "3911.66"), line("Функция 06", "Жилищно", "3911,66"), line("5201", "Компютри", "1955.83"),
        line(None, "Обект"), line("5219", "not an object"), line("0606", "Компютри за школата", "1955.83", None, "195.583", "0", "ПМС 1", "100", "50", "20", "10", None, None, None, "95.583", "7"),
        line("0607", "Сървър", "1 955,83", None, "391.166"), line(None, "забележка"), line("xx", "odd"), line("Функция 07", "Култура", "500"),
    ]
    return [(r, c, v) for r, row in enumerate(rows) for c, v in row]


def frame(spark, *files):
    return spark.createDataFrame([(name, sheet, r, c, v) for name, sheet, cells in files for r, c, v in cells], CELLS)


@pytest.mark.parametrize(("shift", "headers"), [(0, True), (0, False), (2, True), (3, False)])
def test_ledger(spark, shift, headers):
    rows = G.capital_ledger(frame(spark, ("f", "Общо", grid(shift, headers)))).orderBy("source_row").collect()
    got = [(r.row_type, r.paragraph, r.function_code, r.subparagraph, r.object_code, r.object_name) for r in rows]
    assert got == [
        ("grand_total", None, None, None, "ОБЩО", "ОБЩО"), ("paragraph_subtotal", "5200", None, None, None, "Придобиване"), ("function_subtotal", "5200", "06", None, None, "Жилищно"),
        ("subparagraph_subtotal", "5200", "06", "5201", None, "Компютри"), ("subparagraph_subtotal", "5200", "06", "5219", None, "not an object"), ("object", "5200", "06", "5219", "0606", "Компютри за школата"),
        ("object", "5200", "06", "5219", "0607", "Сървър"), ("function_subtotal", "5200", "07", None, None, "Култура"),
    ]
    o = rows[5]
    assert (o.period, o.unit, o.currency, o.source_row, float(o.estimated_total), float(o.plan_current), o.spent_prior) == ("2022-06", "Общо", "BGN", 13, 1000.0, 100.0, None)
    f = {x.group: (x.note, *(None if v is None else float(v) for v in (x.plan, x.plan_subset, x.actual, x.actual_subset))) for x in o.funding}
    assert f["targeted_subsidies"] == ("ПМС 1", 51.13, 25.56, 10.23, 5.11)
    assert f["own_funds"] == (None, 48.87, None, 3.58, None)
    assert rows[6].funding is None and rows[2].funding is None


def test_group_labels_and_currency(spark):
    cells = [c for c in grid(currency="Сумите са в EUR!") if c[2] != "5219" and c[2] != "not an object"]
    rows = {r.object_code: r for r in G.capital_ledger(frame(spark, ("f", "Общо", cells))).where("row_type = 'object'").collect()}
    assert rows["0606"].group_label == "Обект" and rows["0606"].currency == "EUR" and float(rows["0606"].estimated_total) == 1955.83


def test_subtotals_and_unread_sheets(spark):
    cells = frame(spark, ("f", "Общо", grid()), ("f", "Бележки", [(0, 0, "text")]), ("f", "Празен", [c for c in grid() if c[2] != "ОБЩО"]), ("g", "Общо", grid(1)))
    off = {(r.file, r.function_code, float(r.subtotal), float(r.summed)) for r in G.function_mismatches(G.capital_ledger(cells)).collect()}
    assert off == {(f, "07", 255.65, 0.0) for f in "fg"}
    assert {(r.file, r.sheet, r.reason) for r in G.unread_sheets(cells).collect()} == {("f", "Бележки", "no header"), ("f", "Празен", "no grand total")}
