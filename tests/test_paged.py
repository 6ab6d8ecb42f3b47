"""The paging source: stop rules, failures as rows, what is pushed down."""

import json

import pytest

from ledgerlens.sources import paged


@pytest.fixture
def pages(spark, tmp_path):
    def land(resource, *bodies):
        for k, body in enumerate(bodies):
            folder = tmp_path / f"resource={resource}" / f"start={k * 2 + 1}"
            folder.mkdir(parents=True)
            (folder / "page.json").write_text(body if isinstance(body, str) else json.dumps(body))

    return land, lambda **o: paged.read_pages(spark, path=f"file://{tmp_path}", pagesize="2", **o)


def page(*items, more=None, count=None):
    return {"CurrentPageResults": list(items), "HasMoreResults": more, "ResultsCount": count}


def test_stop_rules_and_failures(pages):
    land, read = pages
    land("a", page(1, 2, more=True), page(3, more=False), page(99))
    land("b", page(1, 2, more=True), page(more=True), page(99))
    land("c", page(1, 2, count=4), page(3, 4, count=4), page(99))
    land("d", page(1, 2), page(3), page(99))
    land("e", page(1, 2, more=True), "{broken", page(99))
    land("f", page(1, 2, more=True))
    land("g", "[1]")
    got = {}
    for r in read(retries="1").collect():
        got.setdefault(r.resource, []).append(r.failure.split(":")[0] if r.failure else int(r.item))
    assert {k: got[k] for k in "abcd"} == {"a": [1, 2, 3], "b": [1, 2], "c": [1, 2, 3, 4], "d": [1, 2, 3]}
    assert got["e"] == [1, 2, "JSONDecodeError"] and got["f"] == [1, 2, "FileNotFoundError"] and got["g"] == ["not an object"]


def test_filters_choose_what_is_asked_for(pages):
    land, read = pages
    for name in ("a", "b", "c"):
        land(name, page(1, 2, more=True), page(3, 4, more=True), page(5, more=False))
    chosen = read().where("resource IN ('a', 'c') AND page <= 2")
    assert sorted((r.resource, r.page, r.item) for r in chosen.collect()) == [(n, p, str(2 * p - 1 + k)) for n in ("a", "c") for p in (1, 2) for k in (0, 1)]
    assert chosen.rdd.getNumPartitions() == 2
    assert read().where("resource = 'none'").count() == 0
    assert read(resources="b", maxPages="1").count() == 2
    assert read().where("item = '5'").count() == 3  # what isn't pushed down is filtered after


def test_pushed_filters():
    from pyspark.sql.datasource import EqualTo, GreaterThan, In, LessThan

    r = paged.PagedReader({})
    rest = [GreaterThan(("page",), 1), EqualTo(("item",), "x")]
    assert list(r.pushFilters([In(("resource",), ("a", "b")), EqualTo(("resource",), "b"), LessThan(("page",), 4), *rest])) == rest
    assert r.chosen == {"b"} and r.last_page == 3
