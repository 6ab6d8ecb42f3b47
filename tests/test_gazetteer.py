"""The automaton against the expression over the same names, and with thousands of them."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import gazetteer, places

ALIASES = [("n", "Созопол"), ("n", "гр. Созопол"), ("sb", "к.к. Слънчев бряг"), ("sb", "Слънчев бряг"), ("sv", "Свети Влас"), ("sv", "св. Влас"), ("r", "Равда"), ("b", "Баня"), ("bb", "Баня Бряг"), ("x", "a+b")]
EKATTE = {"51500": "n", "11538": "sv"}
TEXTS = [
    None, "", "Созопол", "община Созопол", "Община  Созопол и Равда", "общ. Созопол, гр.Созопол", "СОЗОПОЛ-Равда", "кк Слънчев бряг", "к. к.  Слънчевбряг", "слънчев  бряг", "св.Влас; Свети\nВлас", "Равдата Равда2 _Равда Равда",
    "Баня Бряг Баня", "Баня. Бряг", "баня бря", "ПИ 51500.505.12 и 11538.1.2", "51500.505", "x51500.1.2", "99999.1.2 Равда", "A+B a+bc", "Сл.ънчев бряг",
]


@pytest.mark.parametrize("municipal", [None, "Созопол"])
def test_same_as_the_expression(spark, municipal):
    rng = random.Random(5)
    pieces = [t for t in TEXTS if t] + [" ", ", ", ".", "гр.", "община ", "общ.", "и"]
    texts = TEXTS + ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 6))) for _ in range(300)]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    both = df.select("k", "t", places.settlements(F.col("t"), ALIASES, EKATTE, municipal).alias("a"), gazetteer.settlements_of_many("t", ALIASES, EKATTE, municipal).alias("b")).collect()
    assert [(r.t, r.a) for r in both] == [(r.t, r.b) for r in both]


def test_thousands_of_names_on_documents(spark):
    """Words of the documents themselves as 5,000 names; every tenth document by the expression in turns of 500 names would be slow, so single names are checked."""
    from pathlib import Path

    folder = Path("/root/testdata/sf0.001")
    if not folder.exists():
        pytest.skip("no test tables")
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    words = sorted({w for r in docs.collect() for w in (r.text or "").lower().split() if w.isalpha() and len(w) > 3})[:5000]
    aliases = [(w, w) for w in words]
    out = docs.select("doc_id", "text", gazetteer.settlements_of_many("text", aliases).alias("found"))
    small = docs.select(gazetteer.settlements_of_many("text", aliases[:3]).alias("found"))
    plans = [len(d._jdf.queryExecution().optimizedPlan().toString()) for d in (out.select("found"), small)]
    assert abs(plans[0] - plans[1]) < 50  # the plan doesn't grow with the names
    known = set(words)
    import re

    for r in out.collect():
        want = list(dict.fromkeys(w for w in re.findall(r"\w+", (r.text or "").lower()) if w in known))
        assert [f for f in r.found] == want
