"""Suffix statistics cover all labelled urls, whatever the trees are fitted on."""

import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import url_filter


def test_suffix_rates_do_not_depend_on_the_sample(spark):
    rows = [(f"https://h{k}.x{k % 30}/{k}", f"h{k}.x{k % 30}", f"/{k}", "block" if k % 30 < 10 else "allow") for k in range(300)]
    urls = spark.createDataFrame(rows, "url string, host string, path string, verdict string")
    small, whole = (url_filter.fit(urls, n) for n in (20, 1000))
    rates = [dict(map(tuple, m.suffixes.select("suffix", F.round("rate", 9)).collect())) for m in (small, whole)]
    assert small.prior == pytest.approx(1 / 3) and rates[0] == rates[1] and len(rates[0]) == 330


def test_own_label_is_left_out(spark):
    """One suffix for all, labels that nothing tells: the fit can't read them off the statistics."""
    rows = [(f"https://h.s/{k:03d}", "h.s", f"/{k:03d}", "block" if (k * 37) % 10 < 7 else "allow") for k in range(400)]
    urls = spark.createDataFrame(rows, "url string, host string, path string, verdict string")
    model = url_filter.fit(urls)
    scores = url_filter.with_suffix_rates(url_filter.with_lexical(urls), model.suffixes, model.prior).select(model.score().alias("p"), (F.col("verdict") == "block").cast("int").alias("y"))
    r = scores.agg(F.avg((F.col("p") >= 0.5).cast("int")).alias("said"), F.avg("y").alias("y")).first()
    assert r.y > 0.65 and r.said > 0.9  # the frequent verdict, not the labels turned round


def test_held_out_accuracy(spark):
    rows = [(k, f"https://x{k}.{'com/de' if k % 3 else 'com/fr'}/{'p' * (k % 5)}{k}") for k in range(400)]
    r = url_filter.held_out_accuracy(spark.createDataFrame(rows, "page_id long, url string")).first()
    assert 40 < r.n < 140 and r.accuracy >= r.majority - 0.1
    assert url_filter.held_out_accuracy(spark.createDataFrame([], "page_id long, url string")).first().n == 0
