"""Suffix statistics of all labelled URLs, and trees at the true mix of labels."""

from math import log

import pytest

from tidewright.llm import url_filter


def test_all_suffixes_and_the_true_mix(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "SAMPLE", 100)
    rows = spark.range(3000).selectExpr("id AS _key", "concat('http://h', id % 1500, '.org/p') AS _url", "cast(id % 1500 < 150 AS int) AS _label")
    trees, statistics = url_filter.fit(url_filter._parsed(rows))
    assert statistics[1].count() == 1500 and statistics[0].select("times").first()[0] == pytest.approx(log(3001))
    assert trees.base == pytest.approx(log(300 / 2700))
