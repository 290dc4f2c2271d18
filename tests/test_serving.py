"""Views of results, class reports, grids and counters."""

import pytest

from tidewright.operators import metrics, serving


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_views(spark):
    df = spark.createDataFrame
    results, ranking = df([("a", 0.2), ("b", 0.3)], "model string, map double"), df([("a", 2), ("b", 1)], "model string, rank long")
    found = serving.models(results, ranking)
    assert rows(found) == [("a", 0.2, 2, False), ("b", 0.3, 1, True)]
    assert serving.model(found, "b").first()["rank"] == 1
    with pytest.raises(KeyError):
        serving.model(found, "c")
    with pytest.raises(Exception, match="no rank of b"):
        serving.models(results, ranking.where("model = 'a'")).collect()
    sizes, classes = df([("a", "small", 0.1), ("a", "large", 0.4)], "model string, size string, map double"), df([("b", "x", 0.5)], "model string, class string, map double")
    out = serving.evaluation(results, sizes, classes, "a").first()
    assert [tuple(x) for x in out["sizes"]] == [("large", 0.4), ("small", 0.1)] and out["classes"] is None
    splits = df([("train", "s1"), ("train", "s2"), ("test", "s3")], "split string, source_group_id string")
    one = serving.project(splits, results).first()
    assert {k: tuple(v) for k, v in one["splits"].items()} == {"train": (2, 2), "test": (1, 1)} and one["models"] == 2
    log = df([("r", 1, 0.5), ("r", 2, 0.7), ("r", 3, 0.7)], "run string, epoch int, metric double")
    assert rows(serving.training(df([("r",), ("s",)], "run string"), log)) == [("r", 3, 2, 0.7), ("s", None, None, None)]
    lineage = df([("split", None, "a" * 64), ("bank", "split", "x"), ("pool", "gone", "b" * 64)], "node string, parent string, sha256 string")
    assert [r[3:] for r in rows(serving.reproducibility(lineage))] == [(False, True), (True, False), (True, True)]
    assert [r[0] for r in serving.reports(df([("b.md", 1), (".x/a.md", 1), ("a.CSV", 1), ("c.png", 1)], "path string, size long")).collect()] == ["a.CSV", "b.md"]
    assert rows(serving.health({"x": results})) == [("x", True)]


def test_reports_grids_and_counters(spark):
    df = spark.createDataFrame
    assert rows(metrics.grid(df([("a", 1), ("b", 2), ("a", 1)], "k string, v int"), "k", "v")) == [("a", 1, 2), ("a", 2, 0), ("b", 1, 0), ("b", 2, 1)]
    report = metrics.class_report(df([(0,), (1,), (2,)], "class int"), df([(0, 0.5), (2, 1.0)], "class int, ap double"), ["ap"])
    assert rows(report) == [("0", 0.5), ("1", None), ("2", 1.0), ("all", 0.75)]
    timed = metrics.latency(df([(1.0, 3.0, 9.0, None), (0.0, 0.0, 1.0, 0.0)], "pre double, run double, loss double, post double"), ["pre", "run", "loss", "post"])
    assert [r[-2:] for r in rows(timed)] == [(0.0, None), (4.0, 250.0)]
    before, after = df([(1, "a"), (2, None), (3, "c")], "k int, v string"), df([(1, "b"), (2, None), (4, "d")], "k int, v string")
    assert tuple(metrics.change_counts(before, after, "k").first()) == (1, 1, 1, 1)
