"""The library's operators against small plain definitions."""

import hashlib
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewright.functions import scalars as S
from tidewright.operators import graph, metrics, selection, validation
from tidewright.sources import scan
from tidewright.streaming.events import daily, run_daily, validated


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_hamming_pairs_against_all_pairs(spark):
    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(8)]
    values = [b ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(0, 4))) & (2**64 - 1) for b in base for _ in range(12)] + base
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    df = spark.createDataFrame(list(enumerate(signed)), "k long, h long").repartition(5)
    want = sorted((i, j, d) for i in range(len(values)) for j in range(i + 1, len(values)) if (d := (values[i] ^ values[j]).bit_count()) <= 6)
    assert rows(graph.hamming_pairs(df, "k", "h", 6)) == want


@pytest.mark.parametrize("block", [3, 1 << 16])
def test_nearest_in_blocks_against_all_rows(spark, block):
    rng = random.Random(11)
    data = [(i, rng.randrange(3), rng.getrandbits(6) - 32 << 20) for i in range(80)] + [(200, None, 5), (201, 1, None)]
    df = spark.createDataFrame(data, "k long, g int, h long").repartition(6)
    got = rows(graph.nearest_in_blocks(df, "k", "g", "h", F.col("k") % 7 == 0, block, 64))
    full = [d for d in data if d[1] is not None and d[2] is not None]
    want = []
    for k, g, h in full:
        if k % 7 == 0:
            d, b, o = min((((h ^ y) & (2**64 - 1)).bit_count(), j, x) for j, x, y in full if x != g)
            want.append((k, g, b, o, d))
    assert got == sorted(want)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, k) for k in range(101, 130)] + [(7, 7), (3, 2)]
    nodes = spark.createDataFrame([(i,) for i in [*range(45), *range(100, 131)]], "node long")
    found = dict(rows(graph.components(nodes, spark.createDataFrame(edges, "a long, b long"))))
    assert all(found[i] == 0 for i in range(41)) and all(found[i] == 100 for i in range(100, 130)) and found[44] == 44 and found[130] == 130


def test_components_without_edges(spark):
    assert rows(graph.components(spark.range(3).withColumnRenamed("id", "node"), spark.createDataFrame([], "a long, b long"))) == [(0, 0), (1, 1), (2, 2)]


def test_dense_ids_follow_the_order_of_keys(spark):
    df = spark.createDataFrame([(i, k) for i, k in enumerate(["b", "a", None, "b", "c"])], "i int, k string").repartition(4)
    assert [r[1] for r in rows(graph.dense_ids(df, "k", "g", "group").select("i", "g"))] == ["group-0002", "group-0001", "", "group-0002", "group-0003"]


def test_star_edges_ignore_blanks(spark):
    df = spark.createDataFrame([(1, "x"), (2, "x"), (3, ""), (4, ""), (5, None)], "k long, v string")
    assert rows(graph.star_edges(df, "k", "v")) == [(2, 1)]


def test_islands(spark):
    df = spark.createDataFrame([("a", n) for n in (1, 2, 3, 7, 8, 10, 10)], "g string, n long")
    assert [r[2] for r in rows(graph.islands(df, ["g"], "n"))] == [1, 1, 1, 7, 7, 10, 10]


def test_iou_and_occlusion(spark):
    box = lambda *v: F.struct(*[F.lit(float(x)).alias(n) for x, n in zip(v, ("x1", "y1", "x2", "y2"), strict=True)])
    a, b = box(0, 0, 10, 10), box(5, 5, 15, 15)
    got = spark.range(1).select(S.iou(a, b), S.iou(box(0, 0, 0, 0), box(0, 0, 0, 0)), S.occlusion(a, b), S.occlusion(box(1, 1, 1, 1), b)).first()
    assert tuple(got) == pytest.approx((25 / 175, 0.0, 0.25, 1.0))


def test_box_conversions(spark):
    one = [F.lit(v) for v in (0.5, 0.6, 0.2, 0.2)]
    got = spark.range(1).select(S.yolo_to_xyxy(*one, F.lit(100), F.lit(80)).alias("b")).select("b.*").first()
    assert tuple(got) == (40, 40, 60, 56)


def test_seeds_and_digests(spark):
    r = spark.createDataFrame([("k",)], "k string").select(S.hash_order(42, F.col("k")), S.derived_seed(F.lit(42), F.col("k")), S.hash_uniform(42, F.col("k"))).first()
    h = hashlib.sha256(b"42|k").hexdigest()
    assert (r[0], int(r[1]), r[2]) == (h, int(h[:16], 16), int(h[:8], 16))


def test_difference_bits(spark):
    v = np.random.default_rng(0).normal(size=64).tolist()
    got = spark.createDataFrame([(v,)], "v array<double>").select(S.bits_of(F.col("v"))).first()[0]
    want = 0
    for i in range(64):
        want = want << 1 | (v[i] > v[(i + 1) % 64])
    assert got & (2**64 - 1) == want


@pytest.mark.parametrize(("path", "bad"), [("a/b.txt", False), ("/a", True), ("a//b", True), ("a/../b", True), ("C:/x", True), ("a\\b", True), ("a/./b", True), ("a/b..c", False)])
def test_path_safety(spark, path, bad):
    assert spark.createDataFrame([(path,)], "p string").select(S.unsafe_path(F.col("p"))).first()[0] is bad


def test_canonical_hash_ignores_key_order():
    assert S.canonical_hash({"b": 1, "a": "é"}) == S.canonical_hash({"a": "é", "b": 1}) == hashlib.sha256(b'{"a":"\\u00e9","b":1}').hexdigest()


def plain_iou(a, b):
    """Shared unit cells over all unit cells: the boxes have whole corners."""
    cells = lambda v: {(x, y) for x in range(int(v[0]), int(v[2])) for y in range(int(v[1]), int(v[3]))}
    one, two = cells(a), cells(b)
    return len(one & two) / len(one | two) if one | two else 0.0


def plain_size(b):
    area = (b[2] - b[0]) * (b[3] - b[1])
    return "small" if area < 1024 else "medium" if area < 9216 else "large"


def plain_events(truths, guesses):
    """(prediction, truth, kind, iou, classes, score, size), from a table of all overlaps that is crossed off."""
    order = sorted(range(len(guesses)), key=lambda i: (-guesses[i][2], guesses[i][1], guesses[i][0]))
    shares = {(g, t): plain_iou(guesses[g][3], truths[t][2]) for g in range(len(guesses)) for t in range(len(truths))}
    open_, out = set(range(len(truths))), []
    for g in order:
        k, c, score, box = guesses[g]
        fits = sorted((-shares[g, t], t) for t in open_ if truths[t][1] == c)
        near = sorted((-shares[g, t], t) for t in range(len(truths)))
        own, top = (fits or [(1, None)])[0], (near or [(0.0, None)])[0]
        if -own[0] >= 0.5:
            kind, (share, t) = "true_positive", own
            open_.discard(t)
        elif -top[0] >= 0.5 and truths[top[1]][1] != c:
            kind, (share, t) = "class_confusion", top
        elif -own[0] >= 0.1:
            kind, (share, t) = "localization_error", own
        else:
            kind, (share, t) = "false_positive", top
        hit = truths[t] if t is not None else (None, None, None)
        out.append((k, hit[0], kind, -share, c, hit[1], score, plain_size(hit[2] if kind == "true_positive" else box)))
    for t in sorted(open_):
        k, c, box = truths[t]
        near = min(((-shares[g, t], n, g) for n, g in enumerate(order) if guesses[g][1] == c), default=None)
        g = guesses[near[2]] if near else (None, None, None)
        out.append((g[0], k, "false_negative", -near[0] if near else 0.0, g[1], c, g[2], plain_size(box)))
    return out


IMAGES = "image long, truths array<struct<id:long,class:int,box:struct<x1:double,y1:double,x2:double,y2:double>>>, predictions array<struct<id:long,class:int,score:double,box:struct<x1:double,y1:double,x2:double,y2:double>>>"


def test_greedy_events_against_the_plain_loop(spark):
    rng = random.Random(2)

    def box():
        x, y = rng.randint(0, 12), rng.randint(0, 12)
        return (float(x), float(y), float(x + rng.randint(0, 9)), float(y + rng.randint(1, 9)))

    data = [(i, [(k, rng.randint(0, 1), box()) for k in range(rng.randint(0, 5))], [(k, rng.randint(0, 1), rng.choice([0.2, 0.5, 0.9]), box()) for k in range(rng.randint(0, 6))]) for i in range(60)]
    columns = ("image", "prediction", "truth", "kind", "iou", "prediction_class", "truth_class", "score", "size")
    got = sorted((tuple(r) for r in metrics.greedy_events(spark.createDataFrame(data, IMAGES), "image").select(*columns).collect()), key=repr)
    want = sorted(((i, *e) for i, ts, gs in data for e in plain_events(ts, gs)), key=repr)
    assert [r[:4] + r[5:] for r in got] == [r[:4] + r[5:] for r in want] and [r[4] for r in got] == pytest.approx([r[4] for r in want])


def plain_ap(hits, total):
    """The area under the envelope, read at recalls 0, 1/100, ..., 1 in exact fractions."""
    points, found = [(Fraction(0), Fraction(1))], 0
    for n, hit in enumerate(hits, 1):
        found += bool(hit)
        points.append((Fraction(found, total), Fraction(found, n)))
    points.append((Fraction(1), Fraction(0)))
    high = [(r, max(p for _, p in points[i:])) for i, (r, _) in enumerate(points)]

    def read(x):
        last = max(i for i, (r, _) in enumerate(high) if r <= x)
        if last == len(high) - 1:
            return high[last][1]
        (r, p), (r2, p2) = high[last : last + 2]
        return p + (p2 - p) * (x - r) / (r2 - r)

    ys = [read(Fraction(i, 100)) for i in range(101)]
    return float(sum((a + b) / 200 for a, b in zip(ys, ys[1:], strict=False)))


def test_average_precision(spark):
    rng = random.Random(3)
    data = {g: [rng.random() < 0.5 for _ in range(n)] for g, n in (("a", 1), ("b", 7), ("c", 50))} | {"one": [True]}
    scored = spark.createDataFrame([(g, i, h) for g, hs in data.items() for i, h in enumerate(hs)], "g string, i int, hit boolean")
    totals = {g: max(sum(h), 1) + (g == "b") for g, h in data.items()} | {"none": 4}
    found = dict(rows(metrics.average_precision(scored, ["g"], spark.createDataFrame(list(totals.items()), "g string, total long"), [F.col("i")])))
    assert found["one"] == pytest.approx(0.995) and found["none"] == 0
    for g, h in data.items():
        assert found[g] == pytest.approx(plain_ap(h, totals[g]), abs=1e-9), g


def test_size_ap_of_a_perfect_detection(spark):
    data = [(1, [(0, 0, (0.0, 0.0, 10.0, 10.0))], [(0, 0, 0.9, (0.0, 0.0, 10.0, 10.0))]), (2, [(0, 1, (0.0, 0.0, 50.0, 50.0))], [])]
    got = {r["size"]: r for r in metrics.size_ap(spark.createDataFrame(data, IMAGES), "image").collect()}
    assert got["small"]["map50"] == pytest.approx(0.995) and got["small"]["map50_95"] == pytest.approx(0.995) and got["medium"]["map50"] == 0
    assert tuple(got["large"])[1:] == (0, 0, None, None)
    assert [tuple(r)[1:] for r in metrics.size_ap(spark.createDataFrame([], IMAGES), "image").collect()] == [(0, 0, None, None)] * 3


def test_size_ap_against_plain_strata(spark):
    rng = random.Random(6)

    def box():
        x, y = rng.randint(0, 30), rng.randint(0, 30)
        return (float(x), float(y), float(x + rng.randint(10, 60)), float(y + rng.randint(10, 60)))

    data = []
    for i in range(40):
        truths = [(k, rng.randint(0, 2), box()) for k in range(rng.randint(0, 4))]
        guesses = [(k, t[1] if rng.random() < 0.8 else rng.randint(0, 2), rng.random(), tuple(v + rng.choice([0, 0, 1, 4]) for v in t[2])) for k, t in enumerate(truths)] + [(9, rng.randint(0, 2), rng.random(), box())]
        data.append((i, truths, guesses))
    got = {r["size"]: r for r in metrics.size_ap(spark.createDataFrame(data, IMAGES), "image").collect()}
    for size in ("small", "medium", "large"):
        per = {}
        for c in range(3):
            own = {i: [t[2] for t in ts if t[1] == c and plain_size(t[2]) == size] for i, ts, _ in data}
            total = sum(map(len, own.values()))
            if not total:
                continue
            ranked = sorted((-s, i, b) for i, _, gs in data for _, k, s, b in gs if k == c and plain_size(b) == size)
            for step in range(10):
                least, taken, hits = 0.5 + step * (0.55 - 0.5), set(), []
                for _, i, b in ranked:
                    best = min(((-plain_iou(b, t), n) for n, t in enumerate(own[i]) if (i, n) not in taken), default=(1, None))
                    hits.append(-best[0] >= least)
                    if hits[-1]:
                        taken.add((i, best[1]))
                per.setdefault(c, []).append(plain_ap(hits, total) if ranked else 0.0)
        r = got[size]
        assert (r["truths"], r["classes"]) == (sum(plain_size(t[2]) == size for _, ts, _ in data for t in ts), len(per))
        if per:
            assert r["map50"] == pytest.approx(np.mean([v[0] for v in per.values()])) and r["map50_95"] == pytest.approx(np.mean([np.mean(v) for v in per.values()]))


def test_greedy_split_against_the_plain_loop(spark):
    rng = random.Random(7)
    data = [(f"g{i}", rng.randint(1, 9), {c: rng.randint(1, 4) for c in rng.sample("abc", rng.randint(1, 3))}) for i in range(60)]
    goals, total = {"train": 0.7, "val": 0.2, "test": 0.1}, sum(d[1] for d in data)
    every = {c: sum(d[2].get(c, 0) for d in data) for c in "abc"}
    tie = lambda g: hashlib.sha256(f"3|{g}".encode()).hexdigest()
    left, placed = sorted(data, key=lambda d: (-sum(1.0 / every[c] for c in sorted(d[2])), -d[1], tie(d[0]))), {}

    def loss(split, group):
        trial = placed | {group[0]: split}
        by = {s: [d for d in data if trial.get(d[0]) == s] for s in goals}
        size = sum(((sum(d[1] for d in by[s]) - total * g) / max(total * g, 1)) ** 2 for s, g in goals.items())
        per_class = [((sum(d[2].get(c, 0) for d in by[s]) - every[c] * g) / max(every[c] * g, 1)) ** 2 for s, g in goals.items() for c in "abc"]
        fill = sum(d[1] for d in data if placed.get(d[0]) == split) / max(total * goals[split], 1)
        return round(size + sum(per_class) / 3, 12), fill

    for group in left:
        placed[group[0]] = min(goals, key=lambda s: loss(s, group))
    assert dict(rows(selection.greedy_split(spark.createDataFrame(data, "group string, size long, classes map<string,long>"), 3))) == placed


def test_greedy_split_keeps_groups_and_balances(spark):
    rng = random.Random(4)
    data = [(f"g{i}", rng.randint(1, 9), {c: rng.randint(1, 4) for c in rng.sample("abcd", rng.randint(1, 3))}) for i in range(120)]
    df = spark.createDataFrame(data, "group string, size long, classes map<string,long>")
    got = rows(selection.greedy_split(df, 1))
    assert got == rows(selection.greedy_split(df.repartition(7), 1)) and len(got) == 120
    size = {s: sum(d[1] for d in data if (d[0], s) in got) for s in ("train", "val", "test")}
    total = sum(size.values())
    assert abs(size["train"] / total - 0.7) < 0.05 and abs(size["val"] / total - 0.2) < 0.05


def test_deficit_select_against_the_plain_loop(spark):
    rng = random.Random(5)
    data = [(i, sorted(rng.sample(range(5), rng.randint(0, 3)))) for i in range(60)]
    tie = lambda k: hashlib.sha256(f"9|{k}".encode()).hexdigest()
    totals = {c: sum(c in v for _, v in data) for c in range(5)}
    goals, have, left, want = {c: t * 20 / 60 for c, t in totals.items()}, dict.fromkeys(range(5), 0), dict(data), []
    while len(want) < 20:
        k = min(left, key=lambda k: (-sum(max(goals[c] - have[c], 0.0) for c in left[k]), -sum(1.0 / totals[c] for c in left[k]), tie(k)))
        want.append(k)
        for c in left.pop(k):
            have[c] += 1
    got = selection.deficit_select(spark.createDataFrame(data, "k long, c array<int>").repartition(5), "k", "c", 20, 9).orderBy("position")
    assert [r["k"] for r in got.collect()] == want
    with pytest.raises(ValueError):
        selection.deficit_select(spark.createDataFrame(data, "k long, c array<int>"), "k", "c", 61, 9)


def test_even_sample(spark):
    df = spark.range(10).select(F.lit("g").alias("g"), F.col("id").alias("n"))
    assert [r[1] for r in rows(selection.even_sample(df, "g", "n", 4))] == [0, 3, 6, 9]


def test_first_accepted(spark):
    df = spark.createDataFrame([("a", 1, False), ("a", 2, True), ("a", 3, True), ("b", 1, False)], "k string, n int, ok boolean")
    assert rows(selection.first_accepted(df, "k", "n", F.col("ok"))) == [("a", 2, 1)]


def test_annotation_rules_in_order(spark):
    lines = ["0 0.5 0.5 0.2 0.2", "0 0.5 0.5 0.2", "a 0.5 0.5 0.2 0.2", "9 0.5 0.5 0.2 0.2", "0 1.5 0.5 0.2 0.2", "0 0.5 0.5 0 0.2", "0 0.05 0.5 0.2 0.2", "1.5 9 9 9 9"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, x string").select("i", F.split("x", " ").alias("t"))
    got = [r[1] for r in rows(df.select("i", validation.first_failure(validation.annotation_rules(F.col("t"), 3))))]
    assert got == [None, "unsupported_annotation_line", "non_numeric_annotation", "unknown_class", "non_normalized_box", "non_positive_box", "box_outside_image", "unknown_class"]


def test_violations_and_the_gate(spark):
    df = spark.createDataFrame([(1, -1), (2, 5)], "k int, v int")
    found = validation.violations("s", [("second", "error", df.where("v > 4"), F.col("k"), F.col("v")), ("first", "error", df.where("v < 0"), F.col("k"), F.col("v"))])
    assert found.count() == 2
    with pytest.raises(ValueError, match="first: 1"):
        validation.require(found, ["first", "second"])
    validation.require(found.where("false"), ["first"])


def test_overlap_and_set_difference(spark):
    df = spark.createDataFrame([("train", "x"), ("test", "x"), ("train", ""), ("test", ""), ("train", "y")], "s string, v string")
    assert rows(validation.overlap(df, "s", "v")) == [("x", "test,train")]
    a, b = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(2,), (3,)], "k int")
    assert rows(validation.set_difference(a, b, "k")) == [(1, "missing"), (3, "extra")]


def test_fingerprint_ignores_row_order(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (2, None)], "k int, v string")
    assert rows(validation.fingerprint(df)) == rows(validation.fingerprint(df.orderBy(F.desc("k")).repartition(3)))
    assert rows(validation.fingerprint(df)) != rows(validation.fingerprint(df.distinct()))


def test_csv_scans_keep_empty_text(spark, tmp_path):
    (tmp_path / "x.csv").write_text('a,b\n1,\n"",2\n')
    assert rows(scan.text_csv(spark, str(tmp_path / "x.csv"))) == [("", "2"), ("1", "")] and scan.header(spark, str(tmp_path / "x.csv")) == ["a", "b"]
    scan.write_csv(scan.text_csv(spark, str(tmp_path / "x.csv")), str(tmp_path / "out"), ["a"])
    with pytest.raises(Exception, match="(?i)exist"):
        scan.write_csv(scan.text_csv(spark, str(tmp_path / "x.csv")), str(tmp_path / "out"), ["a"])
    with pytest.raises(ValueError):
        scan.write_csv(spark.createDataFrame([], "a int"), str(tmp_path / "none"), ["a"], allow_empty=False)


def test_label_files_and_paths(spark, tmp_path):
    (tmp_path / "l").mkdir()
    (tmp_path / "l" / "a.txt").write_text("0 1 2\n\n1 2 3\n")
    assert [r[1:] for r in rows(scan.label_lines(spark, str(tmp_path / "l")))] == [(1, "0 1 2"), (3, "1 2 3")]
    df = spark.createDataFrame([("x/images/a/images/b.jpg",)], "p string")
    assert df.select(scan.label_path(F.col("p"))).first()[0] == "x/images/a/labels/b.txt"
    assert rows(scan.files(spark, str(tmp_path), (".txt",)).select("supported")) == [(True,)]


def test_latest_run_by_time(spark, tmp_path):
    for i, end in enumerate(["2024-01-02T00:00:00Z", "2024-01-10T00:00:00Z", "2024-01-09T00:00:00Z"]):
        (tmp_path / f"{i}.json").write_text(f'{{"regime": "a", "ended": "{end}"}}')
    assert scan.latest_run(spark, f"{tmp_path}/*.json", "regime string, ended string", "regime", "ended").select("ended").first()[0] == "2024-01-10T00:00:00Z"


def test_ranking_and_changes(spark):
    df = spark.createDataFrame([("a", 1.0, 3.0, 0), ("b", 1.0, 2.0, 1), ("c", 0.0, 9.0, 2)], "m string, x double, t double, i int")
    assert [(r["m"], r["rank"]) for r in metrics.ranked(df, [("x", True), ("t", False)], "i").orderBy("rank").collect()] == [("b", 1), ("a", 2), ("c", 3)]
    got = [tuple(r) for r in metrics.changes(df.where("i > 0").unionByName(df.where("i = 0")), "i", "x").select("from_previous", "from_first", "relative").orderBy(F.col("from_first").desc()).collect()]
    assert got[-1] == (-1.0, -1.0, -1.0)


def test_stream_equals_batch(spark, sf):
    want = daily(spark.read.parquet(f"{sf}/events.parquet")).select(F.to_date("w.start"), "event_type", "code", "n")
    assert rows(run_daily(spark, sf)) == rows(want)
    assert validated(spark.createDataFrame([(None, 1.0), (1, None), (1, -1.0), (1, 1.0)], "user_id long, value double")).select("code").collect()[2][0] == "non_positive"


def test_size_ap_over_many_parts_without_a_row_per_threshold(spark, monkeypatch):
    """Equal scores, crowded images, null classes and thresholds at which a later prediction takes what an earlier one leaves; sorted once."""
    monkeypatch.setattr(metrics, "average_precision", None)
    rng = random.Random(12)
    data = []
    for i in range(150):
        at = [(rng.randint(0, 9), rng.randint(0, 9)) for _ in range(rng.randint(0, 8))]
        box = lambda x, y, d: (float(x), float(y), float(x + 30 + d), float(y + 30 + d))
        data.append((i, [(k, rng.choice([0, 1]), box(*p, 0)) for k, p in enumerate(at)], [(k, rng.choice([0, 1, None]), rng.choice([0.5, 0.7, rng.random()]), box(x + rng.randint(0, 5), y, rng.choice([0, 1, 2, 5]))) for k, (x, y) in enumerate(at + at[:2])]))
    got = {r["size"]: r for r in metrics.size_ap(spark.createDataFrame(data, IMAGES).repartition(7), "image").collect()}
    for size in ("small", "medium"):
        aps, count = [], 0
        for c in (0, 1):
            own = {i: [t[2] for t in ts if t[1] == c and plain_size(t[2]) == size] for i, ts, _ in data}
            total = sum(map(len, own.values()))
            if not total:
                continue
            count += total
            ranked = sorted((-s, i, b, n) for i, _, gs in data for n, k, s, b in gs if k == c and plain_size(b) == size)
            for step in range(10):
                taken, hits = set(), []
                for _, i, b, _ in ranked:
                    best = min(((-plain_iou(b, t), n) for n, t in enumerate(own[i]) if (i, n) not in taken), default=(1, None))
                    hits.append(-best[0] >= 0.5 + step * (0.55 - 0.5))
                    if hits[-1]:
                        taken.add((i, best[1]))
                aps.append((step, plain_ap(hits, total) if hits else 0.0))
        assert got[size]["truths"] == count
        if count:
            assert got[size]["map50_95"] == pytest.approx(sum(a for _, a in aps) / len(aps), abs=1e-9)
            assert got[size]["map50"] == pytest.approx(sum(a for s, a in aps if s == 0) / sum(s == 0 for s, _ in aps), abs=1e-9)
