"""Orderings, choices, identities, sinks and archive scans against plain definitions."""

import hashlib
import json
import random
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewright.functions import scalars as S
from tidewright.operators import graph, identity, ordering, suites
from tidewright.sources import archives, sinks


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_last_by_key_and_first_by_predicate(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y"), ("a", 3, "z")], "k string, n int, v string")
    assert rows(ordering.last_by_key(df, "k", "n")) == [("a", 3, "z", 1), ("b", 2, "y", 2)]
    found = ordering.first_by_predicate(df, "n", {"any": F.lit(True), "a": F.col("k") == "a", "b": F.col("k") == "b", "none": F.lit(False)}, ["n"])
    assert rows(found) == [("any", 1), ("b", 2)]
    assert rows(ordering.attempts(df, "k", "n").select("k", "attempt")) == [("a", 1), ("a", 2), ("b", 1)]


def test_preferred_candidates(spark):
    candidates = [(f"o{c}{s}{i}", c, f"g{s}") for c in range(3) for s in range(c + 1) for i in range(4)]
    needs = [(n, n % 3, f"g{n % 4}") for n in range(200)]
    got = ordering.preferred(spark.createDataFrame(needs, "id long, class int, group string"), spark.createDataFrame(candidates, "object string, class int, source string"), 1).collect()
    assert len(got) == 200 and len({r["object"] for r in got if r["class"] == 2}) == 12
    for r in got:
        assert (r["object"], r["class"], r["source"]) in candidates
        assert r["source"] != r["group"] or {s for _, c, s in candidates if c == r["class"]} == {r["group"]}


def test_same_rows_and_resolutions(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x"), (2, "y")], "k int, v string")
    assert rows(ordering.same_rows(a, a.orderBy("v"))) == [] and rows(ordering.same_rows(a, a.distinct())) == [(1, "x", "only_first")]
    assert rows(ordering.resolutions(spark.createDataFrame([(1, 2), (1, 2), (2, 1)], "w int, h int"), "w", "h")) == [("1x2", 2), ("2x1", 1)]


def plain_place(image, width, height, boxes, objects, iou_limit, cover_limit, attempts):
    boxes, out = [tuple(b) for b in boxes], []
    area = lambda b: (b[2] - b[0]) * (b[3] - b[1])
    cut = lambda a, b: max(0.0, min(a[2], b[2]) - max(a[0], b[0])) * max(0.0, min(a[3], b[3]) - max(a[1], b[1]))
    for name, w, h in objects:
        found = None
        for n in range(1, attempts + 1) if w <= width and h <= height else ():
            at = [int(hashlib.sha256(f"place|{image}|{name}|{n}|{axis}".encode()).hexdigest()[:8], 16) for axis in "xy"]
            x, y = (float(int(v * (room + 1) / 2**32)) for v, room in zip(at, (width - w, height - h), strict=True))
            b = (x, y, x + w, y + h)
            if all(cut(b, e) / (area(b) + area(e) - cut(b, e)) <= iou_limit and cut(b, e) / area(e) <= cover_limit for e in boxes):
                found = (n, b)
                boxes.append(b)
                break
        out.append((image, name, found and found[0], found[0] - 1 if found else attempts, *(found[1] if found else [None] * 4)))
    return out


def test_placements_against_the_plain_loop(spark):
    rng = random.Random(1)
    data = [(i, 60, 40, [(0.0, 0.0, 20.0, 20.0)], [(f"o{k}", float(rng.randint(5, 30)), float(rng.randint(5, 45))) for k in range(rng.randint(0, 6))]) for i in range(30)]
    df = spark.createDataFrame(data, "image int, width int, height int, boxes array<struct<x1:double,y1:double,x2:double,y2:double>>, objects array<struct<id:string,w:double,h:double>>")
    got = ordering.placements(df, "image", 0.1, 0.2, 5)
    want = [r for d in data for r in plain_place(*d, 0.1, 0.2, 5)]
    assert rows(got) == sorted(want, key=repr) and any(r[2] is None for r in want) and any((r[2] or 0) > 1 for r in want)
    tries = got.withColumns({"sample": F.col("image") % 10, "try": F.floor(F.col("image") / 10).cast("int")})
    kept = {r["sample"]: r["try"] for r in ordering.samples(tries, "image", "sample", "try").collect()}
    for s in {r[0] % 10 for r in want}:
        good = [r[0] // 10 for r in want if r[0] % 10 == s and r[2]]
        assert kept[s] == (min(good) if good else None)


def test_fallback(spark):
    tried = spark.createDataFrame([(1, "standard", "passed", 100), (2, "low", "passed", 900)], "place int, profile string, status string, free int")
    found = ordering.fallback(tried, "place", (F.col("status") == "passed") & (F.col("free") >= 512)).collect()
    assert [(r["profile"], r["rejected"]) for r in found] == [("low", 1)]


def test_nearest_chain(spark):
    rng = random.Random(2)
    data = [("g", i, rng.getrandbits(63)) for i in range(30)] + [("one", 99, 5)]
    got = {r["k"]: r["place"] for r in ordering.nearest_chain(spark.createDataFrame(data, "g string, k int, h long"), "g", "k", "h").collect()}
    bits, left, at = {k: h for g, k, h in data if g == "g"}, set(range(1, 30)), 0
    for place in range(1, 31):
        assert got[at] == place
        if left:
            at = min(left, key=lambda k: ((bits[k] ^ bits[at]).bit_count(), k))
            left.discard(at)
    assert got[99] == 1


def test_category_offsets(spark):
    df = lambda ids: spark.createDataFrame([(i,) for i in ids], "c int")
    assert rows(ordering.category_offset(df([1, 3]), "c", 3).select("class_id")) == [(0,), (2,)]
    assert rows(ordering.category_offset(df([0, 2]), "c", 3).select("class_id")) == [(0,), (2,)]
    assert rows(ordering.category_offset(df([1, 2]), "c", 3).select("class_id")) == [(0,), (1,)]  # both fit: ids from 1 it is
    assert rows(ordering.category_offset(df([]), "c", 3)) == []
    for bad in ([0, 3], [4], [-1]):
        with pytest.raises(ValueError):
            ordering.category_offset(df(bad), "c", 3)


def test_small_choices(spark):
    assert ordering.find_column(["a", " Metrics/mAP50 -95 "], "map50-95") == " Metrics/mAP50 -95 "
    with pytest.raises(ValueError):
        ordering.find_column(["a"], "b")
    df = spark.createDataFrame([("a", "0.5", "x/y"), ("b", "nan", "x/z"), ("c", "0.9", "q/y")], "m string, v string, p string")
    assert [r["m"] for r in ordering.within(df, {"v": (0.4, 0.8)}, {"m": ("a", "b")}).collect()] == ["a"]
    assert [r["m"] for r in ordering.matching(df, " X/", ["m", "p"], "m", descending=True).collect()] == ["b", "a"]
    assert [r["m"] for r in ordering.outside_prefixes(df, "p", ("q",), ("z",)).collect()] == ["a"]
    assert df.select(ordering.below_root(F.col("p"), "/base/data", "/base")).first()[0] == "data/x/y"
    with pytest.raises(ValueError):
        ordering.below_root(F.col("p"), "/other", "/base")
    pixels = spark.createDataFrame([("i", 3, 4, 20), ("i", 5, 9, 200), ("i", 0, 0, 16), ("j", 1, 1, 3)], "k string, x int, y int, value int")
    assert rows(ordering.mask_box(pixels, "k")) == [("i", 3, 4, 6, 10)]


def test_identities(spark, tmp_path):
    tables = {"b": spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string"), "a": spark.range(3)}
    found = identity.frozen(tables)
    by = {r["name"]: r["identity"] for r in found.collect()}
    assert by["combined"] == hashlib.sha256(f"a:{by['a']}\nb:{by['b']}".encode()).hexdigest()
    assert all(r["same"] for r in identity.compared(found, identity.frozen({k: v.repartition(3) for k, v in tables.items()})).collect())
    changed = {r["name"] for r in identity.compared(found, identity.frozen(tables | {"a": spark.range(4)})).collect() if not r["same"]}
    assert changed == {"a", "combined"}
    kept = identity.freeze(tables, str(tmp_path / "f"))
    assert identity.active(kept, by["combined"]) == by["combined"]
    with pytest.raises(ValueError):
        identity.active(kept, "0")
    with pytest.raises(Exception, match="(?i)exist"):
        identity.freeze(tables, str(tmp_path / "f"))
    identity.frozen_profile(str(tmp_path / "p.json"), {"batch": 4})
    identity.frozen_profile(str(tmp_path / "p.json"), {"batch": 4})
    with pytest.raises(FileExistsError):
        identity.frozen_profile(str(tmp_path / "p.json"), {"batch": 16})


def test_campaign_states(spark):
    assert identity.next_state(None, "preflight") == "preflight" and identity.next_state("failed_technical_attempt", "preflight")
    for now, then in (("sealed", "preflight"), ("failed_preflight", "preflight"), (None, "running"), ("preflight", "sealed")):
        with pytest.raises(ValueError):
            identity.next_state(now, then)
    df = spark.createDataFrame([("a", 1, "preflight"), ("a", 2, "running"), ("a", 3, "sealed"), ("a", 4, "preflight")], "campaign string, at int, state string")
    assert [r["allowed"] for r in identity.campaign_history(df).orderBy("at").collect()] == [True, True, True, False]


def test_sinks(spark, tmp_path):
    sinks.write_json(str(tmp_path / "x.json"), {"b": np.float64(1.5), "a": np.arange(2), "p": tmp_path})
    assert json.loads((tmp_path / "x.json").read_text()) == {"a": [0, 1], "b": 1.5, "p": tmp_path.as_posix()}
    with pytest.raises(ValueError):
        sinks.plain({"x": float("nan")})
    df = spark.createDataFrame([(2, "b"), (1, None)], "k int, v string")
    assert sinks.write_ordered_csv(df, str(tmp_path / "x.csv"), ["v", "k"], ["k"]) == 2 and (tmp_path / "x.csv").read_bytes() == b"v,k\n,1\nb,2\n"
    sinks.descriptor(str(tmp_path / "d.yaml"), "/data", {"train": "train.txt"}, ["a", "b: c"])
    assert archives.class_names((tmp_path / "d.yaml").read_text()) == ["a", "b: c"]
    assert sinks.file_list(df, "k", str(tmp_path / "l.txt")) == 2 and (tmp_path / "l.txt").read_text() == "1\n2\n"
    assert "| 2 | b |" in sinks.markdown("t", {"x": df})
    with pytest.raises(RuntimeError):
        sinks.publish(lambda d: (_ for _ in ()).throw(RuntimeError("no")), str(tmp_path / "out"))
    assert not (tmp_path / "out").exists() and not list(tmp_path.glob(".out-*"))


def test_archives(spark, tmp_path):
    root = tmp_path / "r"
    root.mkdir()
    (root / "a.txt").write_text("token ghp_" + "a" * 36)
    (root / "b.bin").write_bytes(bytes(range(256)))
    inventory = sinks.deterministic_zip(str(tmp_path / "x.zip"), str(root), ["b.bin", "a.txt"])
    sinks.deterministic_zip(str(tmp_path / "y.zip"), str(root), ["a.txt", "b.bin"])
    assert (tmp_path / "x.zip").read_bytes() == (tmp_path / "y.zip").read_bytes()
    (tmp_path / "y.zip").unlink()
    with zipfile.ZipFile(tmp_path / "x.zip", "a") as out:
        out.writestr("more/../c.txt", "x")
    members = archives.zip_members(spark, str(tmp_path))
    listed = spark.createDataFrame([(x["path"], x["size"], x["sha256"]) for x in inventory] + [("gone.txt", 1, "0" * 64)], "path string, size long, sha256 string")
    found = {(r["rule"], r["key"]) for r in suites.archive(listed, members).collect()}
    assert found == {("member_missing", "gone.txt"), ("member_unlisted", "more/../c.txt"), ("path_unsafe", "more/../c.txt"), ("secret", "a.txt")}
    with pytest.raises(ValueError):
        archives.import_zip(str(tmp_path / "x.zip"), str(tmp_path / "in"))
    assert not (tmp_path / "in").exists()
    sinks.deterministic_zip(str(tmp_path / "z.zip"), str(root), ["a.txt"])
    assert archives.import_zip(str(tmp_path / "z.zip"), str(tmp_path / "in")) == 1


def test_metric_logs_and_documents(spark, tmp_path):
    (tmp_path / "log.csv").write_text(" epoch, mAP50-95\n1,0.5\n2,nan\n4,0.7\n")
    log = archives.metric_log(spark, str(tmp_path / "log.csv"))
    assert [(r["metric"], r["value"]) for r in log.orderBy("position", "metric").collect()] == [("epoch", 1.0), ("mAP50-95", 0.5), ("epoch", 2.0), ("mAP50-95", None), ("epoch", 4.0), ("mAP50-95", 0.7)]
    wide = spark.createDataFrame([("r", "1", "0.5"), ("r", "2", "nan"), ("r", "4", "1e-3"), ("s", "1", "1"), ("s", "1", "2")], "run string, epoch string, v string")
    assert {(r["rule"], r["key"]) for r in suites.run_log(wide, "run", "epoch", ["epoch", "v"]).collect()} == {("non_numeric", "r:2"), ("epoch_missing", "r"), ("epoch_repeated", "s")}
    assert archives.class_names('{"names": {"1": "b", "0": "a"}}') == ["a", "b"]
    for bad in ('{"names": {"0": "a", "2": "b"}}', '{"names": ["a", "a"]}', "[1]", '{"names": []}'):
        with pytest.raises(ValueError):
            archives.class_names(bad)
    assert archives.configured('{"n": 3, "x": 1}', {"n": int, "x": float}, {"n": (1, 5)}) == {"n": 3, "x": 1}
    with pytest.raises(ValueError, match="q is unknown; x is missing; n is out of range"):
        archives.configured('{"n": 9, "q": 1}', {"n": int, "x": float}, {"n": (1, 5)})
    (tmp_path / "i").mkdir()
    (tmp_path / "i" / "a.png").write_bytes(b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + (7).to_bytes(4, "big") + (9).to_bytes(4, "big"))
    (tmp_path / "i" / "b.png").write_bytes(b"broken")
    assert [(r["width"], r["height"], r["readable"]) for r in archives.image_heads(spark, str(tmp_path / "i")).orderBy("path").collect()] == [(7, 9, True), (None, None, False)]


def test_scalars(spark):
    one = lambda *c: tuple(spark.range(1).select(*c).first())
    lit = F.lit
    assert one(S.capture_id(lit("a/IMG_2_jpeg_jpg.rf.0ab.jpg")), S.capture_id(lit("x_png.png")), S.leading_number(lit("IMG_12_x"), "IMG_"), S.first_part(lit("a/b/c")), S.safe_name(lit("-a b/é-"))) == ("IMG_2", "x", 12, "a", "a-b")
    assert one(S.is_digest(lit("a" * 64)), S.is_digest(lit("A" * 64)), S.is_digest(lit(None).cast("string"))) == (True, False, False)
    assert one(S.iou_xywh(F.array(*map(lit, (0, 0, 10, 10))), F.array(*map(lit, (5, 5, 10, 10)))))[0] == pytest.approx(25 / 175)
    assert one(S.box_shares(F.array(*map(lit, (10, 20, 30, 40))), lit(100), lit(200)))[0] == pytest.approx([0.1, 0.1, 0.3, 0.2])
    for raw in ('a"b\\c', "é\U0001f600\n\t\x00\x7f", "", "plain"):
        assert one(S.json_text(lit(raw)))[0] == json.dumps(raw)
    assert one(S.canonical_json({"b": S.json_text(lit("é")), "a": lit("1")}))[0] == json.dumps({"b": "é", "a": 1}, sort_keys=True, separators=(",", ":"))
    assert one(S.object_id(lit("p"), lit(3), lit(" 0 1 ")))[0] == hashlib.sha256(json.dumps(["p", 3, "0 1"], separators=(",", ":")).encode()).hexdigest()[:16]
    assert one(S.number(lit("1d")), S.number(lit(" 1e2 ")), S.number(lit("nan")), S.number(lit(".5"))) == (None, 100.0, None, 0.5)
    assert one(S.all_finite(F.array(lit(1.0), lit(float("inf")))), S.close(lit(1.0), lit(1.0 + 1e-13), 1e-12), S.fixed10(lit(1 / 3)), S.url_quote(lit("a b/ü")), S.stem(lit("x/y.tar.gz")), S.suffix(lit("x/y.tar.gz"))) == (False, True, "0.3333333333", "a%20b%2F%C3%BC", "y.tar", ".gz")
    assert one(S.prohibited(lit("a/Datasets/x")), S.prohibited(lit("a/test_predictions1/x")), S.prohibited(lit("a/.ENV")), S.prohibited(lit("a/k.pem")), S.prohibited(lit("a/testing.txt"))) == (True, True, True, True, False)
    assert one(S.utc_text(F.timestamp_seconds(lit(0))))[0] == "1970-01-01T00:00:00Z"
    box = lambda *v: [lit(float(x)) for x in v]
    faults = [one(S.yolo_fault(*box(*v), lit(100), lit(100)))[0] for v in ((0.5, 0.5, 0.2, 0.2), (0.5, 0.5, 0, 0.2), (1.5, 0.5, 0.2, 0.2), (0.05, 0.5, 0.2, 0.2), (0.1, 0.5, 0.2 + 1e-9, 0.2))]
    assert faults == [None, "not positive", "not shares of the image", "outside the image", None]
    with pytest.raises(Exception, match="outside the image"):
        one(S.yolo_to_xyxy(*box(0.05, 0.5, 0.2, 0.2), lit(100), lit(100)))
    with pytest.raises(Exception, match="inside the image"):
        one(S.xyxy_to_yolo(F.struct(lit(5).alias("x1"), lit(1).alias("y1"), lit(5).alias("x2"), lit(9).alias("y2")), lit(10), lit(10)))


def test_source_groups_by_three_kinds_of_evidence(spark):
    data = [("IMG_1_jpg.rf.0a.jpg", ""), ("IMG_2.jpg", ""), ("IMG_2_png.png", ""), ("IMG_9.jpg", "d1"), ("other.jpg", "d1"), ("IMG_4_MOV-1.jpg", ""), ("IMG_4_MOV-7.jpg", ""), ("IMG_77.jpg", None)]
    df = spark.createDataFrame(data, "path string, duplicate_group_id string")
    found = graph.components(df.select(F.col("path").alias("node")), suites.source_edges(df))
    of = dict(map(tuple, found.collect()))
    assert of["IMG_1_jpg.rf.0a.jpg"] == of["IMG_2.jpg"] == of["IMG_2_png.png"] and of["IMG_9.jpg"] == of["other.jpg"] and of["IMG_4_MOV-1.jpg"] == of["IMG_4_MOV-7.jpg"]
    assert len(set(of.values())) == 4
    made = suites.group_decisions(df.join(found.withColumnRenamed("node", "path"), "path"))
    assert {(r["size"], r["status"]) for r in made.collect()} == {(3, "pending"), (2, "pending"), (2, "confirmed"), (1, "pending")}
