"""Each suite on a sound fixture, which breaks no rule, and on changed ones, which break the rules they are changed to break."""

import hashlib

import pytest
from pyspark.sql import functions as F

from tidewright.operators import suites
from tidewright.operators.validation import require


def found(df):
    return sorted((r["rule"], r["key"]) for r in df.collect())


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


@pytest.fixture
def make(spark):
    return lambda schema, *rows: spark.createDataFrame(list(rows), schema)


def pool(make, **changes):
    tables = {
        "images": ("image_path string, label_path string, image_hash string, label_hash string, total int, pasted int, retained int, width int, height int, identity string", [("s/images/a.jpg", "s/labels/a.txt", "ha", "la", 2, 1, 1, 64, 48, "id1")]),
        "sources": ("image string, object_id string, image_path string, content_hash string", [("s/images/a.jpg", "o1", "t/1.jpg", "h1")]),
        "backgrounds": ("image string, image_path string, content_hash string, label_path string", [("s/images/a.jpg", "t/2.jpg", "h2", "t/2.txt")]),
        "bank": ("object_id string, image_path string, content_hash string, inclusion_status string", [("o1", "t/1.jpg", "h1", "included"), ("o2", "t/1.jpg", "h1", "excluded")]),
        "splits": ("split string, image_path string, content_hash string", [("train", "t/1.jpg", "h1"), ("train", "t/2.jpg", "h2"), ("val", "v/1.jpg", "h3"), ("test", "v/2.jpg", "h4")]),
        "files": ("path string, sha256 string, width int, height int", [("s/images/a.jpg", "ha", 64, 48), ("s/labels/a.txt", "la", None, None)]),
        "lines": ("path string, line_number int, line string", [("s/labels/a.txt", 1, "0 0.5 0.5 0.2 0.2"), ("s/labels/a.txt", 2, "1 0.1 0.1 0.4 0.1")]),
        "base_lines": ("path string, line_number int, line string", [("t/2.txt", 1, "0 0.5 0.5 0.2 0.2000000001")]),
    }
    for name, rows in changes.items():
        tables[name] = (tables[name][0], rows)
    return suites.synthetic_pool(*[make(schema, *rows) if rows else make(schema, *[]) for schema, rows in tables.values()], classes=2, expected=1, identity="id1")


IMAGE = ("s/images/a.jpg", "s/labels/a.txt", "ha", "la", 2, 1, 1, 64, 48, "id1")


@pytest.mark.parametrize(("changes", "rules"), [
    ({}, set()),
    ({"images": [(*IMAGE[:2], "hx", "lx", 3, 0, 2, 65, 48, "id2")]}, {"image_hash_differs", "label_hash_differs", "label_count_differs", "nothing_pasted", "source_count_differs", "base_count_differs", "dimensions_differ", "split_identity_differs"}),
    ({"images": [IMAGE, IMAGE]}, {"image_count", "image_path_repeated", "background_count", "image_repeated", "label_count_differs"}),
    ({"images": [("../a.jpg", *IMAGE[1:])]}, {"path_unsafe", "pair_missing", "background_missing", "source_count_differs", "base_count_differs", "class_missing", "base_line_changed"}),
    ({"files": [("s/images/a.jpg", "ha", 64, 48)]}, {"pair_missing", "class_missing", "base_line_changed"}),
    ({"lines": [("s/labels/a.txt", 1, "0 0.5 0.5 0.2 0.3"), ("s/labels/a.txt", 2, "2 0.1 0.1 0.4 0.1")]}, {"base_line_changed", "line_invalid", "class_missing"}),
    ({"backgrounds": [("s/images/a.jpg", "t/2.jpg", "hx", "t/2.txt")]}, {"background_hash_differs"}),
    ({"backgrounds": [("s/images/a.jpg", "v/1.jpg", "h3", "t/2.txt")]}, {"background_not_train"}),
    ({"sources": [("s/images/a.jpg", "o2", "t/1.jpg", "h1")]}, {"object_not_in_bank"}),
    ({"sources": [("s/images/a.jpg", "o1", "v/1.jpg", "h3")]}, {"object_provenance_differs", "object_not_train", "protected_hash_used"}),
    ({"splits": [("train", "t/1.jpg", "h1"), ("train", "t/2.jpg", "h2"), ("test", "v/2.jpg", "ha")]}, {"image_is_real"}),
])
def test_synthetic_pool(make, changes, rules):
    assert {r for r, _ in found(pool(make, **changes))} == rules


def test_views(make):
    files = [(g, s, k, f"{g}/{s}/{k}s/{n}.{e}", f"{s}{n}") for g in ("a", "b") for s, n in (("train", "1"), ("train", "2"), ("val", "3")) for k, e in (("image", "jpg"), ("label", "txt"))]
    schema = "regime string, split string, kind string, path string, sha256 string"
    lines = make("regime string, path string, line_number int, line string", ("a", "p", 1, "0 0.5 0.5 1 1"))
    names = make("regime string, position int, class_name string", *[(g, i, c) for g in ("a", "b") for i, c in enumerate(("x", "y"))])
    regimes, val = make("regime string", ("a",), ("b",)), make("sha256 string", ("val3",))
    check = lambda f, l=lines, n=names: found(suites.views(make(schema, *f), l, n, regimes, ["x", "y"], val, 2, 1))  # noqa: E731, E741
    assert check(files) == []
    assert check([f for f in files if f[3] != "a/train/labels/2.txt"]) == [("pair_count", "a:train"), ("stems_differ", "a:train")]
    assert check([(*f[:4], "other") if f[3] == "b/val/images/3.jpg" else f for f in files]) == [("validation_differs", "b")]
    bad = make("regime string, path string, line_number int, line string", ("a", "p", 1, "0 1"), ("a", "p", 2, "0.0 0.5 0.5 1 1"), ("a", "p", 3, "2 0.5 0.5 1 1"), ("a", "p", 4, "1 0.5 0.5 0 1"), ("a", "p", 5, "0 x 0.5 1 1"))
    assert check(files, bad) == [("box_invalid", "a:p:4"), ("class_invalid", "a:p:3"), ("field_count", "a:p:1"), ("non_numeric", "a:p:2"), ("non_numeric", "a:p:5")]
    assert check(files, lines, names.where("regime = 'a'").unionAll(names.where("regime = 'b'").select("regime", (1 - F.col("position")).alias("position"), "class_name"))) == [("class_order", "b")]


def test_frozen_files_of_the_leakage_suite(make):
    splits = make("split string, image_path string, content_hash string, source_group_id string", ("train", "a", "h", "s"), ("test", "b", "i", "t"))
    empty = (make("image_path string, duplicate_group_id string"), make("manifest string, image_path string, content_hash string"), make("path string"))
    combined = sha(f"x:{'1' * 64}\ny:{'2' * 64}")
    hashes = lambda *rows: make("name string, expected string, actual string, combined string", *rows)
    good = [("y", "2" * 64, "2" * 64, combined), ("x", "1" * 64, "1" * 64, combined)]
    assert found(suites.leakage(splits, *empty, hashes(*good), combined)) == []
    assert [r for r, _ in found(suites.leakage(splits, *empty, hashes(good[0], (*good[1][:2], "3" * 64, combined)), "other"))] == ["combined_identity_differs", "expected_identity_differs", "frozen_hash_differs"]
    assert found(suites.leakage(splits, *empty, hashes(good[0], (*good[1][:2], None, combined)))) == [("frozen_file_missing", "x")]


def test_included_images_follow_from_the_violations(make):
    images = make("path string, readable boolean", ("x/images/a.jpg", True), ("x/images/b.jpg", True), ("x/images/c.jpg", False), ("x/images/d.jpg", True))
    labels = make("path string", ("x/labels/a.txt",), ("x/labels/b.txt",), ("x/labels/c.txt",))
    lines = make("path string, line_number int, line string", ("x/labels/a.txt", 1, "0 0.5 0.5 0.1 0.1"), ("x/labels/b.txt", 1, "9 0.5 0.5 0.1 0.1"), ("x/labels/c.txt", 1, "0 0.5 0.5 0.1 0.1"))
    out = suites.included_images(images, suites.dataset_files(images, labels, lines, 2)).orderBy("path").collect()
    assert [(r["inclusion_status"], r["exclusion_reason"]) for r in out] == [("included", ""), ("excluded", "no_valid_objects;unknown_class"), ("excluded", "corrupt_image"), ("excluded", "missing_label")]


def test_runs(make):
    runs = "run string, status string, mode string, profile string, epochs int, test_access int"
    files = make("run string, name string", ("a", "best.pt"), ("a", "log.csv"), ("b", "best.pt"))
    good = make(runs, ("a", "completed", "final", "p", 50, 0))
    assert found(suites.completed_runs(good, files, ("best.pt", "log.csv"), 50)) == []
    bad = good.unionAll(make(runs, ("b", "running", None, "q", 49, None)))
    assert found(suites.completed_runs(bad, files, ("best.pt", "log.csv"), 50)) == [("epochs", "b"), ("file_missing", "b/log.csv"), ("not_completed", "b"), ("not_final", "b"), ("profiles_differ", "profile"), ("test_access", "b")]
    latest = make("regime string, run string, status string, smoke boolean, test_access int", ("x", "a", "completed", True, 0), ("y", "b", "failed", None, 1))
    expected = make("regime string", ("x",), ("y",), ("z",))
    assert found(suites.smoke_runs(latest, expected, files, ("best.pt", "log.csv"))) == [("file_missing", "b/log.csv"), ("not_completed", "b"), ("not_smoke", "b"), ("regime_missing", "z"), ("test_access", "b")]


def test_inputs_bundles_and_split_files(make):
    rows = make("regime string, split string, path string, identity string", ("x", "train", "a", "i"), ("x", "train", "../b", "i"), ("x", "val", "c", "j"))
    got = suites.runner_inputs(rows, make("regime string, split string, n int", ("x", "train", 2), ("x", "val", 2)), make("path string", ("a",), ("../b",)), make("identity string", ("i",)), make("path string", ("c",)))
    assert found(got) == [("count", "x:val"), ("file_missing", "c"), ("identity_not_frozen", "j"), ("path_unsafe", "x:../b"), ("test_referenced", "x:c")]
    manifest, files = make("path string, sha256 string", ("a", "1"), ("b", "2")), make("path string, sha256 string", ("a", "1"), ("b", "2"))
    assert found(suites.bundle(manifest, files, sha("a:1\nb:2"))) == []
    odd = make("path string, sha256 string", ("a", "9"), (".env", "3"), ("/x", "4"))
    assert found(suites.bundle(odd, files, "0")) == [("content_prohibited", ".env"), ("file_missing", ".env"), ("file_missing", "/x"), ("file_unlisted", "b"), ("hash_differs", "a"), ("identity_differs", sha(".env:3\n/x:4\na:9")), ("path_unsafe", "/x")]
    split = "image_path string, label_path string, inclusion_status string, content_hash string, width int, height int, objects int"
    there = make("path string, sha256 string, width int, height int, lines int", ("a", "1", 4, 5, None), ("al", "x", None, None, 3))
    assert found(suites.split_files(make(split, ("a", "al", "included", "1", 4, 5, 3)), there)) == []
    bad = make(split, ("a", "al", "excluded", "2", 4, 6, 2), ("a", "al", "included", "2", 4, 5, 3), ("b", "bl", "included", "3", 1, 1, 1))
    assert found(suites.split_files(bad, there)) == [("file_missing", "b"), ("hash_differs", "a"), ("hash_differs", "a"), ("hash_repeated", "2"), ("object_count_differs", "a"), ("path_repeated", "a"), ("size_differs", "a"), ("status", "a")]


def test_campaigns(make):
    results = "place int, model string, map double, map50 double, latency double, place_in_ranking int"
    lock, files = make("name string, sha256 string", ("m", "1"), ("n", "2")), make("name string, sha256 string", ("m", "1"), ("n", "2"))
    good = make(results, (1, "a", 0.2, 0.5, 9.0, 2), (2, "b", 0.2, 0.6, 9.0, 1), (3, "c", 0.2, 0.5, 9.0, 3))
    assert found(suites.campaign(good, ["a", "b", "c"], lock, files)) == []
    wrong = good.withColumn("place_in_ranking", F.col("place"))
    assert found(suites.campaign(wrong, ["b", "a", "c"], lock, make("name string, sha256 string", ("m", "9")))) == [("file_hash_differs", "m"), ("file_missing", "n"), ("model_order", "a,b,c"), ("ranking_differs", "a"), ("ranking_differs", "b")]


def test_documents_and_settings(make):
    cells = make("position int, text string", (1, "# One"), (2, "run it"), (3, " # Two "))
    assert found(suites.text_policy(cells, ["# One", "# Two"], ("secret",))) == []
    assert found(suites.text_policy(cells, ["# Two", "# One"], ("run",))) == [("banned_text", "2"), ("section_order", "# One,# Two")]
    document = make("document string", ('{"a": [1, 2], "b": [], "p": "C:/home"}',))
    assert found(suites.snapshot_policy(document, {"a": 2, "b": 0}, ("/root",))) == []
    assert found(suites.snapshot_policy(document, {"a": 3, "c": 1}, ("/home",))) == [("count", "a"), ("count", "c"), ("forbidden", "/home")]
    schema = make("key string, kind string, low double, high double, below string", ("small", "int", 1.0, None, "large"), ("large", "int", None, 100.0, None), ("on", "boolean", None, None, None), ("name", "text", None, None, None))
    value = lambda **k: make("key string, value string", *k.items())
    assert found(suites.settings(value(small="3", large="9", on="True", name="x"), schema)) == []
    assert found(suites.settings(value(small="10", large="9", on="yes", name=" ", more="1"), schema)) == [("key_unknown", "more"), ("kind", "name"), ("kind", "on"), ("order", "small")]
    assert found(suites.settings(value(small="0", large="101.5"), schema)) == [("key_missing", "name"), ("key_missing", "on"), ("kind", "large"), ("range", "large"), ("range", "small")]
    assert found(suites.config_differences(value(a="1", b="2", c="3"), value(a="1", b="9"))) == [("value_differs", "b"), ("value_differs", "c")]


def test_the_gate_raises_by_rule_and_key(make):
    bad = pool(make, images=[IMAGE, IMAGE])
    with pytest.raises(ValueError, match="synthetic_pool: image_count"):
        require(bad, ["image_count", "image_repeated"])
