"""Every operator and stage on hard and on empty tables."""

import pytest

import corpus_pipeline
from tidewright.llm import packing
from tidewright.llm.queries import QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_hard_tables(spark, folder, name):
    rows = QUERIES[name](spark, folder).collect()
    if name.startswith("op9"):
        assert len({(r["doc_id"]) for r in rows}) == 12
    else:
        assert len(rows) == 14


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, empty, name):
    assert QUERIES[name](spark, empty).collect() == []


@pytest.mark.parametrize("stage", range(len(corpus_pipeline.STAGES)))
def test_stages(spark, folder, empty, hard_docs, no_docs, stage):
    name, f = corpus_pipeline.STAGES[stage]
    out = f(spark, hard_docs, folder)
    rows = out.collect()
    assert rows
    if name != "best_fit_packing":
        assert len(rows) <= 15 and out.columns == hard_docs.columns
    assert f(spark, no_docs, empty).collect() == []


def test_ties_and_nulls_of_exact_dedup(spark, folder):
    rows = {}
    for r in QUERIES["op4_exact_dedup"](spark, folder).collect():
        rows.setdefault(r["doc_id"], []).append(r)
    assert rows[1][0]["keep_id"] == 2 and rows[1][0]["group_size"] == 3 and not rows[1][0]["kept"] and rows[2][0]["kept"]
    assert rows[3][0]["keep_id"] == 4 and rows[3][0]["group_size"] == 3  # null counts as empty
    assert [r["kept"] for r in rows[8]] == [True, True]
    assert {r["keep_id"] for r in rows[None]} == {2, 4}


def test_exact_stage_leaves_one_row_of_each_text(spark, hard_docs, folder):
    out = corpus_pipeline.exact_stage(spark, hard_docs, folder)
    texts = [r["text"] or "" for r in out.collect()]
    assert len(texts) == len(set(texts)) == 9
    assert {r["doc_id"] for r in out.collect()} == {2, 4, 5, 6, 7, 8, 9, 10, 11}


def test_one_hot_group(spark, tmp_path):
    """A group of copies that is most of the table, over many partitions."""
    spark.range(3000).selectExpr("id AS doc_id", "CASE WHEN id % 3 < 2 THEN 'the same text for most of the rows here' ELSE concat('row ', id, ' is alone') END AS text").repartition(40).write.parquet(f"{tmp_path}/documents.parquet")
    out = QUERIES["op4_exact_dedup"](spark, str(tmp_path))
    assert out.where("group_size = 2000 AND keep_id = 2998").count() == 2000
    assert out.where("kept").count() == 1001
    near = QUERIES["op5_simhash_near_dedup"](spark, str(tmp_path))
    assert near.where("component_id = 0").count() >= 2000


def by_id(rows):
    out = {}
    for r in rows:
        out.setdefault(r["doc_id"], []).append(r)
    return out


def test_values_of_hard_rows(spark, folder):
    """Null, empty, tied, repeated and clashing rows have the answers that the docstrings state."""
    language = by_id(QUERIES["op2_language_id"](spark, folder).collect())
    assert {(r["lang_pred"], r["score"]) for i in (3, 4, 5, 8) for r in language[i]} == {("und", 0.0)}
    assert language[1][0][2:] == language[2][0][2:] and all(r["lang_pred"] != "und" for i in (1, 6, 9, 10) for r in language[i])
    toxic = by_id(QUERIES["op3_toxicity"](spark, folder).collect())
    assert len({r["score"] for i in (3, 4, 5) for r in toxic[i]}) == 1 and toxic[1][0]["score"] == toxic[2][0]["score"] and toxic[8][0] == toxic[8][1]
    quality = by_id(QUERIES["op8_quality_classifier"](spark, folder).collect())
    assert quality[3][0]["score"] == quality[4][0]["score"] and quality[8][0] == quality[8][1]
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for x in quality.values() for r in x)
    order = by_id(QUERIES["op6_order_minhash"](spark, folder).collect())
    assert order[1][0]["fingerprint"] == order[2][0]["fingerprint"] and order[3][0]["fingerprint"] == order[4][0]["fingerprint"]
    assert order[8][0]["near_next"] == 1.0 and order[3][0]["n_chars"] == 0 and order[9][0]["n_chars"] == len("Ünïcödé tëxt \U0001f600 with\u2028odd\x00 signs") and len(order[None]) == 2
    licence = by_id(QUERIES["op7_license_scan"](spark, folder).collect())
    assert {tuple(r[1:]) for x in licence.values() for r in x} == {("", 0, 0, None)}


def test_urls_without_host_or_scheme(spark, folder):
    urls = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    got = {r["page_id"]: r for r in QUERIES["op1_url_filter"](spark, folder).collect()}
    assert all((got[i]["host"], got[i]["path"], got[i]["rule"]) == ("", "", None) for i in (1, 2, 3) if "://" not in (urls[i] or "://"))
    rules = {i: (got[i]["host"], got[i]["rule"], got[i]["verdict"]) for i in (4, 6, 7, 8, 9, 11, 12, 13)}
    assert rules[4] == ("www.example.com", "www.example.com/en/", "allow") and rules[6] == ("a.net", "net/es/", "block")
    assert rules[7][1] == "net/fr/" and rules[8][1] is None and rules[9] == ("example.com", "example.com/en/", "block") and rules[12][1] == "www.example.com/en/"
    assert rules[13][:2] == ("Äb.net", "net/es/") and rules[11][1] is None


def test_packing_does_not_depend_on_files(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    pack = lambda df: sorted(map(repr, packing.best_fit(df.select("doc_id", "text"), shard_rows=3).collect()))
    assert pack(docs) == pack(docs.repartition(7)) == pack(docs.coalesce(1).orderBy("text"))
