import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def hard_docs(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and columns whose names clash with outputs."""
    long = " ".join(f"word{i % 977}" for i in range(30_000))
    rows = [
        (1, "The quick brown fox jumps over the lazy dog again and again.", "en", "a", 5), (2, "The quick brown fox jumps over the lazy dog again and again.", "en", None, 5),
        (3, None, None, None, None), (4, "", "de", "b", 0), (5, "   \n\t ", "de", "b", 6), (None, "The quick brown fox jumps over the lazy dog again and again.", "en", "a", 1),
        (None, None, None, None, None), (6, long, "en", "c", len(long)), (7, long + " end", "en", "c", None), (8, "1234 5678 !!!", "fr", "c", 13), (8, "1234 5678 !!!", "fr", "c", 13),
        (9, "Ünïcödé tëxt \U0001f600 with\u2028odd\x00 signs", None, "d", 3), (10, "a", "en", "d", 1), (11, "a b", "en", "d", 1),
    ]
    extra = "score double, kept boolean, fp long, _text string, _sha binary, component_id long, predicted int, bucket int, shard long, held_out boolean, `n` string, m map<string,int>"
    return spark.createDataFrame([(*r, 0.5, True, 1, "x", b"y", 2, 3, 4, 5, None, "q", {"a": 1}) for r in rows], f"{DOCS}, {extra}")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def folder(spark, hard_docs, tmp_path_factory):
    """A data folder with the hard documents, labels with nulls and contradictions, and odd urls."""
    at = str(tmp_path_factory.mktemp("hard"))
    hard_docs.write.parquet(f"{at}/documents.parquet")
    labels = [(1, 1, 0), (2, 1, 1), (2, 0, 0), (6, 1, 0), (8, 0, 1), (9, None, None), (None, 1, 1), (10, 0, 1), (11, 1, 0), (77, 1, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    urls = [
        None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/x?a=1#b", "https://a.net/es", "https://a.net/es/", "x://net/fr/1", "https://notnet/fr/", "https://example.com/en/1?u=://z/",
        "https://example.com?x=/en/", "ftp://casino.bets.org/" + "a/" * 5000, "https://www.example.com/en/1", "https://ÄB.net/es/ü",
    ]
    spark.createDataFrame([(i if i % 5 else None, u, "h", "v") for i, u in enumerate(urls)], "page_id long, url string, host string, verdict string").write.parquet(f"{at}/pages.parquet")
    return at


@pytest.fixture(scope="session")
def empty(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("empty"))
    spark.createDataFrame([], DOCS).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{at}/pages.parquet")
    return at
