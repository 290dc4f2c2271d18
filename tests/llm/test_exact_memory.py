"""What exact deduplication of whole rows keeps in memory at once."""

from tidewright.llm.exact_dedup import dedup_rows


def test_texts_are_not_sorted_while_files_are_read(spark, sf):
    """Below the first exchange there are a scan and columns alone, and each exchange is followed by one sort of the texts."""
    plan = dedup_rows(spark.read.parquet(f"{sf}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    above, _, below = plan.rpartition("Exchange hashpartitioning")
    assert "Sort" not in below
    assert above.count("Sort [") == above.count("Exchange hashpartitioning") + 1


def test_copies_dealt_over_salts_leave_the_largest_id(spark):
    rows = [(i, "one text" if i % 2 else f"text {i // 10}", i % 3) for i in range(2000)]
    found = dedup_rows(spark.createDataFrame(rows, "doc_id long, text string, lang int").repartition(7))
    last = {text: (i, text, lang) for i, text, lang in rows}
    assert sorted(found.collect()) == sorted(last.values())
