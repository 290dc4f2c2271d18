"""Scores mean the same at every bound of the training sample."""

import numpy as np

from tidewright.llm import toxicity


def test_two_sample_bounds(spark):
    sf = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{sf}/documents.parquet").join(spark.read.parquet(f"{sf}/labels.parquet").where("toxic = 0"), "doc_id")
    clean = [r["text"] for r in rows.where(toxicity.held_out(3, 1)).select("text").limit(600).collect()]
    full, few = (np.array(toxicity.fit(spark, sf, n).scorer()(clean)) for n in (toxicity.PER_CLASS, 300))
    print("mean scores of clean texts", full.mean(), few.mean(), "flagged", (full >= toxicity.THRESHOLD).mean(), (few >= toxicity.THRESHOLD).mean())
    assert abs(few.mean() - full.mean()) < 0.05
    assert (few >= toxicity.THRESHOLD).mean() < 0.05
