"""What the pipeline's stages keep out of the driver and out of rows."""

import os

import numpy as np
import pandas as pd

from tidewright.llm import near_copies, toxicity


def test_training_is_not_in_the_driver(spark, sf, monkeypatch):
    def here(data):
        return toxicity.Model(np.full(toxicity.BUCKETS, os.getpid(), np.float32), 0.0)

    monkeypatch.setattr(toxicity, "train", here)
    assert toxicity.fit(spark, sf).weight[0] != os.getpid()


def test_pairs_that_cannot_be_alike_never_become_rows():
    """Four nodes of one bucket and one fingerprint: two are alike in both, one differs in the second one, one in size."""
    rows = pd.DataFrame({
        "key": np.zeros(4, np.int64), "mask": np.zeros(4, np.int32), "node": np.arange(4), "fp": np.full(4, 77, np.int64),
        "other": np.array([0, 1, -1, 0], np.int64), "n": np.array([100, 100, 100, 40], np.int32), "component": np.arange(4),
    })
    found = pd.concat(near_copies._candidates(1, True)(iter([rows])))
    assert found[["a", "b", "open"]].to_numpy().tolist() == [[0, 1, False]]
