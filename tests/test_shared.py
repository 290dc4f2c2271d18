"""The shared folder: the context's, the named one, or a refusal."""

from types import SimpleNamespace

import pytest

from tidewright.sources import shared


def session(master, folder=None, named=None):
    context = SimpleNamespace(master=master, folder=folder)
    context.getCheckpointDir = lambda: context.folder
    context.setCheckpointDir = lambda x: setattr(context, "folder", x)
    return SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda key, default: named))


def test_folders():
    assert shared.shared_folder(session("spark://host:7077", "hdfs://a")) == "hdfs://a"
    assert shared.shared_folder(session("spark://host:7077", None, "hdfs://b")) == "hdfs://b"
    assert "shared-" in shared.shared_folder(session("local[4]"))
    for master in ("spark://host:7077", "local-cluster[2,1,1024]", "yarn"):
        with pytest.raises(ValueError):
            shared.shared_folder(session(master))


def test_stored_goes_to_the_checkpoint_folder(spark):
    df, path = shared.stored(spark.range(3))
    assert path.startswith(spark.sparkContext.getCheckpointDir()) and df.count() == 3
    shared.removed(spark, path)
