"""The folder that driver and executors share: checkpoints, and tables written between steps."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the context, or the one that spark.checkpoint.dir names.

    Where neither is set, a local master gets a temporary folder, and a cluster raises ValueError: a folder of the driver's
    own disk would lose what executors write.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named:
            if context.master != "local" and not context.master.startswith("local["):
                raise ValueError("spark.checkpoint.dir names no shared folder")
            named = tempfile.mkdtemp(prefix="shared-")
        context.setCheckpointDir(named)
    return context.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """``df`` from an eager checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> tuple[DataFrame, str]:
    """``df`` as a Parquet table in the shared folder, reread, and the table's path."""
    path = f"{shared_folder(df.sparkSession)}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path), path


def removed(spark: SparkSession, path: str) -> None:
    """Deletes what ``stored`` wrote."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
