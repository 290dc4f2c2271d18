"""An incremental form of the event checks: a stream of event files, validated and counted by day."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.operators.validation import first_failure
from tidewright.sources.shared import shared_folder


def validated(events: DataFrame) -> DataFrame:
    """``events`` with the first rule that each breaks, or ``ok``."""
    rules = [("no_user", F.col("user_id").isNull()), ("non_numeric", F.col("value").isNull() | F.isnan("value")), ("non_positive", F.col("value") <= 0)]
    return events.withColumn("code", F.coalesce(first_failure(rules), F.lit("ok")))


def daily(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Counts by day, type and code. Of a stream, rows later than ``late`` behind the newest are left out."""
    timed = validated(events).withColumn("ts", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        timed = timed.withWatermark("ts", late)
    return timed.groupBy(F.window("ts", "1 day").alias("w"), "event_type", "code").agg(F.count("*").alias("n"))


def run_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads the event files as a stream until all are consumed; state and results live in the shared folder."""
    base = f"{shared_folder(spark)}/events-{uuid.uuid4().hex}"
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("maxFilesPerTrigger", 16).parquet(f"{sf_dir}/events.parq*")

    def keep(batch: DataFrame, number: int) -> None:
        batch.select(F.to_date("w.start").alias("day"), "event_type", "code", "n").write.mode("overwrite").parquet(f"{base}/out/{number % 2}")
        last.append(number % 2)

    last: list[int] = []
    query = daily(stream).writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    if not last:
        return spark.createDataFrame([], "day date, event_type string, code string, n long")
    return spark.read.parquet(f"{base}/out/{last[-1]}")
