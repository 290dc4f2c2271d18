"""What the operators of this subpackage share: tables, training samples, Arrow batches; checkpoints are the library's."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidewright.sources.shared import checkpoint, removed, stored  # noqa: F401

#: Rows of an Arrow batch of texts. Spark's default of 10,000 rows would put a gigabyte into a Python worker where
#: texts are 100 kB long; this many keep a batch of such texts near 25 MB.
TEXT_BATCH = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of the folder ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Lower the Arrow batch size of the session to ``TEXT_BATCH`` rows unless it is lower already."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > TEXT_BATCH:
        spark.conf.set(key, str(TEXT_BATCH))


@contextmanager
def large_batches(spark: SparkSession, rows: int = 50_000) -> Iterator[None]:
    """Arrow batches of ``rows`` rows for what is executed inside, where rows are a few numbers each."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key, "10000")
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def given_back() -> None:
    """Gives memory that is free in this process back to the system: a Python worker is kept for the stages after its own,
    beside a JVM that grows to its whole heap in those without Python."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def released(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files and checkpoints that nothing refers to any more: it does so when the driver collects its garbage,
    which a driver with memory to spare does only every half hour."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def remainder(doc_id: Column, by: int) -> Column:
    """crc32 of the id as text, modulo ``by``."""
    return F.crc32(doc_id.cast("string")) % F.lit(by)


def held_out(by: int, rest: int) -> Column:
    """Whether doc_id is of the fold that is not learnt from; false for a null id, which is not learnt from either."""
    return F.coalesce(remainder(F.col("doc_id"), by) == rest, F.lit(False)).alias("held_out")


def bounded_per_class(rows: DataFrame, label: str, key: str, most: int) -> DataFrame:
    """At most ``most`` rows of each value of ``label``, chosen by a hash of ``key``: a fixed, documented bound.

    A first aggregation counts the values, a hash threshold then thins each value to about ``1.5 * most`` rows, so
    the window that makes the bound hard sees a bounded number of rows even where one value has most of the table.
    """
    counts = rows.where(F.col(label).isNotNull()).groupBy(F.col(label).alias("_tw_label")).agg(F.count("*").alias("_tw_n"))
    spread = 1 << 20
    hashed = F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(spread))
    found = rows.join(counts, F.col(label) == F.col("_tw_label"))
    found = found.where(hashed < F.least(F.lit(1.0), F.lit(1.5 * most) / F.col("_tw_n")) * spread + 1).drop("_tw_label", "_tw_n")
    order = W.partitionBy(label).orderBy(F.xxhash64(F.col(key).cast("string")), F.col(key))
    return found.withColumn("_tw_rank", F.row_number().over(order)).where(F.col("_tw_rank") <= most).drop("_tw_rank")


def labelled(spark: SparkSession, sf_dir: str, column: str, fold: Column) -> DataFrame:
    """(doc_id, label) of the labels that may be learnt from; of a document labelled twice the larger label counts."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col(column).cast("int").alias("label"))
    labels = labels.where(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & fold)
    return labels.groupBy("doc_id").agg(F.max("label").alias("label"))


def class_counts(rows: DataFrame, label: str) -> dict:
    """The number of rows of each value of ``label``, null left out."""
    return {r[0]: r[1] for r in rows.groupBy(label).count().collect() if r[0] is not None}


def training_rows(spark: SparkSession, sf_dir: str, column: str, fold: Column, per_class: int, longest: int) -> DataFrame:
    """(doc_id, text, label) of labelled documents for fitting: a bounded sample.

    ``fold`` says of ``doc_id`` whether a row may be learnt from. At most ``per_class`` documents of each label are
    taken, and none of over ``longest`` characters, so at most ``2 * per_class * longest`` characters. Null
    ids, labels and texts are left out; of a document labelled twice the larger label counts.
    """
    chosen = bounded_per_class(labelled(spark, sf_dir, column, fold), "label", "doc_id", per_class)
    texts = table(spark, sf_dir, "documents").select("doc_id", "text").where(F.col("text").isNotNull() & (F.length("text") <= longest))
    # The sample has at most 2 * per_class rows of two numbers.
    return texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("label").alias("label"))


def training_texts(spark: SparkSession, sf_dir: str, column: str, fold: Column, per_class: int, longest: int) -> list[tuple[str, int]]:
    """(text, label) of ``training_rows``, ordered, on the driver."""
    found = training_rows(spark, sf_dir, column, fold, per_class, longest).orderBy("doc_id")
    return [(r["text"], int(r["label"])) for r in found.select("text", "label").collect()]
