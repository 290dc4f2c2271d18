"""What a service shows of the results, as views: models, evaluations, runs, identities, reports. No network, no state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def health(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, available): which result tables can be read."""
    spark = next(iter(tables.values())).sparkSession
    return spark.createDataFrame([(name, bool(df.columns)) for name, df in sorted(tables.items())], "table string, available boolean")


def project(splits: DataFrame, models: DataFrame) -> DataFrame:
    """One row: images and groups by split as a map, and the number of models."""
    by = splits.groupBy("split").agg(F.count("*").alias("images"), F.countDistinct("source_group_id").alias("groups"))
    counts = by.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("split", F.struct("images", "groups"))))).alias("splits"))
    return counts.join(models.agg(F.count("*").alias("models")), F.lit(True))


def models(results: DataFrame, ranking: DataFrame) -> DataFrame:
    """Every model of ``results(model, ...)`` with its rank; the one of rank 1 is recommended. A model without a rank raises."""
    out = results.join(ranking.select("model", F.col("rank").alias("_rank")), "model", "left")
    out = out.withColumn("rank", F.coalesce("_rank", F.raise_error(F.concat(F.lit("no rank of "), "model")).cast("long"))).drop("_rank")
    return out.withColumn("recommended", F.col("rank") == 1)


def model(found: DataFrame, name: str) -> DataFrame:
    """The row of one model; raises KeyError if there is none."""
    out = found.where(F.col("model") == name)
    if out.isEmpty():
        raise KeyError(name)
    return out


def evaluation(results: DataFrame, sizes: DataFrame, classes: DataFrame, name: str | None = None) -> DataFrame:
    """Each model's results with its rows by size and by class as arrays; of one model if ``name`` is given."""
    nest = lambda df, as_: df.groupBy("model").agg(F.array_sort(F.collect_list(F.struct(*[c for c in df.columns if c != "model"]))).alias(as_))
    out = results.join(nest(sizes, "sizes"), "model", "left").join(nest(classes, "classes"), "model", "left")
    return out if name is None else model(out, name)


def training(runs: DataFrame, log: DataFrame) -> DataFrame:
    """Each run with its number of epochs and the best epoch by ``metric``, the first on a tie; of ``log(run, epoch, metric)``."""
    best = log.groupBy("run").agg(F.count("*").alias("epochs"), F.max_by("epoch", F.struct("metric", -F.col("epoch"))).alias("best_epoch"), F.max("metric").alias("best"))
    return runs.join(best, "run", "left")


def reproducibility(lineage: DataFrame) -> DataFrame:
    """``lineage(node, parent, sha256)`` with whether each identity is a digest and each parent is known."""
    known = lineage.select(F.col("node").alias("parent")).distinct().withColumn("_known", F.lit(True))
    return lineage.join(known, "parent", "left").select("node", "parent", "sha256", F.col("sha256").rlike("^[0-9a-f]{64}$").alias("is_digest"), (F.col("parent").isNull() | F.coalesce("_known", F.lit(False))).alias("parent_known"))


def reports(files: DataFrame) -> DataFrame:
    """The Markdown, CSV and JSON files of ``files(path, size)``, by path, without those under a hidden folder."""
    return files.where(F.lower("path").rlike(r"\.(md|csv|json)$") & ~F.col("path").rlike(r"(^|/)\.")).orderBy("path")
