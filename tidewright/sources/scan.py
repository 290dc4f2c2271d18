"""Scans and sinks: typed tables, all-text CSV, nested JSON, files, write-once outputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_csv(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """A CSV with a header whose fields are all text; an empty field is an empty string, not null. Fails if it is missing."""
    reader = spark.read.option("header", True)
    if columns:
        reader = reader.schema(T.StructType([T.StructField(c, T.StringType()) for c in columns])).option("enforceSchema", False)
    return reader.csv(path).na.fill("")


def header(spark: SparkSession, path: str) -> list[str]:
    """The column names of a CSV, without reading its rows."""
    return spark.read.option("header", True).csv(path).columns


def json_rows(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A JSON document that is one object or an array of objects; bad input fails."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def latest_run(spark: SparkSession, glob: str, schema: str, key: str, ended: str) -> DataFrame:
    """Of the JSON files of ``glob`` the run that ended last for each ``key``, by time, with its file's name."""
    runs = spark.read.schema(schema).option("multiLine", True).json(glob).withColumn("file", F.input_file_name())
    return runs.groupBy(key).agg(F.max_by(F.struct(*runs.columns), F.struct(F.to_timestamp(ended), "file")).alias("r")).select("r.*")


def files(spark: SparkSession, path: str, extensions: tuple[str, ...]) -> DataFrame:
    """Every file below ``path``: path, length, and whether its extension is one of ``extensions``, in any case."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    return found.withColumn("supported", F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).isin(*extensions))


def label_lines(spark: SparkSession, path: str) -> DataFrame:
    """Label files as (path, line_number from 1, line), blank lines left out."""
    read = spark.read.text(path, wholetext=True, recursiveFileLookup=True).withColumn("path", F.input_file_name())
    lines = read.select("path", F.posexplode(F.split("value", "\n")).alias("at", "line"))
    return lines.where(F.trim("line") != "").select("path", (F.col("at") + 1).alias("line_number"), "line")


def label_path(image_path: Column) -> Column:
    """The label file of an image: the last ``images`` directory becomes ``labels``, the suffix ``.txt``."""
    return F.regexp_replace(image_path, r"^(.*/)?images/(.*)\.[^./]+$", "$1labels/$2.txt")


def write_once(df: DataFrame, path: str, partition_by: tuple[str, ...] = (), kind: str = "parquet") -> None:
    """Writes ``df``, and fails if ``path`` exists."""
    df.write.mode("errorifexists").partitionBy(*partition_by).format(kind).save(path)


def write_csv(df: DataFrame, path: str, order: list[str], allow_empty: bool = True) -> None:
    """A CSV with a header, each file sorted by ``order``; refuses an empty table unless allowed."""
    if not allow_empty and df.isEmpty():
        raise ValueError("no rows to write")
    df.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("errorifexists").option("header", True).csv(path)


def snapshot(parts: dict[str, DataFrame]) -> DataFrame:
    """One row with one JSON document: an array of the rows of each small result table by its name."""
    out = None
    for name, df in parts.items():
        one = df.agg(F.sort_array(F.collect_list(F.to_json(F.struct(*df.columns)))).alias("rows"))
        one = one.select(F.concat(F.lit(f'"{name}":['), F.array_join("rows", ","), F.lit("]")).alias("part"), F.lit(name).alias("name"))
        out = one if out is None else out.unionByName(one)
    return out.agg(F.concat(F.lit("{"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("name", "part"))), lambda x: x["part"]), ","), F.lit("}")).alias("document"))
