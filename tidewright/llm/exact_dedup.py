"""Exact deduplication by skew-safe combining, in DataFrame operations alone.

Equal texts are combined in three steps, each of which groups by the digest *and* the whole text, so that two texts
of one digest never merge:

1. locally: the map side of the first aggregation leaves one row per text and task;
2. salted: the first exchange deals the rows of one text over ``salts`` tasks by a hash of the id;
3. globally: the winners of the salts, at most ``salts`` rows per text, meet in one task.

``exact_groups`` then lets every row look up its group by SHA-256 and a second, independent hash of the text. That join's
lookup side is unique and both exchanges below it are Spark's own, so adaptive execution splits the partition of a hot
group. ``dedup_rows`` needs no lookup: the winner's other columns travel through the steps. It has no first step: columns of any type
make Spark combine by sorting whole rows, and a sort beside the reader's row groups and batches of texts was more than a small heap holds. So rows
are dealt over the salts as they are read, and the texts are sorted where nothing else needs memory, once for both of the other steps.

Cases: null text counts as empty; an empty table gives no rows; a null id loses against any other, and a group of null
ids alone has a null keep_id; rows that repeat an id and text are one document: ``exact_groups`` gives each of them the
same answer, ``dedup_rows`` returns one of them; other columns play no part, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table

SALTS = 16


def _keyed(docs: DataFrame, id_col: str, text_col: str, salts: int, *more) -> DataFrame:
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"), *more)
    return rows.withColumns({"_sha": F.unhex(F.sha2("_text", 256)), "_check": F.xxhash64("_text"), "_salt": F.pmod(F.xxhash64("_id"), F.lit(salts))})


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """One row per row of ``docs``: id_col, keep_id, group_size, kept, text_sha256."""
    rows = _keyed(docs, id_col, text_col, salts)
    salted = rows.groupBy("_sha", "_check", "_salt", "_text").agg(F.max("_id").alias("_keep"), F.count("*").alias("_size"))
    won = salted.groupBy("_sha", "_check", "_text").agg(F.max("_keep").alias("_keep"), F.sum("_size").alias("_size"))
    found = rows.select("_id", "_sha", "_check").join(won.drop("_text"), ["_sha", "_check"])
    return found.select(
        F.col("_id").alias(id_col), F.col("_keep").alias("keep_id"), F.col("_size").alias("group_size"),
        F.col("_id").eqNullSafe(F.col("_keep")).alias("kept"), F.lower(F.hex("_sha")).alias("text_sha256"),
    )


def dedup_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """The row with the largest id of each text, with all columns of ``docs`` in their order.

    Of rows that repeat an id and a text the one whose other columns hash highest stays (map columns are left out of
    that hash). A kept null text stays null.
    """
    others = [f for f in docs.schema.fields if f.name != text_col]
    plain = [F.col(f"`{f.name}`") for f in others if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    kept = F.struct(F.col(text_col).isNull().alias("_null"), *[F.col(f"`{f.name}`").alias(f"c{i}") for i, f in enumerate(others)])
    rows = _keyed(docs, id_col, text_col, salts, kept.alias("_kept"), F.xxhash64(*plain).alias("_tie"))
    order = F.struct("_id", "_tie")
    # The salt comes last, so that the order by text serves the next step too.
    salted = rows.repartition("_sha", "_check", "_salt").groupBy("_sha", "_check", "_text", "_salt").agg(F.max_by("_kept", order).alias("_kept"), F.max(order).alias("_order"))
    won = salted.groupBy("_sha", "_check", "_text").agg(F.max_by("_kept", "_order").alias("_kept"))
    back = {f.name: F.col(f"_kept.c{i}") for i, f in enumerate(others)} | {text_col: F.when(~F.col("_kept._null"), F.col("_text"))}
    return won.select(*[back[c].alias(c) for c in docs.columns])


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


OP4_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
