"""Validation: rule chains, violation tables, and the fail-fast gate."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.functions.scalars import number

SCHEMA = ("suite", "rule", "severity", "key", "detail")


def first_failure(rules: list[tuple[str, Column]]) -> Column:
    """The code of the first rule that a row breaks, null if none; later rules are not evaluated for it."""
    out = F.lit(None).cast("string")
    for code, broken in reversed(rules):
        out = F.when(F.coalesce(broken, F.lit(False)), F.lit(code)).otherwise(out)
    return out


def annotation_rules(tokens: Column, classes: int) -> list[tuple[str, Column]]:
    """The ordered rules of a box line: class, centre and size as five numbers, the last four shares of the image."""
    v = [number(F.get(tokens, i)) for i in range(5)]
    shares = v[1:]
    bad_number = reduce(lambda a, b: a | b, [x.isNull() for x in v])
    half_w, half_h = v[3] / 2, v[4] / 2
    return [
        ("unsupported_annotation_line", F.size(tokens) != 5),
        ("non_numeric_annotation", bad_number),
        ("unknown_class", (v[0] != F.floor(v[0])) | (v[0] < 0) | (v[0] >= classes)),
        ("non_normalized_box", reduce(lambda a, b: a | b, [(x < 0) | (x > 1) for x in shares])),
        ("non_positive_box", (v[3] <= 0) | (v[4] <= 0)),
        ("box_outside_image", (v[1] - half_w < 0) | (v[1] + half_w > 1) | (v[2] - half_h < 0) | (v[2] + half_h > 1)),
    ]


def violations(suite: str, rules: list[tuple[str | Column, str, DataFrame, Column, Column]]) -> DataFrame:
    """The union of (rule, severity, rows, key, detail) as one table of SCHEMA."""
    parts = [df.select(F.lit(suite).alias("suite"), F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), key.cast("string").alias("key"), detail.cast("string").alias("detail")) for rule, severity, df, key, detail in rules]
    return reduce(DataFrame.unionByName, parts)


def require(found: DataFrame, order: list[str]) -> None:
    """Raises on the first violation by the order of rules, then key."""
    place = F.coalesce(F.array_position(F.array(*[F.lit(r) for r in order]), F.col("rule")), F.lit(len(order) + 1))
    worst = found.orderBy(F.when(place == 0, len(order) + 1).otherwise(place), "key").limit(1).collect()
    if worst:
        raise ValueError(f"{worst[0]['suite']}: {worst[0]['rule']}: {worst[0]['key']}: {worst[0]['detail']}")


def overlap(rows: DataFrame, split: str, value: str) -> DataFrame:
    """(value, splits): values that several splits hold; null and blank values are ignored."""
    own = rows.where(F.col(value).isNotNull() & (F.trim(F.col(value).cast("string")) != ""))
    return own.groupBy(F.col(value).alias("value")).agg(F.array_join(F.array_sort(F.collect_set(split)), ",").alias("splits"), F.countDistinct(split).alias("_n")).where("_n > 1").drop("_n")


def set_difference(expected: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """(key, side): keys that only one of the two tables has: ``missing`` from found, or ``extra`` in it."""
    missing = expected.select(key).distinct().join(found, key, "left_anti").withColumn("side", F.lit("missing"))
    extra = found.select(key).distinct().join(expected, key, "left_anti").withColumn("side", F.lit("extra"))
    return missing.unionByName(extra)


def fingerprint(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row with the table's row count and an identity that no order of rows changes.

    Row digests are summed as numbers in four 60-bit pieces, so no task ever holds the list of digests.
    """
    columns = columns or sorted(df.columns)
    row = F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\x00")) for c in columns]), 256)
    sums = [F.sum(F.conv(F.substring("_row", 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")).cast("string") for i in range(4)]
    return df.select(row.alias("_row")).agg(F.count("*").alias("n"), F.sha2(F.concat_ws("|", *[F.coalesce(s, F.lit("0")) for s in sums]), 256).alias("identity"))
