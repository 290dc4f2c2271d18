"""Frozen identities: of named files, of designs, and the states of a sealed run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.sources.sinks import write_same

from .validation import fingerprint, set_difference

#: From each state of a campaign the states that may follow.
STATES = {
    None: ("preflight",), "preflight": ("running", "failed_preflight"), "running": ("sealed", "failed_technical_attempt"),
    "failed_technical_attempt": ("preflight",), "failed_preflight": (), "sealed": (),
}


def combined(named: DataFrame) -> DataFrame:
    """One row ``identity``: the digest of the lines ``name:sha256`` of ``named(name, sha256)`` by name. A handful of manifests."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("name", "sha256"))), lambda x: F.concat(x["name"], F.lit(":"), x["sha256"]))
    return named.agg(F.sha2(F.array_join(lines, "\n"), 256).alias("identity"))


def frozen(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, n, identity) of each table and, as ``combined``, of all: what a freeze writes beside them."""
    out = None
    for name, df in tables.items():
        one = fingerprint(df).select(F.lit(name).alias("name"), "n", "identity")
        out = one if out is None else out.unionByName(one)
    whole = combined(out.withColumnRenamed("identity", "sha256")).select(F.lit("combined").alias("name"), F.lit(None).cast("long").alias("n"), "identity")
    return out.unionByName(whole)


def compared(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """(name, expected, actual, same) of two tables (name, identity): whether a reproduction equals what was frozen."""
    both = expected.select("name", F.col("identity").alias("expected")).join(actual.select("name", F.col("identity").alias("actual")), "name", "full")
    return both.withColumn("same", F.coalesce(F.col("expected") == F.col("actual"), F.lit(False)))


def freeze(tables: dict[str, DataFrame], path: str) -> DataFrame:
    """Writes each table below ``path`` once, then the identities; refuses a path in use."""
    found = frozen(tables)
    for name, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{path}/{name}")
    found.coalesce(1).write.mode("errorifexists").json(f"{path}/identity")
    return found.sparkSession.read.schema(found.schema).json(f"{path}/identity")


def active(identities: DataFrame, wanted: str) -> str:
    """``wanted`` if the combined identity is it; raises else."""
    found = identities.where("name = 'combined'").select("identity").first()
    if found is None or found[0] != wanted:
        raise ValueError(f"identity {found and found[0]} is not the active {wanted}")
    return wanted


def frozen_profile(path: str, profile: dict) -> None:
    """Writes a profile once; the same again is no change, another one raises."""
    write_same(path, profile)


def next_state(now: str | None, then: str) -> str:
    """``then`` where it may follow ``now``; raises else, so that a sealed or failed campaign stays what it is."""
    if then not in STATES.get(now, ()):
        raise ValueError(f"a campaign can't go from {now} to {then}")
    return then


def campaign_history(events: DataFrame) -> DataFrame:
    """``events(campaign, at, state)`` with the state before each and whether the change is allowed."""
    from pyspark.sql import Window as W

    before = F.lag("state").over(W.partitionBy("campaign").orderBy("at"))
    allowed = F.lit(False)
    for now, then in STATES.items():
        allowed = allowed | (F.col("before").eqNullSafe(F.lit(now)) & F.col("state").isin(*then)) if then else allowed
    return events.withColumn("before", before).withColumn("allowed", allowed)


def design_differs(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """Rows of two designs that only one has, as (key, side)."""
    return set_difference(expected, actual, key)
