"""Sequential selections: a group-aware greedy split, deficit-greedy subsets, weighted draws, even samples."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidewright.functions.scalars import hash_order, hash_uniform

# The shares of the splits, in the order that decides ties.
RATIOS = {"train": 0.70, "val": 0.20, "test": 0.10}


def greedy_split(groups: DataFrame, seed: int, ratios: dict[str, float] = RATIOS) -> DataFrame:
    """(group, split) for ``groups(group, size, classes: map<string, long>)``.

    Groups go by falling rarity (the sum of 1 / total over their classes, in class order), falling size, then a digest
    of seed and group. Each goes to the split that leaves the least squared relative error of sizes plus the mean one
    of classes; ties go to the less filled, then the earlier split. The loop is sequential, so it runs as one ordered
    stream whose state is the splits' counts: memory does not grow with the number of groups.
    """
    totals = {r[0]: r[1] for r in groups.select(F.explode("classes").alias("c", "n")).groupBy("c").agg(F.sum("n")).collect()}
    items = groups.agg(F.sum("size")).first()[0] or 0
    names = sorted(totals)

    shares = np.array(list(ratios.values()))
    goal, class_goals = items * shares, shares[:, None] * np.array([float(totals[c]) for c in names])[None, :]
    place = {c: i for i, c in enumerate(names)}

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        splits, n = list(ratios), len(ratios)
        filled, counts = np.zeros(n), np.zeros((n, len(names)))
        size_by, class_by = np.maximum(goal, 1), np.maximum(class_goals, 1)
        for x in batches:
            out = []
            for size, classes in zip(x["size"], x["classes"], strict=True):
                own = np.zeros(len(names))
                for c, k in dict(classes).items():
                    own[place[c]] = k
                # An error is the sum over all splits; a choice changes that of its own split alone.
                now = ((filled - goal) / size_by) ** 2 + (((counts - class_goals) / class_by) ** 2).sum(1) / max(len(names), 1)
                then = ((filled + size - goal) / size_by) ** 2 + (((counts + own - class_goals) / class_by) ** 2).sum(1) / max(len(names), 1)
                best = min(range(n), key=lambda s: (round(then[s] - now[s], 12), filled[s] / size_by[s]))
                filled[best] += size
                counts[best] += own
                out.append(splits[best])
            yield pd.DataFrame({"group": x["group"], "split": out})

    known = F.create_map(*[F.lit(v) for c in names for v in (c, 1.0 / totals[c])]) if names else F.lit(None).cast("map<string,double>")
    rarity = F.aggregate(F.array_sort(F.map_keys("classes")), F.lit(0.0), lambda a, c: a + known[c])
    ordered = groups.withColumns({"_rarity": rarity, "_tie": hash_order(seed, F.col("group"))})
    ordered = ordered.repartition(1).sortWithinPartitions(F.desc("_rarity"), F.desc("size"), "_tie").select("group", "size", "classes")
    kind = dict(groups.dtypes)["group"]
    return ordered.mapInPandas(assign, f"group {kind}, split string")


def deficit_select(rows: DataFrame, key: str, classes: str, count: int, seed: int) -> DataFrame:
    """The keys of ``count`` rows chosen one by one: largest class deficit, then rarity, then digest of seed and key.

    Rows with one set of classes differ in their digest alone, so of each set only the first ``count`` can be chosen:
    the loop sees that many of each set at most, whatever the table's size.
    """
    n = rows.count()
    if not 0 <= count <= n:
        raise ValueError(f"{count} of {n} rows can't be chosen")
    tagged = rows.select(F.col(key).alias("key"), F.array_sort(F.array_distinct(F.col(classes))).alias("classes"), hash_order(seed, F.col(key)).alias("tie"))
    totals = {r[0]: r[1] for r in tagged.select(F.explode("classes").alias("c")).groupBy("c").count().collect()}
    goals = {c: t * count / max(n, 1) for c, t in totals.items()}
    heads = tagged.withColumn("_no", F.row_number().over(W.partitionBy("classes").orderBy("tie"))).where(F.col("_no") <= count)

    def choose(x: pd.DataFrame) -> pd.DataFrame:
        queues: dict[tuple, list] = {}
        for k, c, t in sorted(zip(x["key"], x["classes"], x["tie"], strict=True), key=lambda r: r[2], reverse=True):
            queues.setdefault(tuple(c), []).append((t, k))
        have, out = dict.fromkeys(totals, 0), []
        while len(out) < count:
            best = min((s for s in queues if queues[s]), key=lambda s: (-sum(max(goals[c] - have[c], 0.0) for c in s), -sum(1.0 / totals[c] for c in s), queues[s][-1][0]))
            out.append(queues[best].pop()[1])
            for c in best:
                have[c] += 1
        return pd.DataFrame({"key": out, "position": range(1, len(out) + 1)})

    kind = dict(tagged.dtypes)["key"]
    return heads.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(choose, f"key {kind}, position long").withColumnRenamed("key", key)


def weighted_draw(rows: DataFrame, key: str, weights: DataFrame, seed: int) -> DataFrame:
    """``rows`` with a ``drawn`` value of ``weights(value, weight)``, chosen by inverse distribution on a hash of the key.

    ``weights`` is a table of classes, one small row each; its running sums stay whole numbers.
    """
    order = W.orderBy("value").rowsBetween(W.unboundedPreceding, 0)
    edges = weights.withColumn("high", F.sum("weight").over(order)).withColumn("total", F.sum("weight").over(W.partitionBy()))
    table = edges.agg(F.array_sort(F.collect_list(F.struct("high", "value"))).alias("edges"), F.max("total").alias("total"))
    edges_, total = table.first() or ([], 0)
    at = F.shiftright(hash_uniform(seed, F.col(key)) * F.lit(int(total or 0)).cast("long"), 32)
    drawn = F.lit(None).cast(dict(weights.dtypes)["value"])
    for high, value in reversed(edges_ or []):
        drawn = F.when(at < high, F.lit(value)).otherwise(drawn)
    return rows.withColumn("drawn", drawn)


def even_sample(rows: DataFrame, group: str, order: str, k: int) -> DataFrame:
    """``k`` evenly spaced rows of each group (all of a smaller one), by place: floor(i (n - 1) / (k - 1)) for i from 0."""
    w = W.partitionBy(group)
    out = rows.withColumn("_n", F.count("*").over(w)).withColumn("_i", F.row_number().over(w.orderBy(order)) - 1)
    picks = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.floor(i * (F.col("_n") - 1) / F.lit(max(k - 1, 1))))
    return out.where((F.col("_n") <= k) | F.array_contains(picks, F.col("_i").cast("long"))).drop("_n", "_i")


def first_accepted(candidates: DataFrame, key: str, attempt: str, accepted: Column) -> DataFrame:
    """Of each key the earliest accepted attempt, with the number of rejected ones before it; keys without one are absent."""
    return candidates.where(accepted).groupBy(key).agg(F.min(attempt).alias("attempt")).withColumn("rejected", F.col("attempt") - 1)
