"""Detection metrics: greedy matching, event taxonomy, average precision, ranking, changes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidewright.functions import scalars as S
from tidewright.functions.scalars import area, iou, size_bucket
from tidewright.sources.shared import checkpoint

BOX = "x1 double, y1 double, x2 double, y2 double"


def _let(value: Column, f) -> Column:
    """``f`` of a value that is computed once, however often ``f`` uses it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _ordered(predictions: Column) -> Column:
    """By falling score, then class, then id."""
    compare = lambda a, b: F.when(a["score"] > b["score"], -1).when(a["score"] < b["score"], 1).when(a["class"] < b["class"], -1).when(a["class"] > b["class"], 1).when(a["id"] < b["id"], -1).when(a["id"] > b["id"], 1).otherwise(0)
    return F.array_sort(predictions, compare)


def greedy_events(images: DataFrame, key: str, match: float = 0.5, near: float = 0.1) -> DataFrame:
    """One row per prediction and per missed truth of ``images(key, truths, predictions)``.

    ``truths`` is an array of struct(id, class, box), in order; ``predictions`` of struct(id, class, score, box). By
    falling score, then class, then id, each prediction takes the unmatched truth of its class that overlaps it most (the first on a tie)
    if they overlap by ``match``: true_positive. Else it is a class_confusion if the truth that overlaps it most is of another class and
    overlaps by ``match``; else a localization_error if an unmatched truth of its class overlaps by ``near``; else a
    false_positive. Truths left are false_negative, with the prediction of their class that overlaps them most (the first in the
    order on a tie), if any. Rows also have the classes of both, the prediction's score, and the size of the truth for
    true_positive and false_negative, else of the prediction.

    The overlaps of an image are computed once; its predictions are then folded in order by ``aggregate``: no Python, and
    state is one image's.
    """
    one = "struct<prediction:bigint,truth:bigint,kind:string,iou:double,prediction_class:int,truth_class:int,score:double,size:string>"
    state = f"struct<used:array<int>,out:array<{one}>>"
    scored = lambda p: F.transform("truths", lambda t, i: F.struct(iou(p["box"], t["box"]).alias("iou"), (-i).alias("back"), t["class"].alias("class"), t["id"].alias("id"), size_bucket(area(t["box"])).alias("size")))
    ready = F.transform(_ordered(F.col("predictions")), lambda p: F.struct(p.alias("p"), scored(p).alias("all")))
    ready = F.transform(ready, lambda r: F.struct(r["p"], r["all"], F.array_max(r["all"]).alias("top")))

    def step(acc: Column, r: Column) -> Column:
        p, any_ = r["p"], r["top"]

        def judged(best: Column) -> Column:
            hit = F.coalesce(best["iou"] >= match, F.lit(False))
            confused = F.coalesce((any_["iou"] >= match) & (any_["class"] != p["class"]), F.lit(False))
            loose = F.coalesce(best["iou"] >= near, F.lit(False))
            kind = F.when(hit, "true_positive").when(confused, "class_confusion").when(loose, "localization_error").otherwise("false_positive")
            target = F.when(hit, best).when(confused, any_).when(loose, best).otherwise(any_)
            return F.struct(kind.alias("kind"), target.alias("target"), hit.alias("hit"))

        def added(j: Column) -> Column:
            target = j["target"]
            event = F.struct(
                p["id"].alias("prediction"), target["id"].alias("truth"), j["kind"].alias("kind"), F.coalesce(target["iou"], F.lit(0.0)).alias("iou"),
                p["class"].alias("prediction_class"), target["class"].alias("truth_class"), p["score"].alias("score"), F.when(j["hit"], target["size"]).otherwise(size_bucket(area(p["box"]))).alias("size"),
            ).cast(one)
            used = F.when(j["hit"], F.concat(acc["used"], F.array(-target["back"]))).otherwise(acc["used"])
            return F.struct(used.alias("used"), F.concat(acc["out"], F.array(event)).alias("out")).cast(state)

        free = F.array_max(F.filter(r["all"], lambda s: (s["class"] == p["class"]) & ~F.array_contains(acc["used"], -s["back"])))
        return _let(_let(free, judged), added)

    start = F.struct(F.array().cast("array<int>").alias("used"), F.array().alias("out")).cast(state)
    folded = images.withColumn("_ready", ready).withColumn("_f", F.aggregate("_ready", start, step))
    missed = F.filter(F.transform("truths", lambda t, i: F.struct(i.alias("i"), t.alias("t"))), lambda s: ~F.array_contains(F.col("_f.used"), s["i"]))

    def lost(s: Column) -> Column:
        own = F.transform("_ready", lambda r, n: F.struct(F.get(r["all"], s["i"])["iou"].alias("iou"), (-n).alias("back"), r["p"].alias("p")))
        own = F.filter(own, lambda r: r["p"]["class"] == s["t"]["class"])
        # The place decides before the prediction is compared.
        nearest = F.array_max(F.transform(own, lambda r: F.struct(r["iou"], r["back"])))
        found = F.get(F.filter(own, lambda r: r["back"] == nearest["back"]), F.lit(0))["p"]
        return F.struct(
            found["id"].alias("prediction"), s["t"]["id"].alias("truth"), F.lit("false_negative").alias("kind"), F.coalesce(nearest["iou"], F.lit(0.0)).alias("iou"),
            found["class"].alias("prediction_class"), s["t"]["class"].alias("truth_class"), found["score"].alias("score"), size_bucket(area(s["t"]["box"])).alias("size"),
        ).cast(one)

    return folded.select(key, F.explode(F.concat("_f.out", F.transform(missed, lost))).alias("e")).select(key, "e.*")


def average_precision(scored: DataFrame, group: list[str], positives: DataFrame, order: list[Column]) -> DataFrame:
    """(group, ap) from ``scored(group, hit)`` in ``order`` and ``positives(group, total)``.

    Precision and recall run along the order; the precision envelope, with sentinels (0, 1) and (1, 0), is read at 101 recalls by
    linear interpolation and integrated by trapezoids. A group with positives but no prediction scores 0.
    """
    w = W.partitionBy(*group).orderBy(*order)
    run = scored.join(positives, group).withColumns({"_no": F.row_number().over(w), "_tp": F.sum(F.col("hit").cast("long")).over(w.rowsBetween(W.unboundedPreceding, 0))})
    points = run.select(*group, F.col("_no").cast("long").alias("no"), (F.col("_tp") / F.col("total")).alias("r"), (F.col("_tp") / F.col("_no")).alias("p"))
    keys = points.select(*group).distinct()
    last = F.lit((1 << 62)).cast("long")
    ends = keys.select(*group, F.explode(F.array(F.struct(F.lit(0).cast("long").alias("no"), F.lit(0.0).alias("r"), F.lit(1.0).alias("p")), F.struct(last.alias("no"), F.lit(1.0).alias("r"), F.lit(0.0).alias("p")))).alias("e")).select(*group, "e.*")
    all_ = points.unionByName(ends)
    by = W.partitionBy(*group).orderBy("no")
    # Run backwards: a frame that ends with the partition would be summed up anew for every row.
    back = W.partitionBy(*group).orderBy(F.desc("no")).rowsBetween(W.unboundedPreceding, 0)
    env = all_.withColumn("p", F.max("p").over(back))
    # Of points at one recall the last counts from the right, the first from the left.
    env = env.withColumns({"r2": F.lead("r").over(by), "p2": F.lead("p").over(by)})
    # Only the grid's points near a segment can lie on it: about one row per point and 101 per group.
    near = lambda x, by: F.greatest(F.lit(0), F.least(F.lit(100), F.floor(x * 100).cast("int") + by))
    grid = F.explode(F.transform(F.sequence(near(F.col("r"), -1), F.greatest(near(F.col("r"), -1), near(F.coalesce("r2", F.lit(1.0)), 1))), lambda i: i * F.lit(0.01)))
    inside = F.when(F.col("r2").isNull(), F.col("x") >= F.col("r")).otherwise((F.col("r") <= F.col("x")) & (F.col("x") < F.col("r2")))
    at = env.withColumn("x", grid).where(inside)
    y = F.when(F.col("r2").isNull(), F.col("p")).otherwise(F.col("p") + (F.col("p2") - F.col("p")) * (F.col("x") - F.col("r")) / (F.col("r2") - F.col("r")))
    ends_weight = F.when((F.col("x") == 0) | (F.col("x") == 1), 0.5).otherwise(1.0)
    found = at.groupBy(*group).agg(F.sum(y * ends_weight * 0.01).alias("ap"))
    return positives.join(found, group, "left").select(*group, F.coalesce("ap", F.lit(0.0)).alias("ap"))


def _flat(of: pa.ListArray, *fields: str) -> list[np.ndarray]:
    """For the elements of a column of arrays of structs: the row of each, and its ``fields``; null numbers are NaN."""
    flat = of.flatten()
    own = dict(zip([f.name for f in flat.type], flat.flatten(), strict=True))
    return [pc.list_parent_indices(of).to_numpy(zero_copy_only=False), *[own[f] for f in fields]]


def _corners(box: pa.StructArray) -> np.ndarray:
    own = dict(zip([f.name for f in box.type], box.flatten(), strict=True))
    return np.stack([own[c].to_numpy(zero_copy_only=False).astype(float) for c in ("x1", "y1", "x2", "y2")])


def _areas(box: np.ndarray) -> np.ndarray:
    return (box[2] - box[0]) * (box[3] - box[1])


SIZES = ("small", "medium", "large")
#: Pairs of boxes compared at once.
PAIRS = 1 << 20


def _hits(of: np.ndarray, guesses: np.ndarray, own: np.ndarray, truths: np.ndarray, least: np.ndarray) -> np.ndarray:
    """For each guess and each of the ``least`` overlaps whether it takes a truth.

    ``of`` and ``own`` are the groups of the guesses, which are in order within each, and of the truths. A guess takes the truth of its group that overlaps it most and
    that no guess before it took (the first on a tie) if they overlap by so much. All groups take their first guess at once, then their second.
    """
    order = np.argsort(own, kind="stable")
    start, end = np.searchsorted(own[order], of), np.searchsorted(own[order], of, "right")
    area_g, area_t = _areas(guesses), _areas(truths)
    ends, found = np.cumsum(end - start), []
    at = 0
    while at < len(of):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, "right")))
        n = (end - start)[at:to]
        g = np.repeat(np.arange(at, to), n)
        t = order[np.repeat(start[at:to] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        wide, high = (np.maximum(np.minimum(guesses[k + 2, g], truths[k + 2, t]) - np.maximum(guesses[k, g], truths[k, t]), 0.0) for k in (0, 1))
        shared = wide * high
        union = area_g[g] + area_t[t] - shared
        overlap = np.divide(shared, union, out=np.zeros(len(g)), where=union > 0)
        near = overlap >= least[0]
        found.append((g[near], t[near], overlap[near]))
        at = to
    hits, used = np.zeros((len(of), len(least)), bool), np.zeros((len(own), len(least)), bool)
    if not found:
        return hits
    g, t, overlap = (np.concatenate(x) for x in zip(*found, strict=True))
    asked = np.unique(g)
    by = np.argsort(of[asked], kind="stable")
    first = np.r_[True, of[asked][by][1:] != of[asked][by][:-1]][: len(by)]
    turn = np.empty(len(asked), np.int64)
    turn[by] = np.arange(len(by)) - np.maximum.accumulate(np.where(first, np.arange(len(by)), 0))
    turns = turn[np.searchsorted(asked, g)]
    by = np.lexsort((t, -overlap, g, turns))
    g, t, overlap, turns = g[by], t[by], overlap[by], turns[by]
    cuts = np.r_[np.flatnonzero(np.r_[True, turns[1:] != turns[:-1]][: len(turns)]), len(turns)]
    for s, e in zip(cuts[:-1], cuts[1:], strict=True):
        free = ~used[t[s:e]] & (overlap[s:e, None] >= least)
        begin = np.flatnonzero(np.r_[True, g[s + 1 : e] != g[s : e - 1]])
        sums = np.cumsum(free, axis=0)
        before = np.repeat((sums - free)[begin], np.diff(np.r_[begin, e - s]), axis=0)
        taken = free & (sums - before == 1)
        used[t[s:e]] |= taken
        hits[g[s:e][begin]] = np.logical_or.reduceat(taken, begin, axis=0)
    return hits


def _matched(least: np.ndarray):
    """Batches of (k, truths, guesses) to a row per guess, and to the numbers of truths by class and size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            at_t, class_t, box_t = _flat(x.column("truths"), "class", "box")
            at_g, class_g, box_g, score = _flat(x.column("guesses"), "class", "box", "s")
            box_t, box_g = _corners(box_t), _corners(box_g)
            size_t, size_g = (np.where(a < S.SMALL, 0, np.where(a < S.MEDIUM, 1, 2)) for a in (_areas(box_t), _areas(box_g)))
            known = pc.unique(pa.chunked_array([class_t, class_g])).drop_null()
            code_t, code_g = (pc.fill_null(pc.index_in(c, known), -1).to_numpy(zero_copy_only=False).astype(np.int64) for c in (class_t, class_g))
            group = lambda at, code, size: (at.astype(np.int64) * (len(known) + 1) + code) * 3 + size
            # A null class is the class of no other.
            t, g = np.flatnonzero(code_t >= 0), np.flatnonzero(code_g >= 0)
            hits = _hits(group(at_g, code_g, size_g)[g], box_g[:, g], group(at_t, code_t, size_t)[t], box_t[:, t], least)
            kinds, n = np.unique(code_t * 3 + size_t, return_counts=True)
            none = len(kinds)
            place = np.arange(len(at_g)) - np.searchsorted(at_g, at_g)
            taken = lambda of, i: pa.array(of).take(pa.array(i)) if isinstance(of, np.ndarray) else of.take(pa.array(i))
            both = lambda of, i, type_: pa.concat_arrays([pa.nulls(none, type_), taken(of, i).cast(type_)])
            of_kind = np.floor_divide(kinds, 3)
            yield pa.RecordBatch.from_arrays([
                both(x.column("k"), at_g[g], x.column("k").type), both(place, g, pa.int32()), pa.concat_arrays([known.take(pa.array(of_kind, mask=of_kind < 0)), class_g.take(pa.array(g))]), pa.array(np.r_[kinds % 3, size_g[g]].astype(np.int32)),
                both(score, g, pa.float64()), pa.array(np.r_[np.zeros(none, np.int64), hits @ (1 << np.arange(len(least)))]), pa.array(np.r_[n, np.zeros(len(g), np.int64)]),
            ], ["k", "place", "class", "size", "s", "hits", "truths"])

    return run


def _bounds(total: int) -> np.ndarray:
    """For each of the 101 recalls the least number of hits that is beyond it."""
    x = np.arange(101) * 0.01
    m = np.maximum(np.floor(x * total) - 1, 0)
    for _ in range(4):
        m += m / total <= x
    return m.astype(np.int64)


def _precisions(before: dict, totals: dict, steps: int):
    """Ordered (part, class, size, hits) to (class, size, step, bound, no, best): of the hits from one of the ``_bounds`` up to the next one the place, if the
    bound's own, and the best precision. ``before``: guesses, and hits of every step, in the parts before, by part, class and size."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        done: dict = {}
        bounds = {k: np.unique(_bounds(n)) for k, n in totals.items()}
        for x in batches:
            part, kind, size, hits = (x[c].to_numpy() for c in ("part", "class", "size", "hits"))
            cuts, out = np.r_[np.flatnonzero(np.r_[True, (kind[1:] != kind[:-1]) | (size[1:] != size[:-1])][: len(x)]), len(x)], []
            for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                k = (kind[s].item(), size[s].item())
                if k not in totals:
                    continue
                so_far = done.setdefault(k, np.array(before[part[s].item(), *k], np.int64))
                bit = hits[s:e]
                for step in range(steps):
                    at = np.flatnonzero(bit >> step & 1)
                    if not len(at):
                        continue
                    no, m = so_far[0] + at + 1, so_far[step + 1] + np.arange(1, len(at) + 1)
                    own = np.searchsorted(bounds[k], m, "right") - 1
                    begin = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
                    bound = bounds[k][own[begin]]
                    same = [np.full(len(begin), v) for v in (*k, step)]
                    out.append((*same, bound, np.where(m[begin] == bound, no[begin], 0), np.maximum.reduceat(m / no, begin)))
                    so_far[step + 1] += len(at)
                so_far[0] += e - s
            if out:
                yield pd.DataFrame(dict(zip(("class", "size", "step", "bound", "no", "best"), map(np.concatenate, zip(*out, strict=True)), strict=True)))

    return run


def _ap(total: int, guesses: int, hits: int, found: dict[int, tuple[int, float]]) -> float:
    """Average precision at 101 recalls as ``average_precision`` has it, from (place, best precision up to the next bound) by bound."""
    if not guesses:
        return 0.0
    best, envelope = 0.0, {}
    for m in sorted(found, reverse=True):
        best = max(best, found[m][1])
        envelope[m] = best
    ap = 0.0
    for i, m in enumerate(_bounds(total)[:100].tolist()):
        # The last point at the recall before, and the next hit or the end.
        left, no = min(m - 1, hits), (found[m][0] if m <= hits else guesses + 1) - 1
        r2, p2 = (m / total, envelope[m]) if m <= hits else (1.0, 0.0)
        r, p = left / total, max(left / no if no else 1.0, p2)
        ap += (p + (p2 - p) * (i * 0.01 - r) / (r2 - r)) * 0.01 * (0.5 if i == 0 else 1.0)
    return ap


def size_ap(images: DataFrame, key: str, thresholds: int = 10) -> DataFrame:
    """(size, truths, classes, map50, map50_95) of all three sizes: average precision in strata of truths and predictions of one size.

    A size without a truth has null precisions. Classes without a truth of the size are left out, a class without a prediction of it scores 0. The overlap thresholds
    are 0.5 + i * 0.05 for i under ``thresholds``. Boxes with a null corner overlap none.

    Each image is matched at all thresholds at once, then the predictions are sorted once by class, size and score. Their places and the
    hits before them follow from the counts of each part of that order, and only 101 recalls a class, size and threshold leave it.
    """
    spark, least = images.sparkSession, 0.5 + np.arange(thresholds) * (0.55 - 0.5)
    guesses = F.array_sort(F.transform("predictions", lambda p: F.struct((-p["score"]).cast("double").alias("s"), p["box"].alias("box"), p["id"].alias("id"), p["class"].alias("class"))))
    rows = images.select(F.col(key).alias("k"), "truths", guesses.alias("guesses"))
    kind = images.schema["truths"].dataType.elementType["class"].dataType.simpleString()
    rows = rows.mapInArrow(_matched(least), f"k {rows.schema['k'].dataType.simpleString()}, place int, class {kind}, size int, s double, hits long, truths long")
    order = checkpoint(rows.orderBy("class", "size", "s", "k", "place").select(F.spark_partition_id().alias("part"), "class", "size", "hits", "truths"))
    sums = [F.sum(F.shiftright("hits", i).bitwiseAND(F.lit(1))) for i in range(thresholds)]
    # A row per part, and per class and size of its own.
    parts = [tuple(r) for r in order.groupBy("part", "class", "size").agg(F.sum("truths"), F.count_if(F.col("truths") == 0), *sums).orderBy("part").collect()]
    before, totals, sofar = {}, {}, {}
    for part, c, size, truths, *counts in parts:
        now = sofar.setdefault((c, size), np.zeros(thresholds + 1, np.int64))
        before[part, c, size] = now.tolist()
        sofar[c, size] = now + counts
        totals[c, size] = totals.get((c, size), 0) + truths
    totals = {k: n for k, n in totals.items() if n}
    asked = order.where("truths = 0 AND class IS NOT NULL").select("part", "class", "size", "hits")
    points = asked.mapInPandas(_precisions(before, totals, thresholds), f"class {kind}, size int, step int, bound long, no long, best double")
    found: dict = {}
    for r in points.groupBy("class", "size", "step", "bound").agg(F.max("no"), F.max("best")).collect():
        found.setdefault(tuple(r[:3]), {})[r[3]] = tuple(r[4:])
    out = []
    for n, size in enumerate(SIZES):
        own = [k for k in totals if k[1] == n]
        aps = [[_ap(totals[k], int(sofar[k][0]), int(sofar[k][i + 1]), found.get((*k, i), {})) for i in range(thresholds)] for k in own]
        mean = lambda x: float(np.mean(x)) if x else None
        out.append((size, sum(totals[k] for k in own), len(own), mean([a[0] for a in aps]), mean([np.mean(a) for a in aps])))
    return spark.createDataFrame(out, "size string, truths long, classes long, map50 double, map50_95 double")


def ranked(models: DataFrame, keys: list[tuple[str, bool]], ordinal: str) -> DataFrame:
    """``models`` with ``rank`` by ``keys`` (column, descending), ties by ``ordinal``; rank 1 is recommended."""
    order = [F.desc(c) if down else F.asc(c) for c, down in keys] + [F.asc(ordinal)]
    out = models.withColumn("rank", F.row_number().over(W.orderBy(*order)).cast("long"))
    return out.withColumn("recommended", F.col("rank") == 1)


def changes(rows: DataFrame, order: str, value: str) -> DataFrame:
    """Changes from the previous and from the first row, and the latter's share, null where the first is 0."""
    w = W.orderBy(order)
    first = F.first(value).over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return rows.withColumns({"from_previous": F.col(value) - F.lag(value).over(w), "from_first": F.col(value) - first, "relative": (F.col(value) - first) / F.nullif(first, F.lit(0.0))})


def grid(rows: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b, n) for every pair of a value of each column, 0 for pairs without a row. The two columns have few values."""
    pairs = rows.select(a).distinct().join(rows.select(b).distinct(), F.lit(True))
    return pairs.join(rows.groupBy(a, b).agg(F.count("*").alias("n")), [a, b], "left").na.fill(0, ["n"])


def class_report(classes: DataFrame, measured: DataFrame, columns: list[str]) -> DataFrame:
    """A row of ``columns`` for every class of ``classes(class)``, null where nothing is measured, and the means over the others as class ``all``."""
    each = classes.join(measured.select("class", *columns), "class", "left")
    means = each.agg(*[F.avg(c).alias(c) for c in columns]).select(F.lit("all").alias("class"), *columns)
    return each.select(F.col("class").cast("string").alias("class"), *columns).unionByName(means)


def latency(rows: DataFrame, stages: list[str], without: str = "loss") -> DataFrame:
    """``rows`` with ``total``, the sum of the stages' milliseconds but for ``without``, and images a second, null for no time."""
    parts = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in stages if c != without]
    total = sum(parts[1:], parts[0])
    return rows.withColumns({"total": total, "throughput": F.when(total > 0, 1000 / total)})


def change_counts(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """One row: how many keys are changed, unchanged, added and removed; every other column counts, null equals null."""
    others = [c for c in before.columns if c != key]
    one = lambda df, name: df.select(F.col(key).alias("k"), F.struct(*others).alias(name))
    both = one(before, "x").join(one(after, "y"), "k", "full")
    same = F.col("x").eqNullSafe(F.col("y"))
    held = F.col("x").isNotNull() & F.col("y").isNotNull()
    count = lambda c, name: F.count_if(c).alias(name)
    return both.agg(count(held & ~same, "changed"), count(held & same, "unchanged"), count(F.col("x").isNull(), "added"), count(F.col("y").isNull(), "removed"))
