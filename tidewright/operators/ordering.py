"""Orderings and choices within groups: first by predicate, last by key, attempts, preferred candidates, placements, chains."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidewright.functions import scalars as S


def last_by_key(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Of each key the values of its last row by ``order``, at the place of its first: column ``place``."""
    others = [c for c in rows.columns if c != key]
    found = rows.groupBy(key).agg(F.max_by(F.struct(*others), order).alias("_last"), F.min(order).alias("place"))
    return found.select(key, "_last.*", "place")


def first_by_predicate(rows: DataFrame, key: str, predicates: dict[str, Column], order: list[str]) -> DataFrame:
    """(rule, key) of the first row of each predicate by ``order`` and key; a row that an earlier predicate has is not given again.

    One aggregation gives a row for each predicate, whatever the table's size.
    """
    at = F.struct(F.struct(*order).alias("at"), F.col(key).alias("key"))
    least = rows.agg(*[F.min(F.when(p, at)).alias(f"p{i}") for i, p in enumerate(predicates.values())])
    found = least.select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(n).alias("rule"), F.col(f"p{i}")["key"].alias(key)) for i, n in enumerate(predicates)])).alias("r")).select("r.*")
    return found.where(F.col(key).isNotNull()).groupBy(key).agg(F.min_by("rule", "i").alias("rule")).select("rule", key)


def attempts(history: DataFrame, key: str, order: str) -> DataFrame:
    """``history`` with ``attempt`` from 1 within each key."""
    return history.withColumn("attempt", F.row_number().over(W.partitionBy(key).orderBy(order)).cast("long"))


def preferred(needs: DataFrame, candidates: DataFrame, seed: int | str) -> DataFrame:
    """For each of ``needs(id, class, group)`` one of ``candidates(object, class, source)``: of another group if its class has one, else of any.

    Candidates are numbered within class and source; a hash of the need's id picks a number among those that may be taken, which
    are the class's numbers without the stretch of the need's own group. So a need meets one candidate, never the whole class.
    """
    by_source = candidates.groupBy("class", "source").agg(F.count("*").alias("n"))
    w = W.partitionBy("class").orderBy("source").rowsBetween(W.unboundedPreceding, 0)
    starts = by_source.withColumn("start", F.sum("n").over(w) - F.col("n"))
    totals = by_source.groupBy("class").agg(F.sum("n").alias("total"))
    numbered = candidates.withColumn("_no", F.row_number().over(W.partitionBy("class", "source").orderBy("object")) - 1)
    numbered = numbered.join(starts.select("class", "source", "start"), ["class", "source"]).select("class", (F.col("start") + F.col("_no")).alias("no"), "object", "source")
    own = starts.select("class", F.col("source").alias("group"), F.col("start").alias("_start"), F.col("n").alias("_n"))
    asked = needs.join(totals, "class").join(own, ["class", "group"], "left").na.fill(0, ["_start", "_n"])
    free = F.when(F.col("total") > F.col("_n"), F.col("total") - F.col("_n")).otherwise(F.col("total"))
    pick = S.hash_uniform(seed, F.col("id")) % free
    skip = (F.col("total") > F.col("_n")) & (F.col("_n") > 0) & (pick >= F.col("_start"))
    asked = asked.withColumn("no", F.when(skip, pick + F.col("_n")).otherwise(pick))
    return asked.join(numbered, ["class", "no"]).select("id", "class", "group", "object", "source")


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows, repeats counted, that only one of two tables has, with ``side``; none if one is exactly the other."""
    columns = a.columns
    b = b.select(*columns)
    return a.exceptAll(b).withColumn("side", F.lit("only_first")).unionAll(b.exceptAll(a).withColumn("side", F.lit("only_second")))


def resolutions(rows: DataFrame, width: str, height: str) -> DataFrame:
    return rows.groupBy(F.concat_ws("x", width, height).alias("resolution")).agg(F.count("*").alias("n"))


def placements(images: DataFrame, key: str, most_iou: float, most_cover: float, most_attempts: int) -> DataFrame:
    """Where the objects of each image go, one after another, and which find no place.

    ``images(key, width, height, boxes: array<struct<x1,y1,x2,y2: double>>, objects: array<struct<id: string, w: double, h: double>>)``. The
    attempt n of an object has a corner that a digest of image, object and n gives; the first attempt that no box there and none
    placed before overlaps by over ``most_iou``, nor is covered by it over ``most_cover``, is taken. Rows: key, object, attempt
    (null where none is accepted), rejected, x1, y1, x2, y2. Objects larger than the image find none. One image is one row, folded in the JVM.
    """
    box = "struct<x1:double,y1:double,x2:double,y2:double>"
    one = f"struct<object:string,attempt:int,rejected:int,box:{box}>"
    state = f"struct<boxes:array<{box}>,out:array<{one}>>"

    def corner(o: Column, n: Column, axis: str, room: Column) -> Column:
        digest = S.hash_uniform("place", F.concat_ws("|", F.col(key).cast("string"), o["id"], n.cast("string"), F.lit(axis)))
        return F.floor(digest * (room + 1) / F.lit(2.0**32)).cast("double")

    def tried(o: Column, n: Column) -> Column:
        x, y = corner(o, n, "x", F.col("width") - o["w"]), corner(o, n, "y", F.col("height") - o["h"])
        return F.struct(x.alias("x1"), y.alias("y1"), (x + o["w"]).alias("x2"), (y + o["h"]).alias("y2"))

    def step(acc: Column, o: Column) -> Column:
        fits = (o["w"] <= F.col("width")) & (o["h"] <= F.col("height"))
        every = F.transform(F.sequence(F.lit(1), F.lit(most_attempts)), lambda n: F.struct(n.alias("n"), tried(o, n).alias("box")))
        clear = lambda t: F.forall(acc["boxes"], lambda b: (S.iou(t["box"], b) <= most_iou) & (S.occlusion(b, t["box"]) <= most_cover))
        good = F.filter(every, lambda t: F.lit(True) & fits & clear(t))

        def added(first: Column) -> Column:
            t = F.get(first, F.lit(0))
            made = F.struct(o["id"].alias("object"), t["n"].alias("attempt"), F.coalesce(t["n"] - 1, F.lit(most_attempts)).alias("rejected"), t["box"].alias("box")).cast(one)
            boxes = F.when(t.isNull(), acc["boxes"]).otherwise(F.concat(acc["boxes"], F.array(t["box"].cast(box))))
            return F.struct(boxes.alias("boxes"), F.concat(acc["out"], F.array(made)).alias("out")).cast(state)

        return F.element_at(F.transform(F.array(F.slice(good, 1, 1)), added), 1)

    start = F.struct(F.col("boxes").cast(f"array<{box}>").alias("boxes"), F.array().cast(f"array<{one}>").alias("out")).cast(state)
    out = images.select(key, F.explode(F.aggregate("objects", start, step)["out"]).alias("p"))
    return out.select(key, "p.object", "p.attempt", "p.rejected", "p.box.*")


def samples(placed: DataFrame, key: str, image: str, attempt: str) -> DataFrame:
    """Of every image the first attempt with a placed object, or ``attempt`` null where no attempt has one: what to keep and what to record as failed."""
    good = placed.groupBy(image, key, attempt).agg(F.count("x1").alias("n"))
    return good.groupBy(image).agg(F.min(F.when(F.col("n") > 0, F.struct(attempt, key, "n"))).alias("first"), F.count("*").alias("attempts")).select(image, f"first.{attempt}", f"first.{key}", "first.n", "attempts")


def fallback(tried: DataFrame, place: str, ok: Column) -> DataFrame:
    """The first of a few ordered candidates that is ``ok``, with the number of those rejected before it; no row if none is."""
    return tried.where(ok).orderBy(place).limit(1).withColumn("rejected", F.col(place) - 1)


def nearest_chain(rows: DataFrame, group: str, key: str, bits: str) -> DataFrame:
    """The rows of each group in a chain: from the least key on, always the nearest one left by 64 bits (ties: the least key). Column ``place`` from 1.

    A chain is sequential and quadratic in its group by definition, so groups are what one task can hold: review pages, not corpora.
    """
    def chain(x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values(key, ignore_index=True)
        h = x[bits].to_numpy(np.int64).view(np.uint64)
        left, order = np.arange(1, len(x)), [0]
        while len(left):
            at = int(np.bitwise_count(h[left] ^ h[order[-1]]).argmin())
            order.append(int(left[at]))
            left = np.delete(left, at)
        return pd.DataFrame({group: x[group].iloc[order].to_numpy(), key: x[key].iloc[order].to_numpy(), "place": np.arange(1, len(x) + 1)})

    kinds = dict(rows.dtypes)
    return rows.select(group, key, bits).groupBy(group).applyInPandas(chain, f"{group} {kinds[group]}, {key} {kinds[key]}, place long")


def category_offset(predictions: DataFrame, column: str, classes: int) -> DataFrame:
    """``predictions`` with ``class_id``: ids within 1 .. classes lose one, ids within 0 .. classes - 1 stay, anything else raises; none at all stays empty."""
    least, most = predictions.agg(F.min(column), F.max(column)).first()
    if least is None:
        offset = 0
    elif least >= 1 and most <= classes:
        offset = 1
    elif least >= 0 and most < classes:
        offset = 0
    else:
        raise ValueError(f"category ids from {least} to {most} for {classes} classes")
    return predictions.withColumn("class_id", F.col(column) - offset)


def find_column(columns: list[str], fragment: str) -> str:
    """The first column whose name, in lower case and without spaces, holds ``fragment``; raises if none does."""
    for c in columns:
        if fragment in c.lower().replace(" ", ""):
            return c
    raise ValueError(f"no column has {fragment}")


def within(rows: DataFrame, ranges: dict[str, tuple[float | None, float | None]], among: dict[str, tuple] | None = None) -> DataFrame:
    """Rows whose numbers lie in all ``ranges`` (either end may be open) and whose values are ``among`` those allowed."""
    for c, (low, high) in ranges.items():
        rows = rows.where(S.number(F.col(c).cast("string")) >= low) if low is not None else rows
        rows = rows.where(S.number(F.col(c).cast("string")) <= high) if high is not None else rows
    for c, allowed in (among or {}).items():
        rows = rows.where(F.col(c).isin(*allowed))
    return rows


def matching(rows: DataFrame, text: str, columns: list[str], order: str, descending: bool = False) -> DataFrame:
    """Rows that hold ``text`` in any of ``columns``, in any case, by ``order``."""
    found = rows.where(F.contains(F.lower(F.concat_ws(" ", *columns)), F.lit(text.strip().lower())))
    return found.orderBy(F.desc(order) if descending else F.asc(order))


def outside_prefixes(rows: DataFrame, path: str, prefixes: tuple[str, ...], parts: tuple[str, ...] = ()) -> DataFrame:
    """Rows whose path begins with none of ``prefixes`` and has none of ``parts``."""
    for x in prefixes:
        rows = rows.where(~F.startswith(path, F.lit(x)))
    return rows.where(~F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(p) for p in parts]))) if parts else rows


def below_root(path: Column, root: str, base: str) -> Column:
    """``path`` below ``root``, itself given relative to ``base``; raises where the root lies outside of it."""
    if root.startswith("/"):
        if not (root.rstrip("/") + "/").startswith(base.rstrip("/") + "/"):
            raise ValueError(f"{root} is outside {base}")
        root = root[len(base.rstrip("/")) + 1 :]
    return F.concat_ws("/", F.lit(root.strip("/")), path) if root.strip("/") else path


def mask_box(pixels: DataFrame, key: str, threshold: int = 16) -> DataFrame:
    """(key, x1, y1, x2, y2) around the pixels (key, x, y, value) over ``threshold``; keys without any are absent."""
    return pixels.where(F.col("value") > threshold).groupBy(key).agg(F.min("x").alias("x1"), F.min("y").alias("y1"), (F.max("x") + 1).alias("x2"), (F.max("y") + 1).alias("y2"))
