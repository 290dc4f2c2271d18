"""Variable-capacity best-fit packing of documents into training sequences.

Several sequence lengths are permitted, each at a cost. Of a document longer than the largest, every full stretch of that
length is a sequence by itself; the rest of it, or a shorter document whole, is a piece to pack. Nothing is dropped.
Pieces go longest first:

* into the open bin with the least room that still holds the piece, whatever the bin's capacity;
* else into a new bin of the capacity that is cheapest for each token it is going to hold, which counts the pieces still
  to come: as long as enough remain to fill it, that is the capacity of the best rate; towards the end, smaller ones;
* finally every bin shrinks to the smallest permitted length that holds its contents.

There is at most one such piece per row, and they are packed in shards of about ``SHARD`` rows, dealt by a hash, so a task holds a
bounded number of two-number rows and the number of tasks grows with the input. Texts do not move: only ids and lengths
are shuffled.

The query and the pipeline stage count a text's length in words (runs without ASCII white space), not in tokens of a tokenizer: a
sequence may exceed its capacity once tokenized, and a text without spaces is one word. ``length`` takes any other count.

Cases: a null or blank text has no words and one empty piece, which joins a bin as any other; a null id is packed and stays
null; repeated rows are packed as often as they occur; ties go by the id's text and the piece; an empty table gives no bins; other columns play no
part, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, table

#: Permitted lengths in words (or the unit of ``length``), and what a sequence costs besides them.
CAPACITIES, OVERHEAD, SHARD = (512, 1024, 2048, 4096), 32, 8192

SCHEMA = "shard long, bin long, capacity long, used long, id string, piece int, offset long, length long"


def words(text: Column) -> Column:
    """The number of words of ``text``; none for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def pack(lengths: list[int], capacities: tuple[int, ...] = CAPACITIES, overhead: int = OVERHEAD) -> tuple[list[int], list[int]]:
    """(bin of each length, final capacity of each bin). ``lengths`` fall and none is over the largest capacity.

    Open bins are stacked by their room; the bits of ``open_`` say which rooms have one, so the best fit is the lowest
    set bit at or above the length. Of bins of one room the latest is taken.
    """
    capacities = tuple(sorted(capacities))
    stacks: list[list[int]] = [[] for _ in range(capacities[-1] + 1)]
    open_, left = 0, sum(lengths)
    where, used = [], []
    for n in lengths:
        fits = open_ >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            own = stacks[room].pop()
            if not stacks[room]:
                open_ ^= 1 << room
        else:
            room = min((c for c in capacities if c >= n), key=lambda c: ((c + overhead) / min(c, max(left, 1)), c))
            own = len(used)
            used.append(0)
        where.append(own)
        used[own] += n
        left -= n
        stacks[room - n].append(own)
        open_ |= 1 << (room - n)
    return where, [next(c for c in capacities if c >= u) for u in used]


def _packed(capacities: tuple[int, ...], overhead: int):
    most = max(capacities)

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        """The sequences of one shard's (shard, id, n): first the packed bins, then a bin for each full stretch."""
        rows = rows.sort_values(["n", "id"], ascending=[False, True], kind="stable", ignore_index=True)
        full = rows["n"] // most
        pieces = pd.DataFrame({"id": rows["id"], "piece": full, "offset": full * most, "length": rows["n"] % most})
        pieces = pieces[(rows["n"] == 0) | (pieces["length"] > 0)]
        pieces = pieces.sort_values(["length", "id", "piece"], ascending=[False, True, True], kind="stable", ignore_index=True)
        where, sizes = pack(pieces["length"].tolist(), capacities, overhead)
        pieces["bin"] = where
        pieces["capacity"] = [sizes[b] for b in where]
        pieces["used"] = pieces.groupby("bin")["length"].transform("sum")
        at = np.repeat(np.arange(len(rows)), full)
        stretch = np.arange(len(at)) - np.repeat(np.cumsum(full) - full, full)
        whole = pd.DataFrame({"id": rows["id"].to_numpy()[at], "piece": stretch.to_numpy(), "offset": stretch.to_numpy() * most, "bin": len(sizes) + np.arange(len(at))})
        out = pd.concat([pieces, whole.assign(length=most, capacity=most, used=most)] if len(at) else [pieces]).assign(shard=key[0])
        return out[["shard", "bin", "capacity", "used", "id", "piece", "offset", "length"]]

    return run


def best_fit(docs: DataFrame, id_col: str = "doc_id", length: Column | None = None, capacities: tuple[int, ...] = CAPACITIES, overhead: int = OVERHEAD, shard_rows: int = SHARD) -> DataFrame:
    """One row per piece: shard, bin (within the shard), capacity, used, id_col, piece, offset, length (in words, or the unit of ``length``).

    Lengths are counted once. Rows of one id and length are alike, so they are counted and numbered, and the shard follows from
    id, length and number: the same rows pack alike in any files and any order, and copies of one row spread over the shards.
    """
    sized = docs.select(F.col(f"`{id_col}`").alias("id"), (words(F.col("text")) if length is None else length).cast("long").alias("n"))
    alike = checkpoint(sized.groupBy("id", "n").agg(F.count("*").alias("times")))
    shards = max(1, -(-(alike.agg(F.sum("times")).first()[0] or 0) // shard_rows))
    each = alike.select("id", "n", F.explode(F.sequence(F.lit(1).cast("long"), "times")).alias("copy"))
    # As text: pandas would make floats of ids among which one is null.
    dealt = each.select(F.pmod(F.xxhash64("id", "n", "copy"), F.lit(shards)).cast("long").alias("shard"), F.col("id").cast("string").alias("id"), "n")
    packed = dealt.groupBy("shard").applyInPandas(_packed(capacities, overhead), SCHEMA)
    return packed.withColumn("id", F.col("id").cast(alike.schema["id"].dataType)).withColumnRenamed("id", id_col)


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit(table(spark, sf_dir, "documents"))
