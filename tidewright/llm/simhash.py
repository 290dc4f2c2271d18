"""SimHash near-duplicates with covering locality-sensitive hashing.

A fingerprint has 64 bits, each set where over half the shingles' hashes have it. Texts link where their fingerprints
differ in at most ``radius`` bits, and a component is what links join.

**Candidates.** Give each bit position i a vector f(i) of radius + 1 bits. For each of the 2^(radius+1) - 1 non-zero
vectors v, a mask holds the positions with <f(i), v> = 1 (mod 2). Any radius vectors leave some v orthogonal to all of
them, so for every pair within the radius one mask avoids all the bits in which the two differ: they collide in that
table, always. With radius 3 there are 15 tables, whose masks keep about half of the bits each. A wide radius is covered in
parts: of ``parts`` equal parts of the positions one has at most radius / parts of the differing bits, so masks that cover
each part by itself cover the whole. Radius 15 in 4 parts takes 60 tables.

**Large buckets.** A bucket of more than ``block`` distinct fingerprints is dealt into smaller ones by a further set
of masks, for which the same guarantee holds within the bucket. In one part each level halves the bits that may differ, so a
bucket of level k has at most 2^(64 / 2^k) fingerprints, roughly, and the levels end. Nothing is dropped.

**Links.** A bucket of at most ``block`` fingerprints is compared in one task, and leaves a star for each set of
fingerprints that links join within it, never all pairs. Copies share a fingerprint and are one node.

Cases: null and blank texts have fingerprint zero and link like any other; under ``words`` words the whole sequence is
the one shingle; null ids get the component of their fingerprint and never name one (a component of null ids alone has
a null name); repeated rows are kept; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import accumulate

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, large_batches, small_batches, table
from .components import components

WORDS, RADIUS, SEED, BLOCK, LEVELS = 3, 3, 42, 2048, 8


def shingle_hashes(text: str | None, words: int = WORDS, seed: int = SEED) -> np.ndarray:
    """XXH64 of every shingle, repeats included. Lower-cases A-Z alone; words end at ASCII white space."""
    parts = (text or "").encode().lower().split()  # of bytes: ASCII rules
    if not parts:
        return np.empty(0, np.uint64)
    whole, digest = b" ".join(parts), xxhash.xxh64_intdigest
    if len(parts) <= words:
        return np.array([digest(whole, seed)], np.uint64)
    starts = list(accumulate(map(len, parts), lambda at, n: at + n + 1, initial=0))
    return np.fromiter((digest(whole[i : j - 1], seed) for i, j in zip(starts, starts[words:], strict=False)), np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The 64 bits that over half of ``hashes`` have, as a signed integer; zero for none."""
    n, ones = len(hashes), np.zeros(64, np.int64)
    for at in range(0, n, 255 * 64):  # sums of 255 bits fit a byte
        bits = np.unpackbits(hashes[at : at + 255 * 64].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        for low in range(0, len(bits), 255):
            ones += np.add.reduce(bits[low : low + 255], axis=0, dtype=np.uint8)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.int64)[0])


def fingerprint(text: str | None, words: int = WORDS, seed: int = SEED) -> int:
    """The fingerprint as a signed 64-bit integer."""
    return majority(shingle_hashes(text, words, seed))


def masks(level: int, radius: int = RADIUS, parts: int = 1) -> list[int]:
    """The masks of a level as signed 64-bit integers; levels differ in how positions get their parts and vectors."""
    top = (1 << (radius // parts + 1)) - 1
    step = [1, 37, 23, 43, 29, 31, 41, 19, 47][level % 9]
    if parts == 1:
        part, f = [0] * 64, [1 + (i * step + (i * i * level) // 7) % top for i in range(64)]
    else:
        place = [i * step % 64 for i in range(64)]
        part, f = [x % parts for x in place], [1 + (x // parts + level) % top for x in place]
    out = [sum(1 << i for i in range(64) if part[i] == p and (f[i] & v).bit_count() % 2) for p in range(parts) for v in range(1, top + 1)]
    return [m - (1 << 64) if m >> 63 else m for m in out]


def _stars(fp: np.ndarray, radius: int) -> np.ndarray:
    """The least fingerprint (as stored) of each one's linked set, within one bucket."""
    label, todo = np.arange(len(fp)), len(fp)
    for i in range(len(fp)):
        near = label[i:][np.bitwise_count(fp[i] ^ fp[i:]) <= radius]
        meet = np.unique(near)
        if len(meet) > 1:
            label[np.isin(label, meet)] = meet[0]
            todo -= len(meet) - 1
            if todo == 1:
                break
    least = np.full(len(fp), np.iinfo(np.int64).max)
    np.minimum.at(least, label, fp.view(np.int64))
    return least[label]


def _links(key: np.ndarray, fp: np.ndarray, radius: int, narrow: int = 16) -> pd.DataFrame:
    """Star edges of the buckets in sorted ``key``. Small buckets are compared all at once, by distance in the order."""
    ends = np.flatnonzero(np.r_[key[1:] != key[:-1], True]) + 1
    starts = np.r_[0, ends[:-1]]
    sizes, least = ends - starts, fp.view(np.int64).copy()
    big = sizes > narrow
    for s, e in zip(starts[big], ends[big], strict=True):
        least[s:e] = _stars(fp[s:e], radius)
    small = ~np.repeat(big, sizes)
    pairs = []
    for d in range(1, int(sizes[~big].max(initial=1))):
        i = np.flatnonzero(small[:-d] & (key[:-d] == key[d:]))
        i = i[np.bitwise_count(fp[i] ^ fp[i + d]) <= radius]
        pairs.append((i, i + d))
    if pairs:
        a, b = (np.concatenate(x) for x in zip(*pairs, strict=True))
        while True:
            m = np.minimum(least[a], least[b])
            if (m == least[a]).all() and (m == least[b]).all():
                break
            np.minimum.at(least, a, m)
            np.minimum.at(least, b, m)
    moved = least != fp.view(np.int64)
    return pd.DataFrame({"a": fp.view(np.int64)[moved], "b": least[moved]})


def _compare(radius: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, fp = np.empty(0, np.int64), np.empty(0, np.uint64)
        for x in batches:  # sorted by key; a bucket may go on in the next batch
            key = np.r_[key, x["key"].to_numpy()]
            fp = np.r_[fp, x["fp"].to_numpy().view(np.uint64)]
            if len(key) and (cut := int(np.searchsorted(key, key[-1]))):
                yield _links(key[:cut], fp[:cut], radius)
                key, fp = key[cut:], fp[cut:]
        if len(key):
            yield _links(key, fp, radius)

    return run


def links(nodes: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) that join exactly the fingerprints of ``nodes(fp)``, all distinct, which chains of links join."""
    found, rows = [], nodes.select(F.lit(0).cast("long").alias("key"), "fp")
    for level in range(LEVELS):
        dealt = F.array(*[F.xxhash64("key", F.lit(level), F.lit(t), F.col("fp").bitwiseAND(F.lit(m))) for t, m in enumerate(masks(level, radius))])
        dealt = rows.select("fp", F.explode(dealt).alias("key"))
        sizes = dealt.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
        dealt = checkpoint(dealt.join(sizes, "key"))
        found.append(dealt if level == LEVELS - 1 else dealt.where(F.col("n") <= block))
        rows = dealt.where(F.col("n") > block).select("key", "fp")
        if level == LEVELS - 1 or rows.isEmpty():
            break
    here = reduce(DataFrame.unionAll, [x.select("key", "fp") for x in found])
    edges = here.repartition("key").sortWithinPartitions("key").mapInPandas(_compare(radius), "a long, b long").distinct()
    with large_batches(nodes.sparkSession):
        return checkpoint(edges)


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, words: int = WORDS, block: int = BLOCK) -> DataFrame:
    """One row per row of ``docs``: id_col, fp (signed long), component_id."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("long")
    def hashed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([fingerprint(x, words) for x in texts], dtype="int64")

    prints = checkpoint(docs.select(F.col(id_col).alias("id"), hashed(F.col(text_col)).alias("fp")))
    nodes = prints.groupBy("fp").agg(F.min("id").alias("least"))
    found = components(links(nodes.select("fp"), radius, block)).select(F.col("node").alias("fp"), "component")
    of = nodes.join(found, "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    name = of.groupBy("component").agg(F.min("least").alias("component_id"))
    named = of.join(name, "component").select("fp", "component_id")
    return prints.join(named, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
