"""Order MinHash fingerprints: signatures that are sensitive to edit distance.

A text is the set of its byte k-mers, each numbered by its occurrence. For each of SIZE hash functions the PICK k-mers
with the smallest hashes are taken, put back into the order of the text, and hashed as a tuple; the fraction of equal
entries of two signatures estimates how likely a random choice of PICK k-mers, order included, is shared.

The SIZE hash functions are one 64-bit hash y with SIZE different origins, y - c (mod 2^64): each orders the k-mers at
random, and its PICK smallest are the cyclic successors of c in one sorted array. So a text is hashed and sorted once
for numbering the occurrences and once for all functions, in numpy, whatever SIZE is; SIZE hashes of every k-mer would take
five times this operator's whole time. Hashes have one width at every length of text.

``fingerprints`` compares each text with an edited copy and with the next document by id. Only the texts themselves
move, once: rows go to buckets that are ranges of ids, and the first row of each bucket goes to the bucket before it
as well. The ranges come from an aggregate over the ids alone.

Cases: null text counts as empty; a text shorter than K bytes is padded to one k-mer; next is by descending id, null ids
last, and among equal ids by text; the last document's next is the first, and a sole document's is itself; an empty table
gives no rows; other columns play no part, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table

K, PICK, SIZE = 6, 2, 64
_A, _B, _STEP = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(0x9E3779B97F4A7C15)
_SHIFT = np.uint64(32)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> _SHIFT)) * _A
    x ^= x >> _SHIFT
    x *= _B
    x ^= x >> _SHIFT
    return x


#: A hash is cut to its upper 64 - PLACE bits, whatever the text's length; up to 2^PLACE windows their places fill the rest.
PLACE = 24
_CUT, _LOW = np.uint64(PLACE), np.uint64((1 << PLACE) - 1)
ORIGINS = _mix(np.arange(1, SIZE + 1, dtype=np.uint64) * _STEP) >> _CUT


def _sorted(hashes: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cut hashes, places) by hash, then by place. ``place`` are distinct numbers under len(hashes)."""
    if len(hashes) <= int(_LOW) + 1:
        packed = np.sort((hashes & ~_LOW) | place)
        return packed >> _CUT, packed & _LOW
    by_place = np.empty_like(hashes)
    by_place[place] = hashes >> _CUT
    order = np.argsort(by_place, kind="stable")
    return by_place[order], order.astype(np.uint64)


def signature(text: str | None) -> np.ndarray:
    """SIZE unsigned 32-bit integers."""
    raw = (text or "").encode()
    raw += bytes(max(0, K - len(raw)))
    n = len(raw) - K + 1
    windows = np.ndarray((n,), "<u8", raw + bytes(8), strides=(1,))
    x = windows if K == 8 else windows & np.uint64((1 << 8 * K) - 1)
    kmer, at = _sorted(_mix(x), np.arange(n, dtype=np.uint64))
    new = np.r_[True, kmer[1:] != kmer[:-1]]
    rank = np.arange(n, dtype=np.uint64)
    occurrence = rank - np.maximum.accumulate(np.where(new, rank, np.uint64(0)))
    second, at = _sorted(_mix(kmer + occurrence * _STEP), at)
    picks = (np.searchsorted(second, ORIGINS)[:, None] + np.arange(PICK)) % n
    ordered = np.take_along_axis(second[picks], np.argsort(at[picks], axis=1, kind="stable"), 1)
    out = ordered[:, 0].copy()
    for i in range(1, PICK):
        out = _mix(out * _STEP + ordered[:, i])
    return (out >> _SHIFT).astype(np.uint32) if PICK > 1 else (_mix(out) >> _SHIFT).astype(np.uint32)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def edited(text: str, after: str) -> str:
    """``text`` with its last third replaced by the first as many code points of ``after``, or all of it."""
    third = len(text) // 3
    return text[: len(text) - third] + after[:third]


def _text(signature_: np.ndarray) -> str:
    return signature_.astype(">u4").tobytes().hex()


COLUMNS = "id string, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (bucket, guard, id, text), each bucket in order with its guards at the end."""
    last = None  # the row that waits for its next: bucket, id, text, signature
    for x in batches:
        rows = []
        for bucket, guard, key, text in zip(x["bucket"], x["guard"], x["id"], x["text"], strict=True):
            if guard and (last is None or last[0] != bucket):
                continue  # the bucket's last row has met its first guard
            own = signature(text)
            if last is not None:
                if last[0] != bucket:
                    raise ValueError("a bucket without its guard")
                _, of, before, print_ = last
                changed = edited(before, text)
                edit = signature(changed)
                rows.append((of, len(before), hashlib.sha256(changed.encode()).hexdigest(), _text(print_), _text(edit), likeness(print_, edit), likeness(print_, own)))
            last = None if guard else (bucket, key, text, own)
        out = pd.DataFrame(rows, columns=[c.split()[0] for c in COLUMNS.split(", ")])
        yield out.astype({"id": object, "n_chars": "int64", "near_edited": float, "near_next": float})


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None) -> DataFrame:
    """One row per row of ``docs``: id_col and COLUMNS after it. See the module's text."""
    spark = docs.sparkSession
    small_batches(spark)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ranges = 4 * n
    cuts = rows.agg(F.percentile_approx("id", [i / ranges for i in range(1, ranges)], 20 * ranges)).first()[0] if ranges > 1 else None
    splits = [-float("inf"), *sorted({float(x) for x in cuts or [0]}), float("inf")]
    bucketizer = Bucketizer(splits=splits, inputCol="_at", outputCol="_range", handleInvalid="keep")

    def placed(df: DataFrame) -> DataFrame:
        found = bucketizer.transform(df.withColumn("_at", F.coalesce(F.col("id").cast("double"), F.lit(float("nan")))))
        back = F.when(F.col("id").isNull(), F.lit(len(splits))).otherwise(F.lit(len(splits)) - 2 - F.col("_range"))
        return found.withColumn("bucket", back.cast("int")).drop("_at", "_range")

    # One row per bucket that is not empty, so at most 4 * n + 1 small rows.
    heads = [(r[0], r[1]) for r in placed(rows.select("id")).groupBy("bucket").agg(F.max("id")).orderBy("bucket").collect()]
    before = [(b, head, heads[i - 1][0]) for i, (b, head) in enumerate(heads)]
    lookup = spark.createDataFrame(before, "bucket int, head long, earlier int")
    found = placed(rows).join(F.broadcast(lookup), "bucket")
    own = F.struct(F.col("bucket"), F.lit(False).alias("guard"))
    guard = F.struct(F.col("earlier").alias("bucket"), F.lit(True).alias("guard"))
    to = F.when(F.col("id").eqNullSafe(F.col("head")), F.array(own, guard)).otherwise(F.array(own))
    dealt = found.select("id", "text", F.explode(to).alias("to")).select("to.bucket", "to.guard", "id", "text")
    dealt = dealt.repartition(n, "bucket").sortWithinPartitions("bucket", "guard", F.desc_nulls_last("id"), "text")
    # As text: pandas would make floats of ids among which one is null.
    made = dealt.select("bucket", "guard", F.col("id").cast("string").alias("id"), "text").mapInPandas(_walk, COLUMNS)
    return made.select(F.col("id").cast("long").alias(id_col), *made.columns[1:])


def op6_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
