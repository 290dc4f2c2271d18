"""Byte-level BPE with a two-tier lookup.

A text is split by the tokenizer's pattern. Tier one: a minimal perfect hash over the vocabulary says in two hash
computations and one comparison whether a whole pre-token is a token. Tier two: any other pre-token is a linked list of
bytes whose adjacent pairs wait in a heap by (rank, place); the lowest is merged until none is in the vocabulary. Pre-tokens
repeat, so each worker keeps the ids of the last CACHE or fewer distinct ones.

The rank file is read on the driver, its path being a parameter, and reaches executors as a broadcast variable of a few
megabytes: its size is the vocabulary's, whatever the corpus.

Cases: null text counts as empty, which has no tokens; whole texts are encoded, however long; ids outside the
vocabulary cannot be decoded and raise KeyError; repeated rows get the same answer; columns besides the text play no
part, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
import public_tokenizers
import regex
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table

CACHE = 300_000


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a file with a base64 token and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (x.split() for x in lines if x.strip())}


class PerfectHash:
    """A minimal perfect hash from the n keys to 0 .. n-1, by hash and displace.

    Keys fall into n buckets; from the fullest on, each bucket of several keys gets the first seed that sends all of them to
    free slots, and each bucket of one key is given a free slot outright, stored as ``-slot - 1``.
    """

    def __init__(self, keys: list[bytes]):
        n = len(keys)
        buckets: dict[int, list[bytes]] = {}
        for key in keys:
            buckets.setdefault(xxhash.xxh64_intdigest(key, 0) % n, []).append(key)
        self.seeds, self.keys = [0] * n, [None] * n
        ordered = sorted(buckets.items(), key=lambda x: (-len(x[1]), x[0]))
        for b, own in ordered:
            if len(own) == 1:
                break
            seed = 1
            while True:
                slots = {xxhash.xxh64_intdigest(key, seed) % n for key in own}
                if len(slots) == len(own) and all(self.keys[s] is None for s in slots):
                    break
                seed += 1
            self.seeds[b] = seed
            for key in own:
                self.keys[xxhash.xxh64_intdigest(key, seed) % n] = key
        free = iter([s for s in range(n) if self.keys[s] is None])
        for b, own in ordered:
            if len(own) == 1:
                slot = next(free)
                self.seeds[b], self.keys[slot] = -slot - 1, own[0]

    def slot(self, key: bytes) -> int:
        """The key's slot, or -1 for what is not a key."""
        n = len(self.keys)
        if not n:
            return -1
        seed = self.seeds[xxhash.xxh64_intdigest(key, 0) % n]
        slot = -seed - 1 if seed < 0 else xxhash.xxh64_intdigest(key, seed) % n
        return slot if self.keys[slot] == key else -1


def merged(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of ``piece`` after all merges, lowest rank first and leftmost among equals."""
    n = len(piece)
    after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    of = ranks.get
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := of(piece[i : i + 2])) is not None]
    heapify(heap)
    while heap:
        _, i, end = heappop(heap)
        j = after[i] if alive[i] else n
        if j >= n or after[j] != end:
            continue  # one of its sides has been merged meanwhile
        alive[j], after[i] = False, end
        if end < n:
            before[end] = i
            if (r := of(piece[i : after[end]])) is not None:
                heappush(heap, (r, i, after[end]))
        if (h := before[i]) >= 0 and (r := of(piece[h:end])) is not None:
            heappush(heap, (r, h, end))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : after[i]]])
        i = after[i]
    return out


class Tokenizer:
    def __init__(self, ranks: dict[bytes, int], pattern: str = public_tokenizers.PATTERN):
        self.ranks, self.pattern = ranks, pattern
        self.whole = PerfectHash(list(ranks))
        self.rank_at = [ranks[k] for k in self.whole.keys]
        self.bytes_of = {r: k for k, r in ranks.items()}

    def ids_of(self, piece: str) -> bytes:
        """The ids of one pre-token, as little-endian unsigned 32-bit integers."""
        raw = piece.encode()
        slot = self.whole.slot(raw)
        ids = [self.rank_at[slot]] if slot >= 0 else merged(raw, self.ranks)
        return np.array(ids, "<u4").tobytes()

    def encoder(self):
        """text -> ids as little-endian unsigned 32-bit integers."""
        split, known = regex.compile(self.pattern).findall, {}

        class Known(dict):
            def __missing__(cache, piece: str) -> bytes:  # noqa: N805
                if len(cache) >= CACHE:
                    cache.clear()
                cache[piece] = out = self.ids_of(piece)
                return out

        known = Known()
        return lambda text: b"".join(map(known.__getitem__, split(text or "")))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def _shared(spark: SparkSession, path: str):
    small_batches(spark)
    return spark.sparkContext.broadcast(Tokenizer(read_ranks(path)))


def encoded(text: Column, path: str) -> Column:
    """``text`` as an array of token ids."""
    shared = _shared(SparkSession.getActiveSession(), path)

    @F.pandas_udf("array<int>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = shared.value.encoder()
        for texts in batches:
            yield pd.Series([np.frombuffer(encode(x), "<u4").astype(np.int32) for x in texts])

    return run(text)


def decoded(ids: Column, path: str) -> Column:
    """An array of token ids as the bytes they stand for; null stays null."""
    shared = _shared(SparkSession.getActiveSession(), path)

    @F.pandas_udf("binary")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for rows in batches:
            yield pd.Series([None if x is None else shared.value.decode(np.asarray(x, "<u4").tobytes()) for x in rows])

    return run(ids)


def op10_byte_bpe(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """Encodes and decodes every document and returns the digests of both."""
    shared = _shared(spark, path or public_tokenizers.path("byte_bpe_50k.tiktoken"))

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digests(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = shared.value
        encode, sha = own.encoder(), hashlib.sha256
        for texts in batches:
            rows = [(len(ids) // 4, sha(ids).hexdigest(), sha(own.decode(ids)).hexdigest()) for ids in map(encode, texts)]
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"]).astype({"n_tokens": "int64"})

    return table(spark, sf_dir, "documents").select("doc_id", digests("text").alias("_made")).select("doc_id", "_made.*")
