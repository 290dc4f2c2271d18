"""Toxicity scores from subword-bag embeddings averaged into a linear softmax.

A word is the bag of its hashed character n-grams (with word ends marked) and of its own hash, so an unseen misspelling
or inflection shares most vectors with the words it resembles. A text is the average of its words' vectors, which a
two-class linear softmax reads. Vectors and softmax are trained jointly in numpy on a bounded sample of labelled texts, and the bias is then set to the labels' true mix.

As the softmax is linear, a text's logit is the weighted sum of its distinct words' logits: scoring needs one number per
distinct word, kept in a bounded cache. Whole texts are scored. A word weighs its count, but no word more than 1/SHARE of
the text, so that a line of one repeated word is no evidence by itself, and a text of fewer than SHORT words is
averaged as if it had SHORT.

Cases: null, empty and wordless texts score the bias alone; without labelled rows of both classes the score is 0;
repeated rows score alike; columns besides the text play no part, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from math import exp, log

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import class_counts, given_back, held_out, labelled, remainder, small_batches, table, training_rows

#: Of each label at most PER_CLASS texts, none of over LONGEST characters, are learnt from.
PER_CLASS, LONGEST = 4000, 20_000
BITS, DIM, LOW, HIGH = 19, 4, 3, 6
BUCKETS = 1 << BITS
_BASE, _MIX = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)
SHORT, SHARE, CHUNK, THRESHOLD = 32, 16, 20_000, 0.7
#: A worker keeps the logits of CACHE words of at most LETTERS characters; characters are hashed BLOCK at a time.
CACHE, LETTERS, BLOCK = 300_000, 64, 1 << 19
#: Times the average that the softmax reads: insults are a few words of a text, so plain averages are small.
GAIN = 16.0

WORD = re.compile(r"\w+")


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def weights(found: list[str]) -> dict[str, float]:
    """What each distinct word adds to the average."""
    most, over = -(-len(found) // SHARE), max(len(found), SHORT)
    return {w: min(c, most) / over for w, c in Counter(found).items()}


def subwords(words: list[str], block: int = BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(buckets, word numbers) of every n-gram of LOW to HIGH characters of each word, ends marked, and of the whole word.

    Words of any length, ``block`` characters at a time: n-grams are polynomial hashes of code points, formed by shifting
    one array over itself, and a word's own hash is the sum of its characters' parts.
    """
    sizes = np.array([len(w) + 2 for w in words], np.int64)
    ends = np.cumsum(sizes)
    marked = "".join([f"<{w}>" for w in words])
    whole = np.zeros(len(words), np.uint64)
    for at in range(0, len(marked), block):
        own = min(block, len(marked) - at)
        codes = np.frombuffer(marked[at : at + own + HIGH - 1].encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        places = np.arange(at, at + len(codes))
        of = np.searchsorted(ends, places, side="right")
        inner = (places - (ends - sizes)[of])[:own].astype(np.uint64)
        first = np.flatnonzero(np.r_[True, of[1:own] != of[: own - 1]])
        whole[of[first]] += np.add.reduceat(codes[:own] * _BASE**inner, first)
        for n in range(LOW, HIGH + 1):
            starts = min(own, len(codes) - n + 1)
            if starts < 1:
                break
            h = np.zeros(starts, np.uint64)
            for k in range(n):
                h = h * _BASE + codes[k : starts + k]
            inside = of[:starts] == of[n - 1 : starts + n - 1]
            yield _bucket(h[inside] * np.uint64(2) + np.uint64(n * int(_MIX) % 2**64)), of[:starts][inside]
    yield _bucket(whole + np.uint64(1)), np.arange(len(words))


def _bucket(h: np.ndarray) -> np.ndarray:
    h = h * _MIX
    return (((h ^ (h >> np.uint64(31))) * _MIX) >> np.uint64(64 - BITS)).astype(np.int64)


@dataclass
class Model:
    """``vectors @ head`` is what a subword adds to the logit of label 1; ``bias`` is the rest of it."""

    weight: np.ndarray
    bias: float

    def scorer(self):
        """A function from a list of texts to their probabilities of label 1."""
        cache: dict[str, float] = {}

        def score(texts: list[str | None]) -> list[float]:
            bags = [weights(words_of(x)) for x in texts]
            new = list({w for bag in bags for w in bag if w not in cache})
            if len(cache) + len(new) > CACHE:
                cache.clear()
                new = list({w for bag in bags for w in bag})
            sums, times = np.zeros(len(new)), np.zeros(len(new))
            for at, of in subwords(new):
                sums += np.bincount(of, self.weight[at], len(new))
                times += np.bincount(of, minlength=len(new))
            logits = dict(zip(new, (sums / np.maximum(times, 1)).tolist(), strict=True))
            cache.update((w, z) for w, z in logits.items() if len(w) <= LETTERS)
            found = (self.bias + sum(c * (cache[w] if w in cache else logits[w]) for w, c in bag.items()) for bag in bags)
            return [1 / (1 + exp(-min(max(z, -50.0), 50.0))) for z in found]

        return score


def train(data: list[tuple[str, int]], epochs: int = 8, rate: float = 0.5, damping: float = 0.003, batch: int = 50, seed: int = 7) -> Model | None:
    """Fit vectors and softmax jointly by Adagrad on the cross-entropy.

    ``damping`` starts the sums of squares at the size of some tens of gradients, so that n-grams of many texts move
    far and the n-grams of a single text hardly at all. None where ``data`` lacks one of the two labels.
    """
    vocabulary: dict[str, int] = {}
    texts, shares, labels = [], [], []
    for text, y in data:
        if bag := weights(words_of(text)):
            texts.append(np.array([vocabulary.setdefault(w, len(vocabulary)) for w in bag]))
            shares.append(np.array(list(bag.values())))
            labels.append(y)
    if len(set(labels)) < 2:
        return None
    labels = np.array(labels)
    known, parts = list(vocabulary), []
    for at in range(0, len(known), CHUNK):  # the hashes of all words at once would be the peak of the driver's memory
        own = known[at : at + CHUNK]
        found, of = (np.concatenate(x) for x in zip(*subwords(own), strict=True))
        parts.append((found[np.argsort(of, kind="stable")].astype(np.int32), np.bincount(of, minlength=len(own))))
    flat, lengths = (np.concatenate(x) for x in zip(*parts, strict=True))
    firsts = np.r_[0, np.cumsum(lengths)]
    rng = np.random.default_rng(seed)
    vectors = rng.normal(0, 0.01, (BUCKETS, DIM)).astype(np.float32)
    squares = np.full(BUCKETS, damping, np.float32)
    head = rng.normal(0, 1, DIM)
    head, bias = np.stack([head, -head], 1), np.zeros(2)
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for at in range(0, len(order), batch):
            own = order[at : at + batch]
            words, back = np.unique(np.concatenate([texts[i] for i in own]), return_inverse=True)
            n = lengths[words]
            edges = np.r_[0, np.cumsum(n)[:-1]]
            # positions in ``flat`` of the subwords of each distinct word
            sub, place = np.unique(flat[np.repeat(firsts[words] - edges, n) + np.arange(n.sum())], return_inverse=True)
            inside = np.add.reduceat(vectors[sub][place], edges) / n[:, None]
            starts = np.r_[0, np.cumsum([len(texts[i]) for i in own])[:-1]]
            share = GAIN * np.concatenate([shares[i] for i in own])[:, None]
            means = np.add.reduceat(inside[back] * share, starts)
            logits = means @ head + bias
            p = 1 / (1 + np.exp(-np.clip(logits[:, 1] - logits[:, 0], -50, 50)))
            wrong = np.stack([labels[own] - p, p - labels[own]], 1)  # gradient of the loss by the logits
            to_word = np.repeat(wrong @ head.T, [len(texts[i]) for i in own], axis=0) * share
            by_word = np.stack([np.bincount(back, to_word[:, k], len(words)) for k in range(DIM)], 1) / n[:, None]
            spread = np.repeat(by_word, n, axis=0)
            gradient = np.stack([np.bincount(place, spread[:, k], len(sub)) for k in range(DIM)], 1).astype(np.float32)
            squares[sub] += (gradient * gradient).sum(1)
            vectors[sub] -= rate * gradient / np.sqrt(squares[sub])[:, None]
            head -= 0.01 * means.T @ wrong / len(own)
            bias -= 0.5 * wrong.sum(0) / len(own)
    return Model((GAIN * vectors @ (head[:, 1] - head[:, 0])).astype(np.float32), float(bias[1] - bias[0]))


def scored(text: Column, model: Model | None) -> Column:
    """The probability that ``text`` is toxic, as a double."""
    if model is None:
        return F.lit(0.0)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        of = model.scorer()
        for texts in batches:
            yield pd.Series(of(list(texts)), dtype="float64")
        del of
        given_back()

    return score(text)


def fit(spark: SparkSession, sf_dir: str, per_class: int = PER_CLASS) -> Model | None:
    """Learns from documents whose crc32 of the id modulo 3 is not 1.

    The sample, at most ``2 * per_class`` texts, is learnt from in one task of an executor, so that neither texts nor hashes ever are in the
    driver's memory, which gets the weights alone (2 MB). The sample's bound changes the mix of labels, so the bias is shifted by the log-odds that the bound took: a score means the
    same whether or not the bound applies.
    """
    small_batches(spark)
    fold = remainder(F.col("doc_id"), 3) != 1

    def learnt(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("doc_id")
        model = train(list(zip(rows["text"], rows["label"].astype(int), strict=True)))
        given_back()  # training takes some 0.8 GB
        found = [] if model is None else [(model.weight.tobytes(), model.bias)]
        return pd.DataFrame(found, columns=["weight", "bias"])

    texts = training_rows(spark, sf_dir, "toxic", fold, per_class, LONGEST)
    got = texts.groupBy(F.lit(0).alias("all")).applyInPandas(learnt, "weight binary, bias double").collect()
    model = Model(np.frombuffer(bytes(got[0]["weight"]), np.float32), got[0]["bias"]) if got else None
    if model is not None:
        of = class_counts(labelled(spark, sf_dir, "toxic", fold), "label")
        model.bias += log(of[1] / min(of[1], per_class)) - log(of[0] / min(of[0], per_class))
    return model


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = docs.select("doc_id", held_out(3, 1), scored(F.col("text"), fit(spark, sf_dir)).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``docs`` without the documents that score THRESHOLD or more."""
    return docs.where(scored(F.col("text"), fit(spark, sf_dir)) < THRESHOLD)
