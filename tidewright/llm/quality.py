"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad. A line's features are its own shape (length, shares of upper case, digits, symbols, ...), how
far it repeats itself or other lines of its text, and the same of the line before and after it; transitions tie neighbours
together. Trained on a bounded sample of labelled documents, each line taking its document's label, by gradient ascent
on the conditional likelihood. A document's score is the average of its lines' forward-backward probabilities of good,
weighted by length.

Forward and backward run over all documents of a batch at once, one step per line number.

Cases: a null or blank text has one empty line and is scored by it; without labelled rows of both classes the score is
0; repeated rows score alike; columns besides the text play no part, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, remainder, small_batches, table, training_texts

#: Of each label at most PER_CLASS texts, none of over LONGEST characters, are learnt from.
PER_CLASS, LONGEST, THRESHOLD = 1500, 20_000, 0.3
#: Lines scored at once, which bounds a worker's memory whatever the texts of a batch; a longer text is scored alone.
LINES = 100_000

_CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "digit": b"0123456789",
    "symbol": bytes(c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,;:?'\"-()"),
    "stop": b".,;:?",
    "space": b" \t",
}
_TABLES = np.zeros((len(_CLASSES), 256), np.uint8)
for _i, _members in enumerate(_CLASSES.values()):
    _TABLES[_i, list(_members)] = 1
FEATURES = len(_CLASSES) + 7


def line_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(features of each line, its length in bytes)."""
    lines = text.split("\n")
    times = Counter(lines)
    raw = np.frombuffer((text + "\n").encode(), np.uint8)
    ends = np.flatnonzero(raw == 10)
    starts = np.r_[0, ends[:-1] + 1]
    length = (ends - starts).astype(np.float64)
    out = np.empty((len(lines), FEATURES))
    for i, t in enumerate(_TABLES):
        out[:, i] = np.add.reduceat(t[raw], starts, dtype=np.int64)  # the line end is of no class
    over = np.maximum(length, 1)
    out[:, : len(_TABLES)] /= over[:, None]
    k = len(_TABLES)
    words = [line.split() for line in lines]
    counts = np.fromiter(map(len, words), np.float64, len(lines))
    distinct = np.fromiter((len(set(w)) for w in words), np.float64, len(lines))
    out[:, k] = np.log1p(length) / 5
    out[:, k + 1] = 1 - distinct / np.maximum(counts, 1)
    out[:, k + 2] = np.fromiter((times[x] > 1 for x in lines), np.float64, len(lines))
    out[:, k + 3] = length / np.maximum(counts, 1) / 10
    out[:, k + 4] = out[:, 2] > 0.1
    out[:, k + 5] = out[:, 0] > 0.4
    out[:, k + 6] = out[:, k + 1] > 0.5
    return np.minimum(out, 5), np.maximum(length, 1)


def with_neighbours(x: np.ndarray) -> np.ndarray:
    """A bias, each line's features, and those of the line before and after (zero, and flagged, where there is none)."""
    none = np.zeros((1, x.shape[1]))
    first, last = np.zeros((len(x), 1)), np.zeros((len(x), 1))
    first[0], last[-1] = 1, 1
    return np.hstack([np.ones((len(x), 1)), x, np.vstack([none, x[:-1]]), np.vstack([x[1:], none]), first, last])


def forward_backward(scores: np.ndarray, moves: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(probability of each state of each line, sums of the probabilities of each pair of neighbouring states).

    ``scores`` are those of each line's two states, documents one after another with ``sizes`` lines each.
    """
    order = np.argsort(-sizes, kind="stable")
    firsts = (np.cumsum(sizes) - sizes)[order]
    sizes = sizes[order]
    active = np.searchsorted(-sizes, -np.arange(int(sizes.max(initial=0))), side="left")  # documents of over t lines
    ahead, behind = scores.copy(), np.zeros_like(scores)
    for t in range(1, len(active)):
        at = firsts[: active[t]] + t
        ahead[at] += np.logaddexp(ahead[at - 1, :1] + moves[0], ahead[at - 1, 1:] + moves[1])
    for t in range(len(active) - 1, 0, -1):
        at = firsts[: active[t]] + t
        to = scores[at] + behind[at]
        behind[at - 1] = np.logaddexp(to[:, :1] + moves[:, 0], to[:, 1:] + moves[:, 1])
    joint = ahead + behind
    each = 1 / (1 + np.exp(np.clip(joint[:, 0] - joint[:, 1], -700, 700)))
    inner = np.ones(len(scores), bool)
    inner[firsts] = False
    at = np.flatnonzero(inner)
    pair = ahead[at - 1][:, :, None] + moves + (scores[at] + behind[at])[:, None, :]
    pair = np.exp(pair - np.logaddexp(joint[at, 0], joint[at, 1])[:, None, None])
    return np.stack([1 - each, each], 1), pair.sum(0)


@dataclass
class Model:
    states: np.ndarray  # of each state and feature
    moves: np.ndarray
    middle: np.ndarray
    spread: np.ndarray

    def line_scores(self, features: np.ndarray) -> np.ndarray:
        """What ``with_neighbours`` of the features times the states gives, without forming it."""
        x, k = (features - self.middle) / self.spread, features.shape[1]
        out = self.states[:, 0] + x @ self.states[:, 1 : k + 1].T
        out[1:] += (x @ self.states[:, k + 1 : 2 * k + 1].T)[:-1]
        out[:-1] += (x @ self.states[:, 2 * k + 1 : 3 * k + 1].T)[1:]
        out[0] += self.states[:, -2]
        out[-1] += self.states[:, -1]
        return out

    def score(self, texts: list[str | None], lines: int = LINES) -> np.ndarray:
        """The score of each text, as many at once as have ``lines`` lines together, and one at least."""
        out, scores, lengths = [], [], []

        def flush() -> None:
            sizes = np.array([len(n) for n in lengths])
            good = forward_backward(np.concatenate(scores), self.moves, sizes)[0][:, 1]
            length, starts = np.concatenate(lengths), np.cumsum(sizes) - sizes
            out.append(np.clip(np.add.reduceat(good * length, starts) / np.add.reduceat(length, starts), 0, 1))
            scores.clear()
            lengths.clear()

        waiting = 0
        for x in texts:
            own = (x or "").count("\n") + 1
            if lengths and waiting + own > lines:
                flush()
                waiting = 0
            features, length = line_features(x or "")
            scores.append(self.line_scores(features))
            lengths.append(length)
            waiting += own
        if lengths:
            flush()
        return np.concatenate(out) if out else np.empty(0)


def train(data: list[tuple[str, int]], steps: int = 120, rate: float = 0.05, ridge: float = 1e-3) -> Model | None:
    """Adam on the log-likelihood per line. None where ``data`` lacks one of the two labels."""
    if len({y for _, y in data}) < 2:
        return None
    made = [line_features(text)[0] for text, _ in data]
    sizes = np.array([len(f) for f in made])
    every = np.vstack(made)
    middle, spread = every.mean(0), every.std(0) + 1e-6
    x = np.vstack([with_neighbours((f - middle) / spread) for f in made])
    label = np.repeat([y for _, y in data], sizes)
    # Each document counts alike, and so does each label.
    weight = np.repeat(1 / sizes, sizes)
    weight /= np.where(label == 1, weight[label == 1].sum(), weight[label == 0].sum()) * 2
    truth = np.stack([1 - label, label], 1)
    states, moves = np.zeros((2, x.shape[1])), np.zeros((2, 2))
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (states, moves)]
    kept = np.diag([(sizes[np.array([y for _, y in data]) == k] - 1).sum() for k in (0, 1)])  # moves of the given labels
    for step in range(1, steps + 1):
        p, pairs = forward_backward(x @ states.T, moves, sizes)
        gradient = ((truth - p) * weight[:, None]).T @ x - ridge * states, (kept - pairs) / len(x) - ridge * moves
        for value, g, m in zip((states, moves), gradient, moments, strict=True):
            m[0] += 0.1 * (g - m[0])
            m[1] += 0.001 * (g * g - m[1])
            value += rate * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.999**step)) + 1e-8)
    return Model(states, moves, middle, spread)


def scored(text: Column, model: Model | None) -> Column:
    """The quality of ``text`` as a double from 0 to 1."""
    if model is None:
        return F.lit(0.0)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(model.score(list(texts)), dtype="float64")

    return score(text)


def fit(spark: SparkSession, sf_dir: str) -> Model | None:
    """Learns from documents whose crc32 of the id modulo 5 is not 0."""
    small_batches(spark)
    return train(training_texts(spark, sf_dir, "quality", remainder(F.col("doc_id"), 5) != 0, PER_CLASS, LONGEST))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = docs.select("doc_id", held_out(5, 0), scored(F.col("text"), fit(spark, sf_dir)).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
