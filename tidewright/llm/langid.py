"""Language identification by prediction by partial matching (PPM) over bytes.

Each language has its own variable-order context tree, which counts which byte follows which context of up to ``ORDER``
bytes in a bounded sample of its texts. A byte unseen in a context escapes to the next shorter one (method C: a context of n
bytes seen with q distinct followers gives the escape q / (n + q)); below the empty context all 256 bytes are alike. The
statistics are then frozen, so a text's code length in a language is a sum of one number per byte, and the shortest code wins.

**Trees.** A tree is sparse: for each order the sorted codes of the contexts and of the contexts with a follower, with the
bits that an escape and that the follower cost. Contexts seen fewer than ``LEAST`` times are cut. Trees are grown on the
executors, one language a task, from at most ``PER_LANGUAGE`` texts; no language is left out, however many there are, and none
takes room from another. The driver and each worker hold all trees, 2 MB of a language or less.

**Scoring.** Of a block of bytes the distinct contexts with followers are few, so each is looked up once a language and
kept for the next blocks, and the code lengths are sums over their places.

Cases: a text that is null or has no letter (Unicode category L) is ``und`` with score 0; without any training text so
is every text; repeated rows get the same answer; columns besides the text play no part, whatever their names.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_per_class, given_back, held_out, remainder, small_batches, table

ORDER, LEAST = 3, 2
#: Of each language at most PER_LANGUAGE texts, none of over LONGEST characters, are learnt from.
PER_LANGUAGE, LONGEST = 250, 20_000
UNKNOWN = "und"
#: Symbols: 0 stands before the text, a byte b is b + 1.
SYMBOLS = 257
#: Bytes scored at once, and codes whose costs a worker keeps.
BLOCK, KEPT = 1 << 20, 1 << 18
LETTER = regex.compile(r"\p{L}")


@dataclass
class Level:
    """Of one order: sorted codes of contexts and their escapes' bits, sorted codes of context and follower and their bits."""

    contexts: np.ndarray
    escape: np.ndarray
    codes: np.ndarray
    bits: np.ndarray


def codes_of(raw: bytes, order: int = ORDER) -> np.ndarray:
    """For each byte the code of the ``order`` symbols before it and of itself."""
    s = np.r_[np.zeros(order, np.int64), np.frombuffer(raw, np.uint8).astype(np.int64) + 1]
    out = s[order:].copy()
    for back in range(1, order + 1):
        out += s[order - back : len(s) - back] * SYMBOLS**back
    return out


def grow(texts: list[str], order: int = ORDER, least: int = LEAST) -> list[Level]:
    """The tree of a language: its levels from the empty context up."""
    seen, times = np.unique(np.concatenate([codes_of(t.encode(), order) for t in texts] or [np.empty(0, np.int64)]), return_counts=True)
    levels = []
    for k in range(order + 1):
        codes, where = np.unique(seen % SYMBOLS ** (k + 1), return_inverse=True)
        count = np.bincount(where, times, len(codes))
        contexts, of = np.unique(codes // SYMBOLS, return_inverse=True)
        total, distinct = np.bincount(of, count, len(contexts)), np.bincount(of, minlength=len(contexts))
        kept = total >= (least if k else 1)
        inside = kept[of]
        bits = -np.log2(count[inside] / (total + distinct)[of[inside]])
        levels.append(Level(contexts[kept], -np.log2(distinct[kept] / (total + distinct)[kept]), codes[inside], bits))
    return levels


def _find(sorted_: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, whether it is there) of each wanted code."""
    if not len(sorted_):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(sorted_, wanted), len(sorted_) - 1)
    return at, sorted_[at] == wanted


def cost(tree: list[Level], codes: np.ndarray) -> np.ndarray:
    """The bits of each code of ``len(tree) - 1`` symbols and a follower."""
    bits, open_ = np.zeros(len(codes)), np.arange(len(codes))
    for k in range(len(tree) - 1, -1, -1):
        own = codes[open_] % SYMBOLS ** (k + 1)
        at, hit = _find(tree[k].codes, own)
        bits[open_[hit]] += tree[k].bits[at[hit]] if hit.any() else 0.0
        open_, own = open_[~hit], own[~hit]
        at, known = _find(tree[k].contexts, own // SYMBOLS)
        bits[open_[known]] += tree[k].escape[at[known]] if known.any() else 0.0
    bits[open_] += 8.0
    return bits


class Model:
    def __init__(self, trees: dict[str, list[Level]]):
        self.languages = sorted(trees)
        self.trees = [trees[x] for x in self.languages]
        self.order = len(self.trees[0]) - 1 if trees else ORDER
        self.known, self.costs = np.empty(0, np.int64), np.empty((len(trees), 0))

    def __getstate__(self):
        return self.__dict__ | {"known": self.known[:0], "costs": self.costs[:, :0]}

    def _learn(self, codes: np.ndarray) -> None:
        """Costs of the sorted distinct ``codes`` join those that are kept; beyond KEPT only these stay."""
        new = codes[~_find(self.known, codes)[1]]
        if not len(new):
            return
        if len(self.known) + len(new) > KEPT:
            self.known, self.costs, new = self.known[:0], self.costs[:, :0], codes
        every = np.concatenate([self.known, new])
        order = np.argsort(every, kind="stable")
        added = np.stack([cost(t, new) for t in self.trees])
        self.known, self.costs = every[order], np.concatenate([self.costs, added], 1)[:, order]

    def bits_of(self, texts: list[bytes]) -> np.ndarray:
        """The code length of each whole text in each language."""
        total = np.zeros((len(texts), len(self.languages)))
        parts: list[tuple[int, bytes, int]] = []
        waiting = 0

        def flush() -> None:
            codes = [codes_of(raw, self.order)[skip:] for _, raw, skip in parts]
            starts = np.cumsum([0, *map(len, codes[:-1])])
            distinct, where = np.unique(np.concatenate(codes), return_inverse=True)
            self._learn(distinct)
            costs = self.costs[:, np.searchsorted(self.known, distinct)]
            of = [i for i, _, _ in parts]
            for j in range(len(self.languages)):
                np.add.at(total[:, j], of, np.add.reduceat(costs[j][where], starts))

        for i, raw in enumerate(texts):
            for at in range(0, len(raw), BLOCK):
                skip = min(at, self.order)  # the bytes before a later block are its first contexts
                part = raw[at - skip : at + BLOCK]
                parts.append((i, part, skip))
                waiting += len(part)
                if waiting >= BLOCK:
                    flush()
                    parts, waiting = [], 0
        if parts:
            flush()
        return total

    def bits(self, text: str) -> np.ndarray:
        return self.bits_of([text.encode()])[0]

    def judged(self, texts: list[str | None]) -> list[tuple[str, float, float]]:
        """(language, score, bits a byte) of each: the score is the probability of the language if all are equally likely."""
        out = [(UNKNOWN, 0.0, 8.0)] * len(texts)
        own = [i for i, x in enumerate(texts) if x and self.languages and LETTER.search(x)]
        raws = [texts[i].encode() for i in own]
        for i, raw, bits in zip(own, raws, self.bits_of(raws), strict=True):
            best = int(bits.argmin())
            out[i] = self.languages[best], float(1 / np.exp2(np.maximum(bits[best] - bits, -1000)).sum()), float(bits[best] / len(raw))
        return out

    def judge(self, text: str | None) -> tuple[str, float, float]:
        return self.judged([text])[0]


def train(samples: dict[str, list[str]], order: int = ORDER, least: int = LEAST) -> Model:
    return Model({x: grow(texts, order, least) for x, texts in samples.items()})


def fit(spark: SparkSession, sf_dir: str) -> Model:
    """Learns from text and non-null lang of documents whose crc32 of the id modulo 3 is not 1."""
    small_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    docs = docs.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & (remainder(F.col("doc_id"), 3) != 1))
    docs = docs.where(F.col("text").isNotNull() & (F.length("text") <= LONGEST))
    chosen = bounded_per_class(docs.select("doc_id", "lang"), "lang", "doc_id", PER_LANGUAGE).distinct()

    def tree(rows: pd.DataFrame) -> pd.DataFrame:
        texts = sorted(set(rows["text"]))
        return pd.DataFrame({"lang": rows["lang"].iloc[:1], "tree": [pickle.dumps(grow(texts))]})

    # PER_LANGUAGE ids a language are broadcast, and a task holds the texts of one language; a row arrives for each.
    grown = docs.join(F.broadcast(chosen), ["doc_id", "lang"]).select("lang", "text").groupBy("lang").applyInPandas(tree, "lang string, tree binary")
    return Model({r["lang"]: pickle.loads(bytes(r["tree"])) for r in grown.collect()})


def judged(text: Column, model: Model) -> Column:
    """A struct of lang_pred, score and bits (a byte) of ``text``. The tables go to executors as a broadcast variable."""
    spark = SparkSession.getActiveSession()
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, bits double")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = shared.value
        for texts in batches:
            yield pd.DataFrame(own.judged(list(texts)), columns=["lang_pred", "score", "bits"]).astype({"lang_pred": object, "score": float, "bits": float})
        given_back()

    return judge(text)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = docs.select("doc_id", held_out(3, 1), judged(F.col("text"), fit(spark, sf_dir)).alias("_found"))
    return out.select("doc_id", "held_out", "_found.lang_pred", "_found.score", F.col("_found.bits").alias("bits_per_byte"))


#: The stage rejects what has no letter, texts whose likeliest languages are about equally likely, and texts that even
#: the best language's model finds nearly as long as noise (8 bits a byte), such as digits and base64.
LEAST_SCORE, MOST_BITS = 0.6, 6.5


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``docs`` whose language is known: a score of at least LEAST_SCORE at MOST_BITS a byte or fewer."""
    found = judged(F.col("text"), fit(spark, sf_dir))
    return docs.where((found["score"] >= LEAST_SCORE) & (found["bits"] <= MOST_BITS))
