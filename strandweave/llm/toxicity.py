"""Operator 8: toxicity by a chain of classifiers.

The categories are predicted one after the other by logistic regressions over
words and their beginnings; each later model also sees the probabilities that
the earlier ones give.  In training those are out-of-fold predictions: every
labelled text's probability comes from a model that has not seen it, as at
prediction time.

A feature is the presence of a word or of a word's first 3 to 7 characters
(in lower case).  A model keeps the features that tell its category apart most
clearly in the sample and is a table of their weights, so prediction is a few
look-ups for each distinct word.  Training takes a bounded sample of labelled
rows; prediction reads every whole text where it lies, without a shuffle.

Defined results: null and empty text and others without a feature tell nothing and
get the share of each category among the texts learned from; rows whose label is null or which have no text are not learned from;
rows that repeat a doc_id are judged each by its text; with no labelled rows
every probability is 0.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandweave.llm import words as W
from strandweave.runtime import small_batches

STARTS = (3, 4, 5, 6, 7)
#: Labelled rows and bytes of text learned from, at most; folds; passes; words remembered by a worker.
ROWS, BYTES, FOLDS, EPOCHS, REMEMBERED = 4000, 16 << 20, 3, 12, 400_000
#: A text with more than this part of BYTES is not learned from, so that none takes the place of all others.
SHARE = 16
#: Features of a model at most; texts that hold one at least; deviations from chance at least.
FEATURES, LEAST, CLEAR = 3000, 3, 4.0
#: A text of the rarer class weighs so much more than others in training the last category.
RARE = 3.0
#: Categories in the order of the chain, and the probability from which a document is rejected.
CHAIN, REJECT = ("low_quality", "toxic"), 0.5
_word = re.compile(r"\w+")


def features(word: str) -> tuple:
    return (word, *(word[:n] + "*" for n in STARTS if len(word) > n))


def present(text: str) -> set:
    """All features of a text."""
    return {f for w in set(_word.findall(text.lower())) for f in features(w)}


def telling(sets: list[set], y: np.ndarray) -> list[str]:
    """The features whose share differs most clearly between the two classes."""
    ones = max(int(y.sum()), 1)
    zeros = max(len(y) - ones, 1)
    there, all_ = Counter(), Counter()
    for s, label in zip(sets, y, strict=True):
        all_.update(s)
        if label:
            there.update(s)
    found = []
    for f, n in all_.items():
        if n < LEAST:
            continue
        share = n / len(y)
        z = abs(there[f] / ones - (n - there[f]) / zeros) / math.sqrt(max(share * (1 - share), 1e-9) * (1 / ones + 1 / zeros))
        if z >= CLEAR:
            found.append((-z, f))
    return [f for _, f in sorted(found)[:FEATURES]]


class Linear:
    """Logistic regression over present features and a few dense inputs, by AdaGrad in a fixed order."""

    def __init__(self, dense: int):
        self.weights: dict[str, float] = {}
        self.d, self.b = np.zeros(dense), 0.0

    def logit(self, held, extra) -> float:
        return sum(self.weights.get(f, 0.0) for f in held) + float(self.d @ np.asarray(extra)) + self.b

    def fit(self, sets: list, extra: np.ndarray, y: np.ndarray, weight: float = 1.0) -> Linear:
        names = telling(sets, y)
        number = {f: i for i, f in enumerate(names)}
        xs = [np.array(sorted(number[f] for f in s if f in number), np.int64) for s in sets]
        w, seen, seen_d, seen_b = np.zeros(len(names)), np.full(len(names), 1.0), np.full(len(self.d), 1.0), 1.0
        rng, rate = np.random.default_rng(8), 0.5
        rare = 1.0 if y.mean() < 0.5 else 0.0
        for _ in range(EPOCHS):
            for i in rng.permutation(len(xs)):
                g = (probability(w[xs[i]].sum() + self.d @ extra[i] + self.b) - y[i]) * (weight if y[i] == rare else 1.0)
                if abs(g) < 1e-3:
                    continue
                seen[xs[i]] += g * g
                w[xs[i]] -= rate * g / np.sqrt(seen[xs[i]])
                gd = g * extra[i]
                seen_d, seen_b = seen_d + gd * gd, seen_b + g * g
                self.d -= rate * gd / np.sqrt(seen_d)
                self.b -= rate * g / seen_b**0.5
        self.weights = dict(zip(names, w.tolist(), strict=True))
        return self


def probability(logit):
    return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


class Chain:
    """Models of the categories in order; each has one dense input for each earlier category."""

    def __init__(self, categories=CHAIN):
        self.categories, self.models, self.shares = tuple(categories), [], [0.0] * len(categories)

    def fit(self, sets: list[set], labels: np.ndarray) -> Chain:
        """labels: a column of 0 and 1 for each category."""
        self.shares = labels.mean(axis=0).tolist()
        held = Counter()
        for s in sets:
            held.update(s)
        sets = [tuple(f for f in s if held[f] >= LEAST) for s in sets]
        fold = np.arange(len(sets)) % FOLDS
        earlier = np.zeros((len(sets), 0))
        for k in range(len(self.categories)):
            y = labels[:, k].astype(np.float64)
            self.models.append(Linear(k).fit(sets, earlier, y, RARE if k + 1 == len(self.categories) else 1.0))
            if k + 1 < len(self.categories):
                out = np.zeros(len(sets))
                for f in range(FOLDS):
                    train, test = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
                    if len(train) and len(test):
                        m = Linear(k).fit([sets[i] for i in train], earlier[train], y[train])
                        out[test] = [probability(m.logit(sets[i], earlier[i])) for i in test]
                earlier = np.column_stack([earlier, out])
        return self

    def known(self) -> set:
        return {f for m in self.models for f in m.weights}

    def predict(self, held) -> list[float]:
        known = [f for f in held if any(f in m.weights for m in self.models)]
        if not known:
            return list(self.shares)
        out: list[float] = []
        for m in self.models:
            out.append(float(probability(m.logit(known, out))))
        return out


class Reader:
    """The chain's features that a text holds; words are remembered."""

    def __init__(self, known: set):
        self.known, self._seen = known, {}

    def __call__(self, text: str | None) -> list[str]:
        if not text:
            return []
        if len(self._seen) > REMEMBERED:
            self._seen.clear()
        seen, found = self._seen, set()
        for w in set(_word.findall(text.lower())):
            f = seen.get(w)
            if f is None:
                f = seen[w] = tuple(x for x in features(w) if x in self.known)
            if f:
                found.update(f)
        return sorted(found)


def labelled(docs: DataFrame, labels: DataFrame, rows: int = ROWS) -> DataFrame:
    """(text, low_quality, toxic): a fixed draw by hash of labelled documents.

    The draw is made on the labels, so only its documents' texts are sought, with
    a join whose small side is bounded by ``rows``.  Documents too long to learn
    from are left out before the draw, so others are drawn in their place.
    """
    marks = labels.select(F.col("doc_id").cast("long").alias("_id"), (1 - F.col("quality").cast("int")).alias("low_quality"), F.col("toxic").cast("int").alias("toxic")).where("_id IS NOT NULL AND low_quality IN (0, 1) AND toxic IN (0, 1)")
    long = docs.where(F.length(F.col("text").cast("string")) > BYTES // SHARE).select(F.col("doc_id").cast("long").alias("_id")).distinct()
    drawn = marks.join(long, "_id", "left_anti").orderBy(F.xxhash64(F.lit(8), "_id"), "_id", "toxic", "low_quality").limit(rows)
    texts = docs.where(F.length(F.col("text").cast("string")) <= BYTES // SHARE).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.join(F.broadcast(drawn), F.col("doc_id") == F.col("_id")).select("_id", "text", *CHAIN)


class Sample:
    """Labelled texts in little memory: numbers of words, then only features that LEAST texts may hold.

    Features are counted by a hash first; one that shares its slot with others is
    counted too high and kept, never lost.
    """

    def __init__(self):
        self._number: dict[str, int] = {}
        self._texts: list[np.ndarray] = []

    def add(self, text: str) -> None:
        number = self._number
        own = {number.setdefault(w, len(number)) for w in set(_word.findall(text.lower()))}
        self._texts.append(np.fromiter(own, np.int32, len(own)))

    def held(self) -> list[tuple]:
        """The features of each text."""
        words, wide = list(self._number), 1 + len(STARTS)
        slots = np.zeros((len(words), wide), np.int32)
        for i, w in enumerate(words):
            own = [zlib.crc32(f.encode()) & 0x3FFFFF for f in features(w)]
            slots[i] = own + [own[0]] * (wide - len(own))
        counts = np.zeros(1 << 22, np.int32)
        for t in self._texts:
            counts[np.unique(slots[t].ravel())] += 1
        known: dict[str, str] = {}
        of_word = [tuple(known.setdefault(f, f) for f, s in zip(features(w), slots[i], strict=False) if counts[s] >= LEAST) for i, w in enumerate(words)]
        return [tuple({f for i in t for f in of_word[i]}) for t in self._texts]


def train(docs: DataFrame, labels: DataFrame) -> Chain:
    sample, ys, size = Sample(), [], 0
    found = labelled(docs, labels).orderBy(F.xxhash64(F.lit(8), "_id"), "_id", "text")
    for r in found.toLocalIterator():
        if size + len(r.text) > BYTES:
            continue
        size += len(r.text)
        sample.add(r.text)
        ys.append([r[c] for c in CHAIN])
    return Chain().fit(sample.held(), np.array(ys).reshape(-1, len(CHAIN))) if ys else Chain()


def _judge(shared, keep_clean: bool):
    def run(it):
        chain = shared.value
        read = Reader(chain.known())
        for batch in W.batches(it):
            p = np.array([chain.predict(read(t)) for t in batch.column("text").to_pylist()]).reshape(-1, len(CHAIN))
            bad = p[:, -1] >= REJECT
            if keep_clean:
                yield batch.filter(pa.array(~bad))
            else:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(p[:, k]) for k in range(len(CHAIN))), pa.array(bad)], ["doc_id", *(f"p_{c}" for c in CHAIN), "rejected"])

    return run


def judge(docs: DataFrame, chain: Chain) -> DataFrame:
    """(doc_id, p_low_quality, p_toxic, rejected) for each row of docs."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(W.tidy(_judge(docs.sparkSession.sparkContext.broadcast(chain), False)), "doc_id long, " + ", ".join(f"p_{c} double" for c in CHAIN) + ", rejected boolean")


def remove_toxic(docs: DataFrame, chain: Chain) -> DataFrame:
    """The rows of docs, all columns, that aren't rejected; each row is judged by its own text, and null and empty texts stay unless most of those learned from were rejected."""
    small_batches(docs.sparkSession)
    return W.filtered(docs, _judge(docs.sparkSession.sparkContext.broadcast(chain), True))
