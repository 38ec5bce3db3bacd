"""Toxicity by multiple-instance learning: a document is toxic if some sentence is.

A sentence's score is the logistic of a bias plus the weights of its words and of their
beginnings (first ``BEGINNINGS`` bytes, for inflected and compound forms), hashed to
``2**BITS`` places; a document's score combines its sentences by noisy-or,
1 - prod(1 - p). Only documents are labelled: the loss of the document's score is carried
back through the noisy-or to the sentences, so the weights learn which sentences to
blame, and scoring can point at them.

Fitted on the driver with at most ``labelled.SAMPLE`` labelled documents (AdaGrad); every
text is scored whole. Labels, language, source and id are no input of a score.

Defined results: a null or empty text, or one without words, is one sentence without words and
gets the bias alone; a text of any length is scored whole, at about 60 bytes of memory a word;
without labelled documents all weights are 0 and the score is small; a row without id is
never learned from and not held out; repeated rows have equal scores; an empty table gives an
empty one; columns named score, predicted or offending are replaced, all others stay.
Offending sentences are listed for texts that are predicted toxic; such a text has none if no
single sentence reaches ``OFFENDING``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .labelled import in_fold, training_sample
from .words import ALPHANUMERIC, Words, mix64, packs, to_bytes

BITS = 20
BEGINNINGS = (4, 5, 6)
THRESHOLD = 0.3
OFFENDING = 0.5
START = -10.0
_BREAK = np.zeros(256, bool)
_BREAK[[ord(c) for c in ".!?\n"]] = True


def sentences(words: Words) -> np.ndarray:
    """The first word of each sentence; sentences end at . ! ? and line ends."""
    if not len(words):
        return np.zeros(0, np.int64)
    breaks = np.cumsum(_BREAK[words.data])
    new = np.ones(len(words), bool)
    new[1:] = breaks[words.start[1:]] != breaks[words.end[:-1] - 1]
    return np.flatnonzero(new)  # each text ends with \n, so none spans two texts


def _softplus(x: np.ndarray) -> np.ndarray:
    return np.maximum(x, 0) + np.log1p(np.exp(-np.abs(x)))


def _logistic(x: np.ndarray) -> np.ndarray:
    return np.exp(-_softplus(-x))


class Bags:
    """Texts as sentences of hashed words: ``slots`` by word, ``begin`` by sentence, ``doc`` by sentence."""

    def __init__(self, words: Words):
        self.n = len(words.first) - 1
        self.words = words
        hashes = [words.hash, *(words.beginnings(k) for k in BEGINNINGS)]
        self.slots = np.stack([(h >> np.uint64(64 - BITS)).astype(np.int32) for h in hashes])
        self.begin = sentences(words)
        self.doc = np.searchsorted(words.first, self.begin, "right") - 1

    def logits(self, weight: np.ndarray, bias: float) -> np.ndarray:
        if not len(self.begin):
            return np.zeros(0)
        by_word = weight[self.slots[0]]
        for slot in self.slots[1:]:
            by_word = by_word + weight[slot]
        return bias + np.add.reduceat(by_word, self.begin)

    def scores(self, logits: np.ndarray, bias: float) -> np.ndarray:
        """Noisy-or: 1 - exp(-sum of softplus)."""
        total = np.bincount(self.doc, _softplus(logits), self.n)
        total[np.bincount(self.doc, minlength=self.n) == 0] = _softplus(np.array(bias))
        return -np.expm1(-total)


def copy_weights(raw: list[bytes]) -> np.ndarray:
    """1 / copies of each text, copies told by two equal minima of hashed word triples.

    Without it the chance words of one toxic text with many near copies look like evidence.
    """
    keys = []
    for a, b in packs(raw):
        words = Words(raw[a:b], ALPHANUMERIC)
        h = words.hash.copy()
        h[1:] += words.hash[:-1] * np.uint64(3)
        h[2:] += words.hash[:-2] * np.uint64(5)
        for i in range(b - a):
            own = h[words.first[i] + 2 : words.first[i + 1]]
            keys.append((int(mix64(own).min()), int(mix64(~own).min())) if len(own) else (0, 0))
    if not keys:
        return np.zeros(0)
    _, group, size = np.unique(np.array(keys, np.uint64), axis=0, return_inverse=True, return_counts=True)
    return 1.0 / size[group.reshape(-1)]


class NoisyOr:
    def __init__(self, rounds: int = 8, rate: float = 0.4, l2: float = 1e-4, batch: int = 256, least_docs: int = 4, least_z: float = 4.0):
        self.rounds, self.rate, self.l2, self.batch, self.least_docs, self.least_z = rounds, rate, l2, batch, least_docs, least_z
        self.weight, self.bias = np.zeros(1 << BITS), START

    def fit(self, texts: list, y: np.ndarray) -> NoisyOr:
        raw = [to_bytes(t) for t in texts]
        once = copy_weights(raw)
        bags, count, bad = [], np.zeros(1 << BITS), np.zeros(1 << BITS)
        for a in range(0, len(raw), self.batch):
            words = Words(raw[a : a + self.batch], ALPHANUMERIC)
            bag = Bags(words)
            seen = np.unique(words.doc() * (1 << BITS) + bag.slots)
            slot, weight = seen & ((1 << BITS) - 1), once[a : a + self.batch][seen >> BITS]
            count += np.bincount(slot, weight, 1 << BITS)
            bad += np.bincount(slot, weight * y[a : a + self.batch][seen >> BITS], 1 << BITS)
            bag.words = None
            bags.append((bag, y[a : a + self.batch]))
        # Only features that toxic documents hold more often than chance explains are learned.
        share = np.clip(y.mean() if len(y) else 0.5, 1e-6, 1 - 1e-6)
        known = (count >= self.least_docs) & (bad - count * share >= self.least_z * np.sqrt(count * share * (1 - share)))
        square, bias_square = np.full(1 << BITS, 1e-8), 1e-8
        for _ in range(self.rounds):
            for bag, truth in bags:
                logits = bag.logits(self.weight, self.bias)
                p = np.clip(bag.scores(logits, self.bias), 1e-7, 1 - 1e-7)
                # d loss / d sum of softplus: (1 - p) / p for y = 1, taken with -y, and 1 for y = 0
                outer = np.where(truth > 0, -(1 - p) / p, 1.0) / bag.n
                inner = outer[bag.doc] * _logistic(logits)
                by_word = np.repeat(inner, np.diff(np.append(bag.begin, bag.slots.shape[1])))
                grad = sum(np.bincount(slot, by_word, 1 << BITS) for slot in bag.slots)
                touched = np.flatnonzero(grad)
                touched = touched[known[touched]]
                g = grad[touched] + self.l2 * self.weight[touched]
                square[touched] += g * g
                self.weight[touched] -= self.rate * g / np.sqrt(square[touched])
                g = inner.sum()
                bias_square += g * g
                self.bias -= 0.1 * self.rate * g / np.sqrt(bias_square)
        self.weight = self.weight.astype(np.float32)
        return self

    def score(self, texts: list) -> np.ndarray:
        raw = [to_bytes(t) for t in texts]
        out = [np.zeros(0)]
        for a, b in packs(raw):
            bags = Bags(Words(raw[a:b], ALPHANUMERIC))
            out.append(bags.scores(bags.logits(self.weight, self.bias), self.bias))
        return np.clip(np.concatenate(out), 0.0, 1.0)

    def offending(self, text: str | None, least: float = OFFENDING) -> list[tuple[int, int, float]]:
        """(start, end, probability) in code points of the sentences to blame."""
        words = Words([to_bytes(text)], ALPHANUMERIC)
        bags = Bags(words)
        p = _logistic(bags.logits(self.weight, self.bias))
        point = np.concatenate([[0], np.cumsum((words.data & 0xC0) != 0x80)])
        last = np.append(bags.begin[1:], len(words)) - 1
        return [
            (int(point[words.start[bags.begin[i]]]), int(point[words.end[last[i]]]), float(p[i])) for i in np.flatnonzero(p >= least)
        ]


def score_toxicity(docs: DataFrame, model: NoisyOr, locate: bool = True) -> DataFrame:
    """``docs`` plus score, predicted and, if ``locate``, offending (start, end, probability)."""
    names = ["score", "predicted"] + ["offending"] * locate
    spans = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("probability", T.DoubleType())]))
    kinds = {"score": T.DoubleType(), "predicted": T.IntegerType(), "offending": spans}
    kept = [f for f in docs.schema.fields if f.name not in kinds]
    columns = [f.name for f in kept]

    def run(frames):
        for pdf in frames:
            score = model.score(pdf["text"].tolist())
            new = pdf[columns].assign(score=score, predicted=(score >= THRESHOLD).astype(np.int32))
            if locate:
                found = [[dict(zip(("start", "end", "probability"), s, strict=True)) for s in model.offending(t)] if hit else [] for t, hit in zip(pdf["text"], score >= THRESHOLD, strict=True)]
                new["offending"] = pd.Series(found, dtype=object, index=pdf.index)
            yield new

    return docs.mapInPandas(run, T.StructType([*kept, *[T.StructField(n, kinds[n]) for n in names]]))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = NoisyOr().fit(*training_sample(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), "toxic", 4, 2))
    spans = F.array_join(F.transform("offending", lambda o: F.concat_ws(":", o["start"], o["end"])), ",")
    scored = score_toxicity(docs, model)
    return scored.select("doc_id", in_fold(F.col("doc_id"), 4, 2).alias("held_out"), "score", "predicted", spans.alias("offending"))
