"""Quality by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words. Every passage is encoded: shares of
character classes, word lengths, repetition and shape go through a small tanh layer. A
gated attention, softmax of w (tanh(V h) * logistic(U h)) over the document's passages,
weighs the encodings, and a logistic unit scores their weighted sum. Encoder, attention
and score are learned together from document labels (Adam, back-propagation in numpy), so
which passages matter is learned without passage labels.

Fitted on the driver with at most ``SAMPLE`` labelled documents; every text is
scored whole, in passages. Labels, language, source and id are no input of a score.

Features are shares and shapes only: which words stand in a passage, and their order, play no
part.

Defined results: a null or empty text, or one without words, is one passage whose features are
0; a text of any length is scored whole, at about 60 bytes of memory a word; without labelled
documents the score is that of an untrained network; a row without id is never learned from
and not held out; repeated rows have equal scores; an empty table gives an empty one; columns
named score or predicted are replaced, all others stay.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .labelled import in_fold, training_sample
from .shared import bounded_batches, named_as, place_of, plainly_named
from .words import NOT_BLANK, Words, packs, to_bytes

PASSAGE = 64
#: At most so many labelled documents are taken to the driver for the fit.
SAMPLE = 3000
THRESHOLD = 0.3

#: Character classes whose shares of a passage's bytes are features.
CLASSES = ("upper", "lower", "digit", "stop", "comma", "exclaim", "symbol", "pipe", "quote", "newline", "blank", "other", "high")
_CLASS = np.full(256, CLASSES.index("other"), np.int64)
for _name, _chars in (
    ("upper", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), ("lower", "abcdefghijklmnopqrstuvwxyz"), ("digit", "0123456789"), ("stop", "."),
    ("comma", ",;:"), ("exclaim", "!?"), ("symbol", "#$%&*@^~=+_<>/\\"), ("pipe", "|"), ("quote", "\"'`()[]{}-"), ("newline", "\n"), ("blank", " \t\r\x0b\x0c"),
):
    _CLASS[[ord(c) for c in _chars]] = CLASSES.index(_name)
_CLASS[0x80:] = CLASSES.index("high")
FEATURES = len(CLASSES) + 5


def passages(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(features of each passage, number of passages of each text)."""
    words = Words(texts, NOT_BLANK)
    counts = np.diff(words.first)
    per = np.maximum(1, -(-counts // PASSAGE))
    out = np.zeros((per.sum(), FEATURES), np.float32)
    full = np.repeat(counts > 0, per)
    within = np.arange(len(full)) - np.repeat(np.cumsum(per) - per, per)
    first = (np.repeat(words.first[:-1], per) + within * PASSAGE)[full]
    if not len(first):
        return out, per
    last = np.minimum(first + PASSAGE, np.repeat(words.first[1:], per)[full])  # exclusive
    raw = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    begin, end = words.start[first], words.end[last - 1]
    edge = np.append(begin, end[-1])
    passage = np.repeat(np.arange(len(begin)), np.diff(edge))
    share = np.bincount(passage * len(CLASSES) + _CLASS[raw[begin[0] : end[-1]]], minlength=len(begin) * len(CLASSES))
    share = share.reshape(-1, len(CLASSES)) / np.diff(edge)[:, None]
    n = (last - first).astype(float)
    owner = np.repeat(np.arange(len(first)), last - first)
    length = (words.end - words.start).astype(float)
    mean = np.bincount(owner, length, len(first)) / n
    spread = np.sqrt(np.maximum(np.bincount(owner, length**2, len(first)) / n - mean**2, 0))
    key = np.sort((words.hash >> np.uint64(24)) | (owner.astype(np.uint64) << np.uint64(40)))
    fresh = np.append(True, key[1:] != key[:-1]) if len(key) else np.zeros(0, bool)
    distinct = np.bincount((key[fresh] >> np.uint64(40)).astype(np.int64), minlength=len(first)) / n
    in_doc = (words.hash >> np.uint64(24)) | (words.doc().astype(np.uint64) << np.uint64(40))
    again = np.ones(len(words))
    again[np.unique(in_doc, return_index=True)[1]] = 0  # words that the document has had before
    out[full] = np.column_stack([share, mean / 10, spread / 10, distinct, np.bincount(owner, again, len(first)) / n, np.log1p(n) / 5])
    return out, per


class AttentionMil:
    def __init__(self, hidden: int = 24, gates: int = 12, rounds: int = 30, batch: int = 128, rate: float = 5e-3, l2: float = 1e-4, seed: int = 5):
        self.rounds, self.batch, self.rate, self.l2 = rounds, batch, rate, l2
        rng = np.random.default_rng(seed)
        some = lambda a, b: rng.normal(0, 1 / np.sqrt(a), (a, b))
        self.p = {
            "We": some(FEATURES, hidden), "be": np.zeros(hidden), "V": some(hidden, gates), "U": some(hidden, gates),
            "w": some(gates, 1)[:, 0] * 0.1, "c": some(hidden, 1)[:, 0] * 0.1, "d": np.zeros(1),
        }
        self.mean, self.scale = np.zeros(FEATURES), np.ones(FEATURES)
        self._rng = rng

    def _forward(self, x: np.ndarray, per: np.ndarray) -> dict:
        p = self.p
        begin = np.cumsum(per) - per
        h = np.tanh(x @ p["We"] + p["be"])
        t, g = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        e = (t * g) @ p["w"]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, begin), per))
        a = e / np.repeat(np.add.reduceat(e, begin), per)
        z = np.add.reduceat(a[:, None] * h, begin)
        return {"begin": begin, "h": h, "t": t, "g": g, "a": a, "z": z, "score": 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["d"], -30, 30)))}

    def _gradient(self, x: np.ndarray, per: np.ndarray, y: np.ndarray) -> dict:
        p, f = self.p, self._forward(x, per)
        out = (f["score"] - y) / len(y)
        dz = out[:, None] * p["c"]
        dz_each = np.repeat(dz, per, axis=0)
        da = (dz_each * f["h"]).sum(axis=1)
        de = f["a"] * (da - np.repeat(np.add.reduceat(f["a"] * da, f["begin"]), per))
        dtg = de[:, None] * p["w"]
        dt, dg = dtg * f["g"] * (1 - f["t"] ** 2), dtg * f["t"] * f["g"] * (1 - f["g"])
        dh = f["a"][:, None] * dz_each + dt @ p["V"].T + dg @ p["U"].T
        dx = dh * (1 - f["h"] ** 2)
        grad = {"We": x.T @ dx, "be": dx.sum(axis=0), "V": f["h"].T @ dt, "U": f["h"].T @ dg, "w": (f["t"] * f["g"]).T @ de, "c": f["z"].T @ out, "d": np.array([out.sum()])}
        return {k: v + self.l2 * p[k] for k, v in grad.items()}

    def fit(self, texts: list, y: np.ndarray) -> AttentionMil:
        if not len(texts):
            return self
        raw = [to_bytes(t) for t in texts]
        parts = [passages(raw[a:b]) for a, b in packs(raw)]
        x, per = np.concatenate([p[0] for p in parts]).astype(float), np.concatenate([p[1] for p in parts])
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-3
        x = np.clip((x - self.mean) / self.scale, -8, 8)
        share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.p["d"][:] = np.log(share / (1 - share))
        begin = np.cumsum(per) - per
        m, v, step = {k: 0.0 for k in self.p}, {k: 0.0 for k in self.p}, 0
        for turn in range(self.rounds):
            order = self._rng.permutation(len(y))
            rate = self.rate * (1 - turn / self.rounds)
            for at in range(0, len(y), self.batch):
                own = order[at : at + self.batch]
                rows = np.concatenate([np.arange(begin[i], begin[i] + per[i]) for i in own])
                step += 1
                for k, g in self._gradient(x[rows], per[own], y[own]).items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.p[k] = self.p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        return self

    def score(self, texts: list) -> np.ndarray:
        raw = [to_bytes(t) for t in texts]
        out = [np.zeros(0)]
        for a, b in packs(raw):
            x, per = passages(raw[a:b])
            out.append(self._forward(np.clip((x - self.mean) / self.scale, -8, 8), per)["score"])
        return np.concatenate(out)


def score_quality(docs: DataFrame, model: AttentionMil, text_col: str = "text") -> DataFrame:
    """``docs`` plus score and predicted."""
    kept = [f for f in docs.schema.fields if f.name not in ("score", "predicted")]
    columns = [f.name for f in kept]

    bounded_batches(docs.sparkSession)

    def run(frames):
        for pdf in frames:
            score = model.score(pdf[text_col].tolist())
            yield pdf[columns].assign(score=score, predicted=(score >= THRESHOLD).astype(np.int32))

    return docs.mapInPandas(run, T.StructType([*kept, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]))


def fit_quality(docs: DataFrame, labels: DataFrame) -> AttentionMil:
    return AttentionMil().fit(*training_sample(docs, labels, "quality", 5, 0, SAMPLE))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without those that the classifier rejects."""
    scored = score_quality(plainly_named(docs), fit_quality(docs, labels), place_of(docs, "text"))
    return named_as(scored.filter(F.col("predicted") == 1), docs)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score_quality(docs, model)
    return scored.select("doc_id", in_fold(F.col("doc_id"), 5, 0).alias("held_out"), "score", "predicted")
