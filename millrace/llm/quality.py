"""A compression classifier of text quality.

Two zstandard dictionaries are built from good and from bad labelled text. What a text costs with the one less what it
costs with the other, over its length and over its plain compressed size, becomes a score by a logistic calibration on
labelled texts that built neither. The model is fitted on a bounded sample; every text is scored whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import give_back, slices

THRESHOLD = 0.3


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


@dataclass
class Model:
    good: bytes
    bad: bytes
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def __post_init__(self):
        self._tools = None

    def __getstate__(self):
        return self.__dict__ | {"_tools": None}

    def features(self, texts: list[bytes]) -> np.ndarray:
        """Size differences over length and over plain compressed size, and how well a text compresses by itself."""
        if self._tools is None:
            dicts = [zstandard.ZstdCompressionDict(d) if d else None for d in (self.good, self.bad)]
            self._tools = [zstandard.ZstdCompressor(level=3, dict_data=d) for d in (*dicts, None)]
        sizes = np.array([[len(t.compress(x)) for t in self._tools] + [len(x)] for x in texts], float).reshape(-1, 4)
        good, bad, plain, n = sizes.T
        return np.c_[(bad - good) / (n + 1), (bad - good) / (plain + 20), np.log((plain + 20) / (n + 20))]

    def score(self, texts: list[bytes]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(_terms((self.features(texts) - self.mean) / self.scale) @ self.weights, -30, 30)))


def _terms(x: np.ndarray) -> np.ndarray:
    x = np.clip(x, -6, 6)
    return np.c_[np.ones(len(x)), x, x**2, x[:, 0] * x[:, 2], x[:, 1] * x[:, 2]]


def _logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0) -> np.ndarray:
    """Ridge logistic regression by damped Newton steps."""
    def loss(w: np.ndarray) -> float:
        return float(np.logaddexp(0, np.where(y == 1, -1, 1) * (x @ w)).sum() + penalty / 2 * (w[1:] ** 2).sum())

    ridge = penalty * np.diag([1e-6] + [1] * (x.shape[1] - 1))
    w = np.zeros(x.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
        size = 1.0
        while size > 1e-6 and loss(w + size * step) > loss(w):
            size /= 2
        w = w + size * step
        if np.abs(size * step).max() < 1e-8:
            break
    return w


def _dictionary(texts: list[bytes], size: int) -> bytes:
    if len(texts) >= 100:
        try:
            return zstandard.train_dictionary(size, texts).as_bytes()
        except zstandard.ZstdError:
            pass  # too little text to train on: the text itself serves
    return b"\n".join(texts)[-size:]


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 3000, most_bytes: int = 1 << 16, dictionary: int = 112_640) -> Model:
    """A model from docs(doc_id, text) and labels(doc_id, quality), without the held-out fifth.

    Bounded sample: `per_class` labelled documents of each class, in the order of a hash of doc_id, without texts over
    `most_bytes`; every other one builds the dictionaries, the rest calibrate. Class frequencies come from all labels. Null
    qualities and ids don't count. With one class or none every score is the frequency of class 1, or 0.5.
    """
    known = labels.where("quality in (0, 1) and doc_id is not null").where(~held_out(F.col("doc_id"))).select(F.col("doc_id").alias("label_id"), "quality").distinct()
    counts = {r[0]: r[1] for r in known.groupBy("quality").count().collect()}
    rate = (counts.get(1, 0) + 1) / (sum(counts.values()) + 2)
    picked = [known.where(F.col("quality") == q).orderBy(F.xxhash64("label_id"), "label_id").limit(per_class) for q in (0, 1)]
    picked = F.broadcast(picked[0].union(picked[1]))  # 2 * per_class rows at most
    sample = docs.join(picked, F.col("doc_id") == F.col("label_id")).where(F.octet_length("text").between(1, most_bytes)).select("doc_id", "text", "quality")
    texts: dict[int, list[bytes]] = {0: [], 1: []}
    for r in sorted(sample.collect()):
        texts[r["quality"]].append(r["text"].encode())
    if min(map(len, texts.values())) < 4:
        return Model(b"", b"", np.zeros(3), np.ones(3), np.r_[np.log(rate / (1 - rate)), np.zeros(8)])
    model = Model(_dictionary(texts[1][::2], dictionary), _dictionary(texts[0][::2], dictionary), np.zeros(3), np.ones(3), np.zeros(9))
    x = np.r_[model.features(texts[1][1::2]), model.features(texts[0][1::2])]
    y = np.r_[np.ones(len(texts[1][1::2])), np.zeros(len(texts[0][1::2]))]
    model.mean, model.scale = x.mean(0), x.std(0) + 1e-9
    model.weights = _logistic(_terms((x - model.mean) / model.scale), y)
    model.weights[0] += np.log(rate / (1 - rate)) - np.log(y.mean() / (1 - y.mean()))  # classes were sampled evenly
    del texts
    give_back()
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, predicted) of docs(doc_id, text); predicted is 1 from THRESHOLD on.

    Null texts count as empty, which has a score like any text; rows without doc_id are left out; repeated rows stay.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score([(t or "").encode() for t in b.column(1).to_pylist()]), pa.float64())], ["doc_id", "score"])

    scored = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double")
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_good(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs, all columns, whose text the model does not reject; nulls count as empty, no row is shuffled.

    Only texts go to the workers and only verdicts come back: whole rows would be held in batches on both sides, both ways.
    """

    @F.arrow_udf("boolean")
    def good(text: pa.Array) -> pa.Array:
        parts = (text.slice(at, 512).to_pylist() for at in range(0, len(text), 512))
        return pa.array(np.concatenate([np.zeros(0), *(model.score([(t or "").encode() for t in p]) for p in parts)]) >= THRESHOLD, pa.bool_())

    return docs.where(good(F.col("text").cast("string")))
