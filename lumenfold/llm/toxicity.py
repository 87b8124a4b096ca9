"""Toxicity scores by FTRL-proximal logistic regression.

Features are hashed word unigrams, bigrams and skip-grams (one word left out),
present or absent. Training keeps a learning rate for every coordinate and an
L1 penalty that leaves most weights at zero, so the model that tasks receive is
a short list of weights.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import ASCII_WORDS, labelled_sample, mix, prepare

BITS = 20
#: Labelled rows that are taken to the driver at most, half of them of each class where there are as many, weighted to the true shares.
TRAIN_ROWS = 12_000
EPOCHS = 8
ALPHA, BETA, L1, L2 = 1.0, 1.0, 6.0, 0.3


class _Hashes(dict):
    MOST = 500_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.MOST:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word, 3)
        return h


def features(texts: list[str | None], hashes: _Hashes, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(text's place in the list, hashed feature) of every n-gram, repeats included."""
    lists = [t.encode("utf-8", "surrogatepass").translate(ASCII_WORDS).split() if t else [] for t in texts]
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    n = int(sizes.sum())
    h = np.fromiter((hashes[w] for ws in lists for w in ws), np.uint64, n)
    owner = np.repeat(np.arange(len(texts)), sizes)
    owners, grams = [owner], [h]
    for gap, salt in ((1, 0x51ED270B), (2, 0x2545F491)):
        if n > gap:
            same = owner[gap:] == owner[:-gap]
            owners.append(owner[gap:][same])
            grams.append(mix(h[:-gap] + np.uint64(salt))[same] ^ h[gap:][same])
    return np.concatenate(owners), (mix(np.concatenate(grams)) >> np.uint64(64 - bits)).astype(np.int64)


def distinct(owner: np.ndarray, feature: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    keys = np.unique((owner << bits) | feature)
    return keys >> bits, keys & ((1 << bits) - 1)


class Model:
    """The weights that are not zero, by hashed feature, and the bias."""

    def __init__(self, index: np.ndarray, weight: np.ndarray, bias: float, bits: int = BITS):
        self.index, self.weight, self.bias, self.bits = index, weight, bias, bits

    def dense(self) -> np.ndarray:
        out = np.zeros(1 << self.bits, np.float32)
        out[self.index] = self.weight
        return out

    def score(self, texts: list[str | None], dense: np.ndarray, hashes: _Hashes) -> np.ndarray:
        owner, feature = features(texts, hashes, self.bits)
        used = dense[feature] != 0
        owner, feature = distinct(owner[used], feature[used], self.bits)
        z = self.bias + np.bincount(owner, dense[feature].astype(np.float64), len(texts))
        return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def fit(texts: list[str], y: list[int], bits: int = BITS, epochs: int = EPOCHS, weight: list[float] | None = None) -> Model:
    """FTRL-proximal (McMahan et al. 2013) over the texts, several times in random orders; weight: of each text's loss, 1 if not given."""
    weight = [1.0] * len(y) if weight is None else weight
    size = 1 << bits
    z, n = np.zeros(size + 1), np.zeros(size + 1)
    hashes = _Hashes()
    rows: list[np.ndarray] = []
    for i in range(0, len(texts), 50):
        owner, feature = distinct(*features(texts[i : i + 50], hashes, bits), bits)
        cut = np.searchsorted(owner, np.arange(1, len(texts[i : i + 50])))
        rows += [np.append(f, size).astype(np.int32) for f in np.split(feature, cut)]

    def weights(at: np.ndarray) -> np.ndarray:
        l1 = np.where(at == size, 0.0, L1)
        over = np.abs(z[at]) - l1
        return np.where(over > 0, -np.sign(z[at]) * over / ((BETA + np.sqrt(n[at])) / ALPHA + L2), 0.0)

    order = np.random.default_rng(11)
    for _ in range(epochs):
        for k in order.permutation(len(rows)).tolist():
            at = rows[k]
            w = weights(at)
            g = weight[k] * (1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y[k])
            step = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - step * w
            n[at] += g * g
    w = weights(np.arange(size + 1))
    index = np.flatnonzero(w[:size])
    return Model(index.astype(np.int32), w[index].astype(np.float32), float(w[size]), bits)


def learn(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, label: str = "label") -> Model:
    """A model from at most ``rows`` of docs' texts and their label in labels (0 or 1; others are ignored).

    See labelled_sample(). Without labelled rows every score is 0.5.
    """
    got = labelled_sample(docs, labels, rows, label)
    return fit([t for t, _, _ in got], [y for _, y, _ in got], weight=[w for _, _, w in got])


def score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """docs with a score from 0 to 1 added (a column of that name is replaced).

    Every text is read whole; null and empty texts get the bias alone.
    """
    prepare(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c != name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense, hashes = sent.value.dense(), _Hashes()
        for batch in batches:
            for part in (batch.slice(i, 100) for i in range(0, batch.num_rows, 100)):
                got = sent.value.score(part.column("text").to_pylist(), dense, hashes)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(got, pa.float64())], names=[*kept, name])

    docs = docs.select(*kept)
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))
