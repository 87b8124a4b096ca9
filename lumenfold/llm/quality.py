"""Document quality: random-indexing word vectors and a small neural network.

Every word has a sparse random index vector; a word's vector is the sum of the
index vectors of the words around it in all documents. A document's words
and its runs of signs are pooled to means, shares of letter shapes are added, and
a network with one hidden layer scores the result. Its logits are divided by a
temperature that is fitted on training rows that the network has not seen.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ASCII_WORDS, labelled_sample, mix, prepare, tidy

#: Rows of the table of word vectors: words share a row where their hashes do. It is broadcast (8 MB).
ROWS, DIM, NONZERO = 1 << 15, 64, 6
WINDOW = 2
HIDDEN = 32
#: Words whose contexts are added up at a time, and tasks at least that do so: each makes up to ROWS rows.
CHUNK, TASKS = 1 << 18, 64
#: Labelled rows that are taken to the driver at most, half of them of each class where there are as many, weighted to the true shares.
TRAIN_ROWS = 3000
EPOCHS = 60

#: ASCII signs stay; letters, digits, white space, control and non-ASCII bytes are a space.
_SIGNS = bytes(b if 33 <= b <= 126 and not chr(b).isalnum() else 32 for b in range(256))
#: Bytes by kind: upper case, lower case, digit, sign, space, non-ASCII.
_KIND = np.array([5 if b >= 128 else 0 if 65 <= b <= 90 else 1 if 97 <= b <= 122 else 2 if 48 <= b <= 57 else 3 if 33 <= b <= 126 else 4 for b in range(256)])
KINDS = 6


class _Rows(dict):
    """The row of each word, remembered up to a bound."""

    MOST = 500_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.MOST:
            self.clear()
        r = self[word] = xxhash.xxh3_64_intdigest(word, 5) % ROWS
        return r


def tokens(text: str | None) -> tuple[list[bytes], list[bytes], bytes]:
    """A text's words (A-Z lower-cased), its runs of signs and its bytes."""
    raw = text.encode("utf-8", "surrogatepass") if text else b""
    return raw.translate(ASCII_WORDS).split(), raw.translate(_SIGNS).split(), raw


def _index_places() -> tuple[np.ndarray, np.ndarray]:
    """(ROWS, NONZERO) columns and signs of the sparse ternary index vectors, by hashing."""
    row = mix(np.arange(ROWS, dtype=np.uint64) + np.uint64(1))
    h = np.stack([mix(row + np.uint64(k)) for k in range(NONZERO)], axis=1)
    return (h % np.uint64(DIM)).astype(np.int64), np.where(h >> np.uint64(63), 1, -1)


def index_vectors() -> np.ndarray:
    """Sparse ternary vectors, a few +1 and -1 in each row."""
    out = np.zeros((ROWS, DIM), np.int64)
    columns, signs = _index_places()
    for k in range(NONZERO):
        np.add.at(out, (np.arange(ROWS), columns[:, k]), signs[:, k])
    return out


def context_sums(texts: Iterable[str]) -> np.ndarray:
    """(ROWS, DIM) sums of the index vectors of the words around each row's words, as whole numbers."""
    columns, signs = _index_places()
    rows, total = _Rows(), np.zeros(ROWS * DIM, np.int64)
    ids: list[int] = []
    lengths: list[int] = []

    def add() -> None:
        at, owner = np.array(ids, np.int64), np.repeat(np.arange(len(lengths)), lengths)
        for gap in range(1, WINDOW + 1):
            same = owner[gap:] == owner[:-gap]
            left, right = at[:-gap][same], at[gap:][same]
            word, other = np.concatenate((left, right)) * DIM, np.concatenate((right, left))
            for k in range(NONZERO):
                np.add.at(total, word + columns[other, k], signs[other, k])
        ids.clear()
        lengths.clear()

    for text in texts:
        for items in tokens(text)[:2]:
            ids.extend(map(rows.__getitem__, items))
            lengths.append(len(items))
        if len(ids) >= CHUNK:
            add()
    add()
    return total.reshape(ROWS, DIM)


def unit_vectors(context: np.ndarray) -> np.ndarray:
    """Unit vectors of context for each row; rows without context keep their index vector."""
    out = (context + index_vectors()).astype(np.float64)
    return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-6)).astype(np.float32)


def word_vectors(docs: DataFrame) -> np.ndarray:
    """unit_vectors() of the context sums over the texts of all docs.

    Each task adds up its own documents and gives the rows that it met; the sums by row are
    whole numbers, so their order does not matter. ROWS x DIM numbers come to the driver.
    """
    prepare(docs.sparkSession)
    names = [f"v{i}" for i in range(DIM)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = context_sums(t.as_py() for batch in batches for t in batch.column("text"))
        met = np.flatnonzero(sums.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(met), *(pa.array(np.ascontiguousarray(sums[met, i])) for i in range(DIM))], names=["row", *names])

    schema = ", ".join(["row bigint", *(f"{n} bigint" for n in names)])
    texts = docs.select("text").where("text is not null").coalesce(max(TASKS, 2 * docs.sparkSession.sparkContext.defaultParallelism))
    got = texts.mapInArrow(lambda b: tidy(run(b)), schema).groupBy("row").agg(*(F.sum(n).alias(n) for n in names)).toArrow()
    context = np.zeros((ROWS, DIM), np.int64)
    if got.num_rows:
        context[got["row"].to_numpy()] = np.stack([got[n].to_numpy() for n in names], axis=1)
    return unit_vectors(context)


def pooled(texts: list[str | None], vectors: np.ndarray, rows: _Rows) -> np.ndarray:
    """(texts, 2 * DIM + KINDS + 4): means of word and sign vectors, shares of byte kinds, length, signs, variety and repeats."""
    out = np.zeros((len(texts), 2 * DIM + KINDS + 4), np.float32)
    for k, text in enumerate(texts):
        words, signs, raw = tokens(text)
        distinct = again = 0
        for at, items in ((0, words), (DIM, signs)):
            if items:
                ids = np.fromiter(map(rows.__getitem__, items), np.int64, len(items))
                which, many = np.unique(ids, return_counts=True)
                if not at:
                    distinct, again = len(which), int((ids[1:] == ids[:-1]).sum())
                out[k, at : at + DIM] = many.astype(np.float32) @ vectors[which] / len(items)
        if raw:
            by_byte = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
            out[k, 2 * DIM : 2 * DIM + KINDS] = np.bincount(_KIND, by_byte, KINDS) / len(raw)
        out[k, -4:] = np.log1p(len(words)) / 10, len(signs) / (1 + len(words)), distinct / (1 + len(words)), again / (1 + len(words))
    return out


class Model:
    def __init__(self, vectors: np.ndarray, scale: tuple[np.ndarray, np.ndarray], layers: list[np.ndarray], temperature: float):
        self.vectors, self.scale, self.layers, self.temperature = vectors, scale, layers, temperature

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return np.maximum((x - self.scale[0]) / self.scale[1] @ w1 + b1, 0) @ w2 + b2

    def score(self, texts: list[str | None], rows: _Rows) -> np.ndarray:
        z = self.logits(pooled(texts, self.vectors, rows)).astype(np.float64) / self.temperature
        return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def best_temperature(z: np.ndarray, yes: np.ndarray, weight: np.ndarray) -> float:
    """Of a grid, the number that logits are best divided by: the least weighted log loss."""
    loss = {s: float(np.average(np.logaddexp(0, -np.where(yes, z, -z) / s), weights=weight)) for s in np.geomspace(0.5, 8, 41)}
    return float(min(loss, key=loss.get))


def fit(texts: list[str], y: list[int], vectors: np.ndarray, weight: list[float] | None = None) -> Model:
    """The network (Adam on the log loss) over given word vectors, and its temperature; weight: of each text's loss, 1 if not given."""
    rng = np.random.default_rng(5)
    own = np.ones(len(y)) if weight is None else np.array(weight, np.float64)
    x = np.concatenate([pooled(texts, vectors, _Rows()), np.zeros((0, 2 * DIM + KINDS + 4), np.float32)])
    target = np.array(y, np.float64)
    order = rng.permutation(len(y))
    held, used = order[: len(y) // 5], order[len(y) // 5 :]
    mean, std = (x[used].mean(axis=0), x[used].std(axis=0) + 1e-3) if len(used) else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
    share = min(max(float(np.average(target, weights=own)) if len(y) else 0.5, 1e-3), 1 - 1e-3)
    w = [rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN) * 0.1 * bool(len(used)), np.log(share / (1 - share))]
    m, v, t = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w], 0
    for _ in range(EPOCHS if len(used) else 0):
        for part in np.array_split(rng.permutation(used), -(-len(used) // 64)):
            a = (x[part] - mean) / std
            h = np.maximum(a @ w[0] + w[1], 0)
            g = (1 / (1 + np.exp(-np.clip(h @ w[2] + w[3], -35, 35))) - target[part]) * own[part] / len(part)
            back = np.outer(g, w[2]) * (h > 0)
            t += 1
            for i, d in enumerate((a.T @ back + 1e-4 * w[0], back.sum(axis=0), h.T @ g + 1e-4 * w[2], g.sum())):
                m[i], v[i] = 0.9 * m[i] + 0.1 * d, 0.999 * v[i] + 0.001 * d * d
                w[i] = w[i] - 3e-3 * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    model = Model(vectors, (mean, std), w, 1.0)
    if len(held):
        model.temperature = best_temperature(model.logits(x[held]), target[held] > 0, own[held])
    return model


def learn(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, label: str = "label") -> Model:
    """A model from at most ``rows`` of docs' texts and their label in labels (0 or 1; others are ignored).

    The word vectors are gathered from all docs, which needs no labels.

    See labelled_sample(). Without labelled rows every score is 0.5.
    """
    got = labelled_sample(docs, labels, rows, label)
    return fit([t for t, _, _ in got], [y for _, y, _ in got], word_vectors(docs), [w for _, _, w in got])


def score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """docs with a score from 0 to 1 added (a column of that name is replaced).

    Every text is read whole; null and empty texts are scored as texts without words.
    """
    prepare(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c != name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = _Rows()
        for batch in batches:
            got = sent.value.score(batch.column("text").to_pylist(), rows)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(got, pa.float64())], names=[*kept, name])

    docs = docs.select(*kept)
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))
