"""Language identification with string kernels.

The blended-spectrum presence kernel of two texts counts the byte n-grams
(1 to 4) that occur in both, normalised by how many each has. Texts are compared
with a fixed number of landmark texts (Nystroem), and one-versus-rest kernel
ridge regression on those features scores each language. Scoring is two dense
matrix products for a batch of texts.

Texts are read whole, in segments of about equal length, so that the presence
kernel compares like with like; a text's score is the mean of its segments'.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded, fresh, prepare, tidy

UNDETERMINED = "und"
#: Buckets of hashed n-grams; the hash gives each order n its own share.
BUCKETS = 8192
ORDERS = 4
SEGMENT = 1500
LANDMARKS = 192
#: Training rows taken to the driver at most, the same number for each language (one at least).
TRAIN_ROWS = 1600
RIDGE = 1e-3
#: Divides margins before the softmax that turns them into a score.
TEMPERATURE = 0.25
#: A text whose best language stands out from the others by less than this share of what the training's targets do
#: (1 for a text's language, -1 for the others) is in none of them.
LEAST_MARGIN = 0.18

_LETTER = re.compile(r"[^\W\d_]")
#: ASCII letters in lower case and non-ASCII bytes stay; other bytes are a space.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def has_letter(text: str | None) -> bool:
    return bool(text) and any(m[0].isalpha() for m in _LETTER.finditer(text))  # the pattern also finds signs like ²


def segments(text: str) -> list[bytes]:
    """The whole text's words in pieces of at most about SEGMENT bytes, equal in length."""
    raw = b" ".join(text.lower().encode("utf-8", "surrogatepass").translate(_LETTERS).split())
    n = -(-len(raw) // SEGMENT) or 1
    step = -(-len(raw) // n) or 1
    return [b" " + raw[i : i + step] + b" " for i in range(0, max(1, len(raw)), step)]


def presence(parts: list[bytes]) -> np.ndarray:
    """(parts, BUCKETS) float32: unit vectors of the n-grams present in each part."""
    out = np.zeros((len(parts), BUCKETS), np.float32)
    share = BUCKETS // ORDERS
    flat = np.frombuffer(b"".join(parts), np.uint8).astype(np.uint32)
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    row = np.repeat(np.arange(len(parts), dtype=np.int64) * BUCKETS, sizes)
    last = np.repeat(np.cumsum(sizes), sizes)
    at = np.arange(len(flat))
    gram = np.zeros(len(flat), np.uint32)
    cells = out.ravel()
    for n in range(ORDERS):
        m = len(flat) - n
        if m <= 0:
            break
        gram = (gram[:m] << np.uint32(8)) | flat[n:]
        h = gram * np.uint32(0x9E3779B1)
        h = (h ^ (h >> np.uint32(15))) % np.uint32(share)
        inside = at[:m] + n < last[:m]
        cells[(row[:m] + h + n * share)[inside]] = 1.0
    out /= np.sqrt(out.sum(axis=1, keepdims=True) + 1e-9)
    return out


class Model:
    """Landmark vectors and, for each language, the weights of the kernel values."""

    def __init__(self, languages: list[str], landmarks: np.ndarray, weights: np.ndarray):
        self.languages, self.landmarks, self.weights = languages, landmarks, weights

    def margins(self, x: np.ndarray) -> np.ndarray:
        return x @ self.landmarks.T @ self.weights[:-1] + self.weights[-1]

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, float]]:
        """The best language of each text, its share of the softmax over languages, and how far it stands out: 0 as
        little as a text with nothing to tell (the targets' mean), 1 as the targets do. Of one language nothing stands out, it has 1."""
        parts, owner = [], []
        out: list[tuple[str, float, float]] = [(UNDETERMINED, 0.0, 0.0)] * len(texts)
        total = np.zeros((len(texts), len(self.languages)))
        weight = np.zeros(len(texts))

        def flush() -> None:
            m = self.margins(presence(parts))
            size = np.fromiter(map(len, parts), np.float64, len(parts))
            np.add.at(total, owner, m * size[:, None])
            np.add.at(weight, owner, size)
            parts.clear()
            owner.clear()

        for k, text in enumerate(texts):
            if self.languages and has_letter(text):
                for s in segments(text):
                    parts.append(s)
                    owner.append(k)
                    if len(parts) == 256:
                        flush()
        if parts:
            flush()
        level = 2 / max(1, len(self.languages)) - 1
        for k in np.flatnonzero(weight).tolist():
            mean = total[k] / weight[k]
            z = mean / TEMPERATURE
            p = np.exp(z - z.max())
            best = int(p.argmax())
            out[k] = (self.languages[best], float(p[best] / p.sum()), float((mean[best] - level) / (1 - level)) if level < 1 else 1.0)
        return out


def fit(rows: list[tuple[str, str]]) -> Model:
    """rows: (text, language); all segments of every text are learned from. Without rows the model knows no language."""
    known = sorted({lang for text, lang in rows if has_letter(text)})
    parts, y = [], []
    for text, lang in rows:
        if has_letter(text):
            own = segments(text)
            parts += own
            y += [known.index(lang)] * len(own)
    if not parts:
        return Model([], np.zeros((0, BUCKETS), np.float32), np.zeros((1, 0), np.float32))
    y = np.array(y)
    rank = np.empty(len(y), np.int64)
    for k in range(len(known)):
        at = np.flatnonzero(y == k)
        rank[at] = np.arange(len(at))
    chosen = np.argsort(rank * len(known) + y, kind="stable")[: max(LANDMARKS, len(known))]
    landmarks = presence([parts[i] for i in chosen])
    k = np.concatenate([presence(parts[i : i + 512]) @ landmarks.T for i in range(0, len(parts), 512)])
    return Model(known, landmarks, ridge(k, landmarks @ landmarks.T, y, len(known)).astype(np.float32))


def ridge(k: np.ndarray, inner: np.ndarray, y: np.ndarray, n: int) -> np.ndarray:
    """(landmarks + 1, n) weights of one-versus-rest kernel ridge regression, the last row the bias.

    k: kernel values of each row with each landmark; inner: of landmarks among themselves; y: classes.
    Rows weigh so that each class has the same sum. The bias is the targets' mean, so that a text
    that shares nothing with any landmark stands out in no class.
    """
    level = 2 / n - 1
    target = np.where(y[:, None] == np.arange(n), 1.0, -1.0) - level
    balance = 1.0 / np.bincount(y, minlength=n)[y][:, None]
    k = k.astype(np.float64)
    weights = np.linalg.solve(k.T @ (k * balance) + RIDGE * (inner + 1e-6 * np.eye(len(inner))), k.T @ (target * balance))
    return np.vstack([weights, np.full((1, n), level)])


def learn(docs: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """A model from text and non-null lang of docs: per language at most rows / languages, one at least, chosen by a hash.

    All languages are learned; they are counted in one pass, and a second one takes the
    chosen rows, which come to the driver. Equal rows count once. Texts without a letter or without a doc_id are not
    learned from (nor is a language that has no others); long ones come as bounded() has them.
    """
    usable = docs.where(F.col("text").rlike(r"\p{L}") & F.col("lang").isNotNull() & F.col("doc_id").isNotNull())
    known = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count("*").alias("n")).toLocalIterator()}
    if not known:
        return fit([])
    share = max(1, rows // len(known))
    spark = docs.sparkSession
    most = spark.createDataFrame([(lang, min(1.0, (share + 5 * share**0.5 + 25) / n)) for lang, n in known.items()], "lang string, __share double")
    h = F.xxhash64("doc_id", "text", F.lit(3))
    some = usable.select("doc_id", "text", "lang", h.alias("__h")).join(F.broadcast(most), "lang")
    some = some.where(F.pmod("__h", F.lit(1 << 31)) < F.col("__share") * (1 << 31)).withColumn("text", bounded(F.col("text"))).groupBy("lang", "__h", "doc_id").agg(F.min("text").alias("text"))
    some = some.withColumn("__k", F.row_number().over(Window.partitionBy("lang").orderBy("__h", "doc_id"))).where(F.col("__k") <= share)
    got = sorted((r["lang"], r["__k"], r["text"]) for r in some.select("lang", "__k", "text").toLocalIterator())
    return fit([(text, lang) for lang, _, text in got])


def predict(docs: DataFrame, model: Model, lang: str = "lang_pred", score: str = "lang_score", margin: str | None = None) -> DataFrame:
    """docs with the predicted language and its score (0 to 1) added under those names, and its margin where a name is given.

    Null texts and texts without a letter are ``und`` with score and margin 0, and so is all
    where nothing was learned. Columns of docs that have these names are replaced.
    """
    prepare(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    added = [lang, score, *([margin] if margin else [])]
    kept = [c for c in docs.columns if c not in added]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = sent.value.predict(batch.column("text").to_pylist())
            columns = [pa.array([x[0] for x in got], pa.string()), *(pa.array([x[i] for x in got], pa.float64()) for i in range(1, len(added)))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *columns], names=[*kept, *added])

    kinds = [T.StringType(), *[T.DoubleType()] * (len(added) - 1)]
    schema = T.StructType([*docs.select(*kept).schema.fields, *(T.StructField(n, t) for n, t in zip(added, kinds, strict=True))])
    return docs.select(*kept).mapInArrow(lambda batches: tidy(run(batches)), schema)


def reject_unknown(docs: DataFrame, model: Model, least: float = LEAST_MARGIN) -> DataFrame:
    """docs that are in one of the model's languages: their best margin is at least ``least``; columns as in docs.

    The margin does not depend on the number of languages. Texts without a letter go.
    Where nothing was learned no document is judged, and all stay.
    """
    if not model.languages:
        return docs
    names = [fresh(docs.columns, c) for c in ("lang", "score", "margin")]
    named = predict(docs, model, *names)
    return named.where((F.col(names[0]) != UNDETERMINED) & (F.col(names[2]) >= least)).select(*docs.columns)
