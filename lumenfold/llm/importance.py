"""Importance resampling towards a target distribution, over hashed word n-grams.

Bags of hashed n-grams of all documents and of a target corpus give each bucket a gain in
thousandths of a nat; a document weighs the mean gain of its features. Gumbel noise from
a hash of its id makes the highest scores a draw without replacement by weight. Scores
are whole numbers, so ranks need no sort of all rows: a histogram's suffix sums tell
where each score's ranks begin and at which score the draw ends, and only rows within
one surviving score are put in order.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ASCII_WORDS, Scratch, fresh, prepare, tidy

#: Bytes of a text whose words are held at once.
PIECE = 1 << 20

#: What weigh() tells of a document.
WEIGHED = T.StructType([T.StructField(c, T.LongType()) for c in ("n_words", "n_features", "weight", "score")])


@dataclass(frozen=True)
class Gains:
    """Whole gains by bucket, and the longest run of words that is a feature."""

    by_bucket: np.ndarray
    size: int


def pieces(data: bytes, most: int = PIECE) -> Iterator[list[bytes]]:
    """The words of a text, about ``most`` bytes at a time; no word is cut."""
    if len(data) <= most:
        yield data.translate(ASCII_WORDS).split()
        return
    data, at = data.translate(ASCII_WORDS), 0
    while at < len(data):
        end = data.find(b" ", at + most)
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


def features(data: bytes, size: int, buckets: int, most: int = PIECE) -> Iterator[tuple[int, np.ndarray]]:
    """(words, buckets of the features) of each piece of a text: all runs of 1 to ``size`` words, joined by one space.

    A run's crc32 goes on from that of the run without its last word. The last size - 1 words of a
    piece are read again with the next one, for the runs that end there.
    """
    before: list[bytes] = []
    for words in pieces(data, most):
        all_ = before + words
        spaced = [b" " + w for w in all_]
        runs, found = [crc32(w) for w in all_], []
        for n in range(1, size + 1):
            if n > 1:
                runs = list(map(crc32, spaced[n - 1 :], runs))
            found += runs[max(0, len(before) - n + 1) :]
        yield len(words), np.array(found, np.int64) % buckets
        before = all_[len(all_) - size + 1 :] if size > 1 and len(all_) >= size else all_ if size > 1 else []


def _counter(size: int, buckets: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for text in batch.column(0):
                for _, found in features(text.as_py() or b"", size, buckets):
                    total += np.bincount(found, minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    return lambda batches: tidy(count(batches))


def bucket_counts(texts: DataFrame, size: int = 2, buckets: int = 10_000, text: str = "text") -> np.ndarray:
    """How many features of all texts fall into each bucket. Each task sums up its own; ``buckets`` numbers reach the driver."""
    prepare(texts.sparkSession)
    got = texts.select(F.col(text).cast("binary").alias("text")).mapInArrow(_counter(size, buckets), "bucket long, n long")
    out = np.zeros(buckets, np.int64)
    for r in got.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gain_of(raw: np.ndarray, target: np.ndarray, size: int = 2) -> Gains:
    """floor(1000 ln(target share / raw share)) by bucket, both smoothed by one."""
    k, s_all, t_all = len(raw), float(raw.sum()), float(target.sum())
    by = [math.floor(1000 * math.log((t + 1.0) * (s_all + k) / ((s + 1.0) * (t_all + k)))) for s, t in zip(raw.tolist(), target.tolist(), strict=True)]
    return Gains(np.array(by, np.int64), size)


def learn(docs: DataFrame, target: DataFrame, size: int = 2, buckets: int = 10_000) -> Gains:
    """The gains of target's texts over docs' texts; both have a column text (null: no words)."""
    return gain_of(bucket_counts(docs, size, buckets), bucket_counts(target, size, buckets), size)


def noise(doc_id: str, seed: int = 7) -> int:
    """Gumbel noise in thousandths, from the id alone: reruns and lost executors draw the same."""
    h = int(hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weigh(docs: DataFrame, gains: Gains, keep: list[str] | None = None, name: str = "importance", seed: int = 7) -> DataFrame:
    """The columns ``keep`` of docs (all, if None) and a struct ``name`` of n_words, n_features, weight and score.

    docs has doc_id (any type; null counts as an empty id) and text (null: no words, weight 0). A
    column called ``name`` is replaced. Repeated rows each get their row; nothing is shuffled.
    """
    prepare(docs.sparkSession)
    keep = [c for c in (docs.columns if keep is None else keep) if c != name]
    by, size, buckets = gains.by_bucket, gains.size, len(gains.by_bucket)

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                n_words = n = total = 0
                for words, found in features(text.as_py() or b"", size, buckets):
                    n_words, n, total = n_words + words, n + len(found), total + int(by[found].sum())
                weight = total // n if n else 0
                rows.append({"n_words": n_words, "n_features": n, "weight": weight, "score": weight + noise(doc, seed)})
            told = pa.array(rows, pa.struct([(f.name, pa.int64()) for f in WEIGHED]))
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], told], [*keep, name])

    doc_id, text = fresh([*docs.columns, name], "id"), fresh([*docs.columns, name], "bytes")
    given = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias(doc_id), F.col("text").cast("binary").alias(text), *keep)
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField(name, WEIGHED)])
    return given.mapInArrow(lambda batches: tidy(score(batches)), schema)


def draw(scored: DataFrame, scratch: Scratch, percent: int = 25) -> DataFrame:
    """(row, rank) of the floor(percent * rows / 100) highest scores of scored (row, doc_id, score; row is unique), ties to smaller doc_id.

    Ranks count from 1; null ids come last among equal scores, rows of one id in any order. The driver
    holds one count for each score: scores are whole thousandths of a
    logarithm, some 10^5 of them at most. Surviving rows are dealt by ranges of (score, doc_id), so a
    score with very many rows has several parts, whose own counts say where their ranks begin.
    """
    take = {r.score: r.n for r in scored.groupBy("score").agg(F.count("*").alias("n")).collect()}
    left = percent * sum(take.values()) // 100
    wanted, cutoff, above = left, None, 0
    for score in sorted(take, reverse=True):
        if above >= wanted:
            break
        cutoff, above = score, above + take[score]
    if cutoff is None:
        return scored.select("row", F.lit(None).cast("bigint").alias("rank")).limit(0)
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("row")]
    ranged = scored.where(F.col("score") >= cutoff).select("row", "doc_id", "score").repartitionByRange(*order)
    dealt = scratch.save(ranged.withColumn("part", F.spark_partition_id()), "survivors")
    begins, total = [], 0
    counts = dealt.groupBy("score", "part").agg(F.count("*").alias("n")).collect()  # a row for each score and each partition at most
    for r in sorted(counts, key=lambda r: (-r.score, r.part)):
        begins.append((r.score, r.part, total))
        total += r.n
    begin = scored.sparkSession.createDataFrame(begins, "score long, part int, begin long")
    nth = F.row_number().over(Window.partitionBy("score", "part").orderBy(*order[1:]))
    ranks = dealt.withColumn("nth", nth).join(F.broadcast(begin), ["score", "part"])
    return ranks.select("row", (F.col("begin") + F.col("nth")).alias("rank")).where(F.col("rank") <= wanted)


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, size: int = 2, buckets: int = 10_000, seed: int = 7) -> DataFrame:
    """Every row of docs as (doc_id, n_features, weight, score, rank); rank is null for rows that are not drawn.

    Rows of fewer than ``least_words`` words are scored but take no part in the draw, nor in its size.
    An empty table gives no rows; an empty target leaves the gains that smoothing gives.
    """
    scratch = Scratch(docs.sparkSession, "importance")
    told = weigh(docs.select("doc_id", "text"), learn(docs, target, size, buckets), ["doc_id"], seed=seed)
    told = scratch.save(told.select("doc_id", "importance.*").withColumn("row", F.monotonically_increasing_id()), "weighed")
    ranks = draw(told.where(F.col("n_words") >= least_words), scratch, percent)
    return told.join(ranks, "row", "left").select("doc_id", "n_features", "weight", "score", "rank")
