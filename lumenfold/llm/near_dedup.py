"""Near-duplicate documents: banded MinHash, odd sketches, exact confirmation.

Each document's distinct word shingles give MinHash samples. Bands of samples
name candidate pairs. Each sample also flips one bit of a small bitmap, the odd
sketch; the number of bits in which two sketches differ estimates high
similarities closely, so that only likely pairs are confirmed on their full sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ASCII_LOWER, Carried, Scratch, connected_components, join_counted, link_buckets, mix, only_ids, prepare, tidy

#: 24 bands of 4: a pair at similarity 0.8 shares no band with probability (1 - 0.8**4)**24 = 3e-6.
BANDS, ROWS = 24, 4
#: Bits of an odd sketch, as 64-bit words.
SKETCH_WORDS = 8
#: 64-bit words of a fine sketch, and how many of a set's shingles at most go into it on average.
FINE_WORDS, FINE_SAMPLES = 16, 1024
#: Standard deviations below the threshold at which a sketch still leads to confirmation (miss: below 1e-6).
MARGIN = 5.0

_U = np.uint64


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    MOST = 150_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.MOST:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(text: str | None, size: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles of ``size`` words.

    Words are runs of anything but ASCII white space, A-Z lower-cased. Fewer
    words than ``size`` are one shingle; no words are none.
    """
    words = text.encode("utf-8", "surrogatepass").translate(ASCII_LOWER).split() if text else []
    if not words:
        return np.empty(0, _U)
    w = np.fromiter(map(hashes.__getitem__, words), _U, len(words))
    n = max(1, len(w) - size + 1)
    out = np.full(n, min(size, len(w)), _U)
    for k in range(min(size, len(w))):
        out = mix(out ^ w[k : k + n]) + _U(k)
    return np.unique(out)


class Sketcher:
    def __init__(self, bands: int, rows: int, sketch_words: int):
        self.bands, self.rows, self.words = bands, rows, sketch_words
        k = bands * rows
        seeds = mix(np.arange(1, 2 * k + 1, dtype=_U) * _U(0x9E3779B97F4A7C15))
        self.a, self.b = seeds[:k, None] | _U(1), seeds[k:, None]

    def minima(self, s: np.ndarray) -> np.ndarray:
        """The smallest value of each of the bands * rows hash functions over the set."""
        low = np.full(len(self.a), np.iinfo(_U).max, _U)
        for i in range(0, len(s), 4096):
            np.minimum(low, (self.a * s[None, i : i + 4096] + self.b).min(axis=1), out=low)
        return low

    def keys_and_sketches(self, minima: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For rows of minima: band keys (n, bands), odd sketches (n, words), both int64."""
        n = len(minima)
        key = np.broadcast_to(np.arange(self.bands, dtype=_U), (n, self.bands)).copy()
        parts = minima.reshape(n, self.bands, self.rows)
        for r in range(self.rows):
            key = mix(key ^ parts[:, :, r]) + _U(r)
        bits = 64 * self.words
        at = (mix(minima ^ mix(np.arange(minima.shape[1], dtype=_U))) % _U(bits)).astype(np.int64)
        flips = np.bincount((at + np.arange(n)[:, None] * bits).ravel(), minlength=n * bits) & 1
        odd = np.packbits(flips.astype(np.uint8)).view(np.int64).reshape(n, self.words)
        return key.view(np.int64), odd


def most_differing_bits(similarity: float, bands: int, rows: int, sketch_words: int, margin: float = MARGIN) -> int:
    """The largest XOR population count at which a pair may still reach ``similarity``.

    k samples of sets of similarity J differ in about k(1-J) places, 2k(1-J)
    flips; m flips leave an odd count in n/2 (1 - exp(-2m/n)) of n bits. The
    margin covers both the sampling of J and the folding.
    """
    k, n = bands * rows, 64 * sketch_words
    m = 2 * k * (1 - similarity) + margin * 2 * math.sqrt(k * similarity * (1 - similarity))
    x = n / 2 * (1 - math.exp(-2 * m / n))
    return math.ceil(x + margin / 2 * math.sqrt(n / 4 * (1 - math.exp(-4 * m / n)) * min(1, m / n)))


def fine_level(n: int) -> int:
    """Of a set of n shingles, those whose hash lies below 2**(64 - level) are sampled: all of a small set."""
    return max(0, (n - 1).bit_length() - FINE_SAMPLES.bit_length() + 1)


def fine_sketch(s: np.ndarray, level: int) -> np.ndarray:
    """Odd sketch of the smallest hashes of a set, those below a threshold that depends on its size only.

    Hash values are their own MinHash samples: of two sets sampled at one level,
    each sample that only one set has flips one bit.
    """
    bits = 64 * FINE_WORDS
    h = mix(s ^ _U(0xA0761D6478BD642F))
    h = h[h <= (_U(0xFFFFFFFFFFFFFFFF) >> _U(level))]
    flips = np.bincount((h % _U(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(flips.astype(np.uint8)).view(np.int64)


def _signature_batches(batches: Iterator[pa.RecordBatch], size: int, sketcher: tuple) -> Iterator[pa.RecordBatch]:
    hashes, sk = WordHashes(), Sketcher(*sketcher)
    for batch in batches:
        n, minima, signs, fine = [], [], [], []
        for text in batch.column("text"):
            s = shingles(text.as_py(), size, hashes)
            n.append(len(s))
            minima.append(sk.minima(s))
            fine.append(fine_sketch(s, fine_level(len(s))))
            d = xxhash.xxh3_128_digest(s.tobytes())
            signs.append((int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)))
        key, odd = sk.keys_and_sketches(np.array(minima, _U).reshape(len(n), sk.bands * sk.rows))
        fine = np.array(fine, np.int64).reshape(len(n), FINE_WORDS)
        lists = pa.FixedSizeListArray.from_arrays(pa.array(key.ravel()), sk.bands).cast(pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array([x for x, _ in signs], pa.int64()), pa.array([x for _, x in signs], pa.int64()), pa.array([fine_level(k) for k in n], pa.int32()), lists, *(pa.array(odd[:, i]) for i in range(sk.words)), *(pa.array(fine[:, i]) for i in range(FINE_WORDS))],
            names=["doc_id", "n_shingles", "sig1", "sig2", "level", "bands", *(f"s{i}" for i in range(sk.words)), *(f"f{i}" for i in range(FINE_WORDS))],
        )


def _set_batches(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for batch in batches:
        for lo in range(0, batch.num_rows, 100):
            part = batch.slice(lo, 100)
            sets = [shingles(t.as_py(), size, hashes) for t in part.column("text")]
            ends = np.cumsum([0, *map(len, sets)])
            flat = pa.array(np.concatenate(sets).view(np.int64) if sets else [], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), flat).cast(pa.list_(pa.int64()))], names=["id", "shingles"]
            )


def near_duplicates(
    docs: DataFrame, size: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS, sketch_words: int = SKETCH_WORDS
) -> DataFrame:
    """Components of documents whose shingle sets have a Jaccard similarity of at least percent/100.

    docs: doc_id (integer), text; other columns are ignored. Returns a row for each row of
    docs: doc_id, n_shingles, component_id (smallest doc_id reachable), kept
    (doc_id = component_id).

    Null, empty and blank texts have no shingles and are linked with nothing. A
    document with a null doc_id is linked with nothing, its component is null and
    it is kept. Rows that repeat a doc_id with the same text give equal rows; a
    doc_id with several texts stands for all of them. Documents of one shingle set
    are one node, whatever their number, so that copies make no pairs.

    Two similar documents are missed only if no band holds both (3e-6 at the
    threshold, less above) or both sketches mislead by over 5 standard deviations.
    Links are confirmed on the full sets of 64-bit shingle hashes.
    """
    spark = docs.sparkSession
    prepare(spark)
    scratch = Scratch(spark, "near_dedup")
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    words, fine = [f"s{i}" for i in range(sketch_words)], [f"f{i}" for i in range(FINE_WORDS)]
    schema = f"doc_id bigint, n_shingles bigint, sig1 bigint, sig2 bigint, level int, bands array<bigint>, {', '.join(f'{w} bigint' for w in words + fine)}"
    sketcher = (bands, rows, sketch_words)
    signs = scratch.save(docs.mapInArrow(lambda b: tidy(_signature_batches(b, size, sketcher)), schema), "signatures")
    same = (
        signs.where("n_shingles > 0 and doc_id is not null").groupBy("sig1", "sig2").agg(F.min("doc_id").alias("node"), F.count("*").alias("n"))
    )
    same = scratch.save(same, "classes")
    nodes = scratch.save(
        signs.join(same, (signs.doc_id == same.node) & (signs.sig1 == same.sig1) & (signs.sig2 == same.sig2), "left_semi")
        .dropDuplicates(["doc_id", "sig1", "sig2"]).drop("sig1", "sig2").withColumnRenamed("doc_id", "id"),
        "nodes",
    )
    keys = nodes.select("id", F.explode("bands").alias("key"))
    far = most_differing_bits(percent / 100, bands, rows, sketch_words)

    def differing(x: Carried, y: Carried, names: list[str]) -> Column:
        return sum((F.bit_count(x(w).bitwiseXOR(y(w))) for w in names), F.lit(0))

    def fits(x: Carried, y: Carried) -> Column:
        """Set sizes and both sketches allow the similarity.

        At most (1-J)/(1+J) of the sizes' sum are shingles of one set only. Where the
        whole sets are sampled, the fine sketches cannot differ in more bits than that.
        """
        sizes_fit = 100 * F.least(x("n_shingles"), y("n_shingles")) >= percent * F.greatest(x("n_shingles"), y("n_shingles"))
        apart = (x("n_shingles") + y("n_shingles")) * (100 - percent) / (100 + percent)
        most = F.when(x("level") == 0, apart).otherwise(apart / F.pow(F.lit(2.0), x("level")) + MARGIN * F.sqrt(apart / F.pow(F.lit(2.0), x("level"))))
        return sizes_fit & ((x("level") != y("level")) | (differing(x, y, fine) <= most)) & (differing(x, y, words) <= far)

    def confirmed(pairs: DataFrame) -> DataFrame:
        pairs = scratch.save(pairs.select("a", "b").distinct(), "candidates")
        ids = scratch.save(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "ids")
        sets = only_ids(docs, ids, "doc_id").mapInArrow(lambda b: tidy(_set_batches(b, size)), "id bigint, shingles array<bigint>")
        both = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa")), "a").join(
            sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb")), "b"
        )
        common = F.size(F.array_intersect("sa", "sb")).cast("bigint")
        return both.where(100 * common >= percent * (F.size("sa") + F.size("sb") - common)).select("a", "b").distinct()

    carried = nodes.select("id", "n_shingles", "level", *words, *fine)
    edges = link_buckets(scratch, keys, confirmed, carried, fits, lambda x, y: differing(x, y, fine))
    comp = scratch.save(connected_components(scratch, edges), "components").withColumnRenamed("id", "node")
    named = scratch.save(same.join(comp, "node", "left").select("sig1", "sig2", "n", F.coalesce("component", "node").alias("component_id")), "named")
    linked = signs.where("n_shingles > 0 and doc_id is not null").select("doc_id", "n_shingles", "sig1", "sig2")
    linked = join_counted(linked, named, ["sig1", "sig2"], linked.count()).select("doc_id", "n_shingles", "component_id")
    alone = signs.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_duplicates(docs: DataFrame, **how) -> DataFrame:
    """docs without the documents that are not the first of their component; columns as in docs."""
    gone = near_duplicates(docs, **how).where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
