"""Best-two-fit packing of documents into sequences of a fixed number of tokens.

A bin is filled greedily, always with the longest piece that still fits. Then
its smallest piece is replaced by two unpacked pieces if two of them fit the
gap that this opens more tightly.

Which pieces of one length go where makes no difference, so the packing is
decided on counts by length: at most ``capacity`` numbers, whatever the size of
the corpus. The greedy choice stays the same until a length runs out, so a bin's
contents are repeated as often as the counts allow, and the plan has a few
thousand kinds of bins. The corpus is then numbered within each length in
parallel, and each piece reads its place off the plan.
"""

from __future__ import annotations

import json
from bisect import bisect_right
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, prepare, tidy

CAPACITY = 2048
END_ID = 0
#: Pieces of one length are numbered in shares of about this many rows, so that a
#: length that many pieces have is numbered by many tasks.
SHARE_ROWS = 4000

#: Splits a text as byte-level BPE does before it merges: contractions, letters, numbers,
#: other signs (each with one leading space), white space. (Fixed value of the vocabulary.)
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Encoder:
    """Token ids of whole texts as little-endian 32-bit bytes.

    The vocabulary is a byte-level BPE file of the library ``tokenizers``. Where its ids
    are in the order of its merges, ``tiktoken`` merges by them, which gives the same ids
    in a third of the time. Texts that hold an added token's string, and files of another
    kind, go through ``tokenizers`` itself.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.fast = _by_rank(path)

    def __call__(self, text: str) -> bytes:
        if self.fast is None or any(a in text for a in self.added):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()


def _by_rank(path: str):
    """tiktoken's encoding for the file, or None if the file is not of the kind that it can stand for."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        said = json.load(f)
    model, split = said["model"], said.get("pre_tokenizer") or {}
    plain = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
    if not plain or said.get("normalizer") or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
        return None
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
    added = {t["content"] for t in said.get("added_tokens", [])}
    ranks = {bytes(byte[c] for c in token): n for token, n in model["vocab"].items() if token not in added}
    merged = [model["vocab"].get("".join(m if isinstance(m, list) else m.split(" "))) for m in model["merges"]]
    if len(ranks) != 256 + len(merged) or sorted(n for b, n in ranks.items() if len(b) == 1) != [*range(256)] or merged != [*range(256, 256 + len(merged))]:
        return None
    return tiktoken.Encoding(path, pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """The process's encoder, which a worker's tasks share."""
    return Encoder(path)


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids): every document's tokens and the end id, cut where longer than capacity.

    ids are little-endian unsigned 32-bit numbers. Of a document that is cut, all
    pieces are full but perhaps the first. Null text is empty: the end id alone.
    Repeated rows give repeated pieces.
    """
    prepare(docs.sparkSession)
    limit = 4 * capacity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(vocabulary), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = encode(text.as_py() or "") + end
                cuts = [0, *range(len(ids) % limit or limit, len(ids) + 1, limit)]
                rows += [(doc, k, a // 4, (b - a) // 4, ids[a:b]) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)]
                if rows else [pa.array([], t) for t in (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())],
                names=["doc_id", "piece", "start", "length", "ids"],
            )

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(
        lambda batches: tidy(run(batches)), "doc_id bigint, piece int, start bigint, length bigint, ids binary"
    )


@dataclass
class Bins:
    """``times`` equal bins, numbered from ``first``; lengths from the longest piece to the shortest."""

    first: int
    times: int
    lengths: tuple[int, ...]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[Bins]:
    """Best-two-fit over how many pieces there are of each length."""
    left = {n: c for n, c in counts.items() if c > 0}
    order = sorted(left)
    if order and not 0 < order[0] <= order[-1] <= capacity:
        raise ValueError(f"lengths must be from 1 to {capacity}")
    out: list[Bins] = []
    first = 0
    while order:
        used: Counter[int] = Counter()
        gap = capacity

        def free(n: int) -> int:
            return left[n] - used[n]  # noqa: B023

        at = len(order)
        while gap and at:
            at = min(at, bisect_right(order, gap))
            while at and not free(order[at - 1]):
                at -= 1
            if at:
                used[order[at - 1]] += 1
                gap -= order[at - 1]
        if gap and len(used):
            small = min(used)
            if sum(used.values()) > 1 or small * 2 <= capacity:
                used[small] -= 1
                best = _best_two(order, free, gap + small)
                if best and sum(best) > small:
                    used.update(best)
                else:
                    used[small] += 1
        used += Counter()
        times = min(left[n] // k for n, k in used.items())
        out.append(Bins(first, times, tuple(sorted(used.elements(), reverse=True))))
        first += times
        for n, k in used.items():
            left[n] -= times * k
            if not left[n]:
                del left[n]
                order.remove(n)
    return out


def _best_two(order: list[int], free: Callable[[int], int], room: int) -> tuple[int, int] | None:
    """The two unpacked lengths with the largest sum of at most ``room``."""
    best, i, j = None, 0, bisect_right(order, room) - 1
    while i <= j:
        if not free(order[i]):
            i += 1
        elif not free(order[j]):
            j -= 1
        elif order[i] + order[j] > room or (i == j and free(order[i]) < 2):
            j -= 1
        else:
            if best is None or sum(best) < order[i] + order[j]:
                best = (order[j], order[i])
            i += 1
    return best


class Places:
    """Where the r-th piece of each length goes."""

    def __init__(self, bins: list[Bins]):
        rows: dict[int, list[tuple]] = {}
        seen: Counter[int] = Counter()
        for b in bins:
            at = 0
            where: dict[int, list[int]] = {}
            for n in b.lengths:
                where.setdefault(n, []).append(at)
                at += n
            for n, offsets in where.items():
                rows.setdefault(n, []).append((seen[n], b.first, offsets))
                seen[n] += len(offsets) * b.times
        self.by = {
            n: (np.array([r[0] for r in x]), np.array([r[1] for r in x]), np.array([len(r[2]) for r in x]),
                np.cumsum([0, *(len(r[2]) for r in x)]), np.array([o for r in x for o in r[2]]))
            for n, x in rows.items()
        }

    def __call__(self, length: int, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        begin, first, per, base, offsets = self.by[length]
        k = np.searchsorted(begin, rank, "right") - 1
        r = rank - begin[k]
        return first[k] + r // per[k], offsets[base[k] + r % per[k]]


def assign(rows: DataFrame, scratch: Scratch, capacity: int = CAPACITY) -> DataFrame:
    """rows (saved; doc_id, piece, length, ...) with sequence_id and offset added.

    Pieces of one length are taken in no particular order of documents; the
    numbers are the same on every run over the same saved rows.
    """
    by_length = {r.length: r.n for r in rows.groupBy("length").agg(F.count("*").alias("n")).toLocalIterator()}
    places = rows.sparkSession.sparkContext.broadcast(Places(plan(by_length, capacity)))
    shares = [(n, 1 + k // SHARE_ROWS) for n, k in by_length.items()]  # at most `capacity` rows
    shares = rows.sparkSession.createDataFrame(shares, "length bigint, __shares bigint")
    spread = rows.join(F.broadcast(shares), "length").withColumn("__share", F.pmod(F.xxhash64("doc_id", "piece"), "__shares")).drop("__shares")
    counts = spread.groupBy("length", "__share").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy("length").orderBy("__share").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("length", "__share", F.coalesce(before, F.lit(0)).alias("__before"))
    within = Window.partitionBy("length", "__share").orderBy("doc_id", "piece", *(c for c in rows.columns if c not in ("doc_id", "piece", "length")))
    ranked = (
        spread.withColumn("__rank", F.row_number().over(within) - 1).join(counts, ["length", "__share"])
        .select(*rows.columns, (F.col("__rank") + F.col("__before")).cast("bigint").alias("__rank"))
    )
    kept = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False)
            rank = batch.column("__rank").to_numpy(zero_copy_only=False)
            bin_, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for n in np.unique(length).tolist():
                at = length == n
                bin_[at], offset[at] = places.value(n, rank[at])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(bin_), pa.array(offset)], names=[*kept, "sequence_id", "offset"])

    schema = T.StructType([*rows.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return ranked.mapInArrow(run, schema)


def pack(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """Every document's pieces with their places: doc_id, piece, start, length, ids, ids_crc32, sequence_id, offset.

    Sequences have at most ``capacity`` tokens; pieces lie in them without gaps
    from 0. Without ``with_ids`` the ids themselves are left out, so that they are
    not shuffled. No documents give no rows.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    cut = pieces(docs, vocabulary, capacity, end_id).withColumn("ids_crc32", F.crc32("ids"))
    rows = scratch.save(cut if with_ids else cut.drop("ids"), "pieces")
    return assign(rows, scratch, capacity)
