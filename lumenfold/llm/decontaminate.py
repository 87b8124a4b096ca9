"""Benchmark decontamination with a generalised suffix automaton.

All items of a benchmark go into one automaton over word numbers. Documents
stream through it word by word; the automaton's state knows the longest
suffix of what was read that stands in any item. Wherever that match is at
least a window long, the window's words are hit.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ASCII_WORDS, Scratch, fresh, prepare, tidy

WINDOW = 13

#: Words of benchmark text that one automaton holds. It is broadcast, so this bounds its
#: size (about 60 MB); longer benchmarks are dealt over several automata, one at a time,
#: each of which reads the documents once.
AUTOMATON_WORDS = 200_000
#: What several automata found is broadcast if it is in no more texts.
BROADCAST_HITS = 100_000


def words(text: str | None) -> list[bytes]:
    """Maximal runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").translate(ASCII_WORDS).split() if text else []


class ItemAutomaton:
    """Suffix automaton of several word sequences, with the windows of each marked.

    A sequence of fewer than ``window`` words has itself as its only window; an
    empty one has none.
    """

    def __init__(self, items: Iterable[tuple[object, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.vocab: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        kept = [(k, [self.vocab.setdefault(w, len(self.vocab)) for w in ws]) for k, ws in items if ws]
        for _, ids in kept:
            last = 0
            for c in ids:
                last = self._extend(last, c)
        #: state -> {window length: item ids}
        self.marked: dict[int, dict[int, set]] = {}
        for item, ids in kept:
            n = min(window, len(ids))
            state = size = 0
            for c in ids:
                state, size = self.step(state, size, c)
                if size >= n:
                    self.marked.setdefault(self._holding(state, n), {}).setdefault(n, set()).add(item)
        self.shortest = min((min(window, len(ids)) for _, ids in kept), default=0)
        #: nearest state at or above each that is marked, so that climbing visits no others
        self.up = [-1] * len(self.link)
        for s in sorted(range(len(self.link)), key=self.length.__getitem__):
            self.up[s] = s if s in self.marked else self.up[self.link[s]] if s else -1

    def _extend(self, last: int, c: int) -> int:
        """Append c after state ``last``; the state of the whole sequence so far."""
        known = self.next[last].get(c)
        if known is not None:
            return known if self.length[known] == self.length[last] + 1 else self._clone(last, known, c)
        new = self._state(self.length[last] + 1, {}, 0)
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, q, c)
        return new

    def _state(self, length: int, step: dict[int, int], link: int) -> int:
        self.next.append(step)
        self.link.append(link)
        self.length.append(length)
        return len(self.link) - 1

    def _clone(self, p: int, q: int, c: int) -> int:
        """Split off q's strings that are no longer than p's longest and c."""
        copy = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = copy
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        return copy

    def _holding(self, state: int, n: int) -> int:
        while self.length[self.link[state]] >= n:
            state = self.link[state]
        return state

    def step(self, state: int, size: int, c: int) -> tuple[int, int]:
        """The state and length of the longest match after reading c."""
        while state and c not in self.next[state]:
            state = self.link[state]
            size = self.length[state]
        to = self.next[state].get(c)
        return (0, 0) if to is None else (to, size + 1)

    def hits(self, doc: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Spans [start, end) of words hit, in order and apart, and the ids of the items that occur.

        An unknown word ends every match, so only runs of known words that are as
        long as the shortest window go through the automaton.
        """
        spans: list[tuple[int, int]] = []
        found: set = set()
        if not self.shortest or len(doc) < self.shortest:
            return spans, found
        get = self.vocab.get
        ids = np.fromiter((get(w, -1) for w in doc), np.int64, len(doc))
        edges = np.flatnonzero(np.diff(np.concatenate(([-1], np.where(ids < 0, -1, 0), [-1]))))
        for begin, end in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if end - begin < self.shortest:
                continue
            state = size = 0
            for i, c in enumerate(ids[begin:end].tolist(), begin):
                state, size = self.step(state, size, c)
                s, longest = self.up[state], 0
                while s > 0:
                    for n, items in self.marked[s].items():
                        if n <= size:
                            longest = max(longest, n)
                            found |= items
                    s = self.up[self.link[s]]
                if longest:
                    at = i + 1 - longest
                    while spans and spans[-1][1] >= at:
                        at = min(at, spans.pop()[0])
                    spans.append((at, i + 1))
        return spans, found


def _shares(benchmark: DataFrame, window: int, bound: int) -> tuple[DataFrame, int]:
    """The benchmark's items as rows (item_id, words, share) and the number of shares, each of about ``bound`` words.

    An item of more than half so many words is cut into pieces, which overlap so that every
    window lies in one of them.
    """
    items = benchmark.select("item_id", "text").where("text is not null and item_id is not null")
    piece = max(window, bound // 2)

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, out = [], []
            for k, text in enumerate(batch.column("text")):
                ws = words(text.as_py())
                for i in range(0, max(1, len(ws) - window + 1), piece):
                    at.append(k)
                    out.append(b" ".join(ws[i : i + piece + window - 1]).decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([batch.column("item_id").take(pa.array(at, pa.int64())), pa.array(out, pa.string())], names=["item_id", "words"])

    schema = T.StructType([items.schema["item_id"], T.StructField("words", T.StringType())])
    pieces = items.mapInArrow(cut_up, schema)
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    shares = int(1 + size // (4 * bound))
    return pieces.withColumn("share", F.pmod(F.xxhash64("item_id", "words"), F.lit(shares))), shares


def _automaton(pieces: DataFrame, share: int, window: int) -> ItemAutomaton:
    """The automaton of one share, the only one that the driver holds at a time."""
    rows = pieces.where(F.col("share") == share).toLocalIterator()
    return ItemAutomaton(((r["item_id"], words(r["words"])) for r in rows), window)


FOUND = ("n_words", "spans", "items")


def matches(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, bound: int = AUTOMATON_WORDS, prefix: str = ""
) -> DataFrame:
    """Every document with its hit spans.

    Adds to the rows of docs: n_words long, spans array<struct<start,end>> (words
    from 0, end exclusive, disjoint, in order), items array<string> (ids of items
    with a window in the document, sorted as strings), their names after ``prefix``.

    Null or empty text has no words. Items without words or without an id are
    ignored; items that repeat count once by id. Documents keep every row,
    repeated rows included, and every column but one that has an added column's name.
    """
    spark = docs.sparkSession
    prepare(spark)
    names = [prefix + c for c in FOUND]
    docs = docs.select(*(c for c in docs.columns if c not in names))
    pieces, shares = _shares(benchmark, window, bound)
    if shares == 1:
        return _through(docs, spark.sparkContext.broadcast(_automaton(pieces, 0, window)), names)
    scratch = Scratch(spark, "decontaminate")
    pieces = scratch.save(pieces, "pieces")
    hits = []
    for k in range(shares):
        sent = spark.sparkContext.broadcast(_automaton(pieces, k, window))
        hits.append(scratch.save(_hits(docs, sent), f"hits{k}"))
        sent.destroy()
    return _joined(docs, _united(hits, scratch), names)


_SPAN = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _through(docs: DataFrame, sent: Broadcast, names: list[str]) -> DataFrame:
    """docs with what one automaton finds."""
    carried = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = sent.value
        for batch in batches:
            n_words, spans, items = [], [], []
            for text in batch.column("text"):
                ws = words(text.as_py())
                s, found = auto.hits(ws)
                n_words.append(len(ws))
                spans.append([{"start": a, "end": b} for a, b in s])
                items.append(sorted({str(x) for x in found}))
            columns = [pa.array(n_words, pa.int64()), pa.array(spans, _SPANS), pa.array(items, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carried), *columns], names=[*carried, *names])

    added = zip(names, (T.LongType(), T.ArrayType(_SPAN), T.ArrayType(T.StringType())), strict=True)
    schema = T.StructType([*docs.schema.fields, *(T.StructField(n, t) for n, t in added)])
    return docs.mapInArrow(lambda batches: tidy(run(batches)), schema)


def _digest(text: str) -> tuple[int, int]:
    d = xxhash.xxh3_128_digest(text.encode("utf-8", "surrogatepass"))
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def _hits(docs: DataFrame, sent: Broadcast) -> DataFrame:
    """(d1, d2, spans, items) of each distinct text in which one automaton finds a window; d1, d2: the text's digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = sent.value
        for batch in batches:
            rows = []
            for text in batch.column("text"):
                s, found = auto.hits(words(text.as_py()))
                if found:
                    rows.append((*_digest(text.as_py()), [{"start": a, "end": b} for a, b in s], sorted({str(x) for x in found})))
            if rows:
                kinds = (pa.int64(), pa.int64(), _SPANS, pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["d1", "d2", "spans", "items"])

    found = docs.select("text").mapInArrow(lambda b: tidy(run(b)), "d1 bigint, d2 bigint, spans array<struct<start:bigint,end:bigint>>, items array<string>")
    return found.groupBy("d1", "d2").agg(F.any_value("spans").alias("spans"), F.any_value("items").alias("items"))


def _united(hits: list[DataFrame], scratch: Scratch) -> DataFrame:
    """What several automata found in the same texts, spans merged; one row for each text."""
    both = hits[0]
    for more in hits[1:]:
        both = both.unionByName(more)
    both = both.groupBy("d1", "d2").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [[{"start": a, "end": b} for a, b in _merged([(x["start"], x["end"]) for x in own])] for own in batch.column("spans").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("d1"), batch.column("d2"), pa.array(spans, _SPANS), batch.column("items")], names=batch.schema.names)

    return scratch.save(both.mapInArrow(run, both.schema), "united")


def _joined(docs: DataFrame, hits: DataFrame, names: list[str]) -> DataFrame:
    """docs with the spans and items of their text; texts are shuffled only where hits are too many to broadcast."""
    carried, d1, d2 = docs.columns, fresh([*docs.columns, *names], "d1"), fresh([*docs.columns, *names], "d2")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [text.as_py() for text in batch.column("text")]
            digests = [_digest(t or "") for t in texts]
            columns = [pa.array([len(words(t)) for t in texts], pa.int64()), pa.array([a for a, _ in digests], pa.int64()), pa.array([b for _, b in digests], pa.int64())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carried), *columns], names=[*carried, names[0], d1, d2])

    keyed = docs.mapInArrow(lambda b: tidy(run(b)), T.StructType([*docs.schema.fields, *(T.StructField(n, T.LongType()) for n in (names[0], d1, d2))]))
    hits = hits.select(F.col("d1").alias(d1), F.col("d2").alias(d2), F.col("spans").alias(names[1]), F.col("items").alias(names[2]))
    if hits.count() <= BROADCAST_HITS:
        hits = F.broadcast(hits)
    none = (F.array().cast(T.ArrayType(_SPAN)), F.array().cast("array<string>"))
    return keyed.join(hits, [d1, d2], "left").select(*carried, names[0], *(F.coalesce(n, x).alias(n) for n, x in zip(names[1:], none, strict=True)))


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def n_hit(prefix: str = ""):
    return F.aggregate(prefix + "spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])


def is_contaminated(share: int = 20, prefix: str = ""):
    """A document is contaminated if at least a 1/share part of its words is hit."""
    return (n_hit(prefix) > 0) & (share * n_hit(prefix) >= F.col(prefix + "n_words"))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = 20) -> DataFrame:
    """The documents that are not contaminated, unchanged; columns as in docs."""
    own = _free_prefix(docs)
    found = matches(docs, benchmark, window, prefix=own)
    return found.where(~is_contaminated(share, own)).select(*docs.columns)


def _free_prefix(docs: DataFrame) -> str:
    """What makes the names of FOUND differ from all columns of docs."""
    out, taken = "__", {c.lower() for c in docs.columns}
    while any(out + c in taken for c in FOUND):
        out += "_"
    return out


def remove_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, min_words: int = WINDOW, share: float = 0.5) -> DataFrame:
    """docs with hit spans cut from the text; documents hit beyond ``share`` go altogether.

    A span is cut if it has at least min_words words. What stands around it is
    joined by one space; the rest of the text keeps its characters.
    """
    own = _free_prefix(docs)
    found = matches(docs, benchmark, window, prefix=own).where(n_hit(own) <= share * F.col(own + "n_words"))
    kept, spans_of = docs.columns, own + "spans"
    found = found.select(*kept, spans_of)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [
                cut(t, [(s["start"], s["end"]) for s in spans if s["end"] - s["start"] >= min_words])
                for t, spans in zip(batch.column("text").to_pylist(), batch.column(spans_of).to_pylist(), strict=True)
            ]
            columns = [pa.array(texts, pa.string()) if c == "text" else batch.column(c) for c in kept]
            yield pa.RecordBatch.from_arrays(columns, names=kept)

    return found.mapInArrow(run, docs.schema)


def cut(text: str | None, spans: list[tuple[int, int]]) -> str | None:
    if not spans:
        return text
    raw = text.encode("utf-8", "surrogatepass")
    low = np.frombuffer(raw.translate(ASCII_WORDS), np.uint8) != 32
    change = np.diff(np.concatenate(([False], low, [False])).astype(np.int8))
    starts, ends = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
    out, at = [], 0
    for a, b in spans:
        out.append(raw[at : starts[a]])
        at = int(ends[b - 1])
    out.append(raw[at:])
    return b" ".join(p.strip(b" ") if 0 < i else p.rstrip(b" ") for i, p in enumerate(out)).decode("utf-8", "surrogatepass")


def items_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()
