"""Fuzzy line deduplication: banded MinHash of counted, weighted words, edit similarity.

A line is the set of its words, each with its number among the line's equal words.
Two lines of at most n words whose edit similarity is 80 % or more share at least
0.8 n of at most 1.2 n such members, whatever their length. A MinHash sample picks a
member of the two lines, rare words rather than common ones, and is equal if it picks
a shared one: where edits fall on words without regard to their frequency with a chance of
two in three at the threshold. A band of three is then equal with 0.296, and any of BANDS
with 0.996 (at a similarity of 0.9 with 0.999997). Weights keep lines apart that have
nothing but common words in common. They are gentle, so that lines still meet where edits
fall on the rarest words of a large corpus: 0.96 and more at the threshold (a test). Lines that share a band are linked if their edit
similarity, in words, is high enough. Of each connected group of lines, the first
occurrence in the corpus stays.

Blocks of a SimHash, which the operator is named for, cannot do this: at 80 % each bit
differs with a chance of 0.2, so a block of 20 bits is equal with 0.01 and over 200 blocks
a line would be needed for a recall of 0.9.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BROADCAST_IDS, Carried, Scratch, connected_components, fresh, join_counted, link_buckets, mix, prepare, tidy

#: Bands of 32 bits, two to a stored column, and the MinHash samples that each is made of.
BANDS, SAMPLES = 16, 3
#: Rows of the table of word counts: words share a row where their hashes do.
COUNTED = 1 << 16
#: A word's share of all words is told in fourfolds of COMMON, so many at most. Shares are smoothed by as many words as
#: UNSEEN, so that few words tell nothing.
COMMON, MOST_HALVINGS, UNSEEN = 2.0**-15, 6, 1 << 20
#: So many fourfolds halve a word's chance to be sampled once. With one, lines whose edits fall on their rarest words meet
#: too seldom in large corpora; with more, common words alone make lines meet.
GENTLE = 2
#: Samples of a line are also kept as four bits each. Lines are compared if as many are equal as ALIKE: at the threshold
#: 33 of the 48 are on average (fewer than 20 with a chance of 2e-5), of lines that share only a band and common words 10.
SKETCH_WORDS, ALIKE = BANDS * SAMPLES // 16, 20
#: A line's words are also counted, modulo four, in so many cells by their hashes: see profiles().
PROFILE = 256
#: Lines of fewer words stay wherever they stand: they repeat by chance. A default.
MIN_WORDS = 5
PERCENT = 80

#: Line feeds, digits and non-ASCII bytes stay, A-Z become lower case, other ASCII a space.
_NORMAL = bytes(
    b if b >= 128 or b == 10 or 97 <= b <= 122 or 48 <= b <= 57 else b + 32 if 65 <= b <= 90 else 32
    for b in range(256)
)

#: Characters of scripts that put no spaces between words (Thai, Lao, Burmese, Khmer, kana, Han): each is a word.
_SPACELESS = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3000-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")


def _normal(text: str) -> bytes:
    if text.isascii():
        return text.encode().translate(_NORMAL)
    text = text.lower()
    raw = text.encode("utf-8", "surrogatepass")
    if np.frombuffer(raw, np.uint8).max() >= 0xE0:  # else there is no character from U+0800 on
        raw = _SPACELESS.sub(r" \g<0> ", text).encode("utf-8", "surrogatepass")
    return raw.translate(_NORMAL)


def normal_lines(text: str) -> list[list[bytes]]:
    """The words of each line (ended by LF), without case and punctuation."""
    return [line.split() for line in _normal(text).split(b"\n")]


#: Bytes of text that are worked on at a time; a longer line is taken alone.
CHUNK = 1 << 19
_STEP = 0x9E3779B97F4A7C15 | 1


class _Powers:
    """Powers of an odd number modulo 2**64 and of its inverse, as many as were asked for so far."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, CHUNK + 1)
            steps = [np.full(size, x, np.uint64) for x in (_STEP, pow(_STEP, -1, 1 << 64))]
            for x in steps:
                x[0] = 1
            self.up, self.down = (np.multiply.accumulate(x) for x in steps)
        return self.up[:n], self.down[:n]


_powers = _Powers()
#: A random-looking 64-bit number for each byte.
_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))


def _sums(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the runs [start, end) of values: sums of value times a power by place, scaled to the run's start."""
    up, down = _powers(len(values))
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values * up)))
    return mix((total[ends] - total[starts]) * down[starts] + np.uint64(1))


def hashed_words(text: str) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the text's words (as in normal_lines()) and the number of the line that each stands on."""
    raw = np.frombuffer(_normal(text), np.uint8)
    gap = (raw == 32) | (raw == 10)
    turns = np.flatnonzero(np.diff(gap, prepend=True, append=True))
    starts, ends = turns[::2], turns[1::2]
    feeds = np.flatnonzero(raw == 10)
    return _sums(_BYTES[raw], starts, ends), np.searchsorted(feeds, starts)


def hashed_lines(words: np.ndarray, line: np.ndarray, least: int = MIN_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lines of at least ``least`` words: their numbers, two 64-bit hashes of each, and for each word its line's place here or -1."""
    firsts = np.flatnonzero(np.diff(line, prepend=-1))
    lasts = np.append(firsts[1:], len(line))
    long = lasts - firsts >= least
    place = np.repeat(np.where(long, np.cumsum(long) - 1, -1), lasts - firsts)
    firsts, lasts = firsts[long], lasts[long]
    h1, h2 = (_sums(mix(words + np.uint64(salt)), firsts, lasts) for salt in (0x632BE59BD9B4E019, 0xE220A8397B1DCDAF))
    return line[firsts], h1, h2, place


def halvings(counts: np.ndarray) -> np.ndarray:
    """How many fourfolds of COMMON a word's share is, by its row in the table of word counts: GENTLE of them halve its chance to be sampled."""
    share = counts / (int(counts.sum()) + UNSEEN)
    return np.clip(np.floor(np.log2(np.maximum(share, 1e-30) / COMMON) / 2), 0, MOST_HALVINGS).astype(np.uint8)


def word_counts(docs: DataFrame) -> np.ndarray:
    """How often the words of each row of the table stand in the texts of all docs.

    Each task counts its own documents; COUNTED numbers come to the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTED, np.int64)
        for batch in batches:
            for _, text in _chunks([0] * batch.num_rows, batch.column("text")):
                total += np.bincount((hashed_words(text)[0] % np.uint64(COUNTED)).astype(np.int64), minlength=COUNTED)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(total[met])], names=["row", "n"])

    out = np.zeros(COUNTED, np.int64)
    texts = docs.select("text").where("text is not null")
    got = texts.mapInArrow(lambda b: tidy(run(b)), "row bigint, n bigint").groupBy("row").agg(F.sum("n").alias("n")).toArrow()
    out[got["row"].to_numpy()] = got["n"].to_numpy()
    return out


#: One odd factor and one mask for each sample; 32 bits tell a line's members apart and are worked on faster than 64.
_FACTORS = (mix(np.arange(1, 2 * BANDS * SAMPLES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)
_MASKS, _FACTORS = _FACTORS[BANDS * SAMPLES :], _FACTORS[: BANDS * SAMPLES] | np.uint32(1)


def fingerprints(
    words: np.ndarray, place: np.ndarray, n: int, halved: np.ndarray | None = None, sketches: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """(n lines, BANDS) bands of 32 bits and how many words each line has; sketches (n lines, SKETCH_WORDS), if given, is filled.

    words: hashes; place: each word's line, from 0, in order; halved: halvings() by row, none
    if not given. The k-th of a line's equal words is a member of its own, so that replacing
    a word replaces one member only.
    """
    bands, counts = np.zeros((n, BANDS), np.uint32), np.bincount(place, minlength=n)
    if len(words):
        own = mix(words ^ mix(place.astype(np.uint64) + np.uint64(1)))  # equal for a line's equal words only
        order = np.argsort(own)  # which of the equal words gets which number does not matter
        first = np.flatnonzero(np.concatenate(([True], np.diff(own[order]) != 0)))
        number = np.empty(len(words), np.uint64)
        number[order] = np.arange(len(words)) - np.repeat(first, np.diff(np.append(first, len(words))))
        members = (mix(words + number * np.uint64(0xD1B54A32D192ED03)) >> np.uint64(32)).astype(np.uint32)
        starts = np.flatnonzero(np.diff(place, prepend=-1))
        lines = place[starts]
        # A sample is the member of the smallest value; the values of a word halved k times are 2**k as large.
        down = np.uint32(MOST_HALVINGS // GENTLE) - (0 if halved is None else (halved // GENTLE)[(words % np.uint64(COUNTED)).astype(np.int64)].astype(np.uint32))
        values = np.empty_like(members)
        for i in range(BANDS):
            band = np.zeros(len(starts), np.uint64)
            for k in range(i * SAMPLES, (i + 1) * SAMPLES):
                np.bitwise_xor(members, _MASKS[k], out=values)
                np.multiply(values, _FACTORS[k], out=values)
                np.right_shift(values, down, out=values)
                low = np.minimum.reduceat(values, starts).astype(np.uint64)
                band = mix(band ^ low)
                if sketches is not None:
                    sketches[lines, k // 16] |= (mix(low) >> np.uint64(60)) << np.uint64(4 * (k % 16))
            bands[lines, i] = band >> np.uint64(32)
    return bands, counts


def profiles(words: np.ndarray, place: np.ndarray, n: int) -> np.ndarray:
    """(n lines, PROFILE / 32): how many of each line's words fall into each cell, modulo four: all the counts' low bits, then their high bits.

    words and place as in fingerprints(). An edit changes one count by one, or two counts where it replaces a word.
    """
    out = np.empty((n, PROFILE // 32), np.uint64)
    cell = ((words >> np.uint64(20)) % np.uint64(PROFILE)).astype(np.int64)
    for lo in range(0, n, PROFILED):
        hi = min(n, lo + PROFILED)
        a, b = np.searchsorted(place, (lo, hi))
        counts = np.bincount((place[a:b] - lo) * PROFILE + cell[a:b], minlength=(hi - lo) * PROFILE).astype(np.uint8).reshape(-1, PROFILE)
        planes = [np.packbits((counts >> bit) & 1, axis=1, bitorder="little").view(np.uint64) for bit in (0, 1)]
        out[lo:hi] = np.concatenate(planes, axis=1)
    return out


def profile_distance(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """By how much two profiles' counts (last axis) differ in all: twice the edit distance of the lines at most."""
    low, high = np.split(x ^ y, 2, axis=-1)
    return (np.bitwise_count(low) + 2 * np.bitwise_count(~low & high)).sum(-1, dtype=np.int64)


def block_keys(bands: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit keys, and the line that each is of: one for every band of a line that has words."""
    at = np.flatnonzero(counts > 0)
    keys = [mix(bands[at, i].astype(np.uint64) | np.uint64((i + 1) << 32)).view(np.int64) for i in range(BANDS)]
    return np.concatenate(keys), np.tile(at, BANDS)


#: Keys that a part holds on average and those that a task gathers before it deals them; parts are as many as LEAST_PARTS at least.
PART_KEYS, HELD_KEYS, LEAST_PARTS = 1 << 21, 1 << 20, 64
#: Buckets of so many lines are looked through many at once, those of up to SQUARE lines as a square, larger ones some rows at a time.
FEW_LINES, SQUARE = 16, 512
#: Members that a task gathers before it looks through their buckets, pairs of one bucket that it gathers, and lines whose profiles are counted at once.
HELD_ROWS, HELD_PAIRS, PROFILED = 1 << 16, 1 << 18, 4096
#: Buckets of more lines are dealt over tasks (link_buckets()); those of fewer are looked through in one.
LARGE = 5000
#: The columns that hold a line's sketch.
_SKETCH = [f"s{i}" for i in range(SKETCH_WORDS)]
#: Those that hold its bands (two in each) and its profile.
_BANDS, _PROFILE = [f"b{i}" for i in range(BANDS // 2)], [f"p{i}" for i in range(PROFILE // 32)]
#: More than any line's number in its document.
POSITIONS = 1 << 31


def _chunks(docs: list, texts: pa.Array) -> Iterator[tuple[list[tuple[int, int, int]], str]]:
    """Texts joined by line feeds, about CHUNK bytes at a time, cut at line feeds only; with each, for each
    document in it, (its number here, its first line in the chunk, that line's number in the document)."""
    held: list[str] = []
    owners: list[tuple[int, int, int]] = []
    size = lines = 0
    for k in range(len(docs)):
        text, done = texts[k].as_py(), 0
        for piece in [text] if len(text) <= CHUNK else _pieces(text):
            held.append(piece)
            owners.append((k, lines, done))
            n = piece.count("\n") + 1
            lines, done, size = lines + n, done + n, size + len(piece)
            if size >= CHUNK:
                yield owners, "\n".join(held)
                held, owners, size, lines = [], [], 0, 0
    if held:
        yield owners, "\n".join(held)


def _pieces(text: str) -> Iterator[str]:
    at = 0
    while at <= len(text):
        cut = text.find("\n", at + CHUNK)
        cut = len(text) if cut < 0 else cut
        yield text[at:cut]
        at = cut + 1


def _occurrence_batches(batches: Iterator[pa.RecordBatch], halved: np.ndarray | None = None, least: int = MIN_WORDS) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "pos", "h1", "h2", "words", *_BANDS, *_SKETCH, *_PROFILE]
    for batch in batches:
        docs = batch.column("doc_id").to_pylist()
        for owners, text in _chunks(docs, batch.column("text")):
            words, line = hashed_words(text)
            numbers, h1, h2, place = hashed_lines(words, line, least)
            sketches = np.zeros((len(numbers), SKETCH_WORDS), np.uint64)
            words, place = words[place >= 0], place[place >= 0]
            bands, n_words = fingerprints(words, place, len(numbers), halved, sketches)
            wide = np.concatenate((bands.view(np.int64), sketches.view(np.int64), profiles(words, place, len(numbers)).view(np.int64)), axis=1)
            which, first, done = (np.array(x, np.int64) for x in zip(*owners, strict=True))
            at = np.searchsorted(first, numbers, "right") - 1
            ids = np.array(docs, np.int64)[which[at]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids), pa.array((numbers - first[at] + done[at]).astype(np.int32)), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), pa.array(n_words),
                 *(pa.array(np.ascontiguousarray(c)) for c in wide.T)],
                names=names,
            )


def _key_batches(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """Keys dealt over parts, gathered: a row is many keys of one part and the lines that they are of, as bytes, so that few rows are moved."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for batch in batches:
        bands = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in _BANDS], axis=1).view(np.uint32)
        keys, at = block_keys(bands, np.ones(len(bands), np.int64))
        held.append((keys, batch.column("h1").to_numpy(zero_copy_only=False)[at]))
        if sum(len(keys) for keys, _ in held) >= HELD_KEYS:
            yield _dealt_keys(held, parts)
            held = []
    if held:
        yield _dealt_keys(held, parts)


def _dealt_keys(held: list[tuple[np.ndarray, np.ndarray]], parts: int) -> pa.RecordBatch:
    keys, ids = (np.concatenate(x) for x in zip(*held, strict=True))
    part = (keys.view(np.uint64) % np.uint64(parts)).astype(np.int32)
    order = np.argsort(part, kind="stable")
    starts = np.flatnonzero(np.diff(part[order], prepend=-1))
    offsets = pa.py_buffer((8 * np.append(starts, len(order))).astype(np.int32))
    blobs = [pa.Array.from_buffers(pa.binary(), len(starts), [None, offsets, pa.py_buffer(x[order])]) for x in (keys, ids)]
    return pa.RecordBatch.from_arrays([pa.array(part[order][starts]), *blobs], names=["part", "keys", "ids"])


def _shared_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, id, n) of the keys that n > 1 lines have, from rows of _key_batches() in order of their parts.

    A part is held until it is whole. Keys of more than LARGE lines are given on (with n of LARGE + 1 or more) where they would make it much larger than others.
    """
    now, held, size, bound, wide = None, [], 0, 4 * PART_KEYS, np.empty(0, np.int64)
    for batch in batches:
        for part, *blobs in zip(batch.column("part").to_pylist(), batch.column("keys"), batch.column("ids"), strict=True):
            if part != now:
                if held:
                    yield _shared(*_runs(held))
                now, held, size, bound, wide = part, [], 0, 4 * PART_KEYS, wide[:0]
            keys, ids = (np.frombuffer(x.as_buffer(), np.int64) for x in blobs)
            if len(wide):
                gone = np.isin(keys, wide)
                if gone.any():
                    yield _shared(keys[gone], ids[gone], np.full(gone.sum(), LARGE + 1))
                keys, ids = keys[~gone], ids[~gone]
            held.append((keys, ids))
            size += len(keys)
            if size >= bound:
                keys, ids, n = _runs(held)
                over = n > LARGE
                if over.any():
                    yield _shared(keys[over], ids[over], n[over])
                wide = np.union1d(wide, keys[over])
                held = [(keys[~over], ids[~over])]
                size = int((~over).sum())
                bound = max(bound, 2 * size)
    if held:
        yield _shared(*_runs(held))


def _runs(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """keys and ids in order of the keys, and how many rows each one's key has."""
    keys, ids = (np.concatenate(x) for x in zip(*held, strict=True))
    order = np.argsort(keys)
    keys, ids = keys[order], ids[order]
    starts = np.flatnonzero(np.concatenate((np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1])))
    n = np.diff(np.append(starts, len(keys)))
    return keys, ids, np.repeat(n, n)


def _shared(keys: np.ndarray, ids: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    many = n > 1
    return pa.RecordBatch.from_arrays([pa.array(x[many]) for x in (keys, ids, n.astype(np.int32))], names=["key", "id", "n"])


def _alike(x: np.ndarray, y: np.ndarray, words: np.ndarray, other_words: np.ndarray, connected: np.ndarray, percent: int) -> np.ndarray:
    """How many samples of sketches (their last axis) are equal; 0 where the pair does not fit or is connected already."""
    x = x ^ y
    x = x | (x >> np.uint64(1))
    x = x | (x >> np.uint64(2))
    same = BANDS * SAMPLES - np.bitwise_count(x & np.uint64(0x1111111111111111)).sum(-1, dtype=np.int64)
    fit = (100 * np.minimum(words, other_words) >= percent * np.maximum(words, other_words)) & (same >= ALIKE) & ~connected
    return np.where(fit, same, 0)


class _Members:
    """Rows (key, id, words, sketch, c and, where there is one, profile) of whole buckets: which pairs of them may be alike."""

    def __init__(self, rows: pa.Table, percent: int):
        self.percent = percent
        self.key, self.id, self.words, self.own = (rows.column(c).to_numpy() for c in ("key", "id", "words", "c"))
        self.sketches, self.profiles = (
            np.stack([rows.column(c).to_numpy() for c in names], axis=1).view(np.uint64) if names[0] in rows.column_names else None for names in (_SKETCH, _PROFILE)
        )

    def alike(self, of: np.ndarray, to: np.ndarray | int) -> np.ndarray:
        """How many samples of the rows' lines are equal, 0 where a pair does not fit or is connected already."""
        same = _alike(self.sketches[of], self.sketches[to], self.words[of], self.words[to], self.own[of] == self.own[to], self.percent)
        if self.profiles is not None:
            at = np.nonzero(same)
            x, y = (np.broadcast_to(rows, same.shape)[at] for rows in (of, to))
            most = (100 - self.percent) * np.maximum(self.words[x], self.words[y]) // 100
            same[at] *= profile_distance(self.profiles[x], self.profiles[y]) <= 2 * most
        return same

    def batch(self, of: np.ndarray, to: np.ndarray, same: np.ndarray, more: np.ndarray) -> pa.RecordBatch:
        columns = [self.key[of], self.id[of], self.id[to], self.own[of], self.own[to], same.astype(np.int32), more]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "a", "b", "ca", "cb", "alike", "more"])


class _Bucket:
    """The lines of one key, in rows [lo, hi) of members: which pairs may be alike, (of, with, alike) each."""

    def __init__(self, members: _Members, lo: int, hi: int, whole: bool):
        self.members, self.lo, self.n = members, lo, hi - lo
        rows = np.arange(lo, hi)
        self.rows, self.square = rows, members.alike(rows[:, None], rows[None, :]) if whole and self.n <= SQUARE else None

    def alike(self, k: int) -> np.ndarray:
        """How many samples of the k-th line's are equal in each line, 0 where the pair does not fit or is connected already."""
        return self.members.alike(self.rows, self.lo + k) if self.square is None else self.square[k]

    def forest(self) -> Iterator[np.ndarray]:
        """Pairs that connect all that pairs that fit connect: from the most central line on, each with one before it."""
        some = np.arange(0, self.n, max(1, self.n // 64))
        central = sum(self.alike(k) for k in some.tolist()) if self.square is None else self.square[some].sum(axis=0)
        left = np.ones(self.n, bool) if self.square is None else self.square.any(axis=1)
        for first in np.argsort(-central, kind="stable").tolist():
            if not left[first]:
                continue
            left[first], front = False, [first]
            while front and left.any():
                k = front.pop(0)
                same = self.alike(k)
                found = np.flatnonzero((same > 0) & left)
                if len(found):
                    left[found] = False
                    front += found.tolist()
                    yield np.stack((found, np.full(len(found), k), same[found]))

    def all_pairs(self) -> Iterator[np.ndarray]:
        step = max(1, SQUARE * SQUARE // self.n)
        for k in range(0, self.n, step):
            same = np.triu(self.members.alike(self.rows[k : k + step, None], self.rows[None, k:]), 1)
            of, to = np.nonzero(same)
            if len(of):
                yield np.stack((k + to, k + of, same[of, to]))

    def closest(self) -> Iterator[np.ndarray]:
        """Of the pairs of each two components the one with the most equal samples."""
        best = np.empty((3, 0), np.int64)
        for pairs in _gathered(self.all_pairs()):
            best = np.concatenate((best, pairs), axis=1)
            ends = np.sort(self.members.own[self.lo + best[:2]], axis=0)
            best = best[:, np.lexsort((-best[2], ends[1], ends[0]))]
            ends = np.sort(self.members.own[self.lo + best[:2]], axis=0)
            best = best[:, np.concatenate(([True], (ends[:, 1:] != ends[:, :-1]).any(axis=0)))]
        if best.size:
            yield best


def _gathered(pairs: Iterator[np.ndarray]) -> Iterator[np.ndarray]:
    """The same pairs, about HELD_PAIRS at a time."""
    held, n = [], 0
    for some in pairs:
        held.append(some)
        n += some.shape[1]
        if n >= HELD_PAIRS:
            yield np.concatenate(held, axis=1)
            held, n = [], 0
    if held:
        yield np.concatenate(held, axis=1)


def _pair_batches(batches: Iterator[pa.RecordBatch], which: str, percent: int) -> Iterator[pa.RecordBatch]:
    """(key, a, b, ca, cb, alike, more) from members in order of their keys; more: the key's lines have other pairs that fit."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= HELD_ROWS:
            rows = pa.Table.from_batches(held).combine_chunks()
            keys = rows.column("key").to_numpy()
            cut = int(np.searchsorted(keys, keys[-1]))
            if cut:
                yield from _pairs_of(rows.slice(0, cut), which, percent)
            held, size = rows.slice(cut).combine_chunks().to_batches(), len(keys) - cut
    if size:
        yield from _pairs_of(pa.Table.from_batches(held).combine_chunks(), which, percent)


def _pairs_of(rows: pa.Table, which: str, percent: int) -> Iterator[pa.RecordBatch]:
    members = _Members(rows, percent)
    starts = np.flatnonzero(np.concatenate(([True], members.key[1:] != members.key[:-1])))
    ends = np.append(starts[1:], len(members.key))
    open_ = ends - starts > FEW_LINES
    for n in range(2, FEW_LINES + 1):  # buckets of one size at once
        at = starts[ends - starts == n]
        x, y = np.triu_indices(n, 1)
        for some in np.array_split(at, max(1, len(at) * len(x) // 200_000)):
            of, to = some[:, None] + y, some[:, None] + x
            same = members.alike(of, to)
            hits = np.count_nonzero(same, axis=1)
            if which == "forest" and n > 2:
                square = np.zeros((len(some), n, n), np.int64)
                square[:, x, y] = square[:, y, x] = same
                central = square.sum(axis=2)
                lead = central.argmax(axis=1)
                star = square[np.arange(len(some)), lead]  # in most buckets it reaches all lines that have a pair
                whole = np.count_nonzero(star, axis=1) + 1 == np.count_nonzero(central, axis=1)
                open_ |= np.isin(starts, some[(hits > 0) & ~whole])
                bucket, line = np.nonzero(star * whole[:, None])
                of, to, same = some[bucket] + line, some[bucket] + lead[bucket], star[bucket, line]
            else:
                bucket, pair = np.nonzero(same)
                of, to, same = of[bucket, pair], to[bucket, pair], same[bucket, pair]
            if len(of):
                yield members.batch(of, to, same, hits[bucket] > 1)
    for of, to, same, more in _gathered(_open_pairs(members, zip(starts[open_].tolist(), ends[open_].tolist(), strict=True), which)):
        yield members.batch(of, to, same, more > 0)


def _open_pairs(members: _Members, buckets: Iterable[tuple[int, int]], which: str) -> Iterator[np.ndarray]:
    for lo, hi in buckets:
        for of, to, same in _gathered(getattr(_Bucket(members, lo, hi, which == "forest"), which)()):
            yield np.stack((lo + of, lo + to, same, np.full(len(of), len(of) > 1)))


def coded(words: list[bytes]) -> str:
    """A line as a string of one character for each word, so that edits are counted in words.

    Two of a line's words share a character with a chance of one in a million.
    """
    return "".join(chr(0x10000 + xxhash.xxh3_64_intdigest(w) % 0x100000) for w in words)


def _text_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts = [], []
        for text, wanted in zip(batch.column("text"), batch.column("wanted").to_pylist(), strict=True):
            lines = text.as_py().split("\n")
            for w in wanted:
                if w["pos"] < len(lines):
                    ids.append(w["h1"])
                    texts.append(coded(normal_lines(lines[w["pos"]])[0]))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.string())], names=["id", "line"])


def duplicate_lines(docs: DataFrame, scratch: Scratch, percent: int = PERCENT, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, pos, near) of every line to be removed, saved; near: another wording of it stays.

    Lines are ordered by (doc_id, pos); of each connected group the first stays.
    """
    prepare(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("doc_id is not null and text is not null")
    halved = docs.sparkSession.sparkContext.broadcast(halvings(word_counts(docs)))
    schema = f"doc_id bigint, pos int, h1 bigint, h2 bigint, words bigint, {', '.join(f'{c} bigint' for c in [*_BANDS, *_SKETCH, *_PROFILE])}"
    found = scratch.save(docs.mapInArrow(lambda b: tidy(_occurrence_batches(b, halved.value, min_words)), schema), "occurrences")
    lines = found.groupBy("h1", "h2").agg(
        F.count("*").alias("n"), F.min(F.col("doc_id").cast("decimal(19,0)") * F.lit(POSITIONS) + F.col("pos")).alias("at"), *(F.max(c).alias(c) for c in ["words", *_BANDS, *_SKETCH, *_PROFILE])
    )
    pos = F.pmod("at", F.lit(POSITIONS)).cast("int")
    at = F.struct(F.expr(f"(at - pmod(at, {POSITIONS})) div {POSITIONS}").cast("bigint").alias("doc_id"), pos.alias("pos"))
    lines = scratch.save(lines.withColumn("at", at), "lines")
    slim = scratch.save(found.select("doc_id", "pos", "h1", "h2"), "slim")
    scratch.drop(found)
    scratch.release()
    texts: list[DataFrame] = []

    def read(ids: DataFrame) -> DataFrame:
        """The words of the lines of these ids, of all lines that were asked for so far; each is read once."""
        for known in texts:
            ids = ids.join(known.select("id"), "id", "left_anti")
        ids = scratch.save(ids, "ids")
        few = ids.count() <= BROADCAST_IDS
        wanted = lines.join(F.broadcast(ids) if few else ids, lines.h1 == ids.id, "left_semi").select("h1", "at.doc_id", "at.pos").distinct()
        wanted = wanted.groupBy("doc_id").agg(F.collect_list(F.struct("pos", "h1")).alias("wanted"))
        own = docs.join(F.broadcast(wanted) if few else wanted, "doc_id")
        texts.append(scratch.save(own.mapInArrow(lambda b: tidy(_text_batches(b)), "id bigint, line string").distinct(), "texts"))
        out = texts[0]
        for more in texts[1:]:
            out = out.unionByName(more)
        return out

    def verified(pairs: DataFrame) -> DataFrame:
        all_ = read(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())
        both = pairs.join(all_.select(F.col("id").alias("a"), F.col("line").alias("x")), "a").join(
            all_.select(F.col("id").alias("b"), F.col("line").alias("y")), "b"
        )
        return both.where(F.expr(similar("x", "y", percent))).select("a", "b").distinct()

    def fits(x: Carried, y: Carried) -> Column:
        """The lengths allow the similarity, and the sketches do not speak against it."""
        return (100 * F.least(x("words"), y("words")) >= percent * F.greatest(x("words"), y("words"))) & (equal_samples(x, y) >= ALIKE)

    carried = lines.select(F.col("h1").alias("id"), "words", *_SKETCH)
    comp = _connected(scratch, lines, carried, verified, fits, percent)
    near = scratch.save(lines.select("h1", "h2", "at", "n").join(comp.withColumnRenamed("id", "h1"), "h1"), "near")
    first = scratch.save(near.groupBy("component").agg(F.min("at").alias("first"), F.count("*").alias("n")), "first")
    near = join_counted(near.withColumnRenamed("n", "many"), first, ["component"], near.count())
    near = near.select("h1", "h2", "at", "first", F.col("many").alias("n"))
    same = lines.where("n > 1").join(comp.select(F.col("id").alias("h1")), "h1", "left_anti")
    kept = scratch.save(near.unionByName(same.select("h1", "h2", "at", F.col("at").alias("first"), "n")), "kept")
    out = join_counted(slim, kept, ["h1", "h2"], slim.count())
    out = out.where(F.struct("doc_id", "pos") != F.struct("first.doc_id", "first.pos"))
    out = scratch.save(out.select("doc_id", "pos", (F.col("at") != F.col("first")).alias("near")).distinct(), "gone")
    for done in (slim, lines, *texts):
        scratch.drop(done)
    return out


def _small(saved: DataFrame) -> DataFrame:
    """A saved table of two numbers a row, broadcast if it is no larger than BROADCAST_IDS ids."""
    return saved.hint("broadcast") if 2 * saved.count() <= BROADCAST_IDS else saved


def _joined(scratch: Scratch, comp: DataFrame, links: DataFrame) -> DataFrame:
    """comp (id, component) with further links (a, b): only components that they join are worked on."""
    of = lambda c: comp.select(F.col("id").alias(c), F.col("component").alias(f"c{c}"))
    ends = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    low = scratch.save(connected_components(scratch, ends), "joined")
    told = comp.join(low.select(F.col("id").alias("component"), F.col("component").alias("to")), "component", "left")
    told = told.select("id", F.coalesce("to", "component").alias("component"))
    return scratch.save(told.unionByName(low.join(comp, "id", "left_anti")), "components")


def _connected(scratch: Scratch, lines: DataFrame, carried: DataFrame, verified: Callable[[DataFrame], DataFrame], fits: Callable[[Carried, Carried], Column], percent: int) -> DataFrame:
    """(id, component) of all lines that are linked: that share a band and are similar, or are connected by such lines.

    Each line is tried first with one line of its buckets, the nearest of those that their most central lines led to; then of each two
    components that share a bucket the closest pair; then all pairs of different components. Links inside a component could not change it.
    """
    parts = max(LEAST_PARTS, -(-BANDS * lines.count() // PART_KEYS))
    keys = lines.select("h1", *_BANDS).mapInArrow(lambda b: tidy(_key_batches(b, parts)), "part int, keys binary, ids binary")
    shared = keys.repartition("part").sortWithinPartitions("part").mapInArrow(lambda b: tidy(_shared_batches(b)), "key bigint, id bigint, n int")
    shared = scratch.save(shared, "shared")
    scratch.release()
    members = scratch.save(shared.where(F.col("n") <= LARGE).select("key", "id").join(carried.hint("shuffle_hash"), "id"), "members")
    scratch.release()
    schema = "key bigint, a bigint, b bigint, ca bigint, cb bigint, alike int, more boolean"
    pair = (F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    comp = None
    for which in ("forest", "closest", "all_pairs"):
        named = members.withColumn("c", F.col("id"))
        if comp is not None:
            named = members.join(_small(comp), "id", "left").withColumn("c", F.coalesce("component", "id")).drop("component")
        got = named.repartition("key").sortWithinPartitions("key").mapInArrow(lambda b, how=which: tidy(_pair_batches(b, how, percent)), schema)
        got = tried = scratch.save(got, "pairs")
        scratch.release()
        if which == "forest":
            tried = got.groupBy("a").agg(F.max_by("b", "alike").alias("b"))
        elif which == "closest":
            tried = got.groupBy(F.least("ca", "cb").alias("ca"), F.greatest("ca", "cb").alias("cb")).agg(F.max_by(F.struct("a", "b"), "alike").alias("p")).select("p.a", "p.b")
        tried = scratch.save(tried.select(*pair).distinct(), "candidates")
        if comp is not None and tried.isEmpty():
            break
        links = scratch.save(verified(tried), "links")
        comp = scratch.save(connected_components(scratch, links), "components") if comp is None else _joined(scratch, comp, links)
        if which == "all_pairs":
            break
        # Pairs of a bucket are left only where those found lie in different components still, and a bucket's one pair was not refused.
        of = lambda c: _small(comp).select(F.col("id").alias(c), F.col("component").alias(f"now_{c}"))  # noqa: B023, E731
        apart = got.select("key", *pair, "more").join(of("a"), "a", "left").join(of("b"), "b", "left")
        apart = apart.where(F.coalesce("now_a", "a") != F.coalesce("now_b", "b"))
        again = apart
        if which == "forest":
            again = apart.where("more").select("key").unionByName(apart.where("not more").join(_small(tried), ["a", "b"], "left_anti").select("key"))
        again = scratch.save(again.select("key").distinct(), "again")
        members = members.join(F.broadcast(again) if again.count() <= BROADCAST_IDS else again, "key", "left_semi")
        if which == "forest":  # from now on pairs also have to pass their profiles
            members = members.join(lines.select(F.col("h1").alias("id"), *_PROFILE), "id")
        members = scratch.save(members, "members")
    wide = shared.where(F.col("n") > LARGE).select("key", "id")
    if not wide.isEmpty():
        more = link_buckets(scratch, wide, verified, carried, fits, lambda x, y: F.lit(BANDS * SAMPLES) - equal_samples(x, y))
        comp = _joined(scratch, comp, more)
    return comp


def equal_samples(x: Carried, y: Carried) -> Column:
    """How many of the samples' four bits are equal in two sketches."""
    out = F.lit(BANDS * SAMPLES)
    for c in _SKETCH:
        apart = x(c).bitwiseXOR(y(c))
        apart = apart.bitwiseOR(F.shiftrightunsigned(apart, 1))
        apart = apart.bitwiseOR(F.shiftrightunsigned(apart, 2))
        out = out - F.bit_count(apart.bitwiseAND(F.lit(0x1111111111111111)))
    return out


def similar(x: str, y: str, percent: int) -> str:
    """SQL: the edit distance of x and y is at most (100 - percent) % of the longer one's length."""
    most = f"cast(floor({100 - percent} * greatest(length({x}), length({y})) / 100) as int)"
    return f"abs(length({x}) - length({y})) <= {most} and levenshtein({x}, {y}, {most}) >= 0"


def _clean_batches(batches: Iterator[pa.RecordBatch], drops: str, names: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, total = [], []
        for text, drop in zip(batch.column("text"), batch.column(drops).to_pylist(), strict=True):
            t = text.as_py()
            total.append(0 if t is None else t.count("\n") + 1)
            if drop:
                out = set(drop)
                t = "\n".join(line for k, line in enumerate(t.split("\n")) if k not in out)
            texts.append(t)
        columns = [pa.array(texts, pa.string()) if c == "text" else batch.column(c) for c in names]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(total, pa.int64())], names=[*names, "__lines"])


#: The counts that dedup_lines() adds.
ADDED = ("__removed", "__removed_near", "__lines")


def dedup_lines(docs: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with repeated lines removed from the text, plus __lines, __removed, __removed_near (counts).

    A line is what stands between LFs; it is compared without case and
    punctuation. Lines of at least min_words words take part; in scripts without
    spaces every character is a word. Equal lines
    are one; lines are also linked to lines that share a band of the fingerprint if the
    edit distance in words is at most (100 - percent) % of the longer line. Of each
    connected group the occurrence with the smallest (doc_id, line number) stays.

    Every row stays, with its other columns (columns of docs that have an added column's
    name are replaced); a text may become empty. Null text has 0 lines. Rows with a null
    doc_id are left as they are. Rows that repeat a doc_id count as the same document, so
    they keep the same lines.
    """
    scratch = Scratch(docs.sparkSession, "line_dedup")
    carried = [c for c in docs.columns if c not in ADDED]
    own, drops = fresh(docs.columns, "doc"), fresh(docs.columns, "drop")
    gone = duplicate_lines(docs, scratch, percent, min_words)
    few = gone.count() <= BROADCAST_IDS
    gone = gone.groupBy(F.col("doc_id").alias(own)).agg(
        F.collect_list("pos").alias(drops), F.sum(F.col("near").cast("bigint")).alias("__removed_near")
    )
    docs = docs.select(*carried)
    joined = docs.join(F.broadcast(gone) if few else gone, docs.doc_id.cast("bigint") == gone[own], "left").select(
        *carried,
        F.coalesce(F.size(drops), F.lit(0)).cast("bigint").alias("__removed"),
        F.coalesce("__removed_near", F.lit(0)).alias("__removed_near"),
        drops,
    )
    names = [c for c in joined.columns if c != drops]
    schema = T.StructType([*joined.select(*names).schema.fields, T.StructField("__lines", T.LongType())])
    return joined.mapInArrow(lambda b: tidy(_clean_batches(b, drops, names)), schema)


def drop_repeated_lines(docs: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with repeated lines removed; columns as in docs, n_chars (if any) as the new length.

    Documents that had text in lines and lost all of it go: all they held stands elsewhere.
    Columns of docs keep their values, whatever their names.
    """
    safe = {c: fresh(docs.columns, c) for c in ADDED if c in docs.columns}
    out = dedup_lines(docs.withColumnsRenamed(safe), percent, min_words).where((F.col("__removed") == 0) | (F.trim("text") != ""))
    if "n_chars" in docs.columns:
        new = F.when(F.col("__removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
        out = out.withColumn("n_chars", new)
    return out.select(*(F.col(safe.get(c, c)).alias(c) for c in docs.columns))
