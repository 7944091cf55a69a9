"""Benchmark decontamination by q-gram lemma filtering.

An occurrence of an item of m characters with at most k edits shares at least
m - q + 1 - k*q of its q-grams with the text, on diagonals that lie within k of one
another.  The q-grams of a text are looked up among those of the items, the hits of
each item are counted in diagonal bands that overlap by half, and bands that reach
the bound are verified by an alignment restricted to the band.  Items are the
stated query set: they go out in blocks of bounded size and every block meets every
document.

Texts and items are compared as their words (letters and digits) in lower case,
joined by one space.

Defined results: null and empty texts have no match; an item of fewer than q
characters is found only where it is the whole text, one too short for its share of
edits is looked for by shorter grams, for which the lemma still has a bound; equal items match alike; every place of an
item that does not overlap a better one is a row; repeated rows repeat; columns
besides doc_id and text (item_id and text) are ignored; empty tables give no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, small_batches

Q = 8
#: Edits allowed for each character of an item.
EDIT_SHARE = 0.1
#: Characters of items in one block.
BLOCK_CHARS = 4_000_000
#: Letters and diagonals of the bands that are aligned at once.
ALIGN_CELLS = 2_000_000

MATCHES = "doc_id long, item_id long, start int, stop int, edits int"

_words = re.compile(r"[^\W_]+")
_factor = 0x9E3779B97F4A7C15


def normalise(text: str) -> str:
    return " ".join(_words.findall(text.lower()))


def original_span(text: str, start: int, stop: int) -> tuple[int, int]:
    """Code points of ``text`` that the span of its normal form covers."""
    lower, place = text.lower(), None
    if len(lower) != len(text):
        place = [i for i, c in enumerate(text) for _ in c.lower()]
        lower = "".join(c.lower() for c in text)
    at, first, last = 0, None, 0
    for m in _words.finditer(lower):
        end = at + len(m[0])
        if end > start and at < stop:
            first = m.start() + max(0, start - at) if first is None else first
            last = m.start() + min(len(m[0]), stop - at)
        at = end + 1
        if at >= stop:
            break
    first = 0 if first is None else first
    return (place[first], place[last - 1] + 1) if place and last else (first, last)


def letters(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def grams(codes: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit number for each q-gram: a polynomial in its code points, built by doubling lengths."""
    if len(codes) < q:
        return np.zeros(0, np.uint64)
    base = np.uint64(_factor)
    power, size = codes.astype(np.uint64) * base + np.uint64(0x632BE59BD9B4E019), 1
    out, have, step = None, 0, base
    with np.errstate(over="ignore"):
        while True:
            if q & size:
                out = power if out is None else out[: len(codes) - have - size + 1] * step + power[have:][: len(codes) - have - size + 1]
                have += size
            size *= 2
            if size > q:
                break
            power = power[: -(size // 2)] * step + power[size // 2 :]
            step *= step
    return out[: len(codes) - q + 1]


@dataclass
class Items:
    """A block of items with the table of their q-grams."""

    ids: list[int]
    codes: list[np.ndarray]
    q: int = Q
    edit_share: float = EDIT_SHARE

    def __post_init__(self) -> None:
        q, sizes = self.q, np.array([len(c) for c in self.codes], np.int64)
        self.sizes = sizes
        self.edits = np.minimum((sizes * self.edit_share).astype(np.int64), np.maximum((sizes - q) // q, 0))
        self.least = np.maximum(sizes - q + 1 - self.edits * q, 1)
        self.width = self.edits + 1
        found = [grams(c, q) for c in self.codes]
        gram = np.concatenate([*found, np.zeros(0, np.uint64)])
        order = np.argsort(gram, kind="stable")
        self.gram, first = np.unique(gram[order], return_index=True)
        self.item = np.repeat(np.arange(len(found)), [len(g) for g in found])[order]
        self.place = np.concatenate([*[np.arange(len(g)) for g in found], np.zeros(0, np.int64)]).astype(np.int64)[order]
        self.first = np.r_[first, len(gram)].astype(np.int64)
        self.table_bits = max(20, (8 * len(self.gram)).bit_length())  # at most one slot of four is taken
        self.table = np.zeros(1 << self.table_bits, bool)
        self.table[self.slot(self.gram)] = True

    def slot(self, gram: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((gram ^ gram >> np.uint64(29)) * np.uint64(_factor) >> np.uint64(64 - self.table_bits)).astype(np.int64)

    def hits(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text position, item and item position of every shared q-gram."""
        gram = grams(codes, self.q)
        at = np.flatnonzero(self.table[self.slot(gram)])
        near = np.searchsorted(self.gram, gram[at])
        same = self.gram[np.minimum(near, len(self.gram) - 1)] == gram[at]
        at, near = at[same], near[same]
        n = self.first[near + 1] - self.first[near]
        row = np.repeat(self.first[near] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum()) if len(n) else np.zeros(0, np.int64)
        return np.repeat(at, n), self.item[row], self.place[row]

    def regions(self, codes: np.ndarray) -> list[tuple[int, int]]:
        """(item, first diagonal) of the bands that reach the bound."""
        at, item, place = self.hits(codes)
        enough = np.bincount(item, minlength=len(self.ids)) >= self.least
        keep = enough[item]
        if not keep.any():
            return []
        at, item, place = at[keep], item[keep], place[keep]
        width, shift = self.width[item], int(self.sizes.max())
        band = (at - place + shift) // width
        span = int(len(codes) + shift) + 2
        key = np.concatenate([item * span + band, item * span + band - 1])  # a diagonal lies in two bands
        at, place = np.tile(at, 2), np.tile(place, 2)
        full = self.least[key // span] <= self._groups(key)
        key, sides = key[full], (at[full], place[full])
        full = np.ones(len(key), bool)
        for side in sides if len(key) else ():  # q-grams of an alignment stand at places of their own on either side
            own = np.unique(key * (int(side.max()) + 1) + side, return_index=True)[1]
            kept, n = np.unique(key[own], return_counts=True)
            full &= n[np.searchsorted(kept, key)] >= self.least[key // span]
        return [(int(k // span), int(k % span) * int(self.width[k // span]) - shift) for k in np.unique(key[full])]

    @staticmethod
    def _groups(key: np.ndarray) -> np.ndarray:
        """For each row, how many have its key."""
        _, back, n = np.unique(key, return_inverse=True, return_counts=True)
        return n[back]

    def align(self, codes: np.ndarray, found: list[tuple[int, int]]) -> Iterator[tuple[int, int, int, int]]:
        """item, start, stop, edits of the best place on the diagonals of each band, if within the budget. Bands of items of one length go together."""
        by_size: dict[int, list[tuple[int, int]]] = {}
        for item, diagonal in found:
            by_size.setdefault(int(self.sizes[item]), []).append((item, diagonal))
        for size, bands in by_size.items():
            k, w = int(self.edits[bands[0][0]]), int(self.width[bands[0][0]])
            step = max(1, ALIGN_CELLS // (2 * w + 2 * k + 1 + size))
            for i in range(0, len(bands), step):
                yield from self._align(codes, np.array(bands[i : i + step], np.int64), size, k, w)

    def _align(self, codes: np.ndarray, bands: np.ndarray, size: int, k: int, w: int) -> Iterator[tuple[int, int, int, int]]:
        items, diagonal = bands.T
        which, back = np.unique(items, return_inverse=True)
        wanted = np.stack([self.codes[i] for i in which.tolist()])[back]
        start, left = np.full(len(items), -1, np.int64), np.arange(len(items))
        for offset in range(2 * w):  # exact places first
            at = diagonal[left] + offset
            held = (at >= 0) & (at + size <= len(codes))
            held[held] = codes[at[held]] == wanted[left[held], 0]
            held[held] = (codes[at[held][:, None] + np.arange(size)] == wanted[left[held]]).all(axis=1)
            start[left[held]] = at[held]
            left = left[~held]
        yield from ((int(items[i]), int(start[i]), int(start[i]) + size, 0) for i in np.flatnonzero(start >= 0))
        if not len(left):
            return
        low, slides = diagonal[left] - k, 2 * w + 2 * k + 1
        at = low[:, None] + np.arange(slides + size)
        end, edits = banded(wanted[left], _letters_at(codes, at, (at >= 0) & (at < len(codes))), np.zeros((len(left), slides), np.int64))
        stop = np.clip(low + end + size, 0, len(codes))
        good = edits <= k
        left, stop, edits = left[good], stop[good], edits[good]
        if not len(left):
            return
        # the start: the same backwards from the stop, where the part begins there
        part = np.minimum(stop, size + k)
        at = np.arange(2 * k + 1 + size) - k
        first = np.abs(np.arange(-k, k + 1))
        first[:k] = 1 << 30
        end, _ = banded(wanted[left][:, ::-1], _letters_at(codes, stop[:, None] - 1 - at, (at >= 0) & (at < part[:, None])), np.tile(first, (len(left), 1)))
        length = np.clip(end - k + size, 0, part)
        yield from zip(items[left].tolist(), (stop - length).tolist(), stop.tolist(), edits.tolist())


def _letters_at(codes: np.ndarray, at: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Letters at the places; one that equals none where a place is not held."""
    if not len(codes):
        return np.full(at.shape, 0xFFFFFFFF, np.uint32)
    return np.where(held, codes[np.clip(at, 0, len(codes) - 1)], np.uint32(0xFFFFFFFF))


def banded(wanted: np.ndarray, reach: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Last diagonal (counted from the band's lowest) and edits of the best alignment of all of each item in its band.

    Rows are bands: ``wanted`` has the letters of the items, ``reach`` those of the text from the band's
    first column on, ``row`` what it costs to begin on each diagonal. Of equal ends the first. Beyond
    the ends of the text stand letters that equal none, at the price of leaving out a letter of the item.
    """
    slide = np.arange(row.shape[1])
    for i in range(wanted.shape[1]):
        new = row + (reach[:, i : i + len(slide)] != wanted[:, i : i + 1])
        np.minimum(new[:, :-1], row[:, 1:] + 1, out=new[:, :-1])  # a letter of the item is missing in the text
        row = np.minimum.accumulate(new - slide, axis=1) + slide  # letters that the item lacks
    at = row.argmin(axis=1)
    return at, row[np.arange(len(row)), at]


@dataclass
class Block:
    """The items of a block: those that are searched, by the length of their q-grams, and those that must be the whole text."""

    sets: list[Items]
    whole: dict[str, list[int]]

    @classmethod
    def of(cls, rows: list[tuple[int, str]], q: int = Q, edit_share: float = EDIT_SHARE) -> Block:
        by_q: dict[int, list[tuple[int, np.ndarray]]] = {}
        whole: dict[str, list[int]] = {}
        for item_id, text in rows:
            words = normalise(text)
            if len(words) >= q:
                # m characters with k edits share a gram of q or fewer for certain only if q <= m / (k + 1)
                own = min(q, len(words) // (int(len(words) * edit_share) + 1))
                by_q.setdefault(max(1, own), []).append((item_id, letters(words)))
            elif words:
                whole.setdefault(words, []).append(item_id)
        return cls([Items([i for i, _ in found], [c for _, c in found], own, edit_share) for own, found in sorted(by_q.items())], whole)


def search(text: str, block: Block) -> list[tuple[int, int, int, int]]:
    """(item_id, start, stop, edits) in the original text; of overlapping places of an item the best stays."""
    words = normalise(text)
    codes, out = letters(words), []
    for items in block.sets:
        if len(codes) < items.q:
            continue
        found: dict[int, list] = {}
        for item, *place in items.align(codes, items.regions(codes)):
            found.setdefault(item, []).append(tuple(place))
        for item, places in found.items():
            chosen: list[tuple[int, int, int]] = []
            for start, stop, edits in sorted(set(places), key=lambda p: (p[2], p[0], p[1])):
                if all(stop <= a or start >= z for a, z, _ in chosen):
                    chosen.append((start, stop, edits))
            out += [(items.ids[item], *original_span(text, start, stop), edits) for start, stop, edits in chosen]
    out += [(item_id, *original_span(text, 0, len(words)), 0) for item_id in block.whole.get(words, ())]
    return sorted(out)


def _blocks(benchmark: DataFrame, q: int, edit_share: float) -> Iterator[Block]:
    """The items in blocks; each holds about ``BLOCK_CHARS`` characters, whatever their number."""
    items = benchmark.where("text is not null and item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-total // BLOCK_CHARS)
    for i in range(n):
        rows = items.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == i).orderBy("item_id", "text").collect()  # one block
        if rows:
            yield Block.of([(r.item_id, r.text) for r in rows], q, edit_share)


def matches(docs: DataFrame, benchmark: DataFrame, q: int = Q, edit_share: float = EDIT_SHARE) -> DataFrame:
    """doc_id, item_id, start, stop (code points of the text) and edits for each place of an item."""
    spark = docs.sparkSession
    small_batches(spark)

    def scan(block: Block) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows = [(d, *place) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for place in search(t, block)]
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["doc_id", "item_id", "start", "stop", "edits"])

        return id_and_text(docs).mapInArrow(run, MATCHES)

    found = [scan(block) for block in _blocks(benchmark, q, edit_share)]
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], MATCHES)


def keep_clean(docs: DataFrame, benchmark: DataFrame, q: int = Q, edit_share: float = EDIT_SHARE) -> DataFrame:
    """``docs`` without those that hold an item, in one pass for each block; all columns stay as they are."""
    small_batches(docs.sparkSession)
    at = docs.columns.index("text")

    def without(block: Block):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield b.filter(pa.array([not search(t or "", block) for t in b.column(at).to_pylist()], pa.bool_()))

        return run

    for block in _blocks(benchmark, q, edit_share):
        docs = docs.mapInArrow(without(block), docs.schema)
    return docs
