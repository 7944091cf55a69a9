"""Best-fit packing of documents into sequences by a grouping genetic algorithm on islands.

A document's ids (and its end id) are one piece, or pieces of ``CAPACITY`` tokens where it is longer, of
which the first may be shorter.  A whole piece is a sequence of its own.  All others are dealt by a hash of
their row into blocks of about ``BLOCK_ITEMS`` pieces; each block is packed by ``ISLANDS`` islands.

An individual is a grouping of a block's pieces into bins.  Crossover injects whole well-filled bins of one parent
into the other, takes out the bins of the other that hold a piece twice, and best-fits the displaced pieces,
longest first; mutation dissolves the emptiest bins and some others.  Fitness is the mean of the squared fill, so
that free space gathers in few bins.  After each epoch the elite of every island moves to the next one
(a join on block and island); a block ends when an island meets the lower bound of Martello and Toth.

A block loses less than a bin to rounding when it meets its bound.  Rounds win that back: the emptiest bins of every block
(at most ``RESIDUE_ITEMS`` pieces) are dissolved and dealt into new blocks, until one block is left.

Shape of the job: one pass over the documents writes the pieces (some 40 bytes each); every round shuffles pieces by block and
writes the state of islands and the places to the shared folder, so a lost executor repeats one epoch of its blocks.
Blocks are bounded whatever the input, since every piece has a key of its own.

Defined results: a null text is empty, and an empty document is its end id alone; rows that repeat a doc_id or have none are
packed each for itself; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_path, id_and_text, small_batches, written

CAPACITY, END_ID = 2048, 0
BLOCK_ITEMS, RESIDUE_ITEMS = 4096, 128
ISLANDS, POPULATION, EPOCHS, GENERATIONS = 4, 8, 3, 20
#: Crossover injects up to this share of a parent's bins, mutation dissolves up to this share.
INJECTED, DISSOLVED = 0.1, 0.05

PIECE = "key long, doc_id long, piece int, start long, length int, ids_crc32 long"
ISLAND = "block long, island int, bound int, bins int, fitness double, lengths binary, elite binary, population binary"
PLACED = f"{PIECE}, sequence_id long, offset long, closed boolean"


# --- pieces


def ranks_of(spec: dict, tokenizer) -> dict[bytes, int] | None:
    """Bytes and rank of each token of a byte-level BPE file, or None where merging by ranks could differ from its merges.

    The library merges listed pairs in the order of the list; merging by ranks takes any pair whose bytes are a token, lowest id
    first.  Both are the same if ids rise with the list and the library itself reaches every token from the token's own bytes:
    then two neighbours whose bytes make a token are always the listed pair of it.
    """
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    plain = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    level = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space", True)
    if not plain or not level or spec.get("normalizer") is not None or spec.get("post_processor") is not None:
        return None
    vocab, seen = model["vocab"], [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {chr(b): b for b in seen} | {chr(0x100 + i): b for i, b in enumerate(sorted({*range(256)} - {*seen}))}
    products = [vocab.get(m.replace(" ", "") if isinstance(m, str) else "".join(m), -1) for m in model["merges"]]
    if not all(a < b for a, b in zip([-1, *products], products)) or len(products) + 256 != len(vocab) or any(c not in letters for t in vocab for c in t):
        return None
    if any([t.id for t in tokenizer.model.tokenize(token)] != [i] for token, i in vocab.items()):
        return None
    return {bytes(letters[c] for c in token): i for token, i in vocab.items()}


class Encoder:
    """Ids as little-endian 32-bit integers, equal to the library's ``encode(text, add_special_tokens=False)``.

    A byte-level BPE file whose merges are shown to be ranks is merged by ranks, which takes less than half the time. Texts with
    letters beyond the Latin blocks (whose classes the two libraries may know from other versions of Unicode) or with a
    token added to the vocabulary, stretches that are too long for the pattern, and all other files go to the library itself.
    """

    # Fixed value: how a byte-level tokenizer parts a text.
    PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        ranks = ranks_of(spec, self.tokenizer)
        self.by_rank = None
        if ranks is not None:
            import tiktoken

            self.by_rank = tiktoken.Encoding("ranks", pat_str=self.PATTERN, mergeable_ranks=ranks, special_tokens={})
        added = [re.escape(t["content"]) for t in spec.get("added_tokens") or []]
        self.beyond = re.compile("|".join(["[^\\x00-\u02ff]", *added]))

    def ask(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(self, text: str) -> bytes:
        if self.by_rank is None or self.beyond.search(text):
            return self.ask(text)
        try:
            return self.by_rank.encode_to_numpy(text).astype("<u4", copy=False).tobytes()
        except ValueError:  # its pattern gives up on very long runs of space
            return self.ask(text)


@lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """Start and length of the pieces of ``n`` tokens; only the first may be shorter than the capacity where there are several."""
    head = n % capacity or capacity
    return [(0, head), *((a, capacity) for a in range(head, n, capacity))]


def _piece_batches(path: str, capacity: int, end_id: int, with_ids: bool, rows_a_batch: int = 4096):
    end = array("I", [end_id]).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, key = encoder(path), TaskContext.get().partitionId() << 40
        rows: list[tuple] = []

        def full() -> pa.RecordBatch:
            kinds = [("key", pa.int64()), ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int32()), ("ids_crc32", pa.int64())]
            kinds += [("ids", pa.list_(pa.int32()))] * with_ids
            return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, (_, kind) in zip(zip(*rows), kinds)], [name for name, _ in kinds])

        for b in batches:
            for doc_id, text in zip(b.column(0), b.column(1)):
                ids = memoryview(coder.encode(text.as_py()) + end)
                doc_id = doc_id.as_py()
                for piece, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                    part = ids[4 * start : 4 * (start + length)]
                    rows.append((key, doc_id, piece, start, length, zlib.crc32(part), *[np.frombuffer(part, "<u4").astype(np.int32)] * with_ids))
                    key += 1
                    if len(rows) >= rows_a_batch:
                        yield full()
                        rows = []
        if rows:
            yield full()

    return run


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Encode every document and write its pieces, each with a key of its own; with their ids where asked."""
    small_batches(docs.sparkSession)
    schema = PIECE + ", ids array<int>" * with_ids
    return written(id_and_text(docs).mapInArrow(_piece_batches(tokenizer_path, capacity, end_id, with_ids), schema), "pieces")


# --- the genetic algorithm on one block; pieces are numbered from the longest


def least_bins(lengths: np.ndarray, capacity: int) -> int:
    """The bound L2: for each threshold t, pieces over capacity - t stand alone, those over half need a bin each, and what
    of the others from t on does not fit beside these needs more."""
    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=capacity + 1)
    upto, mass = np.cumsum(count), np.cumsum(count * np.arange(capacity + 1))
    half = capacity // 2
    t = np.arange(0, half + 1)
    below = np.maximum(t - 1, 0)
    large = upto[capacity] - upto[half]
    beside = large - (upto[capacity] - upto[capacity - t])
    room = beside * capacity - (mass[capacity - t] - mass[half])
    small = mass[half] - np.where(t > 0, mass[below], 0)
    return int((large + np.maximum(0, -(-(small - room) // capacity))).max())


def best_fit(lengths: list[int], items: list[int], groups: np.ndarray, loads: list[int], capacity: int) -> None:
    """Put ``items`` in turn into the fullest bin that has room, else into a new one; ``groups`` and ``loads`` are changed."""
    free: dict[int, list[int]] = {}
    rooms = 0  # bit r: a bin with r tokens of room
    for b, load in enumerate(loads):
        if load < capacity:
            free.setdefault(capacity - load, []).append(b)
            rooms |= 1 << (capacity - load)
    for i in items:
        size = lengths[i]
        fits = rooms >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            same = free[room]
            b = same.pop()
            if not same:
                rooms ^= 1 << room
        else:
            b, room = len(loads), capacity
            loads.append(0)
        groups[i] = b
        loads[b] += size
        room -= size
        if room:
            free.setdefault(room, []).append(b)
            rooms |= 1 << room


class Block:
    """The pieces of a block, from the longest, and what an island does with them."""

    def __init__(self, lengths: np.ndarray, capacity: int, seed: list[int]):
        self.lengths, self.plain, self.capacity = lengths.astype(np.int64), lengths.tolist(), capacity
        self.rng, self.bound = np.random.default_rng(seed), least_bins(lengths, capacity)

    def loads(self, groups: np.ndarray) -> np.ndarray:
        return np.bincount(groups, self.lengths).astype(np.int64)

    def fitness(self, groups: np.ndarray) -> float:
        return float(np.square(self.loads(groups) / self.capacity).mean()) if len(groups) else 1.0

    def packed(self, items: list[int]) -> np.ndarray:
        groups, loads = np.zeros(len(self.plain), np.uint16), []
        best_fit(self.plain, items, groups, loads, self.capacity)
        return groups

    def first(self, exact: bool) -> np.ndarray:
        """Best fit from the longest piece, or in an order near to that."""
        n = len(self.plain)
        return self.packed(list(range(n)) if exact else np.argsort(-self.lengths * self.rng.uniform(0.8, 1.2, n), kind="stable").tolist())

    def _rebuilt(self, groups: np.ndarray, gone: np.ndarray, apart: np.ndarray, number: np.ndarray, n_new: int) -> np.ndarray:
        """Bins of ``gone`` are taken out, pieces ``apart`` get the new bins ``number``, what is left is best-fitted."""
        kept = np.cumsum(~gone) - 1
        out = kept[groups].astype(np.uint16)
        out[apart] = (kept[-1] + 1 + number[apart]).astype(np.uint16)
        displaced = gone[groups] & ~apart
        loads = np.bincount(out[~displaced], self.lengths[~displaced], minlength=int(kept[-1]) + 1 + n_new).astype(int).tolist()
        best_fit(self.plain, np.flatnonzero(displaced).tolist(), out, loads, self.capacity)
        return out

    def crossover(self, into: np.ndarray, giver: np.ndarray) -> np.ndarray:
        loads = self.loads(giver)
        well = np.flatnonzero(loads >= max(np.median(loads), 1))
        chosen = self.rng.choice(well, self.rng.integers(1, max(2, int(len(loads) * INJECTED)) + 1) % (len(well) + 1) or 1, replace=False)
        number = np.full(len(loads), -1)
        number[chosen] = np.arange(len(chosen))
        number = number[giver]
        apart = number >= 0
        gone = np.zeros(int(into.max()) + 1, bool)
        gone[into[apart]] = True
        return self._rebuilt(into, gone, apart, number, len(chosen))

    def mutation(self, groups: np.ndarray) -> np.ndarray:
        loads = self.loads(groups)
        some = max(2, int(len(loads) * self.rng.uniform(0, DISSOLVED)))
        gone = np.zeros(len(loads), bool)
        gone[np.argsort(loads, kind="stable")[:some]] = True
        gone[self.rng.integers(0, len(loads), some)] = True
        none = np.zeros(len(groups), bool)
        return self._rebuilt(groups, gone, none, np.zeros(len(groups), int), 0)

    def evolved(self, population: list[np.ndarray], size: int, generations: int) -> list[np.ndarray]:
        """Fill the population up, then breed; ends early at the bound.  The best individual comes first."""
        done = lambda g: int(g.max()) + 1 <= self.bound
        scored = [(self.fitness(g), g) for g in population]
        while len(scored) < size and not any(done(g) for _, g in scored):
            g = self.first(exact=not scored)
            scored.append((self.fitness(g), g))
        scored.sort(key=lambda x: -x[0])
        for _ in range(generations * size):
            if done(scored[0][1]) or len(scored) < 2:
                break
            a, b = (min(self.rng.integers(0, len(scored), 2)) for _ in range(2))
            child = self.crossover(scored[a][1], scored[b][1]) if self.rng.random() < 0.8 else self.mutation(scored[a][1])
            value = self.fitness(child)
            if value > scored[-1][0] and all(value != v for v, _ in scored):
                scored[-1] = (value, child)
                scored.sort(key=lambda x: -x[0])
        return [g for _, g in scored]


# --- islands as rows


def _epoch(epoch: int, capacity: int, population: int, generations: int):
    """Rows (block, island, lengths, population, migrant) evolve for one epoch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for block, island, lengths, people, migrant in zip(*(c.to_pylist() for c in b.columns)):
                sizes = np.frombuffer(lengths, "<u2")
                here = Block(sizes, capacity, [block, island, epoch])
                held = list(np.frombuffer(people, "<u2").reshape(-1, len(sizes))) if people else []
                if migrant and len(held) > 1:
                    held[-1] = np.frombuffer(migrant, "<u2")
                found = here.evolved(held, population, generations) if len(sizes) else [np.zeros(0, np.uint16)]
                best = found[0]
                rows.append((block, island, here.bound, int(best.max()) + 1, here.fitness(best), lengths, best.tobytes(), np.stack(found).tobytes()))
            names = [f.split()[0] for f in ISLAND.split(", ")]
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.binary(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names)

    return run


def _lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lengths of a block's pieces (already from the longest) as 16-bit integers."""
    for b in batches:
        packed = [np.asarray(x, "<u2").tobytes() for x in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(packed, pa.binary())], ["block", "lengths"])


def winners(blocks: DataFrame, capacity: int, islands: int, population: int, epochs: int, generations: int) -> DataFrame:
    """block and the best grouping that any island found for it."""
    base = blocks.select("block", F.expr("transform(items, x -> x.length)").alias("lengths")).mapInArrow(_lengths, "block long, lengths binary")
    state = base.select("block", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"), "lengths", F.lit(None).cast("binary").alias("population"), F.lit(None).cast("binary").alias("migrant"))
    found = None
    for epoch in range(epochs):
        made = written(state.mapInArrow(_epoch(epoch, capacity, population, generations), ISLAND), "islands")
        best = made.select("block", "bins", "fitness", "elite")
        found = best if found is None else found.unionByName(best)
        open_blocks = made.groupBy("block").agg(F.min("bins").alias("least"), F.max("bound").alias("bound")).where("least > bound").select("block")
        if epoch == epochs - 1 or open_blocks.isEmpty():
            break
        migrants = made.select("block", F.expr(f"cast(pmod(island + 1, {islands}) as int)").alias("island"), F.col("elite").alias("migrant"))
        state = made.join(open_blocks, "block").join(migrants, ["block", "island"]).select("block", "island", "lengths", "population", "migrant")
    return found.groupBy("block").agg(F.max_by("elite", F.struct(-F.col("bins"), "fitness")).alias("elite"))


def _places(round_: int, capacity: int, residue: int):
    """A row for each piece of a block: its bin, its place there, and whether the bin stays closed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, items, elite in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist()):
                fields = items.values.flatten()  # length, key, doc_id, piece, start, ids_crc32
                lengths, groups = fields[0].to_numpy(zero_copy_only=False).astype(np.int64), np.frombuffer(elite, "<u2").astype(np.int64)
                order = np.argsort(groups, kind="stable")
                before = np.cumsum(lengths[order]) - lengths[order]
                loads = np.bincount(groups, lengths)
                offsets = np.empty_like(before)
                offsets[order] = before - (np.cumsum(loads) - loads).astype(np.int64)[groups[order]]
                fullest = np.argsort(loads, kind="stable")
                held = np.cumsum(np.bincount(groups)[fullest])
                opened = np.zeros(len(loads), bool)
                opened[fullest[(held <= residue) & (loads[fullest] < capacity)]] = True
                yield pa.RecordBatch.from_arrays(
                    [
                        fields[1], fields[2], fields[3], fields[4], fields[0], fields[5], pa.array((round_ << 56) + (block << 16) + groups), pa.array(offsets), pa.array(~opened[groups]),
                    ],
                    [f.split()[0] for f in PLACED.split(", ")],
                )

    return run


def placed(
    made: DataFrame, capacity: int = CAPACITY, block_items: int = BLOCK_ITEMS, islands: int = ISLANDS, population: int = POPULATION, epochs: int = EPOCHS, generations: int = GENERATIONS,
) -> DataFrame:
    """``pieces`` with their sequence_id and offset; sequences hold at most ``capacity`` (under 65,536) tokens without gaps."""
    fields = [f.split()[0] for f in PIECE.split(", ")]
    whole = made.where(F.col("length") == capacity).select(*fields, (-1 - F.col("key")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    open_, out, round_ = made.where(F.col("length") < capacity).select(*fields), whole, 0
    while True:
        n = open_.count()
        if not n:
            return out
        n_blocks = -(-n // block_items)
        item = F.struct("length", "key", "doc_id", "piece", "start", "ids_crc32")
        dealt = open_.withColumn("block", F.pmod(F.xxhash64("key", F.lit(round_)), F.lit(n_blocks)))
        blocks = written(dealt.groupBy("block").agg(F.sort_array(F.collect_list(item), asc=False).alias("items")), "blocks")
        found = winners(blocks, capacity, islands, population, epochs, generations)
        residue = RESIDUE_ITEMS if n_blocks > 1 else 0
        result = written(blocks.join(found.hint("merge"), "block").select("block", "items", "elite").mapInArrow(_places(round_, capacity, residue), PLACED), "places")
        out = out.unionByName(result.where("closed").select(*fields, "sequence_id", "offset"))
        open_, round_ = result.where("not closed").select(*fields), round_ + 1


def sequences(made: DataFrame, places: DataFrame) -> DataFrame:
    """sequence_id, length and the packed ids of each sequence, from pieces that were made with their ids."""
    rows = made.select("key", "ids").join(places.select("key", "sequence_id", "offset"), "key")
    whole = rows.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("held"))
    return whole.select("sequence_id", F.expr("flatten(transform(held, x -> x.ids))").alias("ids")).withColumn("length", F.size("ids").cast("long"))


def report(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for each piece."""
    places = placed(pieces(docs, tokenizer_path, capacity, end_id), capacity)
    return places.select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", "offset")
