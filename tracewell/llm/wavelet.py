"""Token ids in wavelet-matrix shards.

Texts are encoded with the tokenizers library, an end id is appended to each, and
runs of documents in doc_id order become shards.  A shard is one blob: the ids of
its documents as bit-planes, most significant first, each plane stably sorted by
the bits before it, with a count of ones for each block.  Access, counting and
occurrence lookup work on the packed planes through rank and select, of one shard
(``WaveletMatrix``) or of a table of shards (``count_tokens``, ``find_tokens``).  Blobs are
the rows of Parquet files in the shared folder, so any store that Spark reads
holds them and a lost task is run again without traces.

Blob: magic, bits, tokens n, documents d (little-endian 32-bit); d doc_ids (64-bit);
d token counts (32-bit); for each plane its zeros (32-bit), the ones before each
512-bit block (32-bit) and the packed bits.

Defined results: a null text is an empty one and has the end id alone; equal
doc_ids keep together in an order of their own; a null doc_id comes first and is
stored as the least 64-bit number; columns besides doc_id and text are ignored; an
empty table gives no shards and no rows.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import literal_tokens, splits_at_space
from .common import fresh_path, id_and_text, running_start, small_batches

MAGIC = b"TWM1"
BLOCK = 512
NULL_ID = -(1 << 63)
#: A shard is closed at this many ids.
SHARD_TOKENS = 1 << 20
END_ID = 2
#: Parts of texts that a worker keeps ids for, and the longest of them in characters.
CACHE_PARTS, CACHE_CHARS = 800_000, 48

SHARDS = "part int, seq int, n_docs int, n_tokens long, blob binary"
DOCS = "part int, seq int, doc_id long, inner long, n_tokens long, ids_crc32 long"


class WaveletMatrix:
    """A sequence of ids of at most 32 bits as bit-planes with rank and select."""

    def __init__(self, n: int, planes: list[tuple[int, np.ndarray, np.ndarray]]) -> None:
        self.n, self.planes = n, planes  # (zeros, ones before each block, packed bits)

    @classmethod
    def of(cls, ids: np.ndarray, bits: int = 16) -> WaveletMatrix:
        kind = np.uint16 if bits <= 16 else np.uint32
        row, planes = ids.astype(kind), []
        for level in range(bits - 1, -1, -1):
            on = (row & kind(1 << level)) != 0
            packed = np.packbits(on, bitorder="little")
            sums = np.add.reduceat(on, np.arange(0, len(on), BLOCK), dtype=np.uint32) if len(on) else np.zeros(0, np.uint32)
            before = np.concatenate([[0], np.cumsum(sums)]).astype(np.uint32)
            planes.append((len(on) - int(before[-1]), before, packed))
            row = np.concatenate([row.compress(~on), row.compress(on)])
        return cls(len(ids), planes)

    def to_bytes(self) -> bytes:
        return b"".join(struct.pack("<I", z) + before.astype("<u4").tobytes() + packed.tobytes() for z, before, packed in self.planes)

    @classmethod
    def from_bytes(cls, data: memoryview, n: int, bits: int) -> WaveletMatrix:
        planes, at, blocks, size = [], 0, -(-n // BLOCK) + 1, -(-n // 8)
        for _ in range(bits):
            (zeros,) = struct.unpack_from("<I", data, at)
            before = np.frombuffer(data, "<u4", blocks, at + 4)
            at += 4 + 4 * blocks
            planes.append((zeros, before, np.frombuffer(data, np.uint8, size, at)))
            at += size
        return cls(n, planes)

    @staticmethod
    def _bit(packed: np.ndarray, at: np.ndarray) -> np.ndarray:
        return (packed[at >> 3] >> (at & 7).astype(np.uint8)) & 1

    def _ones(self, plane: tuple, at: np.ndarray) -> np.ndarray:
        """Ones before each position: the block's count and the bits of the block up to it."""
        _, before, packed = plane
        block = at // BLOCK
        out = before[block].astype(np.int64)
        for i in range(BLOCK // 8):
            byte = block * (BLOCK // 8) + i
            left = np.clip(at - byte * 8, 0, 8)
            if not left.any():
                break
            value = packed[np.minimum(byte, max(len(packed) - 1, 0))] if len(packed) else np.zeros(len(at), np.uint8)
            out += np.bitwise_count(value & ((1 << left) - 1).astype(np.uint8))
        return out

    def access(self, at) -> np.ndarray:
        """The ids at the positions ``at``."""
        at = np.asarray(at, np.int64)
        out = np.zeros(len(at), np.int64)
        for plane in self.planes:
            bit = self._bit(plane[2], at).astype(np.int64)
            ones = self._ones(plane, at)
            at = np.where(bit == 1, plane[0] + ones, at - ones)
            out = out << 1 | bit
        return out

    def _range(self, token: int, low: int, high: int) -> tuple[int, int]:
        """Where ``token`` of the positions low to high stands after the last plane."""
        ends = np.array([low, high], np.int64)
        for i, plane in enumerate(self.planes):
            ones = self._ones(plane, ends)
            ends = plane[0] + ones if token >> (len(self.planes) - 1 - i) & 1 else ends - ones
        return int(ends[0]), int(ends[1])

    def count(self, token: int, low: int = 0, high: int | None = None) -> int:
        """How often ``token`` stands in positions low to high."""
        if token >> len(self.planes):
            return 0
        a, b = self._range(token, low, self.n if high is None else high)
        return b - a

    def _select(self, plane: tuple, rank: np.ndarray, bit: int) -> np.ndarray:
        """Positions of the ones (zeros) of a plane with these numbers: the block by the directory, then the bit in the block."""
        _, before, packed = plane
        ahead = before.astype(np.int64) if bit else np.arange(len(before), dtype=np.int64) * BLOCK - before
        block = np.searchsorted(ahead, rank, "right") - 1
        out = np.empty(len(rank), np.int64)
        size = BLOCK // 8
        for i in range(0, len(rank), 4096):
            own = block[i : i + 4096]
            place = np.minimum(own[:, None] * size + np.arange(size), len(packed) - 1)
            bits = np.unpackbits(packed[place], axis=1, bitorder="little") == bit
            wanted = rank[i : i + 4096] - ahead[own] + 1
            out[i : i + 4096] = own * BLOCK + (np.cumsum(bits, axis=1, dtype=np.int16) >= wanted[:, None]).argmax(1)
        return out

    def occurrences(self, token: int, low: int = 0, high: int | None = None) -> np.ndarray:
        """All positions of ``token``: select from the last plane back to the first."""
        if token >> len(self.planes):
            return np.zeros(0, np.int64)
        a, b = self._range(token, low, self.n if high is None else high)
        at = np.arange(a, b)
        for i in range(len(self.planes) - 1, -1, -1):
            bit = token >> (len(self.planes) - 1 - i) & 1
            at = self._select(self.planes[i], at - self.planes[i][0] if bit else at, bit)
        return np.sort(at)

    def all(self) -> np.ndarray:
        """The whole sequence: each plane, from the last, puts its two halves back in place."""
        kind = np.uint16 if len(self.planes) <= 16 else np.uint32
        row = np.zeros(self.n, kind)
        for level, (zeros, _, packed) in enumerate(reversed(self.planes)):
            on = np.unpackbits(packed, count=self.n, bitorder="little").astype(bool)
            back = np.empty_like(row)
            back[np.flatnonzero(~on)] = row[:zeros]
            back[np.flatnonzero(on)] = row[zeros:] | kind(1 << level)
            row = back
        return row


def pack_shard(doc_ids: list[int], counts: list[int], ids: np.ndarray, bits: int = 16) -> bytes:
    head = MAGIC + struct.pack("<III", bits, len(ids), len(doc_ids))
    return head + np.array(doc_ids, "<i8").tobytes() + np.array(counts, "<u4").tobytes() + WaveletMatrix.of(ids, bits).to_bytes()


def open_shard(blob: bytes) -> tuple[np.ndarray, np.ndarray, WaveletMatrix]:
    """doc_ids, token counts and the ids of a blob."""
    if blob[:4] != MAGIC:
        raise ValueError("not a token shard")
    bits, n, d = struct.unpack_from("<III", blob, 4)
    at = 16 + 12 * d
    return np.frombuffer(blob, "<i8", d, 16), np.frombuffer(blob, "<u4", d, 16 + 8 * d), WaveletMatrix.from_bytes(memoryview(blob)[at:], n, bits)


class Encoder:
    """The tokenizers library over the parts between white space, with a bounded table of parts met.

    Where white space is a boundary for the tokenizer, ids of a text are those of its parts in a row;
    of any other file the library takes the text as a whole.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.bits = max(1, (max(self.tokenizer.get_vocab(with_added_tokens=True).values()) | END_ID).bit_length())
        self.code, self.kind = ("H", "<u2") if self.bits <= 16 else ("I", "<u4")
        letters = "abcdefghijklmnopqrstuvwxyz" + "".join(c for c in map(chr, range(0xDF, 0x100)) if c.isalpha())
        level = ByteLevel(add_prefix_space=False, use_regex=False)
        self.as_bytes = {ord(c): level.pre_tokenize_str(c)[0][0] for c in letters}
        #: A Latin word and the marks after it, which the tokenizer parts there.
        self.word = re.compile(r"([A-Za-zß-öø-ÿÀ-ÖØ-Þ]+)([!-/:-@\[-`{-~]*)")
        #: Added tokens that a part, or its word and marks taken apart, could hide need whole texts.
        hidden = [t["content"] for t in spec.get("added_tokens") or [] if re.search(r"\s", t["content"]) or self.word.fullmatch(t["content"])]
        self.at_space = splits_at_space(spec) and literal_tokens(spec) and not hidden
        self.inner_space, self.separators = re.compile("[ \t\n\x0b\x0c\r]+"), re.compile("[\x1c-\x1f]")
        self.known: dict[str, bytes] = {}

    def _model(self, word: str) -> bytes:
        """One word, lower-cased: the library's model alone."""
        return array(self.code, [t.id for t in self.tokenizer.model.tokenize(word.lower().translate(self.as_bytes))]).tobytes()

    def _ids(self, part: str) -> bytes:
        known, m = self.known, self.word.fullmatch(part)
        if m is None:
            found = array(self.code, self.tokenizer.encode(part, add_special_tokens=False).ids).tobytes()
        else:
            word, marks = m.groups()
            found = known.get(word) or self._model(word)
            if marks:
                if len(word) <= CACHE_CHARS:
                    known[word] = found
                found += known.get(marks) or self._ids(marks)
        if len(part) <= CACHE_CHARS:
            known[part] = found
        return found

    def encode(self, text: str) -> bytes:
        """Little-endian ids of ``kind``."""
        if not self.at_space:
            return array(self.code, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        parts = self.inner_space.split(text.strip(" \t\n\x0b\x0c\r")) if self.separators.search(text) else text.split()
        found = list(map(self.known.get, parts))
        if None in found:
            ids, get = self._ids, self.known.get
            found = [x or get(p) or ids(p) for p, x in zip(parts, found)]
            if len(self.known) > CACHE_PARTS:
                self.known.clear()
        return b"".join(found)


@lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _writer(path: str, end_id: int, shard_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, coder = TaskContext.get().partitionId(), encoder(path)
        end, size = np.array([end_id], coder.kind).tobytes(), int(coder.kind[2])
        seq, doc_ids, counts, parts, held = 0, [], [], [], 0

        def shard() -> pa.RecordBatch:
            blob = pack_shard(doc_ids, counts, np.frombuffer(b"".join(parts), coder.kind), coder.bits)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([len(doc_ids)], pa.int32()), pa.array([held], pa.int64()), pa.array([blob], pa.binary())], ["part", "seq", "n_docs", "n_tokens", "blob"])

        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = coder.encode(text) + end
                doc_ids.append(NULL_ID if doc_id is None else doc_id)
                counts.append(len(ids) // size)
                parts.append(ids)
                held += len(ids) // size
                if held >= shard_tokens:
                    yield shard()
                    seq, doc_ids, counts, parts, held = seq + 1, [], [], [], 0
        if doc_ids:
            yield shard()

    return run


def write_shards(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Encode ``docs`` in doc_id order into shards under ``path`` and return them as they are read back."""
    spark = docs.sparkSession
    small_batches(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = id_and_text(docs).repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id")
    ordered.mapInArrow(_writer(tokenizer_path, end_id, shard_tokens), SHARDS).write.parquet(path)
    return spark.read.schema(SHARDS).parquet(path)


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for part, seq, blob in zip(*(c.to_pylist() for c in b.columns)):
            doc_ids, counts, matrix = open_shard(blob)
            ids = matrix.all().astype("<u4")
            ends = np.cumsum(counts, dtype=np.int64)
            starts = ends - counts
            crc = [zlib.crc32(ids[a:z]) for a, z in zip(starts.tolist(), ends.tolist())]
            n = len(doc_ids)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(n, part, np.int32)), pa.array(np.full(n, seq, np.int32)), pa.array([None if d == NULL_ID else d for d in doc_ids.tolist()], pa.int64()),
                    pa.array(starts), pa.array(counts.astype(np.int64)), pa.array(crc, pa.int64()),
                ],
                ["part", "seq", "doc_id", "inner", "n_tokens", "ids_crc32"],
            )


def read_report(shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 for each document, from the shards alone."""
    sizes = shards.select("part", "seq", "n_tokens")
    parts = running_start(sizes.groupBy("part").agg(F.sum("n_tokens").alias("_n")), "part", "_n", "_part_start").drop("_n")
    within = F.expr("coalesce(sum(n_tokens) over (partition by part order by seq rows between unbounded preceding and 1 preceding), 0)")
    starts = sizes.withColumn("_inside", within).join(parts, "part").select("part", "seq", (F.col("_part_start") + F.col("_inside")).alias("_start"))
    docs = shards.select("part", "seq", "blob").mapInArrow(_reader, DOCS)
    return docs.join(starts, ["part", "seq"]).select("doc_id", (F.col("_start") + F.col("inner")).cast("long").alias("start"), "n_tokens", "ids_crc32")


def token_report(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID) -> DataFrame:
    """Write the shards of ``docs`` to the shared folder and report on them as read back."""
    return read_report(write_shards(docs, fresh_path(docs.sparkSession, "tokens"), tokenizer_path, end_id))


def count_tokens(shards: DataFrame, tokens: list[int]) -> DataFrame:
    """token and n, its places in all shards, for each of ``tokens``; by rank alone. A token of no shard has 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for blob in b.column(0).to_pylist():
                matrix = open_shard(blob)[2]
                yield pa.RecordBatch.from_arrays([pa.array(tokens, pa.int64()), pa.array([matrix.count(t) for t in tokens], pa.int64())], ["token", "n"])

    spark = shards.sparkSession
    none = spark.createDataFrame([(t, 0) for t in tokens], "token long, n long")
    return shards.select("blob").mapInArrow(run, "token long, n long").unionByName(none).groupBy("token").agg(F.sum("n").alias("n"))


def find_tokens(shards: DataFrame, tokens: list[int]) -> DataFrame:
    """token, doc_id and place within the document of every occurrence of ``tokens``; by rank and select."""
    kinds = [pa.int64(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for blob in b.column(0).to_pylist():
                doc_ids, counts, matrix = open_shard(blob)
                ends = np.cumsum(counts, dtype=np.int64)
                for t in tokens:
                    at = matrix.occurrences(t)
                    doc = np.searchsorted(ends, at, "right")
                    ids = [None if d == NULL_ID else d for d in doc_ids[doc].tolist()]
                    columns = [[t] * len(at), ids, (at - (ends - counts)[doc]).tolist()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["token", "doc_id", "place"])

    return shards.select("blob").mapInArrow(run, "token long, doc_id long, place long")
