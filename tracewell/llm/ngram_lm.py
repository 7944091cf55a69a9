"""Stupid-backoff scores: a table of n-gram counts joined to the n-grams of documents.

A word's score is c(context word) / c(context) for the longest context with a count,
times ``backoff`` for each word that the context had to give up; a lone word has its
share of all words, half an occurrence at least.  By default counts are over all
documents but the one that is scored, so no text vouches for itself; with
``leave_out=False`` they are over all documents, as in the plain form.

1. Documents are gathered to batches, so that common n-grams leave a batch once.  A
   batch is named by its content and dealt out once, in a shuffle that all later steps
   read; if lost files of it were made again in another order of rows, the names would
   not meet and the job would fail rather than count wrongly.
2. Where the scored document is left out, an n-gram of one document counts for
   nothing.  Each batch sends short hashes of its n-grams, as sorted sets, and learns
   which of them another batch has too.  Equal hashes of different n-grams only let
   more through.
3. The n-grams that are left are dealt to the bucket that their hash names, as
   compressed lists of their words.  A task has the table of counts of one bucket and
   order at a time, bounded by PART_WORDS: counts are summed over equal n-grams, told
   apart by their words, and the table is joined to each list where it is.
4. The totals go back to the batches, in the order asked, and these add up their
   documents.

Words are what stands between ASCII white space, ASCII letters in lower case.

Defined results: null, empty and blank texts have no words and score 0; very long
texts are one document like others; a repeated row is another document; columns
besides doc_id and text are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, small_batches

ORDER, BACKOFF = 3, 0.4
#: Bytes of text in one batch, unless one document has more.
BATCH_BYTES = 6 << 20
#: Words of the corpus for each part of the hashes and each bucket of the count table.
PART_WORDS = 1 << 20

BATCHES = "batch long, doc_ids binary, sizes binary, texts binary"
HASHES = "part int, n int, batch long, hashes binary"
SHARED = "batch long, n int, part int, bits binary"
ASKED = "bucket int, batch long, n int, grams binary, counts binary"
ANSWERS = "batch long, n int, bucket int, totals binary"
SCORES = "doc_id long, n_words long, log_score double"

_null_id = -(1 << 63)
_mix, _mix_2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)

#: 64 bits of a word; they deal and sift n-grams but never tell them apart.
HASH: Callable[[bytes], int] = xxhash.xxh3_64_intdigest


def words_of(text: bytes) -> list[bytes]:
    return text.lower().split()


def words_in(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """``words_of`` all texts, one after the other, and how many each of them has."""
    listed = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    words = listed.flatten()
    real = np.asarray(pc.greater(pc.binary_length(words), 0))  # white space at an end leaves an empty piece
    counts = np.bincount(np.asarray(pc.list_parent_indices(listed))[real], minlength=len(texts)).astype(np.int64)
    return words if real.all() else words.filter(pa.array(real)), counts


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array([int(words_in(b.column(1).cast(pa.large_string()))[1].sum())])], ["n"])


def _gather(batch_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq, ids, texts, held = TaskContext.get().partitionId() << 32, [], [], 0
        pack = zstandard.ZstdCompressor(level=6).compress

        def row() -> pa.RecordBatch:
            data = [np.array(ids, "<i8").tobytes(), np.array([len(t) for t in texts], "<u4").tobytes(), pack(b"".join(texts))]
            name = xxhash.xxh3_64(seq.to_bytes(8, "little"))
            for part in data:
                name.update(part)
            return pa.RecordBatch.from_arrays([pa.array([name.intdigest() >> 1]), *(pa.array([x]) for x in data)], ["batch", "doc_ids", "sizes", "texts"])

        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids.append(_null_id if doc_id is None else doc_id)
                texts.append(text.encode("utf-8", "surrogatepass"))
                held += len(texts[-1])
                if held >= batch_bytes:
                    yield row()
                    seq, ids, texts, held = seq + 1, [], [], 0
        if ids:
            yield row()

    return run


def gather(docs: DataFrame, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """Documents as compressed batches, dealt out by their names."""
    small_batches(docs.sparkSession)
    return id_and_text(docs).mapInArrow(_gather(batch_bytes), BATCHES).repartition("batch")


def in_order(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys from 0 on, rising, and the places that they had; equal ones stay in the order of their places."""
    place = max(1, (len(key) - 1).bit_length())
    if not len(key) or int(key.max()).bit_length() + place > 63:
        order = np.argsort(key, kind="stable")
        return key[order], order
    both = np.sort(key << place | np.arange(len(key)))  # numbers alone are sorted much faster than places by them
    return both >> place, both & ((1 << place) - 1)


@dataclass
class Grams:
    """The different n-grams of one order in a batch."""

    of: np.ndarray  # of each occurrence, in order of the words that they end with: its number
    ends: np.ndarray  # for each number, a word with which it ends
    counts: np.ndarray
    n_docs: np.ndarray  # documents of the batch that hold it
    own: np.ndarray  # of each occurrence: how often its document has it
    hashes: np.ndarray


class Batch:
    """Words and n-grams of the documents of a batch; n-grams are told apart by the numbers of their words."""

    def __init__(self, texts: bytes, sizes: bytes, order: int, hash_of: Callable[[bytes], int] = HASH) -> None:
        ends = np.cumsum(np.r_[0, np.frombuffer(sizes, "<u4")], dtype=np.int64)
        text = pa.py_buffer(zstandard.ZstdDecompressor().decompress(texts))
        words, self.counts = words_in(pa.Array.from_buffers(pa.large_string(), len(ends) - 1, [None, pa.py_buffer(ends), text]))
        words = words.dictionary_encode()
        self.ids = words.indices.to_numpy()
        cuts, held = (b"" if x is None else x.to_pybytes() for x in words.dictionary.buffers()[1:])
        cuts = np.frombuffer(cuts, "<i8")[: len(words.dictionary) + 1].tolist()
        self.vocabulary = [held[a:z] for a, z in zip(cuts, cuts[1:])]
        self.words = pa.array(self.vocabulary, pa.binary())
        del text, words
        self.doc = np.repeat(np.arange(len(self.counts), dtype=np.int32), self.counts)
        self.at = np.arange(len(self.ids), dtype=np.int32) - np.repeat((np.cumsum(self.counts) - self.counts).astype(np.int32), self.counts)  # place in the document
        self.hash_of_word = np.fromiter(map(hash_of, self.vocabulary), np.uint64, len(self.vocabulary))
        self.grams: list[Grams] = []
        before = None
        for n in range(1, order + 1):
            where = np.flatnonzero(self.at >= n - 1)
            key = self.ids[where].astype(np.int64) if before is None else before[where - 1].astype(np.int64) * (len(self.vocabulary) + 1) + self.ids[where]
            self.grams.append(self._different(key, where, n))
            before = np.zeros(len(self.ids), np.int32)
            before[where] = self.grams[-1].of

    def _different(self, key: np.ndarray, where: np.ndarray, n: int) -> Grams:
        key, order = in_order(key)
        new = np.r_[len(key) > 0, key[1:] != key[:-1]][: len(key)]
        first = np.flatnonzero(new)
        of = np.empty(len(key), np.int32)
        of[order] = np.cumsum(new) - 1
        doc = self.doc[where][order]
        new_doc = new | np.r_[len(doc) > 0, doc[1:] != doc[:-1]][: len(doc)]
        runs = np.flatnonzero(new_doc)
        own = np.empty(len(key), np.int32)
        times = np.diff(np.r_[runs, len(key)])
        own[order] = np.repeat(times, times)
        n_docs = np.add.reduceat(new_doc, first, dtype=np.int32) if len(first) else np.zeros(0, np.int32)
        ends = where[order[first]].astype(np.int32)
        h = self.hash_of_word[self.ids[ends - (n - 1)]]
        for back in range(n - 2, -1, -1):
            h = (h ^ h >> np.uint64(29)) * _mix + self.hash_of_word[self.ids[ends - back]]
        h = (h ^ h >> np.uint64(32)) * _mix_2
        return Grams(of, ends, np.diff(np.r_[first, len(key)]).astype(np.int32), n_docs, own, h ^ h >> np.uint64(29))

    def text_of(self, n: int, numbers: np.ndarray) -> bytes:
        """The n-grams themselves, words joined by a space, a line for each."""
        ends = self.grams[n - 1].ends[numbers]
        columns = [self.words.take(pa.array(self.ids[ends - back])) for back in range(n - 1, -1, -1)]
        lines = columns[0] if n == 1 else pc.binary_join_element_wise(*columns, b" ")
        lines = pc.binary_join_element_wise(lines, b"", b"\n")  # each with its end
        return lines.buffers()[2].to_pybytes()[: pc.sum(pc.binary_length(lines)).as_py() - 1]


def pack_sorted(x: np.ndarray) -> bytes:
    """Rising 64-bit numbers as the lower bits of each and, in unary, the steps of the upper bits: some two bits above the least."""
    v = x - x[0]
    low = max(0, (int(v[-1]) // len(v)).bit_length() - 1)
    up = np.zeros(int(v[-1] >> np.uint64(low)) + len(v), bool)
    up[(v >> np.uint64(low)).astype(np.int64) + np.arange(len(v))] = True
    bits = np.unpackbits(v.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")[:, :low]
    return len(v).to_bytes(4, "little") + bytes([low]) + int(x[0]).to_bytes(8, "little") + np.packbits(bits, bitorder="little").tobytes() + np.packbits(up, bitorder="little").tobytes()


def unpack_sorted(data: bytes) -> np.ndarray:
    n, low, base = int.from_bytes(data[:4], "little"), data[4], int.from_bytes(data[5:13], "little")
    raw, cut = np.frombuffer(data, np.uint8, -1, 13), -(-n * low // 8)
    bits = np.zeros((n, 64), np.uint8)
    bits[:, :low] = np.unpackbits(raw[:cut], count=n * low, bitorder="little").reshape(n, low)
    v = np.packbits(bits, axis=1, bitorder="little").view("<u8").reshape(-1)
    up = np.flatnonzero(np.unpackbits(raw[cut:], bitorder="little"))[:n] - np.arange(n)
    return v + (up.astype(np.uint64) << np.uint64(low)) + np.uint64(base)


def short_hashes(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The different leading ``bits`` of the hashes, rising, and the place of each hash's own among them."""
    return np.unique(hashes >> np.uint64(64 - bits), return_inverse=True)


def _cuts(rising: np.ndarray) -> list[tuple[int, int]]:
    at = np.flatnonzero(np.r_[len(rising) > 0, rising[1:] != rising[:-1]][: len(rising)]).tolist()
    return list(zip(at, [*at[1:], len(rising)]))


def _sift(order: int, parts: int, bits: int, hash_of: Callable[[bytes], int]):
    """The hashes of each batch's n-grams of two words or more, by part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for batch, sizes, texts in zip(*(b.column(c).to_pylist() for c in ("batch", "sizes", "texts"))):
                out = []
                for n, grams in enumerate(Batch(texts, sizes, order, hash_of).grams[1:], 2):
                    short = np.sort(grams.hashes >> np.uint64(64 - bits))
                    short = short[np.r_[len(short) > 0, short[1:] != short[:-1]][: len(short)]]  # np.unique of numbers alone takes thirty times as long
                    part = _part_of(short, bits, parts)
                    out += [(int(part[a]), n, batch, pack_sorted(short[a:z])) for a, z in _cuts(part)]
                kinds = [pa.int32(), pa.int32(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], ["part", "n", "batch", "hashes"])

    return run


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come in order of (part, n): a bit for each hash, 1 if two batches have it."""

    def answer(part: int, n: int, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        sets = [unpack_sorted(h) for _, h in rows]
        every = np.concatenate(sets)
        order = np.argsort(every, kind="stable")
        same = every[order[1:]] == every[order[:-1]]
        bit = np.zeros(len(every), bool)
        bit[order[1:]] = same
        bit[order[:-1]] |= same
        cut = np.cumsum([0, *map(len, sets)]).tolist()
        for i in range(0, len(rows), 500):
            mine = range(i, min(i + 500, len(rows)))
            packed = [np.packbits(bit[cut[j] : cut[j + 1]], bitorder="little").tobytes() for j in mine]
            columns = [pa.array([rows[j][0] for j in mine], pa.int64()), pa.array([n] * len(mine), pa.int32()), pa.array([part] * len(mine), pa.int32()), pa.array(packed, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["batch", "n", "part", "bits"])

    at, rows = None, []
    for b in batches:
        for part, n, *row in zip(*(c.to_pylist() for c in b.columns)):
            if (part, n) != at and rows:
                yield from answer(*at, rows)
                rows = []
            at = (part, n)
            rows.append(tuple(row))
    if rows:
        yield from answer(*at, rows)


def _part_of(short: np.ndarray, bits: int, parts: int) -> np.ndarray:
    return (short << np.uint64(max(0, 32 - bits)) >> np.uint64(max(0, bits - 32))) * np.uint64(parts) >> np.uint64(32)


def asked_grams(batch: Batch, parts: int, bits: int, answers: list | None) -> Iterator[tuple[int, int, np.ndarray]]:
    """n, bucket and the numbers of the n-grams that are asked for there: of lone words all, of others those that two documents may have; all without ``answers``."""
    for n, grams in enumerate(batch.grams, 1):
        mine = np.arange(len(grams.ends))
        if n > 1 and answers is not None:
            short, place = short_hashes(grams.hashes, bits)
            told = {a["part"]: a["bits"] for a in answers if a["n"] == n}
            met = np.zeros(len(short), bool)
            for a, z in _cuts(part := _part_of(short, bits, parts)):
                met[a:z] = np.unpackbits(np.frombuffer(told[int(part[a])], np.uint8), count=z - a, bitorder="little")
            mine = np.flatnonzero(met[place] | (grams.n_docs > 1))
        bucket = (grams.hashes[mine] >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)
        by = np.argsort(bucket, kind="stable")
        for a, z in _cuts(bucket[by]):
            yield n, int(bucket[by[a]]), mine[by[a:z]]


def _ask(order: int, parts: int, bits: int, sifted: bool, hash_of: Callable[[bytes], int]):
    """Each batch's n-grams as lists by bucket, compressed for the shuffle, with their counts."""
    kinds = [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate(kinds)], ["bucket", "batch", "n", "grams", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3).compress
        for b in batches:
            for name, sizes, texts, answers in zip(*(b.column(c).to_pylist() for c in ("batch", "sizes", "texts", "bits"))):
                batch, rows = Batch(texts, sizes, order, hash_of), []
                for n, bucket, mine in asked_grams(batch, parts, bits, (answers or []) if sifted else None):
                    rows.append((bucket, name, n, squeeze(batch.text_of(n, mine)), _narrow(batch.grams[n - 1].counts[mine])))
                    if len(rows) == 64:
                        yield packed(rows)
                        rows = []
                yield packed(rows)

    return run


def _narrow(x: np.ndarray) -> bytes:
    """Numbers in the least of 1, 2, 4, 5, 6, 7 or 8 bytes that hold all but a few, the few set apart."""
    for width in (1, 2, 4, 5, 6, 7):
        most = (1 << 8 * width) - 1
        big = np.flatnonzero(x >= most)
        if len(big) * 12 <= len(x) * width // 4:
            small = x.astype("<u8")
            small[big] = most
            return bytes([width]) + len(big).to_bytes(4, "little") + big.astype("<u4").tobytes() + x[big].astype("<u8").tobytes() + small.view(np.uint8).reshape(-1, 8)[:, :width].tobytes()
    return bytes([8]) + bytes(4) + x.astype("<u8").tobytes()


def _wide(data: bytes) -> np.ndarray:
    width, n = data[0], int.from_bytes(data[1:5], "little")
    low = np.frombuffer(data, np.uint8, -1, 5 + 12 * n).reshape(-1, width)
    x = np.zeros((len(low), 8), np.uint8)
    x[:, :width] = low
    x = x.view("<u8").reshape(-1)
    x[np.frombuffer(data, "<u4", n, 5)] = np.frombuffer(data, "<u8", n, 5 + 4 * n)
    return x


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come in order of (bucket, n): the table of counts of the bucket's n-grams, joined to each list in the order asked."""
    kinds, names = [pa.int64(), pa.int32(), pa.int32(), pa.binary()], ["batch", "n", "bucket", "totals"]

    def answer(bucket: int, n: int, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        counts = [_wide(c).astype(np.int64) for _, _, c in rows]
        text = pa.array([b"\n".join(unpack(g) for _, g, _ in rows)], pa.large_binary()).cast(pa.large_string())
        grams = pc.split_pattern(text, "\n").flatten()
        of = grams.dictionary_encode().indices.to_numpy()
        table = np.zeros(int(of.max()) + 1, np.int64)
        np.add.at(table, of, np.concatenate(counts))
        ends = np.cumsum(list(map(len, counts))).tolist()
        cut = list(zip([0, *ends[:-1]], ends))
        if ends[-1] != len(of):
            raise ValueError("an n-gram has no count")
        for i in range(0, len(rows), 500):
            out = [(rows[j][0], n, bucket, _narrow(table[of[a:z]])) for j, (a, z) in enumerate(cut[i : i + 500], i)]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], t) for c, t in enumerate(kinds)], names)

    at, rows = None, []
    for b in batches:
        for bucket, batch, n, *row in zip(*(c.to_pylist() for c in b.columns)):
            if (bucket, n) != at and rows:
                yield from answer(*at, rows)
                rows = []
            at = (bucket, n)
            rows.append((batch, *row))
    if rows:
        yield from answer(*at, rows)


def backoff_logs(counts: np.ndarray, left: list[np.ndarray], all_words: np.ndarray, backoff: float) -> np.ndarray:
    """log10 of the score of each word. left: for each n, the counts that speak for the n-gram ending there; 0 where there is none. all_words: of each document."""
    n_words = int(counts.sum())
    doc = np.repeat(np.arange(len(counts)), counts)
    at = np.arange(n_words) - np.repeat(np.cumsum(counts) - counts, counts)
    rest = np.maximum(all_words, 1)[doc]
    score = np.log10(np.maximum(left[0], 0.5) / rest)
    drop = np.log10(backoff)
    score = score + drop * np.minimum(at, len(left) - 1)
    for n in range(2, len(left) + 1):
        hit = np.flatnonzero(left[n - 1] > 0)
        hit = hit[left[n - 2][hit - 1] > 0]
        score[hit] = np.log10(left[n - 1][hit] / left[n - 2][hit - 1]) + drop * (np.minimum(at[hit] + 1, len(left)) - n)
    return score


def _score(order: int, parts: int, bits: int, all_words: int, backoff: float, leave_out: bool, hash_of: Callable[[bytes], int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc_ids, sizes, texts, sifted, answers in zip(*(b.column(c).to_pylist() for c in ("doc_ids", "sizes", "texts", "bits", "answers"))):
                batch = Batch(texts, sizes, order, hash_of)
                totals = [np.full(len(g.ends), -1, np.int64) for g in batch.grams]
                told = {(a["n"], a["bucket"]): a["totals"] for a in answers or ()}
                for n, bucket, mine in asked_grams(batch, parts, bits, (sifted or []) if leave_out else None):
                    found = _wide(told[n, bucket])
                    if len(found) != len(mine):
                        raise ValueError("an n-gram has no total")
                    totals[n - 1][mine] = found
                left = []
                for n, grams in enumerate(batch.grams, 1):
                    out = np.zeros(len(batch.ids))
                    total = totals[n - 1][grams.of]  # what was not asked for has one document alone
                    out[batch.at >= n - 1] = np.maximum(total - grams.own, 0) if leave_out else total
                    left.append(out)
                logs = backoff_logs(batch.counts, left, all_words - batch.counts * leave_out, backoff)
                sums = np.bincount(batch.doc, logs, len(batch.counts)) if len(batch.doc) else np.zeros(len(batch.counts))
                ids = [None if d == _null_id else d for d in np.frombuffer(doc_ids, "<i8").tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(batch.counts), pa.array(sums)], ["doc_id", "n_words", "log_score"])

    return run


def score(
    docs: DataFrame, order: int = ORDER, backoff: float = BACKOFF, leave_out: bool = True,
    batch_bytes: int = BATCH_BYTES, part_words: int = PART_WORDS, hash_of: Callable[[bytes], int] = HASH,
) -> DataFrame:
    """doc_id, n_words, log_score (sum of log10 scores) and mean_log_score (0 without words) for each row."""
    gathered = gather(docs, batch_bytes)
    all_words = id_and_text(docs).mapInArrow(_count_words, "n long").agg(F.sum("n")).first()[0] or 0
    parts = 1 + all_words // part_words
    bits = min(60, (all_words * order).bit_length() + 6)
    if leave_out:
        hashes = gathered.mapInArrow(_sift(order, parts, bits, hash_of), HASHES)
        met = hashes.repartition(parts, "part").sortWithinPartitions("part", "n").mapInArrow(_met, SHARED)
        met = met.groupBy("batch").agg(F.collect_list(F.struct("n", "part", "bits")).alias("bits"))  # a bit for each n-gram of a batch
        gathered = gathered.join(met.hint("merge"), "batch", "left")
    else:
        gathered = gathered.withColumn("bits", F.lit(None).cast("array<struct<n:int,part:int,bits:binary>>"))
    lists = gathered.mapInArrow(_ask(order, parts, bits, leave_out, hash_of), ASKED).repartition(parts, "bucket")
    answers = lists.sortWithinPartitions("bucket", "n").mapInArrow(_counted, ANSWERS)
    answers = answers.groupBy("batch").agg(F.collect_list(F.struct("n", "bucket", "totals")).alias("answers"))  # at most the n-grams of a batch
    scored = gathered.join(answers.hint("merge"), "batch", "left").mapInArrow(_score(order, parts, bits, all_words, backoff, leave_out, hash_of), SCORES)
    return scored.withColumn("mean_log_score", F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words")).otherwise(0.0))


def report(docs: DataFrame, order: int = ORDER, backoff: float = BACKOFF, leave_out: bool = True) -> DataFrame:
    """``score`` with sums rounded to six digits, so that the order of adding cannot show."""
    return score(docs, order, backoff, leave_out).select("doc_id", "n_words", F.round("log_score", 6).alias("log_score"), F.round("mean_log_score", 6).alias("mean_log_score"))
