"""Exact deduplication by an extendible-hash index kept in shared files.

A key is the text without white space.  The leading ``root`` bits of its hash name the
owner task, and an owner holds the slice of the directory under its bits: slots of
further bits that point to buckets.  It inserts its keys in order of the hash; keys of
one hash form a chain and are told apart by their bytes.  A bucket with more than
``capacity`` keys is split by its next bit, and the slice doubles when the bucket was
already as deep as it.  Only the bucket that is being filled is in memory.  Map tasks
combine equal texts first, so a text that fills a third of the rows arrives once from
each of them.  An owner's file has the slots of its slice and its buckets, one after
the other.

A row finds its group the same way: by its owner's depth, its slot, the bucket of that
slot and the chain in it, where SHA-256 names a key (the owner has compared the bytes,
and fails where two keys share it).  An index under a given path is extended by later
calls: owners begin with the stored slice and split what overflows.  Each call writes a
new folder and then one record that names it; a call that stops before leaves the index as it was.

Defined results: a null text is an empty one; empty and blank texts are equal to
one another; rows that repeat a doc_id each count in their group and each give a
row; columns besides doc_id and text are ignored; an empty table gives no rows.  A
null doc_id stays a null doc_id and loses ties to any other.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE_BYTES, bounded_broadcast, fresh_path, id_and_text, join_totals, small_batches, written

#: Distinct keys that a bucket holds before it is split.
BUCKET_CAPACITY = 2048
#: Bits of the hash that name slots and buckets; keys that agree in all of them stay in one bucket.
MAX_DEPTH = 62
#: Code points for each owner task.
OWNER_CHARS = 32 << 20
#: Bytes of text that a map task keeps for combining before it hands them on.
COMBINE_BYTES = 48 << 20

ENTRY = "doc_id long, h long, sha string, n_chars long"
#: A row is a key in its bucket (no slot) or a slot with its bucket and the number of rows that route to it (no hash).
INDEX = "owner int, slot long, bucket long, h long, sha string, n_chars long, doc_id long, rows long, key binary"
COMMITS = "version int, root int, folder string"


def key_bytes(text: str) -> bytes:
    """The bytes on which texts are compared: UTF-8 without white space."""
    return text.encode("utf-8", "surrogatepass").translate(None, SPACE_BYTES)


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = b.column(1).to_pylist()
        keys = [key_bytes(t) for t in texts]
        yield pa.RecordBatch.from_arrays(
            [
                b.column(0),
                pa.array(np.array([xxhash.xxh64_intdigest(k) for k in keys], np.uint64).view(np.int64)),
                pa.array([hashlib.sha256(k).hexdigest() for k in keys], pa.string()),
                pa.array([len(t) for t in texts], pa.int64()),
            ],
            ["doc_id", "h", "sha", "n_chars"],
        )


class Directory:
    """The slice of the directory that one owner holds: slots of leading bits of the hash to buckets; grows by doubling.

    Slots and buckets of d bits are numbered by those bits after a leading one, so 0b1 is all hashes and a
    bucket's halves are twice its number and one more.
    """

    def __init__(self, prefix: int = 1) -> None:
        self.prefix, self.root = prefix, prefix.bit_length() - 1
        self.depth = self.root
        self.slots = np.array([prefix], np.int64)

    @classmethod
    def stored(cls, prefix: int, rows: list[tuple[int, int]]) -> Directory:
        """From pairs of slot and bucket."""
        d = cls(prefix)
        rows = sorted(rows)
        d.depth = rows[0][0].bit_length() - 1
        d.slots = np.array([bucket for _, bucket in rows], np.int64)
        return d

    def first(self) -> int:
        """The number of the first slot."""
        return self.prefix << (self.depth - self.root)

    def slot_of(self, h: int) -> int:
        """The number of the slot of an unsigned hash."""
        return 1 << self.depth | h >> (64 - self.depth)

    def bucket_of(self, h: int) -> int:
        return int(self.slots[self.slot_of(h) - self.first()])

    def split(self, bucket: int) -> None:
        """Divide ``bucket`` by its next bit."""
        if bucket.bit_length() - 1 == self.depth:
            self.slots = np.repeat(self.slots, 2)
            self.depth += 1
        at = np.flatnonzero(self.slots == bucket)
        self.slots[at[: len(at) // 2]], self.slots[at[len(at) // 2 :]] = 2 * bucket, 2 * bucket + 1


def _better(a: tuple[int, int | None], b: tuple[int, int | None]) -> bool:
    """Whether the row (code points, doc_id) a stays before b."""
    return a[0] > b[0] or (a[0] == b[0] and a[1] is not None and (b[1] is None or a[1] < b[1]))


def _emit(rows: list[tuple]) -> pa.RecordBatch:
    names = ["owner", "slot", "bucket", "h", "sha", "n_chars", "doc_id", "rows", "key"]
    kinds = [pa.int32(), *[pa.int64()] * 3, pa.string(), *[pa.int64()] * 3, pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)


def _combiner(root: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            items = list(held.items())
            for i in range(0, len(items), 500):
                out = []
                for key, (best, n) in items[i : i + 500]:
                    h = xxhash.xxh64_intdigest(key)
                    signed = h - (1 << 64) if h >> 63 else h
                    out.append((h >> (64 - root), None, None, signed, hashlib.sha256(key).hexdigest(), best[0], best[1], n, key))
                yield _emit(out)

        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                key, row = key_bytes(text), (len(text), doc_id)
                if (was := held.get(key)) is None:
                    held[key] = [row, 1]
                    size += len(key) + 200
                else:
                    was[1] += 1
                    if _better(row, was[0]):
                        was[0] = row
            if size > COMBINE_BYTES:
                yield from flush()
                held, size = {}, 0
        yield from flush()

    return run


class _Owner:
    """Inserts the keys of one owner, which come in order of the hash, and gives out each bucket once no key can follow in it."""

    def __init__(self, owner: int, directory: Directory, capacity: int) -> None:
        self.owner, self.directory, self.capacity = owner, directory, capacity
        self.bucket: int | None = None
        self.held: list[list] = []  # keys of the bucket that is being filled: unsigned hash, sha, n_chars, doc_id, rows, key
        self.at: list[tuple[int, int]] = []  # hash and rows of every key

    def _give(self, rows: list[list]) -> Iterator[tuple]:
        if len({r[1] for r in rows}) < len(rows):
            raise ValueError("two different texts have one SHA-256")
        for h, sha, n_chars, doc_id, n, key in rows:
            self.at.append((h, n))
            yield self.owner, None, self.bucket, h - (1 << 64) if h >> 63 else h, sha, n_chars, doc_id, n, key

    def insert(self, h: int, sha: str, n_chars: int, doc_id: int | None, n: int, key: bytes) -> Iterator[tuple]:
        held = self.held
        i = len(held)
        while i and held[i - 1][0] == h:  # the chain of this hash
            i -= 1
            if held[i][5] == key:
                same = held[i]
                same[4] += n
                if _better((n_chars, doc_id), (same[2], same[3])):
                    same[2], same[3] = n_chars, doc_id
                return
        bucket = self.directory.bucket_of(h)
        if bucket != self.bucket:
            yield from self._give(held)
            self.bucket, self.held = bucket, []
        self.held.append([h, sha, n_chars, doc_id, n, key])
        while len(self.held) > self.capacity and self.bucket.bit_length() <= MAX_DEPTH:
            self.directory.split(self.bucket)
            low, high = [], []
            for r in self.held:
                (high if self.directory.bucket_of(r[0]) & 1 else low).append(r)
            self.bucket *= 2
            if high:  # hashes rise, so the lower half is whole
                yield from self._give(low)
                self.bucket, self.held = self.bucket + 1, high

    def finish(self) -> Iterator[tuple]:
        """The last bucket, then the slots of the slice."""
        yield from self._give(self.held)
        d = self.directory
        rows = np.zeros(len(d.slots), np.int64)
        if self.at:
            slots = (np.array([h for h, _ in self.at], np.uint64) >> np.uint64(64 - d.depth)).astype(np.int64) + (1 << d.depth) - d.first()
            np.add.at(rows, slots, [n for _, n in self.at])
        for i, bucket in enumerate(d.slots.tolist()):
            yield self.owner, d.first() + i, bucket, None, None, None, None, int(rows[i]), None


def _owners(root: int, capacity: int):
    """Rows of an owner come as its stored slots, if any, and then its keys in order of the hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, stored, out = None, [], []
        for b in batches:
            for owner, slot, bucket, h, sha, n_chars, doc_id, n, key in zip(*(c.to_pylist() for c in b.columns)):
                if now is not None and owner != now.owner:
                    out += now.finish()
                    now = None
                if slot is not None:
                    stored.append((slot, bucket))
                    continue
                if now is None:
                    prefix = 1 << root | owner
                    now, stored = _Owner(owner, Directory.stored(prefix, stored) if stored else Directory(prefix), capacity), []
                out += now.insert(h & (1 << 64) - 1, sha, n_chars, doc_id, n, key)
            for i in range(0, len(out), 500):
                yield _emit(out[i : i + 500])
            out = []
        if now is not None:
            out = [*now.finish()]
            for i in range(0, len(out), 500):
                yield _emit(out[i : i + 500])

    return run


def newest(spark: SparkSession, path: str) -> tuple[int, int, str] | None:
    """Version, root bits and folder of the index under ``path``; None where none was begun."""
    try:
        commits = spark.read.schema(COMMITS).parquet(f"{path}/commits")
        last = commits.orderBy(F.desc("version")).limit(2).collect()
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return None
    if len(last) == 2 and last[0].version == last[1].version:
        raise RuntimeError(f"two writers extended {path} at once, both to version {last[0].version}")
    return tuple(last[0]) if last else None


def insert(docs: DataFrame, path: str, owners: int, capacity: int = BUCKET_CAPACITY) -> tuple[DataFrame, int]:
    """Insert ``docs`` (doc_id, text) into the index under ``path``, begun with ``owners`` tasks (a power of two); the index and its root bits.

    The number of owners stays as it was begun. Stored keys pass through their owners again.
    """
    spark, was = docs.sparkSession, newest(docs.sparkSession, path)
    version, root, folder = was or (0, owners.bit_length() - 1, "")
    rows = docs.mapInArrow(_combiner(root), INDEX)
    if was:
        rows = rows.unionByName(spark.read.schema(INDEX).parquet(f"{path}/{folder}"))
    owned = rows.repartitionById(1 << root, "owner").sortWithinPartitions("owner", F.col("slot").isNull(), "h").mapInArrow(_owners(root, capacity), INDEX)
    folder = f"v{version + 1}-{uuid.uuid4().hex}"
    owned.write.parquet(f"{path}/{folder}")
    spark.createDataFrame([(version + 1, root, folder)], COMMITS).coalesce(1).write.mode("append").parquet(f"{path}/commits")
    return spark.read.schema(INDEX).parquet(f"{path}/{folder}"), root


def look_up(entries: DataFrame, index: DataFrame, root: int) -> DataFrame:
    """``entries`` with keep_id, keep_chars and group_size of their key: slot, bucket of the slot, key in the bucket.

    An owner's depth is one row for each owner. Slots and keys that many rows share meet them by a bounded broadcast.
    """
    slots = index.where("slot is not null").select("owner", "slot", "bucket", F.col("rows").alias("n_of_key"))
    depths = slots.groupBy("owner").agg((F.length(F.bin(F.max("slot"))) - 1).alias("depth"))
    n_slots, n_rows = slots.agg(F.count("*"), F.coalesce(F.sum("n_of_key"), F.lit(0))).first()
    routed = (
        entries.withColumn("owner", F.shiftrightunsigned("h", 64 - root).cast("int"))
        .join(F.broadcast(depths), "owner")
        .withColumn("slot", F.expr("shiftleft(1L, depth) + shiftrightunsigned(h, 64 - depth)"))
        .drop("owner", "depth")
    )
    slots = slots.drop("owner")
    if n_slots <= 200_000:
        found = routed.join(bounded_broadcast(slots.drop("n_of_key"), n_slots), "slot")
    else:
        found = join_totals(routed, slots, "slot", n_rows)
    keys = index.where("slot is null").select(
        "bucket", "h", "sha", F.col("doc_id").alias("keep_id"), F.col("n_chars").alias("keep_chars"), F.col("rows").alias("group_size"), F.col("rows").alias("n_of_key")
    )
    return join_totals(found.drop("slot"), keys, ["bucket", "h", "sha"], n_rows)


def exact_groups(docs: DataFrame, capacity: int = BUCKET_CAPACITY, index_path: str | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for each row of ``docs``.

    Of equal texts the row with the most code points, then the smallest doc_id, stays; rows
    that share that doc_id too are all marked kept. With ``index_path`` the rows are inserted into
    the index kept there, and groups take in the rows of earlier calls.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = id_and_text(docs)
    entries = written(docs.mapInArrow(_entries, ENTRY), "entries")
    chars = entries.agg(F.sum("n_chars")).first()[0] or 0
    owners = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-chars // OWNER_CHARS))
    index, root = insert(docs, index_path or fresh_path(spark, "index"), 1 << (owners - 1).bit_length(), capacity)
    return look_up(entries, index, root).select(
        "doc_id", "keep_id", "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n_chars") == F.col("keep_chars"))).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def dedup(docs: DataFrame, capacity: int = BUCKET_CAPACITY) -> DataFrame:
    """``docs`` without the rows whose text equals that of a row that stays; all columns stay as they are.

    Rows that share a doc_id go together, when none of them is kept.
    """
    ids = exact_groups(docs, capacity).groupBy("doc_id").agg(F.max("kept").alias("_kept"))
    gone = ids.where("not _kept").select(F.col("doc_id").alias("_gone"))
    return docs.join(gone, docs["doc_id"].cast("long").eqNullSafe(gone["_gone"]), "left_anti")
