"""Repeated passages by threshold-bounded interval expansion on Burrows-Wheeler transforms.

A byte goes if a string of ``length`` bytes that covers it also starts in a document
of a smaller id.  Equal strings have the same least k-gram, their anchor, so:

1. equal texts are represented by the one of the smallest id; the others go whole;
2. the anchors of all windows are dealt out by hash, packed by document, and those
   that two different texts share come back to their documents;
3. those documents are cut into segments, runs of windows with one shared anchor;
   equal segments of a bundle are combined, keeping the smallest id, and compressed together before they are shuffled;
4. the owner of some anchors joins their different segments to one text, builds the
   transform and extends all intervals backward, breadth first: the boundaries that
   level l adds are the places where the common prefix is l, and expansion stops at
   ``length``.  What is then still one interval is one string, and gets the smallest
   id among its holders;
   An anchor with more than ``ANCHOR_BYTES`` of different segments is not gathered: its
   windows become rows and the smallest holder of each is an aggregate;
5. segments meet their occurrences again, which lose what a smaller id holds.

Defined results: a null text is an empty one; offsets and lengths are bytes of
UTF-8; rows that repeat a doc_id do not make each other go; a null doc_id loses
nothing and takes nothing from others; texts shorter than ``length`` stay whole;
columns besides doc_id and text are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import id_and_text, join_totals, small_batches, written

LENGTH, GRAM = 50, 16
#: Bytes of joined segments that one transform takes, and those that one anchor may add to it.
BLOCK_BYTES, ANCHOR_BYTES = 2 << 20, 2 << 20
#: Bytes of segments that a task bundles by owner before they are shuffled.
BUNDLE_BYTES = 16 << 20
#: A byte that UTF-8 never holds stands between segments.
BETWEEN = b"\xff"

PACKED = "part int, doc_ids binary, tags binary, counts binary, rest binary"
SHARED = "bucket int, doc_ids binary, tags binary, counts binary, anchors binary"
OF_DOC = "doc_id long, tag long, anchors binary"
SEGMENTS = "doc_id long, tag long, start int, anchor long, key long, body binary, holder long, alone boolean"
BUNDLES = "part int, anchors binary, sizes binary, bodies binary, holders binary, alone binary"
OWNED = "anchor long, body binary, holder long, alone boolean"
LEAST = "anchor long, key long, stops array<int>, holders array<long>, body binary, holder long"

_a, _b = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def gram_hashes(text: bytes, k: int) -> np.ndarray:
    """A mixed 64-bit hash of each run of ``k`` bytes (8 to 16): of its first and last eight."""
    words = np.empty(len(text) - 7, np.uint64)
    for shift in range(8):
        words[shift::8] = np.frombuffer(text, "<u8", (len(text) - shift) // 8, shift)
    n = len(text) - k + 1
    h = words[:n] * _a
    h ^= words[k - 8 : k - 8 + n] * _b
    h ^= h >> np.uint64(31)
    h *= _b
    h ^= h >> np.uint64(29)
    return h


def anchor_runs(text: bytes, length: int = LENGTH, k: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """First windows of the runs that share an anchor, and the anchors (the least k-gram hashes of the windows)."""
    least, have, span = gram_hashes(text, k), 1, length - k + 1
    while have < span:  # least of `have` neighbours, doubling
        step = min(have, span - have)
        least = np.minimum(least[:-step], least[step:])
        have += step
    starts = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
    return starts, least[starts]


def part_of(anchors: np.ndarray, parts: int) -> np.ndarray:
    return ((anchors & np.uint64(0xFFFFFFFF)) % np.uint64(parts)).astype(np.int64)


def _pack(parts: int, length: int, k: int):
    """Distinct anchors of each text, as the upper half of their bits, by part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, tags, sizes, found = [], [], [], []
            for doc_id, tag, text in zip(*(c.to_pylist() for c in b.columns)):
                if len(raw := text.encode("utf-8", "surrogatepass")) >= length:
                    distinct = np.unique(anchor_runs(raw, length, k)[1])
                    ids.append(doc_id), tags.append(tag), sizes.append(len(distinct)), found.append(distinct)
            if not ids:
                continue
            every, doc = np.concatenate(found), np.repeat(np.arange(len(ids)), sizes)
            part = part_of(every, parts)
            order = np.argsort(part, kind="stable")
            every, doc, part = (every[order] >> np.uint64(32)).astype("<u4"), doc[order], part[order]
            cut = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True])
            ids, tags, out = np.array(ids, "<i8"), np.array(tags, "<i8"), []
            for x, y in zip(cut.tolist(), cut[1:].tolist()):
                own, n = np.unique(doc[x:y], return_counts=True)
                out.append((int(part[x]), ids[own].tobytes(), tags[own].tobytes(), n.astype("<u4").tobytes(), every[x:y].tobytes()))
            kinds = [pa.int32(), *[pa.binary()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], ["part", "doc_ids", "tags", "counts", "rest"])

    return run


def _by_document(ids: np.ndarray, tags: np.ndarray, doc: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids, tags, counts and values of the documents that have any; ``doc`` numbers the ids and is sorted."""
    own, n = np.unique(doc, return_counts=True)
    return ids[own], tags[own], n.astype("<u4"), value


def _share(parts: int):
    """Rows come in order of part; anchors of two texts or more go back, packed by buckets of documents."""

    def shared(part: int, rows: list[tuple]) -> pa.RecordBatch | None:
        ids, tags, counts, rest = (np.concatenate([np.frombuffer(r[i], t) for r in rows]) for i, t in ((1, "<i8"), (2, "<i8"), (3, "<u4"), (4, "<u4")))
        doc = np.repeat(np.arange(len(ids)), counts)
        order = np.argsort(rest, kind="stable")
        value, tag = rest[order], tags[doc[order]]
        first = np.flatnonzero(np.r_[True, value[1:] != value[:-1]])
        unlike = np.minimum.reduceat(tag, first) != np.maximum.reduceat(tag, first)
        held = np.zeros(len(rest), bool)
        held[order] = np.repeat(unlike, np.diff(np.r_[first, len(value)]))
        if not held.any():
            return None
        doc, rest = doc[held], rest[held].astype("<u8") << np.uint64(32) | np.uint64(part)
        bucket = (ids[doc] % parts).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        doc, rest, bucket = doc[order], rest[order], bucket[order]
        cut = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True])
        out = [(int(bucket[x]), *(y.tobytes() for y in _by_document(ids, tags, doc[x:z], rest[x:z]))) for x, z in zip(cut.tolist(), cut[1:].tolist())]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate([pa.int32(), *[pa.binary()] * 4])], ["bucket", "doc_ids", "tags", "counts", "anchors"])

    return _grouped(shared)


def _grouped(solve):
    """A map over batches whose rows come in order of their first column: ``solve`` takes a key and its rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rows = None, []
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if row[0] != at and rows:
                    if (out := solve(at, rows)) is not None:
                        yield out
                    rows = []
                at = row[0]
                rows.append(row)
        if rows and (out := solve(at, rows)) is not None:
            yield out

    return run


def _unpack(bucket: int, rows: list[tuple]) -> pa.RecordBatch:
    """One row for each document of a bucket, with its anchors from all parts."""
    ids, tags, counts, value = (np.concatenate([np.frombuffer(r[i], t) for r in rows]) for i, t in ((1, "<i8"), (2, "<i8"), (3, "<u4"), (4, "<u8")))
    doc = np.repeat(np.arange(len(ids)), counts)
    order = np.lexsort((tags[doc], ids[doc]))
    doc, value = doc[order], value[order]
    who = np.flatnonzero(np.r_[True, (ids[doc][1:] != ids[doc][:-1]) | (tags[doc][1:] != tags[doc][:-1])])
    lists = [x.tobytes() for x in np.split(value, who[1:])]
    return pa.RecordBatch.from_arrays([pa.array(ids[doc[who]]), pa.array(tags[doc[who]]), pa.array(lists, pa.binary())], ["doc_id", "tag", "anchors"])


def body_keys(bodies: list[bytes]) -> np.ndarray:
    """With its anchor, 128 bits that tell a segment."""
    return np.array([xxhash.xxh3_64_intdigest(x) for x in bodies], np.uint64).view(np.int64)


def _squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed, for the shuffle to their anchors or ranges."""
    pack = zstandard.ZstdCompressor(level=3).compress
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([pack(t.encode("utf-8", "surrogatepass")) for t in b.column(2).to_pylist()], pa.binary())], ["doc_id", "tag", "packed"])


def _cut(parts: int, length: int, k: int):
    """Segments of the shared anchors of each document.

    Of equal segments in a batch the first carries the body, with the smallest id of its documents and whether it is their only one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for b in batches:
            ids, tags, where, names, bodies = [], [], [], [], []
            for doc_id, tag, packed, shared in zip(*(c.to_pylist() for c in b.columns)):
                raw = unpack(packed)
                starts, anchors = anchor_runs(raw, length, k)
                ends = np.r_[starts[1:], len(raw) - length + 1] + length - 1
                code = anchors >> np.uint64(32) << np.uint64(32) | part_of(anchors, parts).astype(np.uint64)
                wanted = np.unique(np.frombuffer(shared, "<u8"))
                near = np.minimum(np.searchsorted(wanted, code), len(wanted) - 1)
                keep = wanted[near] == code
                starts, ends, anchors = starts[keep], ends[keep], anchors[keep]
                ids += [doc_id] * len(starts)
                tags += [tag] * len(starts)
                where.append(starts)
                names.append(anchors)
                bodies += [raw[a:z] for a, z in zip(starts.tolist(), ends.tolist())]
            if not ids:
                continue
            anchor = np.concatenate(names).view(np.int64)
            first: dict[tuple[int, bytes], int] = {}
            at = [first.setdefault(x, i) for i, x in enumerate(zip(anchor.tolist(), bodies))]
            doc = np.array(ids, np.int64)
            low, high = doc.copy(), doc.copy()
            np.minimum.at(low, at, doc)
            np.maximum.at(high, at, doc)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(doc), pa.array(tags, pa.int64()), pa.array(np.concatenate(where).astype(np.int32)), pa.array(anchor), pa.array(body_keys(bodies)),
                    pa.array([x if i == j else None for i, (j, x) in enumerate(zip(at, bodies))], pa.binary()), pa.array(low), pa.array(low == high),
                ],
                ["doc_id", "tag", "start", "anchor", "key", "body", "holder", "alone"],
            )

    return run


def _bundle(parts: int):
    """Segments by owner, each once with its smallest holder and whether that is its only one; the bodies for one owner compressed together."""
    kinds = [pa.int32(), *[pa.binary()] * 5]

    def packed(table: pa.Table) -> pa.RecordBatch:
        anchor, key, holder, alone = (table.column(c).to_numpy() for c in ("anchor", "key", "holder", "alone"))
        part = part_of(anchor.view(np.uint64), parts)
        order = np.lexsort((key, anchor, part))
        anchor, key, part = anchor[order], key[order], part[order]
        first = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (key[1:] != key[:-1])])
        low, high = np.minimum.reduceat(holder[order], first), np.maximum.reduceat(holder[order], first)
        single = np.logical_and.reduceat(alone[order], first) & (low == high)
        anchor, part = anchor[first], part[first]
        bodies = table.column("body").combine_chunks().take(pa.array(order[first]))
        sizes = pc.binary_length(bodies).to_numpy().astype("<i4")
        ends = np.r_[0, np.cumsum(sizes, dtype=np.int64)]
        data = b"".join(bodies.to_pylist())
        squeeze = zstandard.ZstdCompressor(level=3).compress
        cut = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True]).tolist()
        out = [(int(part[x]), anchor[x:y].tobytes(), sizes[x:y].tobytes(), squeeze(data[ends[x] : ends[y]]), low[x:y].tobytes(), single[x:y].tobytes()) for x, y in zip(cut, cut[1:])]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], ["part", "anchors", "sizes", "bodies", "holders", "alone"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            held.append(b)
            size += b.nbytes
            if size >= BUNDLE_BYTES:
                yield packed(pa.Table.from_batches(held))
                held, size = [], 0
        if size:
            yield packed(pa.Table.from_batches(held))

    return run


def _unbundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpack = zstandard.ZstdDecompressor().decompress
    for b in batches:
        for _, anchors, sizes, bodies, holders, alone in zip(*(c.to_pylist() for c in b.columns)):
            offsets = np.r_[0, np.cumsum(np.frombuffer(sizes, "<i4"))].astype(np.int32)
            body = pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(unpack(bodies))])
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(anchors, "<i8")), body, pa.array(np.frombuffer(holders, "<i8")), pa.array(np.frombuffer(alone, bool))], ["anchor", "body", "holder", "alone"])


def suffix_rows(text: np.ndarray, length: int) -> np.ndarray:
    """Starts of all suffixes in the order of at least their first ``length`` bytes, by doubling ranks."""
    padded, n = np.r_[text, np.zeros(8, np.uint8)].astype(np.uint64), len(text)
    word = np.zeros(n, np.uint64)
    for i in range(8):
        word = word << np.uint64(8) | padded[i : i + n]
    rank, have = np.unique(word, return_inverse=True)[1].astype(np.int64), 8
    while have < length and rank.max() + 1 < n:
        key = rank * (n + 1)
        key[: n - have] += rank[have:] + 1
        rank, have = np.unique(key, return_inverse=True)[1], 2 * have
    return np.argsort(rank, kind="stable")


def common_prefixes(text: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix starts in order, and for each the bytes it has in common with the one before, ``length`` standing for more.

    Level by level: a row and the one before it part at level l + 1 if they have one first byte
    and a boundary of level l lies between the rows that they extend backward.
    """
    rows = suffix_rows(text, length)
    last = text[rows - 1]  # the transform
    extends = np.argsort(last, kind="stable")  # row -> the row that it extends
    prefix = np.full(len(rows), length, np.int32)
    first = text[rows]
    bound = np.r_[True, first[1:] != first[:-1]]
    prefix[bound] = 0
    left = np.flatnonzero(~bound)
    here, above = extends[left], extends[left - 1]
    for level in range(1, length):
        interval = np.cumsum(bound, dtype=np.int32)
        parted = interval[here] != interval[above]
        new = left[parted]
        if not len(new):
            break
        prefix[new] = level
        bound[new] = True
        left, here, above = left[~parted], here[~parted], above[~parted]
    return rows, prefix


def least_holders(bodies: list[bytes], holders: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each segment, in one flat form, runs of windows and the smallest holder of each.

    Returns the number of runs of each segment, the window at which each run stops, and its holder.
    """
    sizes = np.array([len(x) for x in bodies], np.int64)
    windows = sizes - length + 1
    of = np.repeat(np.arange(len(bodies)), windows)
    if len(bodies) == 1:  # one text: no interval holds another
        return np.ones(1, np.int64), windows.astype(np.int32), holders.astype(np.int64)
    text = np.frombuffer(BETWEEN.join(bodies) + BETWEEN, np.uint8)
    begins = np.r_[0, np.cumsum(sizes + 1)[:-1]]
    inside = np.zeros(len(text), bool)
    at = np.arange(len(of)) - np.repeat(np.r_[0, np.cumsum(windows)[:-1]], windows) + begins[of]
    inside[at] = True
    owner = np.zeros(len(text), np.int64)
    owner[at] = holders[of]
    rows, prefix = common_prefixes(text, length)
    string = np.cumsum(prefix < length)
    valid = inside[rows]
    rows, string = rows[valid], string[valid]
    first = np.flatnonzero(np.r_[True, string[1:] != string[:-1]])
    least = np.minimum.reduceat(owner[rows], first)
    owner[rows] = np.repeat(least, np.diff(np.r_[first, len(rows)]))
    flat = owner[at]
    start = np.r_[True, (flat[1:] != flat[:-1]) | (of[1:] != of[:-1])]
    begin = np.flatnonzero(start)
    stops = np.r_[begin[1:], len(flat)] - (np.cumsum(windows) - windows)[of[begin]]
    return np.bincount(of[begin], minlength=len(bodies)), stops.astype(np.int32), flat[begin]


def agreeing(bodies: list[bytes], anchors: np.ndarray, length: int, k: int) -> np.ndarray:
    """Whether each segment can share a string of ``length`` bytes with another of its anchor.

    Such a string has half of the bytes beside its anchor on one side at least, so both segments
    agree there. Where an anchor stands more than once in one of its segments, all of them may.
    """
    side = (length - k + 1) // 2
    text = b"".join(bodies) + bytes(length)
    sizes = np.array([len(x) for x in bodies], np.int64)
    ends = np.cumsum(sizes)
    begins, of = ends - sizes, np.repeat(np.arange(len(bodies)), sizes)
    near = gram_hashes(text, k)
    at = np.flatnonzero(near[: len(of)] == anchors.view(np.uint64)[of])
    at = at[at + k <= ends[of[at]]]
    times = np.bincount(of[at], minlength=len(bodies))
    able = np.zeros(len(bodies), bool)
    group = np.cumsum(np.r_[True, anchors[1:] != anchors[:-1]]) - 1
    many = np.zeros(group[-1] + 1, bool)
    many[group[times != 1]] = True
    once = at[times[of[at]] == 1]
    owner = of[once]
    part = k if side >= k else max(side, 8)  # a shorter part serves, as more pass
    beside = near if part == k else gram_hashes(text, part)
    for start, fits in ((once - part, once - side >= begins[owner]), (once + k, once + k + side <= ends[owner])):
        key = beside[start[fits]] * _a ^ anchors.view(np.uint64)[owner[fits]]
        _, back, n = np.unique(key, return_inverse=True, return_counts=True)
        able[owner[fits][n[back] > 1]] = True
    return able | many[group]


def combined(group: list[tuple]) -> list[tuple]:
    """Rows of one anchor with each body once: its smallest holder, and whether that is its only one."""
    if len(group) < 2:
        return group
    held: dict[bytes, tuple] = {}
    for row in group:
        was = held.get(row[1])
        held[row[1]] = row if was is None else (row[0], row[1], min(row[2], was[2]), row[3] and was[3] and row[2] == was[2])
    return list(held.values())


def _expand(length: int, k: int, anchor_bytes: int):
    """Rows (anchor, body, holder, alone) come in order of anchor; whole anchors fill a block. Those of a larger anchor go on as they are."""

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        anchors, holder, alone = np.array([r[0] for r in rows], np.int64), np.array([r[2] for r in rows], np.int64), np.array([r[3] for r in rows], bool)
        able = agreeing([r[1] for r in rows], anchors, length, k)
        joined = np.flatnonzero(able)
        by_row: dict[int, tuple] = {}
        if len(joined):
            runs, stops, least = least_holders([rows[i][1] for i in joined.tolist()], holder[joined], length)
            ends = np.cumsum(runs)
            # what only its own smallest document holds takes nothing from anyone
            told = ~(alone[joined] & (runs == 1) & (least[ends - 1] == holder[joined]))
            for i, a, z in zip(joined[told].tolist(), (ends - runs)[told].tolist(), ends[told].tolist()):
                by_row[i] = (stops[a:z].tolist(), least[a:z].tolist())
        for i in np.flatnonzero(~able & ~alone).tolist():  # one string that several documents hold
            by_row[i] = ([len(rows[i][1]) - length + 1], [int(holder[i])])
        found = sorted(by_row.items())
        return out([(rows[i][0], int(key), x[0], x[1], None, None) for (i, x), key in zip(found, body_keys([rows[i][1] for i, _ in found]))])

    def apart(rows: list[tuple]) -> pa.RecordBatch:
        return out([(r[0], int(key), None, None, r[1], r[2]) for r, key in zip(rows, body_keys([r[1] for r in rows]))])

    def out(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.binary(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["anchor", "key", "stops", "holders", "body", "holder"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, size, group, held, at, large = [], 0, [], 0, None, False
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if row[0] != at:
                    if large:
                        yield apart(group)
                    else:
                        group = combined(group)
                        if len(group) > 1 or (group and not group[0][3]):  # else one document holds the anchor: a chance agreement
                            if size > BLOCK_BYTES:
                                yield solve(block)
                                block, size = [], 0
                            block += group
                            size += sum(len(r[1]) for r in group)
                    at, group, held, large = row[0], [], 0, False
                group.append(row)
                held += len(row[1])
                if held > anchor_bytes:  # a passage of many documents comes once from each bundle
                    group = combined(group)
                    held = sum(len(r[1]) for r in group)
                    if large or held > anchor_bytes // 2:
                        yield apart(group)
                        group, held, large = [], 0, True
        if large:
            yield apart(group)
        else:
            group = combined(group)
            if len(group) > 1 or (group and not group[0][3]):
                block += group
        if block:
            yield solve(block)

    return run


def windows_apart(rows: DataFrame, length: int) -> DataFrame:
    """anchor, key, holder and window range [a, z) for the segments (anchor, key, body, holder) of large anchors: every window is a row,
    and neighbours with one smallest holder are put together again."""
    at = F.explode(F.sequence(F.lit(0), F.octet_length("body") - length)).alias("a")
    windows = rows.select("anchor", "key", "body", "holder", at).select("anchor", "key", "a", "holder", F.substring("body", F.col("a") + 1, length).alias("window"))
    windows = written(windows, "windows", "zstd")
    n = windows.count()
    if not n:
        return windows.select("anchor", "key", "holder", "a", F.col("a").alias("z"))
    least = windows.groupBy("window").agg(F.min("holder").alias("least"), F.count("*").alias("n_of_key"))
    held = join_totals(windows.drop("holder"), least, "window", n).select("anchor", "key", F.col("least").alias("holder"), "a").distinct()
    # neighbouring windows of one holder are one range, so that a segment meets each of its documents once and not for every window
    at = Window.partitionBy("anchor", "key", "holder").orderBy("a")
    runs = held.withColumn("_run", F.col("a") - F.row_number().over(at)).groupBy("anchor", "key", "holder", "_run").agg(F.min("a").alias("a"), F.max("a").alias("z"))
    return runs.select("anchor", "key", "holder", "a", (F.col("z") + 1).alias("z"))


def squeezed(tagged: DataFrame) -> DataFrame:
    return tagged.select("doc_id", "tag", "text").mapInArrow(_squeeze, "doc_id long, tag long, packed binary")


def repeats(docs: DataFrame, length: int = LENGTH, k: int = GRAM, anchor_bytes: int = ANCHOR_BYTES) -> tuple[DataFrame, DataFrame]:
    """The narrow table of all rows (doc_id, tag, n_bytes, sha, first) and the byte ranges that go (doc_id, tag, start, stop).

    ``first`` is the smallest id of an equal text; ranges are of first texts only and may overlap.
    """
    spark = docs.sparkSession
    small_batches(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tagged = id_and_text(docs).withColumn("tag", F.xxhash64("text"))
    base = written(tagged.select("doc_id", "tag", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("sha")), "texts")
    firsts = base.groupBy("sha").agg(F.min("doc_id").alias("first"), F.count("*").alias("n_of_key"))
    base = written(join_totals(base, firsts, "sha", base.count()), "firsts")
    packed = tagged.where("doc_id is not null").select("doc_id", "tag", "text").mapInArrow(_pack(parts, length, k), PACKED)
    shared = packed.repartitionById(parts, "part").sortWithinPartitions("part").mapInArrow(_share(parts), SHARED)
    of_doc = shared.repartitionById(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(_grouped(_unpack), OF_DOC)
    of_doc = of_doc.join(base.where("doc_id = first").select("doc_id", "tag").distinct(), ["doc_id", "tag"])
    texts = squeezed(tagged).join(of_doc, ["doc_id", "tag"]).select("doc_id", "tag", "packed", "anchors")
    segments = written(texts.mapInArrow(_cut(parts, length, k), SEGMENTS), "segments", "zstd")
    bundles = segments.where("body is not null").select("anchor", "key", "body", "holder", "alone").mapInArrow(_bundle(parts), BUNDLES)
    owned = bundles.repartitionById(parts, "part").mapInArrow(_unbundle, OWNED).sortWithinPartitions("anchor")
    least = written(owned.mapInArrow(_expand(length, k, anchor_bytes), LEAST), "least")
    runs = least.where("body is null").select("anchor", "key", F.posexplode("holders").alias("i", "holder"), "stops")
    runs = runs.select("anchor", "key", "holder", F.when(F.col("i") > 0, F.col("stops")[F.col("i") - 1]).otherwise(0).alias("a"), F.col("stops")[F.col("i")].alias("z"))
    runs = runs.unionByName(windows_apart(least.where("body is not null").select("anchor", "key", "body", "holder"), length))
    gone = segments.select("doc_id", "tag", "start", "anchor", "key").join(runs, ["anchor", "key"]).where("holder < doc_id")
    return base, gone.select("doc_id", "tag", (F.col("start") + F.col("a")).alias("start"), (F.col("start") + F.col("z") + (length - 1)).alias("stop"))


def _strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpack = zstandard.ZstdDecompressor().decompress
    for b in batches:
        out = []
        for doc_id, tag, packed, ranges in zip(*(c.to_pylist() for c in b.columns)):
            raw = unpack(packed)
            kept, at, removed, spans = hashlib.sha256(), 0, 0, 0
            last = -1
            for r in sorted((r["start"], r["stop"]) for r in ranges):
                a, z = max(r[0], at), r[1]
                if r[0] > last:
                    spans += 1
                if z > at:
                    kept.update(raw[at:a])
                    removed += z - a
                    at = z
                last = max(last, z)
            kept.update(raw[at:])
            out.append((doc_id, tag, removed, spans, kept.hexdigest()))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], ["doc_id", "tag", "n_removed", "n_spans", "kept_sha256"])


def report(docs: DataFrame, length: int = LENGTH, k: int = GRAM, anchor_bytes: int = ANCHOR_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each row."""
    base, gone = repeats(docs, length, k, anchor_bytes)
    ranges = gone.groupBy("doc_id", "tag").agg(F.collect_list(F.struct("start", "stop")).alias("ranges"))  # at most the windows of a text
    tagged = id_and_text(docs).withColumn("tag", F.xxhash64("text"))
    stripped = squeezed(tagged).join(ranges, ["doc_id", "tag"]).select("doc_id", "tag", "packed", "ranges").mapInArrow(_strip, "doc_id long, tag long, n_removed long, n_spans long, kept_sha256 string")
    stripped = stripped.distinct()
    whole = (F.col("n_bytes") >= length) & (F.col("doc_id") > F.col("first"))
    pick = lambda copy, cut, else_: F.when(whole, copy).when(F.col("n_removed").isNotNull(), cut).otherwise(else_)
    return base.join(stripped, ["doc_id", "tag"], "left").select(
        "doc_id", "n_bytes", pick(F.col("n_bytes"), F.col("n_removed"), F.lit(0).cast("long")).alias("n_removed"), pick(F.lit(1).cast("long"), F.col("n_spans"), F.lit(0).cast("long")).alias("n_spans"),
        pick(F.lit(hashlib.sha256(b"").hexdigest()), F.col("kept_sha256"), F.col("sha")).alias("kept_sha256"),
    )
