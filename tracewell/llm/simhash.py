"""SimHash near-duplicates with pigeonring filtering.

The 64 bits of a fingerprint form a ring of m segments.  If two fingerprints differ
in at most t bits then, from some segment on, every chain of consecutive segments
of length l differs in at most l*t/m bits.  With m = 4 and t = 3 that chain begins
with an equal segment followed by one that differs in one bit at most, so the index
key is a segment with its neighbour, and the probes are that neighbour and its
one-bit changes.  Candidates must keep within the budgets of longer chains before
the full Hamming check.  Only distinct fingerprints are joined; equal ones are one
node.

Defined results: a null text is an empty one; texts without words have fingerprint
zero and link like any other; fewer words than a shingle make one shingle; repeated
rows share a fingerprint; columns besides doc_id and text are ignored; an empty
table gives no rows; a null doc_id is never the name of a component with other ids,
and a component of null ids alone has a null name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, join_totals, small_batches, written
from .components import components

WORDS, BITS, SEED = 3, 3, 42
SEGMENTS = 4
WIDTH = 64 // SEGMENTS


def fingerprint(text: str, words: int = WORDS, seed: int = SEED) -> int:
    """A bit is 1 if it is set in over half the hashes of the word shingles, repeats included."""
    parts = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII letters and white space only
    if not parts:
        return 0
    line = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    stops = ends[words - 1 :].tolist() if len(parts) >= words else [len(line)]
    starts = [0, *(ends[: len(stops) - 1] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(line[a:z], seed) for a, z in zip(starts, stops)], "<u8")
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, words: int = WORDS, seed: int = SEED) -> DataFrame:
    """doc_id and the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.array([fingerprint(t, words, seed) for t in b.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    small_batches(docs.sparkSession)
    return id_and_text(docs).mapInArrow(run, "doc_id long, fp long")


def _segment(fp: Column, i: int) -> Column:
    return F.shiftrightunsigned(fp, WIDTH * (i % SEGMENTS)).bitwiseAND(F.lit((1 << WIDTH) - 1))


def links(prints: DataFrame, bits: int = BITS) -> DataFrame:
    """Pairs a < b of distinct fingerprints (column ``fp``) that differ in 1 to ``bits`` bits; 0 to 3 are supported."""
    if bits >= SEGMENTS:
        raise ValueError("the key needs an equal segment: fewer bits than segments")
    changes = [0, *(1 << i for i in range(WIDTH))] if 2 * bits // SEGMENTS else [0]
    nodes = prints.select("fp").distinct()
    rings = F.array(*(F.struct(F.lit(i).alias("ring"), _segment(F.col("fp"), i).alias("s"), _segment(F.col("fp"), i + 1).alias("t")) for i in range(SEGMENTS)))
    key = lambda t: (F.col("k.ring").cast("long") * (1 << 2 * WIDTH) + F.col("k.s") * (1 << WIDTH) + t).alias("key")
    held = nodes.select("fp", F.explode(rings).alias("k"))
    index = held.select(key(F.col("k.t")), F.col("k.ring").alias("ring"), F.col("fp").alias("b"))
    probes = held.select(F.col("fp").alias("a"), "k", F.explode(F.array(*map(F.lit, changes))).alias("change")).select("a", key(F.col("k.t").bitwiseXOR(F.col("change"))))
    apart = F.col("a").bitwiseXOR(F.col("b"))
    # a merge: the rows multiply after the last shuffle whose size is known, so a broadcast would be chosen wrongly
    met = index.join(probes.hint("merge"), "key").where("a < b")
    within = F.lit(True)
    for ring in range(SEGMENTS):  # the longer chains from this ring on
        chain = F.lit(True)
        for length in range(3, SEGMENTS):
            budget = length * bits // SEGMENTS
            chain &= sum((F.bit_count(_segment(apart, ring + j)) for j in range(length)), F.lit(0)) <= budget
        within &= (F.col("ring") != ring) | chain
    return met.where(within).where(F.bit_count(apart) <= bits).select("a", "b").distinct()


def near_groups(docs: DataFrame, words: int = WORDS, bits: int = BITS, seed: int = SEED) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id reachable over links)."""
    prints = written(fingerprints(docs, words, seed), "prints")
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n_of_key"))
    joined = components(links(nodes, bits))
    named = nodes.join(joined.select(F.col("node").alias("fp"), "component"), "fp", "left")
    linked = named.where("component is not null")
    names = linked.groupBy("component").agg(F.min("least").alias("name"))
    of = named.where("component is null").select("fp", "n_of_key", F.col("least").alias("component_id")).unionByName(linked.join(names, "component").select("fp", "n_of_key", F.col("name").alias("component_id")))
    return join_totals(prints, of, "fp", prints.count()).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def dedup(docs: DataFrame, words: int = WORDS, bits: int = BITS) -> DataFrame:
    """``docs`` with one document of each group, that of the smallest doc_id; all columns stay as they are."""
    gone = near_groups(docs, words, bits).where("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"].cast("long") == gone["_gone"], "left_anti")
