"""Fill-in-middle transformation over seekable compressed frames.

A text is stored as independent zstandard frames of ``FRAME_UNITS`` code points each, beside the
cumulative counts of units (``starts``), so that any range of units is found by binary search and read
by decompressing the frames it touches.  A document is cut at two units into prefix, middle and suffix:
the frames that hold the cuts are opened to be divided, the frames between them are streamed in order.
The output is itself written as frames while it streams past, its marks are noted as they are met, and
the original text is rebuilt from the output and its form alone, again by seeking and streaming.

Shape of the job: ``stored`` writes one row of frames for each document (one narrow pass, no shuffle) to the
shared folder, ``transformed`` is another narrow pass over that table.  A lost executor repeats its
own input splits.  A task holds one text and its frames at a time.

Defined results: a null text is empty; an empty text, or one that holds a mark, stays plain; a null doc_id
draws its cuts from the word ``null``; rows that repeat a doc_id are transformed each for itself; other
columns of the input are not read.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from .common import fresh_path, id_and_text, small_batches

#: Code points of a frame; a text of fewer has one.
FRAME_UNITS = 16384
LEVEL = 3

STORE = "doc_id long, n long, marked boolean, starts array<long>, frames array<binary>"
OUTPUT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, starts array<long>, frames array<binary>"
DIGESTS = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string"


class Plan(NamedTuple):
    """What decides a document's form: the seed of its draws, percentages, and the three marks."""

    seed: str = "1"
    fim_percent: int = 90
    spm_percent: int = 20
    prefix_mark: str = "<P>"
    suffix_mark: str = "<S>"
    middle_mark: str = "<M>"

    @property
    def marks(self) -> tuple[str, str, str]:
        return self.prefix_mark, self.suffix_mark, self.middle_mark


class Frames:
    """A text as compressed frames; ``starts`` has one entry more than ``blobs``, the last is the number of units."""

    def __init__(self, starts: list[int], blobs: list[bytes], reader: zstandard.ZstdDecompressor):
        self.starts, self.blobs, self.reader = starts, blobs, reader

    def __len__(self) -> int:
        return self.starts[-1]

    def frame(self, i: int) -> bytes:
        return self.reader.decompress(self.blobs[i])

    def stream(self, a: int, z: int) -> Iterator[bytes]:
        """UTF-8 of the units a to z, frame by frame: whole frames as they are, the cut ones divided by units."""
        if a >= z:
            return
        i = bisect_right(self.starts, a) - 1
        while i < len(self.blobs) and self.starts[i] < z:
            raw, lo, hi = self.frame(i), self.starts[i], self.starts[i + 1]
            if a > lo or z < hi:
                raw = raw.decode("utf-8", "surrogatepass")[max(a - lo, 0) : z - lo].encode("utf-8", "surrogatepass")
            yield raw
            i += 1

    def text(self) -> str:
        return b"".join(self.stream(0, len(self))).decode("utf-8", "surrogatepass")


class FrameWriter:
    """Collects pieces of UTF-8 into frames of ``units`` code points and notes where given marks begin."""

    def __init__(self, units: int, coder: zstandard.ZstdCompressor):
        self.units, self.coder = units, coder
        self.starts, self.blobs, self.held = [0], [], ""

    def add(self, piece: bytes) -> None:
        self.held += piece.decode("utf-8", "surrogatepass")
        while len(self.held) >= self.units:
            self._frame(self.held[: self.units])
            self.held = self.held[self.units :]

    def _frame(self, text: str) -> None:
        self.blobs.append(self.coder.compress(text.encode("utf-8", "surrogatepass")))
        self.starts.append(self.starts[-1] + len(text))

    def done(self, reader: zstandard.ZstdDecompressor) -> Frames:
        if self.held:
            self._frame(self.held)
            self.held = ""
        return Frames(self.starts, self.blobs, reader)


def framed(text: str, units: int, coder: zstandard.ZstdCompressor, reader: zstandard.ZstdDecompressor) -> Frames:
    starts = [*range(0, len(text), units), len(text)] if text else [0]
    return Frames(starts, [coder.compress(text[a : a + units].encode("utf-8", "surrogatepass")) for a in range(0, len(text), units)], reader)


def drawn(doc_id: int | None, n: int, marked: bool, plan: Plan) -> tuple[str, int, int]:
    """Form and the two cuts of a document of ``n`` units."""
    digest = hashlib.sha256(f"{plan.seed}:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))
    first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
    if n == 0 or marked or h3 % 100 >= plan.fim_percent:
        return "plain", first, second
    return "spm" if h4 % 100 < plan.spm_percent else "psm", first, second


def output_pieces(source: Frames, form: str, first: int, second: int, plan: Plan) -> Iterator[bytes]:
    """The output in order, from the frames of the text."""
    p, s, m = (x.encode() for x in plan.marks)
    if form == "plain":
        yield from source.stream(0, len(source))
        return
    prefix, suffix = source.stream(0, first), source.stream(second, len(source))
    head = ((p, prefix), (s, suffix)) if form == "psm" else ((s, suffix), (p, prefix))
    for mark, part in head:
        yield mark
        yield from part
    yield m
    yield from source.stream(first, second)


def find_marks(pieces: Iterable[bytes], marks: tuple[str, ...]) -> list[int]:
    """Units at which each mark first begins, in the given order of marks, each after the one before; pieces may divide a mark."""
    found, at, carry = [], 0, ""
    longest = max(map(len, marks)) - 1
    for piece in pieces:
        held = carry + piece.decode("utf-8", "surrogatepass")
        base, look = at - len(carry), 0
        while len(found) < len(marks):
            begin = max(look, (found[-1] + len(marks[len(found) - 1]) - base) if found else 0)
            i = held.find(marks[len(found)], begin)
            if i < 0:
                break
            found.append(base + i)
            look = i
        at = base + len(held)
        if len(found) == len(marks):
            break
        carry = held[len(held) - min(longest, len(held)) :]
    return found


def restored_pieces(output: Frames, form: str, plan: Plan) -> Iterator[bytes]:
    """The text in order, from the output's frames and its form; the marks are found in the output."""
    n = len(output)
    if form == "plain":
        yield from output.stream(0, n)
        return
    p, s, m = plan.marks
    order = (p, s, m) if form == "psm" else (s, p, m)
    one, two, three = find_marks(output.stream(0, n), order)
    a = (one + len(order[0]), two)
    b = (two + len(order[1]), three)
    prefix, suffix = (a, b) if form == "psm" else (b, a)
    yield from output.stream(*prefix)
    yield from output.stream(three + len(m), n)
    yield from output.stream(*suffix)


def _digest(pieces: Iterable[bytes]) -> str:
    h = hashlib.sha256()
    for piece in pieces:
        h.update(piece)
    return h.hexdigest()


def _arrow(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "boolean": pa.bool_(), "string": pa.string(), "array<long>": pa.list_(pa.int64()), "array<binary>": pa.list_(pa.binary())}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[kind]) for i, (_, kind) in enumerate(fields)], [name for name, _ in fields])


def _frame_batches(units: int, marks: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, reader = zstandard.ZstdCompressor(level=LEVEL), zstandard.ZstdDecompressor()
        for b in batches:
            rows = []
            for doc_id, text in zip(b.column(0), b.column(1)):
                text = text.as_py()
                f = framed(text, units, coder, reader)
                rows.append((doc_id.as_py(), len(f), any(m in text for m in marks), f.starts, f.blobs))
            yield _arrow(STORE, rows)

    return run


def stored(docs: DataFrame, path: str | None = None, plan: Plan = Plan(), units: int = FRAME_UNITS) -> DataFrame:
    """Write the frames of ``docs`` to ``path`` (the shared folder if None) and return them as they are read back.

    ``marked`` says whether the text holds one of the plan's marks.  The store serves any number of later plans with the same marks.
    """
    spark = docs.sparkSession
    small_batches(spark)
    path = path or fresh_path(spark, "frames")
    id_and_text(docs).mapInArrow(_frame_batches(units, plan.marks), STORE).write.option("compression", "none").parquet(path)
    return spark.read.schema(STORE).parquet(path)


def _each(store: DataFrame, schema: str, make) -> DataFrame:
    """One row of ``schema`` for each stored document: ``make(doc_id, frames, form, first, second, coder, reader)`` gives its end."""
    plan = make.plan

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, reader = zstandard.ZstdCompressor(level=LEVEL), zstandard.ZstdDecompressor()
        for b in batches:
            rows = []
            for doc_id, n, marked, starts, blobs in zip(*b.columns):
                doc_id, n = doc_id.as_py(), n.as_py()
                form, first, second = drawn(doc_id, n, marked.as_py(), plan)
                source = Frames(starts.as_py(), blobs.as_py(), reader)
                cuts = (None, None) if form == "plain" else (first, second - first)
                rows.append((doc_id, n, form, *cuts, *make(source, form, first, second, coder, reader)))
            yield _arrow(schema, rows)

    small_batches(store.sparkSession)
    return store.mapInArrow(run, schema)


class _Output:
    def __init__(self, plan: Plan, units: int):
        self.plan, self.units = plan, units

    def frames(self, source, form, first, second, coder, reader) -> Frames:
        writer = FrameWriter(self.units, coder)
        for piece in output_pieces(source, form, first, second, self.plan):
            writer.add(piece)
        return writer.done(reader)

    def __call__(self, *args):
        out = self.frames(*args)
        return out.starts, out.blobs


class _Digests(_Output):
    def __call__(self, source, form, *rest):
        out = self.frames(source, form, *rest)
        return _digest(out.stream(0, len(out))), _digest(restored_pieces(out, form, self.plan))


def transformed(store: DataFrame, plan: Plan = Plan(), units: int = FRAME_UNITS) -> DataFrame:
    """The outputs as frames: doc_id, n, form, prefix_chars, middle_chars, starts, frames."""
    return _each(store, OUTPUT, _Output(plan, units))


def texts(outputs: DataFrame) -> DataFrame:
    """doc_id, form and the output text of what ``transformed`` gives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = zstandard.ZstdDecompressor()
        for b in batches:
            rows = [(d.as_py(), f.as_py(), Frames(s.as_py(), x.as_py(), reader).text()) for d, f, s, x in zip(*b.columns)]
            yield _arrow("doc_id long, form string, output string", rows)

    return outputs.select("doc_id", "form", "starts", "frames").mapInArrow(run, "doc_id long, form string, output string")


def restored(outputs: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """doc_id and the text rebuilt from the output's frames and form."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = zstandard.ZstdDecompressor()
        for b in batches:
            rows = []
            for doc_id, form, starts, blobs in zip(*b.columns):
                out = Frames(starts.as_py(), blobs.as_py(), reader)
                rows.append((doc_id.as_py(), b"".join(restored_pieces(out, form.as_py(), plan)).decode("utf-8", "surrogatepass")))
            yield _arrow("doc_id long, text string", rows)

    return outputs.select("doc_id", "form", "starts", "frames").mapInArrow(run, "doc_id long, text string")


def report(docs: DataFrame, plan: Plan = Plan(), units: int = FRAME_UNITS) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256 for each document."""
    return _each(stored(docs, None, plan, units), DIGESTS, _Digests(plan, units))
