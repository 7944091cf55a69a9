"""BPE encoding and decoding: merge rounds in numpy over many words at once.

A vocabulary file gives ids and ranked merges.  The words of a whole batch that were
not met before are laid out as one flat array of symbols.  In each round the pairs
of neighbours are found by binary search among the sorted pair keys, every word's
lowest-rank pair is merged at all its places from the left, and words with no pair
left drop out.  Ids of short words are kept for later batches in a bounded table.

Defined results: a null text is an empty one and has no ids; very long words are
merged like others; the strings of added tokens in a text become their ids, as
the file says (a file whose added tokens are sought in normalised text, as single words
or with the space around them is left to the library as a whole); repeated rows repeat; columns besides doc_id and text are ignored;
an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from .common import id_and_text, small_batches

#: Words that a worker keeps ids for, and the longest of them in characters.
CACHE_WORDS, CACHE_CHARS = 400_000, 48

# The normaliser and the split pattern of the files that are read here, and the end-of-word mark.
NORMALISERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD_END = "</w>"

_no_pair = np.iinfo(np.int32).max
_inner_space = re.compile("[ \t\n\x0b\x0c\r]+")
_separators = re.compile("[\x1c-\x1f]")
#: The split pattern for lower-cased ASCII, where letters, numbers and white space are known without any edition of Unicode.
_ascii_words = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^ \t\n\x0b\x0c\ra-z0-9]+")


def byte_letters() -> list[str]:
    """The letter that byte-level vocabularies write for each byte: itself if printable, else the next letter from U+0100."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def splits_at_space(spec: dict) -> bool:
    """Whether a tokenizer file normalises and splits so that the ids of a text are those of its parts between white space."""
    steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    return (
        (spec.get("normalizer") or {}).get("normalizers") == NORMALISERS
        and len(steps) == 2
        and (steps[0].get("pattern"), steps[0].get("behavior"), steps[0].get("invert")) == ({"Regex": SPLIT}, "Removed", True)
        and (steps[1].get("type"), steps[1].get("add_prefix_space"), steps[1].get("use_regex")) == ("ByteLevel", False, False)
    )


def literal_tokens(spec: dict) -> bool:
    """Whether every added token of a tokenizer file is found as it stands in the raw text, wherever it stands."""
    return not any(t.get(flag) for t in spec.get("added_tokens") or [] for flag in ("normalized", "single_word", "lstrip", "rstrip"))


def pieces(text: str) -> list[str]:
    """The parts of a text between white space; white space never joins what is merged."""
    return _inner_space.split(text.strip(" \t\n\x0b\x0c\r")) if _separators.search(text) else text.split()


class Bpe:
    """Encoder and decoder of one vocabulary file of the byte-level kind with word ends."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        odd = [k for k in ("unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges", "dropout") if model.get(k)]
        if model.get("type") != "BPE" or model.get("end_of_word_suffix") != WORD_END or odd or not splits_at_space(spec) or spec["decoder"]:
            raise ValueError(f"{path}: not a byte-level BPE file with word ends, split at white space")
        self.library, vocab = Tokenizer.from_file(path), model["vocab"]
        self.library.no_truncation()
        self.library.no_padding()
        special = {t["content"]: self.library.token_to_id(t["content"]) for t in spec["added_tokens"]}
        self.tokens = [""] * (max([*vocab.values(), *special.values()]) + 1)
        for token, i in (vocab | special).items():
            self.tokens[i] = token
        small = len(self.tokens) <= 1 << 16
        self.kind, self.shift, self.wide = ("<u2", 16, np.uint32) if small else ("<u4", 32, np.uint64)
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([vocab[a] << self.shift | vocab[b] for a, b in merges], self.wide)
        made = np.array([vocab[a + b] for a, b in merges], np.int32)
        order = np.argsort(keys)
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int32), made
        letters = byte_letters()
        self.inner = np.array([vocab[c] for c in letters], np.int32)
        self.last = np.array([vocab[c + WORD_END] for c in letters], np.int32)
        self.byte_of = {ord(c): b for b, c in enumerate(letters)}
        self.literal = literal_tokens(spec)
        self.special = special
        self.special_split = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.known: dict[str, bytes] = {}

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(self.wide) << self.wide(self.shift) | right.astype(self.wide)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], _no_pair)

    def merge(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word (non-empty UTF-8), as little-endian numbers of ``kind``."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        raw = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum(sizes)
        sym = self.inner[raw]
        sym[ends - 1] = self.last[raw[ends - 1]]
        word = np.repeat(np.arange(len(words)), sizes)
        rank = np.full(len(sym), _no_pair, np.int32)  # of the pair that begins at each symbol
        if len(sym) > 1:
            rank[:-1] = np.where(word[:-1] == word[1:], self.rank_of(sym[:-1], sym[1:]), _no_pair)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(sym):
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            lowest = np.minimum.reduceat(rank, starts)
            lengths = np.diff(np.r_[starts, len(sym)])
            live = np.repeat(lowest != _no_pair, lengths)
            if not live.all():
                done.append((word[~live], sym[~live]))
                sym, word, rank = sym[live], word[live], rank[live]
                lengths, lowest = lengths[lowest != _no_pair], lowest[lowest != _no_pair]
                if not len(sym):
                    break
            hit = rank == np.repeat(lowest, lengths)
            at = np.flatnonzero(hit)
            touching = np.r_[False, (at[1:] == at[:-1] + 1) & (rank[at[1:]] == rank[at[:-1]])]
            if touching.any():  # a run of one symbol: every second pair from the left
                index = np.arange(len(at))
                first = np.maximum.accumulate(np.where(touching, 0, index))
                at = at[(index - first) % 2 == 0]
            sym[at] = self.made[rank[at]]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            place = np.cumsum(keep) - 1
            sym, word, rank = sym[keep], word[keep], rank[keep]
            at = place[at]
            for p in (at, at[at > 0] - 1):  # the pairs on both sides of what was merged
                inside = p[p + 1 < len(sym)]
                rank[inside] = np.where(word[inside] == word[inside + 1], self.rank_of(sym[inside], sym[inside + 1]), _no_pair)
                rank[p[p + 1 >= len(sym)]] = _no_pair
        if not words:
            return []
        word, sym = np.concatenate([w for w, _ in done]), np.concatenate([s for _, s in done])
        order = np.argsort(word, kind="stable")
        flat = sym[order].astype(self.kind).tobytes()
        cut = [0, *(int(self.kind[2]) * np.cumsum(np.bincount(word, minlength=len(words)))).tolist()]
        return [flat[a:b] for a, b in zip(cut, cut[1:])]

    def words(self, part: str) -> list[bytes]:
        """The words of a part in UTF-8. What is not ASCII is normalised and split by the library itself, whatever its edition of Unicode."""
        if part.isascii():
            return [w.encode() for w in _ascii_words.findall(part.lower())]
        found = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(part))
        return [w.translate(self.byte_of).encode("latin-1") for w, _ in found]

    def learn(self, parts: Iterable[str]) -> dict[str, bytes]:
        """Ids of parts that are not kept yet; the words of all of them go through the rounds together."""
        parts = list(parts)
        split = list(map(self.words, parts))
        distinct = list({w for words in split for w in words})
        ids = dict(zip(distinct, self.merge(distinct)))
        return {p: b"".join([ids[w] for w in words]) for p, words in zip(parts, split)}

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text; one that holds the string of an added token is cut there first."""
        if not self.literal:
            return [np.array(self.library.encode(t, add_special_tokens=False).ids, self.kind) for t in texts]
        held = [any(s in t for s in self.special) for t in texts]
        if not any(held):
            return self._plain(texts)
        plain = iter(self._plain([t for t, h in zip(texts, held) if not h]))
        return [self._with_special(t) if h else next(plain) for t, h in zip(texts, held)]

    def _plain(self, texts: list[str]) -> list[np.ndarray]:
        split, known = [pieces(t) for t in texts], self.known
        met = {p for parts in split for p in parts}
        if len(known) > CACHE_WORDS:  # those of this batch are enough to go on with
            self.known = known = {p: known[p] for p in met if p in known}
        ids = self.learn(met - known.keys())
        known.update((p, x) for p, x in ids.items() if len(p) <= CACHE_CHARS)
        if long := {p for p in ids if len(p) > CACHE_CHARS}:
            known = known | {p: ids[p] for p in long}
        return [np.frombuffer(b"".join(map(known.__getitem__, parts)), self.kind) for parts in split]

    def _with_special(self, text: str) -> np.ndarray:
        runs = self.special_split.split(text)
        ids = iter(self._plain([r for i, r in enumerate(runs) if i % 2 == 0]))
        return np.concatenate([np.array([self.special[r]], self.kind) if i % 2 else next(ids) for i, r in enumerate(runs)])

    def decode(self, ids: np.ndarray) -> str:
        """The tokens of ``ids``, joined by a space: the vocabulary file names no decoder."""
        return " ".join(map(self.tokens.__getitem__, ids.tolist()))


@lru_cache(2)
def bpe(path: str) -> Bpe:
    """One for each worker and file."""
    return Bpe(path)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ids (array<int>) for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe(path)
        for b in batches:
            ids = coder.encode_batch(b.column(1).to_pylist())
            flat = pa.array(np.concatenate([*ids, np.zeros(0, np.int32)]).astype(np.int32))
            ends = pa.array(np.cumsum([0, *map(len, ids)]), pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(ends, flat)], ["doc_id", "ids"])

    small_batches(docs.sparkSession)
    return id_and_text(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and text for each row of doc_id and ids; null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([coder.decode(np.array(x or [], np.int64)) for x in b.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    small_batches(encoded.sparkSession)
    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for each row: encoded, decoded and digested in one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe(path)
        decimal = [str(i) for i in range(len(coder.tokens))]
        digest = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
        for b in batches:
            ids = coder.encode_batch(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    pa.array(list(map(len, ids)), pa.int64()),
                    pa.array([digest(" ".join(map(decimal.__getitem__, x.tolist()))) for x in ids], pa.string()),
                    pa.array([digest(coder.decode(x)) for x in ids], pa.string()),
                ],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    small_batches(docs.sparkSession)
    return id_and_text(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def tokenised(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids, n_tokens and the text that the ids decode to, for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe(path)
        for b in batches:
            ids = coder.encode_batch(b.column(1).to_pylist())
            flat = pa.array(np.concatenate([*ids, np.zeros(0, np.int32)]).astype(np.int32))
            ends = pa.array(np.cumsum([0, *map(len, ids)]), pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(ends, flat), pa.array(list(map(len, ids)), pa.int64()), pa.array(list(map(coder.decode, ids)), pa.string())], ["doc_id", "ids", "n_tokens", "decoded"])

    small_batches(docs.sparkSession)
    return id_and_text(docs).mapInArrow(run, "doc_id long, ids array<int>, n_tokens long, decoded string")
