"""Whitening against numpy, packing against the library and bounds, fill-in-middle against plain strings."""

import hashlib
import itertools
import random
import zlib

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tracewell.llm import fill_in_middle as fim
from tracewell.llm import packing, queries, whitening

DIR = "/root/testdata/sf0.001"
BYTES = queries.tokenizer_path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, n long, form string, starts string, frames string, key string, block string, piece string, length string, ids string, island string"
ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "a <P> in the text"), (5, "<S"), (6, "same"), (6, "same"), (7, "word " * 9000), (None, "no id at all"), (8, "é\U0001f600x" * 700), (9, "<|endoftext|> a\x1cb"), (10, "x" * 9000)]


def docs(spark, rows):
    return spark.createDataFrame([(i, t, 0, *["x"] * 9) for i, t in rows], DOCS)


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, x string, n string, ids string, dims string, label int")


# 11
def plain_whitening(c, k):
    x = np.floor(1024 * np.asarray(c, np.float32).astype(float)).astype(np.int64) + 100000
    n, s = len(x), x.sum(0)
    centred = x - s / n
    v = centred.T @ centred / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    return n, ((n * x - s) ** 2).sum(1), centred @ u / np.sqrt(e), e / np.trace(v)


def check_whitening(rows, c, ids, k, apart=1e-8):
    n, deviation, want, explained = plain_whitening(c, k)
    assert len(rows) == n * k
    got = {(r.vec_id, r.component): r for r in rows}
    w = np.array([[got[i, j + 1].whitened for j in range(k)] for i in ids])
    assert np.abs(w * np.sign((w * want).sum(0)) - want).max() < apart
    assert [got[i, 1].deviation for i in ids] == deviation.tolist()
    assert np.abs(np.array([got[ids[0], j + 1].explained for j in range(k)]) / explained - 1).max() < 1e-9
    assert {r.n for r in rows} == {n} and max(r.identity_error for r in rows) < 1e-9


def test_whitening_of_the_table(spark):
    rows = queries.queries()["op11_whitening"](spark, DIR).collect()
    held = queries.table(spark, DIR, "embeddings").select("vec_id", "embedding").collect()
    check_whitening(rows, [r.embedding for r in held], [r.vec_id for r in held], 8)


def test_whitening_drops_what_has_no_integer(spark):
    rng = np.random.default_rng(0)
    c = (rng.standard_normal((300, 20)) * np.linspace(3, 0.1, 20)).astype(np.float32)
    good = [(i, [float(v) for v in row], *["x"] * 4, 0) for i, row in enumerate(c)]
    bad = [(900, None), (901, [float("nan")] * 20), (902, [1.0] * 19 + [None]), (903, [float("inf")] * 20), (904, []), (905, [1.0, 2.0]), (906, [1e30] * 20)]
    rows = whitening.report(vectors(spark, good + [(i, v, *["x"] * 4, 0) for i, v in bad])).collect()
    check_whitening(rows, c, list(range(300)), 8)


def test_whitening_without_variance(spark):
    row = lambda i, v: (i, v, *["x"] * 4, 0)
    for rows in ([], [row(1, [1.0, 2.0])], [row(i, [1.0, 2.0]) for i in range(5)], [row(None, None)]):
        assert whitening.report(vectors(spark, rows)).collect() == []
    plane = np.random.default_rng(1).standard_normal((50, 2)) @ np.random.default_rng(2).standard_normal((2, 30))
    made = whitening.fitted(whitening.blocks(vectors(spark, [row(i, [float(v) for v in r]) for i, r in enumerate(np.round(plane * 16) / 16)])))
    assert np.all(made.values > 0) and made.residual <= whitening.ROUNDING
    few = whitening.report(vectors(spark, [row(i % 3, [float(i % 5), float(i // 5), 7.0]) for i in range(25)])).collect()
    assert {r.component for r in few} == {1, 2} and len(few) == 50


@pytest.mark.parametrize("spectrum", [np.ones(40), np.r_[np.full(12, 5.0), np.ones(28)], np.geomspace(1e4, 1e-4, 40), np.r_[100.0, np.linspace(1.01, 1.0, 39)]])
def test_subspace_meets_the_spectrum(spectrum):
    rng = np.random.default_rng(3)
    u = np.linalg.qr(rng.standard_normal((40, 40)))[0]
    v = (u * spectrum) @ u.T
    values, q, residual = whitening.subspace(lambda x: v @ x, 40, 8)
    assert residual <= whitening.ROUNDING and np.abs(values - np.sort(spectrum)[::-1][:8]).max() < 1e-9 * spectrum.max()
    assert np.abs(q.T @ q - np.eye(8)).max() < 1e-12


def test_filter_damps_the_unwanted_spectrum():
    spectrum = np.r_[10.0, 4.0, np.linspace(2.0, 0.0, 30)]
    out = whitening.filtered(lambda x: spectrum[:, None] * x, np.ones((32, 1)), 10.0, 2.0, 8).ravel()
    assert out[0] == pytest.approx(1) and np.abs(out[2:]).max() < 1e-7 < out[1]


def test_deviation_beyond_a_long():
    x, n = np.array([[100_000, 100_300]]), 3_000_000_000
    sums = np.array([100_100 * n, 100_100 * n])
    long, wide = whitening.deviations(x, n, sums)
    assert long == [None] and int(wide[0]) == (n * 100) ** 2 + (n * 200) ** 2
    assert whitening.deviations(x, 3, np.array([300_300, 300_300])) == ([(300 * 1) ** 2 + 600**2], [None])


def test_sums_of_many_tasks_meet_in_two_levels(spark):
    c = np.random.default_rng(5).integers(-50, 50, (400, 6)) / 16
    made = whitening.blocks(vectors(spark, [(i, [float(v) for v in r], *["x"] * 4, 0) for i, r in enumerate(c)]).repartition(80)).repartition(80)
    x = np.floor(1024 * c).astype(np.int64) + 100000
    assert whitening.summed(made, 6, (6,), "<i8", lambda a: a.sum(axis=0)).tolist() == x.sum(0).tolist()


# 12
@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(BYTES)


def test_ids_are_those_of_the_library(library):
    coder, draw = packing.Encoder(BYTES), random.Random(4)
    assert coder.by_rank is not None
    for _ in range(6000):
        text = "".join(draw.choice(" \n\t\x0b\x1c\x85\xa0 　ab'1!é世\U0001f600  ") for _ in range(draw.randint(0, 12))) + draw.choice(["", "<|endoftext|>", " <|endoftext|>a", "don't", " word,\nNext."])
        assert coder.encode(text) == coder.ask(text), repr(text)


def test_tokens_added_to_the_file(library, tmp_path):
    other = Tokenizer.from_file(BYTES)
    other.add_special_tokens(["hello", "[MASK]"])
    other.save(path := str(tmp_path / "t.json"))
    coder = packing.Encoder(path)
    for text in ("say hello there", "xhellox [MASK] hello, [MASK]hello", "hello"):
        assert coder.encode(text) == coder.ask(text)
    other.add_tokens(["two words"])
    other.save(path)
    coder = packing.Encoder(path)
    assert coder.by_rank is not None and all(coder.encode(t) == coder.ask(t) for t in ("two words here", "xtwo wordsx"))
    assert packing.Encoder(queries.tokenizer_path()).by_rank is None  # word ends and a normaliser: the library alone
    assert packing.Encoder(BYTES).encode(" " * 500_000) == packing.Encoder(BYTES).ask(" " * 500_000)


def test_merges_that_are_no_ranks(library):
    import json

    spec = json.loads(library.to_str())
    assert len(packing.ranks_of(spec, library)) == 50256
    merges = spec["model"]["merges"]
    merges[5], merges[900] = merges[900], merges[5]
    assert packing.ranks_of(spec, library) is None


def check_packing(rows, wanted, library, capacity=packing.CAPACITY):
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
    texts = {}
    for i, t in wanted:
        texts.setdefault(i, []).append(t or "")
    assert by_doc.keys() == texts.keys()
    for i, held in texts.items():
        want = []
        for t in held:
            ids = library.encode(t, add_special_tokens=False).ids + [0]
            head = len(ids) % capacity or capacity
            edges = [0, *range(head, len(ids) + 1, capacity)]
            want += [(n, a, z - a, zlib.crc32(np.array(ids[a:z], "<u4").tobytes())) for n, (a, z) in enumerate(zip(edges, edges[1:]))]
        assert sorted((r.piece, r.start, r.length, r.ids_crc32) for r in by_doc[i]) == sorted(want)
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held in sequences.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences), -(-sum(r.length for r in rows) // capacity)


def test_packing_of_the_table(spark, library):
    rows = queries.queries()["op12_best_fit_packing"](spark, DIR).collect()
    used, least = check_packing(rows, [tuple(r) for r in queries.table(spark, DIR, "documents").select("doc_id", "text").collect()], library)
    assert used <= least + 1


def test_packing_of_odd_rows(spark, library):
    assert packing.report(docs(spark, []), BYTES).collect() == []
    used, least = check_packing(packing.report(docs(spark, ODD), BYTES).collect(), ODD, library)
    assert used <= least + 1


def test_blocks_and_rounds(spark, library):
    """Many small blocks: what their rounding loses, the rounds win back; ids can be read from the sequences."""
    draw = random.Random(6)
    rows = [(i, "ab " * draw.randint(1, 60)) for i in range(900)]
    made = packing.pieces(docs(spark, rows).repartition(6), BYTES, 128, 0, with_ids=True)
    places = packing.placed(made, 128, block_items=200, generations=3, epochs=2).persist()
    used, least = check_packing(places.collect(), rows, library, 128)
    assert used <= least * 1.02 + 1 and places.select("key").distinct().count() == places.count()
    held = packing.sequences(made, places).collect()
    assert len(held) == used and sum(len(r.ids) for r in held) == places.agg(F.sum("length")).first()[0]
    by_key = {r.key: r.ids for r in made.collect()}
    first = next(iter(places.where("offset = 0").collect()))
    whole = next(r for r in held if r.sequence_id == first.sequence_id)
    assert whole.ids[: first.length] == by_key[first.key]


def hard_block(n=400, seed=1):
    return np.sort(np.random.default_rng(seed).integers(300, 900, n))[::-1].astype(np.uint16)


def test_breeding_keeps_every_piece_and_wins(spark):
    block = packing.Block(hard_block(), 2048, [1])
    one, two = block.first(True), block.first(False)
    for child in [block.crossover(one, two) for _ in range(50)] + [block.mutation(two) for _ in range(50)]:
        loads = block.loads(child)
        assert len(child) == 400 and loads.sum() == block.lengths.sum() and loads.min() > 0 and loads.max() <= 2048
    best = block.evolved([], 8, 40)[0]
    assert best.max() < one.max() and block.fitness(best) > block.fitness(one) and int(best.max()) + 1 >= block.bound


def test_injected_bins_stay_whole():
    block = packing.Block(hard_block(60), 2048, [2])
    giver = block.first(False)
    bins = {frozenset(np.flatnonzero(giver == b).tolist()) for b in range(giver.max() + 1)}
    child = block.crossover(block.first(True), giver)
    assert bins & {frozenset(np.flatnonzero(child == b).tolist()) for b in range(child.max() + 1)}


def test_bound_never_exceeds_the_least():
    draw = random.Random(7)

    def least(sizes, capacity):
        best = len(sizes)

        def go(i, loads):
            nonlocal best
            if len(loads) >= best:
                return
            if i == len(sizes):
                best = len(loads)
                return
            for b in range(len(loads)):
                if loads[b] + sizes[i] <= capacity:
                    go(i + 1, [*loads[:b], loads[b] + sizes[i], *loads[b + 1 :]])
            go(i + 1, [*loads, sizes[i]])

        go(0, [])
        return best

    for _ in range(150):
        sizes = sorted((draw.randint(1, 12) for _ in range(draw.randint(1, 8))), reverse=True)
        found, wanted = packing.least_bins(np.array(sizes), 12), least(sizes, 12)
        assert -(-sum(sizes) // 12) <= found <= wanted
        assert packing.Block(np.array(sizes, np.uint16), 12, [1]).evolved([], 6, 10)[0].max() + 1 == wanted


def test_elites_move_between_islands(spark):
    """A block that no island finishes in its first epoch goes on with the elites of its neighbours."""
    items = [[(int(v), i, i, 0, 0, 0) for i, v in enumerate(hard_block(200))]]
    blocks = spark.createDataFrame([(0, x) for x in items], "block long, items array<struct<length:int,key:long,doc_id:long,piece:int,start:long,ids_crc32:long>>")
    one = packing.winners(blocks, 2048, 1, 4, 1, 2).collect()[0].elite
    many = packing.winners(blocks, 2048, 3, 4, 3, 10).collect()[0].elite
    block = packing.Block(hard_block(200), 2048, [0])
    assert block.fitness(np.frombuffer(many, "<u2")) > block.fitness(np.frombuffer(one, "<u2"))


# 13
def expected(doc_id, text):
    h = hashlib.sha256(f"1:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(text)
    a, z = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return "plain", None, None, text
    form = "spm" if h4 % 100 < 20 else "psm"
    out = f"<P>{text[:a]}<S>{text[z:]}<M>{text[a:z]}" if form == "psm" else f"<S>{text[z:]}<P>{text[:a]}<M>{text[a:z]}"
    return form, a, z - a, out


@pytest.mark.parametrize("units", [1, 7, 1000, fim.FRAME_UNITS])
def test_middle_of_odd_rows(spark, units):
    rows = ODD if units > 1 else [(i, t) for i, t in ODD if len(t or "") < 100]
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    got = sorted(map(tuple, fim.report(docs(spark, rows), units=units).collect()), key=str)
    want = []
    for i, t in rows:
        form, a, m, out = expected(i, t or "")
        want.append((i, len(t or ""), form, a, m, sha(out), sha(t or "")))
    assert got == sorted(want, key=str)


def test_stored_frames_serve_other_plans(spark):
    rows = [(i, f"text {i} " * i) for i in range(1, 60)]
    store = fim.stored(docs(spark, rows), units=16)
    for plan in (fim.Plan(), fim.Plan(seed="2", fim_percent=100, spm_percent=100)):
        made = fim.transformed(store, plan, units=10)
        assert {r.doc_id: r.text for r in fim.restored(made, plan).collect()} == dict(rows)
        outputs = {r.doc_id: (r.form, r.output) for r in fim.texts(made).collect()}
        if plan == fim.Plan():
            assert outputs == {i: expected(i, t)[::3] for i, t in rows}
        else:
            assert {f for f, _ in outputs.values()} == {"spm"}


def test_only_cut_and_asked_frames_are_opened():
    text = "".join(chr(0x61 + i % 26) for i in range(1000)) + "é" * 50
    held = fim.framed(text, 100, zstandard.ZstdCompressor(), zstandard.ZstdDecompressor())
    opened, plain = [], held.frame
    held.frame = lambda i: opened.append(i) or plain(i)
    assert b"".join(held.stream(250, 430)).decode() == text[250:430] and opened == [2, 3, 4]
    assert list(held.stream(5, 5)) == [] and b"".join(held.stream(990, 1050)).decode() == text[990:]


def test_marks_that_pieces_divide():
    text = "x<P>a<<S>b<S><M>c<M>"
    for n in (1, 2, 3, 5, 40):
        pieces = [text[i : i + n].encode() for i in range(0, len(text), n)]
        assert fim.find_marks(pieces, ("<P>", "<S>", "<M>")) == [1, 6, 13]


def test_empty_tables(spark):
    assert fim.report(docs(spark, [])).collect() == [] and list(itertools.chain(fim.texts(fim.transformed(fim.stored(docs(spark, [])))).collect())) == []
