"""What a task of the backoff scores holds."""

import numpy as np
import pyarrow as pa
import zstandard

from tracewell.llm import ngram_lm
from tracewell.llm.ngram_lm import Batch


def test_a_batch_holds_few_bytes_for_each_word():
    rng = np.random.default_rng(7)
    docs = [b" ".join(b"w%d" % i for i in rng.integers(0, 5000, 400)) for _ in range(50)]
    sizes = np.array(list(map(len, docs)), "<u4").tobytes()
    batch = Batch(zstandard.ZstdCompressor().compress(b"".join(docs)), sizes, 3)
    arrays = [batch.ids, batch.doc, batch.at, *(x for g in batch.grams for x in vars(g).values())]
    assert sum(x.nbytes for x in arrays) <= 100 * len(batch.ids)  # 64-bit arrays take more
    assert batch.text_of(2, np.array([0, 1])).count(b"\n") == 1 and batch.text_of(1, np.arange(3)).split(b"\n") == [batch.vocabulary[i] for i in batch.ids[batch.grams[0].ends[:3]]]


def test_words_are_numbered_without_an_object_for_each_occurrence(monkeypatch):
    """Arrow's words are those of ``words_of``: ASCII white space and letters alone count."""
    texts = ["", " A  b\tÉ\n", "\x0b\x0c\r", "a\x1cB a\x85b\xa0c", "A"]
    words, counts = ngram_lm.words_in(pa.array(texts, pa.large_string()))
    split = [ngram_lm.words_of(t.encode()) for t in texts]
    assert words.cast(pa.large_binary()).to_pylist() == sum(split, []) and counts.tolist() == list(map(len, split))
    monkeypatch.setattr(ngram_lm, "words_of", None)  # a batch needs no list of a document's words
    data = list(map(str.encode, texts))
    batch = Batch(zstandard.ZstdCompressor().compress(b"".join(data)), np.array(list(map(len, data)), "<u4").tobytes(), 3)
    assert batch.vocabulary == list(dict.fromkeys(sum(split, []))) and [batch.vocabulary[i] for i in batch.ids] == sum(split, [])


def test_equal_keys_stay_in_the_order_of_their_places():
    rng = np.random.default_rng(3)
    for most in (1, 5, 1 << 40, 1 << 62):  # the last does not fit beside a place
        key = rng.choice(rng.integers(0, most, 50), 999)
        rising, places = ngram_lm.in_order(key)
        assert (places == np.argsort(key, kind="stable")).all() and (rising == np.sort(key)).all()
