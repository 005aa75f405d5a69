"""What the corpus operators' Python workers hold at once."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("tokenizers")

from kinograph.llm import bpe, kept, langid, similar  # noqa: E402


def _texts(n, words=2000):
    """Batches of texts of which no two share a word."""
    for i in range(n):
        texts = [" ".join(f"{chr(97 + k % 26)}{chr(97 + i)}{''.join(chr(97 + int(d)) for d in str(j * 50 + k))}" for k in range(words)) for j in range(4)]
        yield pa.RecordBatch.from_arrays([pa.array(range(4), pa.int64()), pa.array(texts), pa.array(["x", "y"] * 2)], ["doc_id", "text", "lang"])


def _most(run):
    """The most bytes of Python's and numpy's that stand at once while it runs."""
    tracemalloc.start()
    try:
        for _ in run:
            pass
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_one_group_of_texts_is_in_memory():
    """Pipeline, language: a batch's texts were strings of Python all at once."""
    batch = pa.RecordBatch.from_arrays([pa.array(["a" * 100_000, None, "", "ß" * 100_000, "é"] * 20)], ["text"])
    assert _most(bpe.text_groups([batch], most=100_000)) < 1_000_000
    assert [t for _, texts in bpe.text_groups([batch], most=100_000) for t in texts] == [t or "" for t in batch.column(0).to_pylist()]
    assert [p.num_rows for p, _ in bpe.text_groups([batch], most=100_000)][:3] == [3, 1, 1]


def test_words_of_earlier_texts_are_not_kept():
    """Pipeline, language: a worker kept the likelihoods of all words that it had met, and what the step before had learnt while the model was counted."""
    model = langid.Model(["x", "y"], np.ones((2, len(langid.ORDERS) * langid.BUCKETS)))
    few, many = (_most(langid._select(_texts(n), model, 0.0)) for n in (4, 24))
    assert many < 1.3 * few
    kept.kept("encoder of another step", object)
    assert list(langid._count(_texts(1), ["x", "y"]))
    assert not kept._things


def test_sets_of_pairs_are_read_a_few_at_a_time():
    """Pipeline, near_duplicates: the sets of a whole batch of pairs were copied at once."""
    sets = [np.arange(i, i + 2000, dtype=np.uint64).tobytes() for i in range(2000)]
    pairs = pa.RecordBatch.from_arrays([pa.array(range(2000), pa.int64())] * 2 + [pa.array(sets), pa.array(sets[::-1])], ["a", "b", "of_a", "of_b"])
    want = [i for i in range(2000) if (2000 - abs(1999 - 2 * i)) >= 0.8 * (2000 + abs(1999 - 2 * i))]
    assert _most(similar._alike([pairs], 0.8)) < 30_000_000
    assert [x for out in similar._alike([pairs], 0.8) for x in out.column(0).to_pylist()] == want
