"""How much a worker takes at once while it makes ids and fingerprints."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from plainweave.llm import packing, simhash
from plainweave.llm.bpe import MOST_ASKED, Bpe
from plainweave.llm.queries import tokenizer


class Asked:
    """The library, with the numbers of characters it was asked for."""

    def __init__(self, own):
        self.own, self.sizes = own, []

    def encode_batch_fast(self, texts, **options):
        self.sizes.append(sum(map(len, texts)))
        return self.own.encode_batch_fast(texts, **options)


@pytest.mark.parametrize("letters", ["abcdefg", "абвгдеж"])
def test_the_library_is_asked_for_bounded_texts(letters):
    rng = random.Random(3)
    texts = [" ".join("".join(rng.choices(letters, k=7)) for _ in range(rng.choice([0, 5, 400]))) for _ in range(400)] + ["", letters * 60_000, "x"]
    bpe = Bpe(tokenizer())
    plain = [e.ids for e in bpe.tokenizer.encode_batch(texts, add_special_tokens=False)]
    bpe.tokenizer = asked = Asked(bpe.tokenizer)
    assert [x.tolist() for x in bpe.encode(texts)] == plain
    assert len(asked.sizes) > 3
    assert sorted(asked.sizes)[-2] <= MOST_ASKED  # but for the one longer text
    assert bpe.whole([]) == []


class Table:
    """Holds the function that an operator gives to mapInArrow."""

    def select(self, *columns):
        return self

    def mapInArrow(self, run, schema):  # noqa: N802
        return run


def peak_mb(run, batch):
    list(run(iter([batch.slice(0, 1)])))  # what is kept for good
    tracemalloc.start()
    for _ in run(iter([batch])):
        pass
    peak = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    return peak


def test_a_task_holds_the_arrays_of_a_small_chunk(monkeypatch, spark):
    rng = np.random.default_rng(5)
    words = np.array(["".join(w) for w in rng.choice(list("abcdefgh"), (2000, 6))])
    texts = [" ".join(rng.choice(words, 300)) for _ in range(3000)]
    ids = pa.array(range(len(texts)), pa.int64())
    monkeypatch.setattr(packing, "TaskContext", type("T", (), {"get": classmethod(lambda c: c), "partitionId": staticmethod(lambda: 0)}))
    assert peak_mb(packing.pack(Table(), tokenizer()), pa.RecordBatch.from_arrays([ids, pa.array(texts)], names=["doc_id", "text"])) < 50
    run = simhash.fingerprints(Table())
    assert peak_mb(run, pa.RecordBatch.from_arrays([ids, ids, pa.array(texts)], names=["doc_id", "__pw_key", "text"])) < 45
