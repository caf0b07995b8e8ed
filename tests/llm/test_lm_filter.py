"""The filter of n-gram counts, and the model on top of it, against exact counts."""

import math
import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pytest

from plainweave.llm import lm_scoring
from plainweave.llm.lm_scoring import DIGITS, WORDS, LogFrequencyFilter, Numbers, build, first_probes


def as_rows(h, c, kind, blocks):
    return [(int(b), kind, int(x), int(n)) for b, x, n in zip(LogFrequencyFilter.block(h, blocks), h.view(np.int64), c, strict=True)]


def filled(spark, rows, blocks, probes, partitions=3):
    counts = spark.createDataFrame(rows, "block int, kind byte, h long, c long").repartition(partitions, "block")
    table, lines = build(counts, blocks, probes)
    bits = np.zeros((blocks, lines * WORDS), np.uint64)
    rows = table.collect()
    for r in rows:
        bits[r["block"]] = np.frombuffer(r["bits"], np.uint64)
    return bits, lines, [r["mistakes"] for r in rows]


@pytest.mark.parametrize("blocks", [4, 1024])
def test_the_filter_gives_counts_back(spark, blocks):
    rng = np.random.default_rng(2)
    h = np.unique(rng.integers(0, 1 << 63, 30_000, dtype=np.uint64) * np.uint64(2))
    c = np.maximum(1, (rng.pareto(0.7, len(h)) + 0.5).astype(np.int64)).clip(max=1 << 30)
    half = len(h) // 2
    rows = as_rows(h[:half], c[:half], 0, blocks) + as_rows(h[half:], c[half:], 1, blocks)
    probes = first_probes(half)
    bits, lines, mistakes = filled(spark, rows, blocks, probes)
    made = LogFrequencyFilter(bits.reshape(-1), blocks, lines, probes)
    one, pair = made.counts(h[:half], 0), made.counts(h[half:], 1)
    assert (one == c[:half]).mean() > 0.999
    assert (abs(pair / c[half:] - 1) <= 2.0 ** -(DIGITS + 1)).mean() > 0.98 and (pair[c[half:] < 16] == c[half:][c[half:] < 16]).mean() > 0.98
    by_chance = sum(mistakes) / (blocks * lines)
    for kind in (0, 1):
        found = (made.counts(h + np.uint64(1), kind) > 0).sum()
        assert abs(found - by_chance * len(h)) <= 4 + 4 * (by_chance * len(h)) ** 0.5 and found < 0.001 * len(h)
    if blocks == 1024:
        assert lines == 1
    else:
        assert 0.3 < np.bitwise_count(bits).mean() / 64 < 0.6  # half of the bits, whatever the size
    # One block alone gives the same counts.
    k = int(LogFrequencyFilter.block(h[half : half + 1], blocks)[0])
    mine = h[half:][LogFrequencyFilter.block(h[half:], blocks) == k]
    assert (LogFrequencyFilter(bits[k], blocks, lines, probes, k).counts(mine, 1) == made.counts(mine, 1)).all()


def test_the_filter_grows_with_its_entries(spark):
    probes = 4
    sizes = []
    for n in (20_000, 40_000, 80_000):
        h = np.unique(np.random.default_rng(n).integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
        sizes.append(filled(spark, as_rows(h, np.ones(len(h), np.int64), 1, 4), 4, probes)[1])
    assert 1.9 < sizes[1] / sizes[0] < 2.1 and 1.9 < sizes[2] / sizes[1] < 2.1


def texts(n=400, seed=5):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(800)]
    weights = [1 / (k + 1) for k in range(800)]
    return [(k, " ".join(rng.choices(words, weights, k=rng.randint(0, 80)))) for k in range(n)] + [(n, None), (None, "w1 w2"), (7, "W1 W1 w5")]


def exact(rows):
    low = lambda t: re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
    one, two = Counter(), Counter()
    for i, t in rows:
        if not lm_scoring.held_out(i):
            w = [*low(t), None]
            one.update(w)
            two.update(zip([None, *w], w))
    return one, two, low


def exact_mu(one, two):
    single = sum(c == 1 for c in two.values())
    low, high = 0.1, 1e6
    for _ in range(60):
        mu = math.sqrt(low * high)
        low, high = (mu, high) if sum(c * mu / (c + mu) for c in one.values()) < single else (low, mu)
    return mu


def test_scores_equal_those_of_exact_counts_both_ways(spark):
    """Sent as a file, and asked for block by block: the same scores, and those of exact counts but for rare mistakes."""
    rows = texts()
    one, two, low = exact(rows)
    mu, total, distinct = exact_mu(one, two), sum(one.values()), len(one)
    p1 = lambda w: (one[w] + 0.1) / (total + 0.1 * (distinct + 1))
    p = lambda v, w: (two[v, w] + mu * p1(w)) / (one[v] + mu) if one[v] else p1(w)
    want = {(i, len(low(t))): sum(math.log10(p(v, w)) for v, w in zip([None, *low(t)], [*low(t), None])) for i, t in rows}
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).cache()
    a, b = ({(r["doc_id"], r["n_tokens"] - 1): r for r in lm_scoring.score(docs, **o).collect()} for o in ({}, {"most_bytes": 0}))
    assert a.keys() == b.keys() == want.keys()
    for k, r in a.items():
        assert r["score"] == pytest.approx(b[k]["score"], abs=1e-9) and r["base_score"] == pytest.approx(b[k]["base_score"])
        assert r["n_known"] == b[k]["n_known"]
    off = [abs(a[k]["score"] - want[k]) / (k[1] + 1) for k in want]
    assert np.mean(off) < 0.01 and np.mean(np.array(off) < 0.02) > 0.95


def test_probabilities_add_up_to_one(spark):
    """Over the vocabulary and one unknown word, after contexts of all ranks, with the filter's mistakes in it."""
    rows = [r for r in texts(1500, 6) if not lm_scoring.held_out(r[0])]
    one, two, _ = exact(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    counts, blocks = lm_scoring.count(docs, 4).cache(), lm_scoring.block_count(4)
    assert sorted(r["c"] for r in counts.filter("kind = 1").collect()) == sorted(two.values()) and min(two.values()) == 1
    words = {r["h"]: r["c"] for r in counts.filter("kind = 0").collect()}
    assert sorted(words.values()) == sorted(one.values())
    probes = first_probes(len(one))
    table, lines = build(counts, blocks, probes)
    bits = np.zeros((blocks, lines * WORDS), np.uint64)
    for r in table.collect():
        bits[r["block"]] = np.frombuffer(r["bits"], np.uint64)
    made = LogFrequencyFilter(bits.reshape(-1), blocks, lines, probes)
    numbers = Numbers(sum(one.values()), len(one), lm_scoring.good_turing(counts), sum(r["mistakes"] for r in table.collect()) / (blocks * lines) * len(one))
    keys = np.array(sorted(words, key=lambda h: -words[h]), np.int64).view(np.uint64)
    c = made.counts(keys, 0)
    for k in [*range(10), *range(10, len(keys), 23)]:
        pair = made.counts(lm_scoring.bigram(np.full(len(keys), keys[k]), keys), 1)
        p = numbers.probability(c, np.full(len(keys), c[k]), pair)
        unknown = numbers.probability(np.zeros(1), c[k : k + 1], np.zeros(1))[0]
        assert p.sum() + unknown == pytest.approx(1, abs=0.01)
    assert numbers.probability(c, np.zeros(len(c)), np.zeros(len(c))).sum() == pytest.approx(1 - numbers.unigram(np.zeros(1))[0])


def test_counts_are_summed_in_little_memory():
    rng = np.random.default_rng(5)
    parts, want = [], Counter()
    for _ in range(8):
        h, c = np.unique(rng.integers(0, 200_000, 150_000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), return_counts=True)
        parts.append((h, c.astype(np.int32)))
        want.update(dict(zip(h.tolist(), c.tolist(), strict=True)))
    held = sum(h.nbytes + c.nbytes for h, c in parts)
    tracemalloc.start()
    for _ in lm_scoring._summed(parts):
        pass
    _, most = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert most < held / 2
    found = [(h, c) for h, c in lm_scoring._summed(parts)]
    keys = np.concatenate([h for h, _ in found])
    assert (np.diff(keys.astype(object)) > 0).all() and dict(zip(keys.tolist(), np.concatenate([c for _, c in found]).tolist(), strict=True)) == want
    assert list(lm_scoring._summed([])) == []
