"""Null ids, ties, hot keys, clashing names, and what each method is made of."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from plainweave.llm import cascade, exact_dedup, line_dedup, lm_scoring, mixing, packing, pii, quality_rules, simhash, substring_dedup, url_filter
from plainweave.llm.common import ROW_KEY, Bloom, joined_by_weight, row_key, stored
from plainweave.llm.queries import tokenizer

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sentence(rng, n):
    return " ".join(f"w{rng.randrange(3000)}" for _ in range(n))


# Columns named like the operators' intermediates, and tables where a third of the rows are one text or have no id.

CLASHING = ["n_words", "digest", "sha", "rank", "k", "n", "fp", "size", "copies", "target", "u", "bucket", "kept", "row", "stays", "gone", "first", "source"]


@pytest.fixture(scope="module")
def clashing(spark):
    rng = random.Random(1)
    texts = [sentence(rng, 60) for _ in range(30)] + ["same text " * 30] * 15 + [None, ""]
    rows = [(k if k % 3 else None, t) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return docs.select("*", *[F.lit(f"x{k}").alias(c) for k, c in enumerate(CLASHING)]).repartition(4).cache()


def test_names_of_other_columns_do_not_matter(spark, clashing):
    plain = clashing.select("doc_id", "text", "source")
    labels = spark.createDataFrame([(k, k % 2) for k in range(20)], "doc_id long, quality int")
    for op in (exact_dedup.decisions, line_dedup.deduplicate, simhash.near_duplicates, substring_dedup.deduplicate, lm_scoring.score, mixing.mix, lambda d: packing.pack(d, tokenizer()), lambda d: pii.pseudonymise(d, b"k"), lambda d: quality_rules.judge(d, labels)):
        assert op(clashing).count() == op(plain).count()
    for op in (exact_dedup.drop_duplicates, simhash.drop_near_duplicates, mixing.sample, lambda d: quality_rules.keep_good(d, labels)):
        out = op(clashing)
        assert out.columns == clashing.columns
        got, want = out.collect(), op(plain).collect()
        assert sorted(((r["doc_id"], r["text"]) for r in got), key=repr) == sorted(((r["doc_id"], r["text"]) for r in want), key=repr)
        assert all(r[c] == f"x{k}" for r in got for k, c in enumerate(CLASHING))


# op5


def test_the_row_that_stays_comes_from_the_index(spark):
    """Of equal texts in several memtables: most code points, then the smallest id; repeated rows and ids of none leave one."""
    rows = [(9, "a b"), (3, "a  b"), (5, "a  b"), (None, "a  b"), (1, "ab"), (None, "z"), (None, "z"), (7, "q"), (7, "q"), (8, None), (4, " "), (4, "  ")]
    for parts in (1, 3, 20):
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        out = exact_dedup.decisions(docs).collect()
        kept = Counter((r["doc_id"], r["keep_id"], r["group_size"]) for r in out if r["kept"])
        assert kept == Counter([(3, 3, 5), (None, None, 2), (7, 7, 2), (4, 4, 3)])
        assert {(r["doc_id"], r["keep_id"]) for r in out if r["group_size"] == 5} == {(9, 3), (3, 3), (5, 3), (None, 3), (1, 3)}
        left = Counter((r["doc_id"], r["text"]) for r in exact_dedup.drop_duplicates(docs).collect())
        assert left == Counter([(3, "a  b"), (None, "z"), (7, "q"), (4, "  ")])


def test_compaction_goes_by_levels(spark):
    index = exact_dedup.DigestIndex(fanout=3)
    rows = spark.range(0, 900, 1, 10).select(F.col("id").alias("doc_id"), (F.col("id") % 100).alias("digest"))
    index.flush(rows)
    assert index.runs == [10] and index.entries().count() == 100
    index.compact()
    assert index.runs[:2] == [0, 4] or index.runs[0] == 0 and sum(index.runs) < 10
    index.compact(whole=True)
    assert sum(index.runs) == 1 and sum(map(len, index.levels)) == 1
    assert sorted(map(tuple, index.entries().collect())) == [(d, 9, d) for d in range(100)]


def test_two_texts_of_one_digest_stop_the_job(spark):
    digested = spark.createDataFrame([(7, b"s", "one"), (7, b"s", "two")], "digest long, sha binary, bare string")
    hits = stored(spark.createDataFrame([(7, b"s", 2)], "digest long, sha binary, n long").withColumn("first_id", F.struct(F.lit(1).alias("doc_id"))), "hits")
    with pytest.raises(Exception, match="two texts share"):
        exact_dedup._verified(digested, hits, Bloom(hits, "digest")).collect()


# op9


def test_common_prefixes_reach_the_longest_runs(spark):
    """A run of 50 lines: intervals at depths 3 to 48, each suffix's common prefix, and one maximal run."""
    rng = random.Random(2)
    shared = [sentence(rng, 4) for _ in range(50)]
    rows = [(1, "\n".join([sentence(rng, 3), *shared])), (2, "\n".join(["x", *shared[:20], "y", *shared])), (3, "\n".join(shared[10:13]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert [d for d, _ in line_dedup.intervals(docs)] == [3, 6, 12, 24, 48]
    runs = sorted((r["doc_id"], r["k"], r["n"]) for r in line_dedup.runs(docs).collect())
    assert runs == [(2, 1, 20), (2, 22, 50), (3, 0, 3)]
    lines = {i: t.split("\n") for i, t in rows}
    seen = []
    best = {}
    for i in sorted(lines):
        for k in range(len(lines[i])):
            lcp = lambda j, m: next((d for d in range(len(lines[i]) + 1) if lines[i][k + d : k + d + 1] != lines[j][m + d : m + d + 1] or not lines[i][k + d : k + d + 1]), 0)  # noqa: B023, E731
            best[i, k] = max((lcp(j, m) for j, m in seen), default=0)
            seen.append((i, k))
    got = {(r["doc_id"], r["k"]): r["lcp"] for r in line_dedup.common_prefixes(docs).collect()}
    assert got == {x: max(d for d in (3, 6, 12, 24, 48) if d <= n) for x, n in best.items() if n >= 3}


# op10


def test_near_duplicates_without_ids(spark):
    rng = random.Random(3)
    text = sentence(rng, 80)
    rows = [(None, text)] * 3 + [(None, "other " + sentence(rng, 80)), (None, None), (None, ""), (5, ""), (6, sentence(rng, 70)), (6, sentence(rng, 70))]
    left = simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert Counter(r["doc_id"] for r in left) == {None: 2, 5: 1, 6: 2}
    assert sum(r["text"] == text for r in left) == 1


# op7


def test_ids_of_none_are_drawn_apart(spark):
    rng = random.Random(4)
    rows = [(None, sentence(rng, rng.randint(1, 30)), "a") for _ in range(400)] + [(k, sentence(rng, 10), "b") for k in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5).cache()
    out = mixing.mix(docs, bucket_rows=50).collect()
    taken, target = defaultdict(int), {}
    for r in out:
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    assert all(abs(taken[s] - target[s]) <= 30 for s in target) and len({r["copies"] for r in out if r["source"] == "a"}) == 2
    again = mixing.mix(docs.repartition(2), bucket_rows=50).collect()
    assert Counter((r["doc_id"], r["size"], r["copies"]) for r in again) == Counter((r["doc_id"], r["size"], r["copies"]) for r in out)


# op1


def test_conjunctions_pruning_and_two_rules():
    """Bad documents of two kinds, each told by two thresholds together; a condition of chance is pruned away."""
    rng = random.Random(5)
    names = quality_rules.FEATURES
    at = {n: k for k, n in enumerate(names)}
    rows = []
    for _ in range(3000):
        x = [rng.random() for _ in names]
        first = x[at["symbols_per_word"]] > 0.6 and x[at["capitals_per_char"]] > 0.6
        second = x[at["marks_per_word"]] > 0.7 and x[at["words_per_line"]] < 0.4
        rows.append((first or second, x))
    rules = quality_rules.cover(rows, cuts=64)
    assert len(rules) >= 2 and any(len(r) >= 2 for r in rules)
    used = Counter(c.name for r in rules for c in r)
    assert {"symbols_per_word", "capitals_per_char", "marks_per_word", "words_per_line"} <= used.keys()
    rejects = lambda x: any(all(x[at[c.name]] >= c.threshold if c.at_least else x[at[c.name]] <= c.threshold for c in r) for r in rules)
    assert sum(rejects(x) == bad for bad, x in rows) / len(rows) > 0.97
    noisy = [(bad, x) for bad, x in rows if rng.random() < 0.9] + [(True, [rng.random() for _ in names]) for _ in range(20)]
    assert max(len(r) for r in quality_rules.cover(noisy, min_precision=0.9)) <= 4


def test_the_sample_of_labels_is_bounded_and_the_same(spark):
    rng = random.Random(6)
    rows = [(k, sentence(rng, 30) + (" !!!" * 20 if k % 2 else "")) for k in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1 - k % 2) for k in range(3000)], "doc_id long, quality int")
    stats = stored(quality_rules.statistics(docs), "statistics")
    seen = []
    whole = quality_rules.cover
    quality_rules.cover = lambda r, **o: seen.append(r) or whole(r, **o)
    try:
        for d in (stats, stats.repartition(7)):
            quality_rules.learn(d, labels, max_labelled=500)
    finally:
        quality_rules.cover = whole
    assert 400 < len(seen[0]) <= 500 and seen[0] == seen[1]


# op2


def test_pieces_go_to_the_cheapest_sequence_with_room():
    """The placement against a plain version of the rule."""
    rng = np.random.default_rng(7)
    for capacity in (16, 64):
        lengths = rng.integers(1, capacity, 60)
        placed, n = packing.place(lengths, capacity)
        total = int(lengths.sum())
        room = [capacity] * (total // capacity) + [1 << b for b in reversed(range(20)) if total % capacity >> b & 1]
        assert n == len(room)
        used, cost, want = [0] * n, [0.0] * n, []
        for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
            start, left = 0, int(lengths[i])
            while left:
                fits = [s for s in range(n) if room[s] >= left]
                s = min(fits, key=lambda s: (cost[s], s)) if fits else max(range(n), key=lambda s: (room[s], -s))
                m = min(left, room[s])
                want.append((i, start, m, s, used[s]))
                room[s], used[s], cost[s] = room[s] - m, used[s] + m, cost[s] + m + m * m / 2048
                start, left = start + m, left - m
        assert placed == want and not any(room)


# op6 and what drops rows


def test_the_list_is_a_table(spark):
    pages = spark.createDataFrame([(1, "http://a.org/x"), (2, "http://b.org/"), (3, None), (4, "http://a.com/")], "page_id long, url string")
    block = spark.createDataFrame([("a.org",), ("nowhere.org",), (None,), ("a.org",), ("a.com",)], "host string")
    assert {r["page_id"]: r["verdict"] for r in url_filter.judge(pages, block).collect()} == {1: "block", 2: "allow", 3: "allow", 4: "allow"}
    assert {r["verdict"] for r in url_filter.judge(pages, block.limit(0)).collect()} == {"allow"}


def test_rows_are_dropped_alike_by_cascade_and_by_join(spark):
    rng = random.Random(8)
    rows = [(k % 700 or None, sentence(rng, 5)) for k in range(1500)]
    docs = spark.createDataFrame(rows + rows[:200], "doc_id long, text string").repartition(4).cache()
    judged = stored(docs.select("doc_id", row_key().alias(ROW_KEY), (F.crc32("text") % 3 == 0).alias("gone")), "judged")
    once = stored(judged.filter("NOT gone").groupBy("doc_id", ROW_KEY).count().filter("count > 1").select("doc_id", ROW_KEY), "once")
    key = lambda df: sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=repr)
    want = sorted({(i, t) for i, t in rows if __import__("zlib").crc32(t.encode()) % 3}, key=repr)
    assert key(cascade.drop_rows(docs, judged, once)) == key(cascade.drop_rows(docs, judged, once, most_keys=0)) == want
    assert cascade.drop_rows(docs, judged).count() > len(want)


def test_hot_keys_are_joined_where_they_are(spark):
    rows = spark.createDataFrame([(1 if k % 3 == 0 else k, k) for k in range(900)], "a long, v long")
    table = stored(rows.groupBy("a").agg(F.count("*").alias("n")), "table")
    got = joined_by_weight(rows, table, ["a"], heavy=100)
    assert sorted((r["a"], r["v"], r["n"]) for r in got.collect()) == sorted((r["a"], r["v"], r["n"]) for r in rows.join(table, "a").collect())
