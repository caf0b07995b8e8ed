"""Operators against plain Python on small tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from plainweave.llm import exact_dedup, line_dedup, lm_scoring, mixing, packing, quality_rules, simhash, substring_dedup, url_filter
from plainweave.llm.queries import tokenizer

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BLANK = re.compile(r"[\x20\x09-\x0D]")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    vocabulary = [f"{rng.choice('abcdefgÄéß')}{k}" for k in range(400)]
    sentence = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage = sentence(70)
    rows = []
    for k in range(n):
        text = "\n".join(sentence(rng.randint(1, 40)) for _ in range(rng.randint(1, 6)))
        if k % 4 == 0:
            text += "\n" + passage + "\t" + sentence(3)
        if k % 9 == 0 and rows:
            text = rng.choice(rows)[1] or ""
        if k % 7 == 0 and rows:
            text = " " + (rng.choice(rows)[1] or "").replace(" ", "  ", 3)
        rows.append((k, text, "en", f"s{k % 5}" if k % 11 else None, len(text)))
    rows += [(n, None, None, None, None), (n + 1, "", "en", "s1", 0), (n + 2, " \n\t", "en", "s1", 3), (n + 3, sentence(6000), "en", "s2", None), (None, passage, "en", "s0", None), rows[3], rows[3], (n + 4, "spam! " * 300, "en", "s3", None)]
    return rows


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def collected(df, *names):
    return sorted((tuple(r[x] for x in names) for r in df.collect()), key=repr)


def last(i):
    return math.inf if i is None else i


def words(text):
    return WORD.findall(text or "")


def test_exact_dedup(docs, rows, none):
    bare = lambda t: BLANK.sub("", t or "")
    groups = defaultdict(list)
    for r in rows:
        groups[bare(r[1])].append(r)
    want = []
    for text, rs in groups.items():
        stays = min(rs, key=lambda r: (-len(r[1] or ""), last(r[0])))
        kept = False
        for r in rs:
            is_kept = not kept and r[0] == stays[0] and len(r[1] or "") == len(stays[1] or "")
            kept |= is_kept
            want.append((r[0], stays[0], len(rs), is_kept, hashlib.sha256(text.encode()).hexdigest()))
    got = collected(exact_dedup.decisions(docs), "doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert got == sorted(want, key=repr)
    left = exact_dedup.drop_duplicates(docs)
    assert left.columns == docs.columns
    assert Counter(r["doc_id"] for r in left.collect()) == Counter(w[0] for w in want if w[3])
    assert exact_dedup.decisions(none).count() == exact_dedup.drop_duplicates(none).count() == 0


def test_exact_dedup_index_compacts(spark):
    index = exact_dedup.DigestIndex(fanout=2)
    for k in range(5):
        index.flush(spark.createDataFrame([(k, 7), (k + 10, k)], "doc_id long, digest long"))
        index.compact()
    index.compact(whole=True)
    assert sorted(map(tuple, index.entries().collect())) == sorted([(7, 5, 0), *[(k, 1, k + 10) for k in range(5)]])


def statistics(text):
    w = words(text)
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    windows = defaultdict(list)
    for i in range(len(w) - 7):
        windows[tuple(w[i : i + 8])].append(i)
    covered = {j for at in windows.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_quality_statistics_and_base_rule(docs, rows, none, spark):
    labels = spark.createDataFrame([(0, 1, 0), (None, 0, 1), (1, None, 0), (2, 0, 0), (2, 1, 0)], "doc_id long, quality int, toxic int")
    got = collected(quality_rules.judge(docs, labels), "doc_id", *quality_rules.BASE, "base_failed", "kept")
    want = []
    for r in rows:
        s = statistics(r[1])
        failed = s[0] < 20 or 100 * s[4] > 30 * s[0]
        want.append((r[0], *s, failed, not failed))
    assert got == sorted(want, key=repr)
    assert collected(quality_rules.keep_good(docs, labels), "doc_id") == sorted([(w[0],) for w in want if w[-1]], key=repr)
    assert quality_rules.judge(none, labels).count() == 0


def test_quality_rules_learn_what_is_there(spark):
    """Held-out accuracy on documents of which the bad ones are full of exclamation marks."""
    rng = random.Random(2)
    make = lambda bad: " ".join(f"w{rng.randrange(500)}" + ("!!" if bad and rng.random() < 0.6 else "") for _ in range(rng.randint(25, 80)))
    rows = [(k, make(k % 3 == 0)) for k in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 3 != 0)) for k in range(400)], "doc_id long, quality int")
    out = {r["doc_id"]: r["kept"] for r in quality_rules.judge(docs, labels).filter("doc_id >= 400").collect()}
    assert sum(kept == (k % 3 != 0) for k, kept in out.items()) / len(out) > 0.97
    assert all(kept for k, kept in out.items() if k % 3)


def test_packing_round_trip(docs, rows, none):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer())
    t.encode_special_tokens = True
    whole = Counter()
    for r in rows:
        whole[(r[0], tuple([*t.encode(r[1] or "", add_special_tokens=False).ids, 1]))] += 1
    got = packing.pack(docs, tokenizer(), capacity=256, block_tokens=5000).collect()
    sequences, pieces = defaultdict(list), defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        pieces[r["doc_id"]].append(r)
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= 256
    padding = sum((-n) % 256 for n in (sum(x[1] for x in p) for p in sequences.values()) if n & (n - 1))
    assert padding == 0
    for doc_id, ps in pieces.items():
        options = [ids for (i, ids), n in whole.items() if i == doc_id for _ in range(n)]
        assert sum(p["length"] for p in ps) == sum(map(len, options))
        for ids in options:
            mine = [p for p in ps if p["doc_tokens"] == len(ids) and zlib.crc32(np.array(ids[p["start"] : p["start"] + p["length"]], "<u4").tobytes()) == p["ids_crc32"]]
            covered = {j for p in mine for j in range(p["start"], p["start"] + p["length"])}
            assert covered == set(range(len(ids)))
    assert packing.pack(none, tokenizer()).count() == 0


def test_packing_ids_equal_the_library():
    from plainweave.llm.bpe import Bpe

    bpe = Bpe(tokenizer())
    texts = ["", " ", "a  b\n\nc\t d", "it's Ünïcödé 漢字 \u00a0x", "<|endoftext|> 123abc!?...", "\x1c\x85x", "word" * 500, "  \n x", "½²³ ª º", "trailing  "]
    for got, want in zip(bpe.encode(texts), bpe.whole(texts), strict=True):
        assert got.tolist() == want.tolist()


def test_substring_dedup(docs, rows, none):
    window = 12
    first = {}
    for r in rows:
        w = words(r[1])
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            first[k] = min(first.get(k, math.inf), last(r[0]))
    want = []
    for r in rows:
        w = words(r[1])
        gone = {j for i in range(len(w) - window + 1) if first[tuple(w[i : i + window])] < last(r[0]) for j in range(i, i + window)}
        want.append((r[0], len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    assert collected(substring_dedup.deduplicate(docs, window), "doc_id", "n_words", "n_removed", "kept") == sorted(want, key=repr)
    assert substring_dedup.deduplicate(none).count() == 0


def test_equal_windows_get_equal_telling_symbols():
    """A phrase whose context lies in a shared window is named alike in both texts."""
    rng = random.Random(4)
    name = lambda n: np.array([rng.getrandbits(64) for _ in range(n)], np.uint64)
    for _ in range(50):
        shared = name(60)
        texts = [np.concatenate([name(rng.randrange(30)), shared, name(rng.randrange(30))]) for _ in range(2)]
        found = []
        for t in texts:
            at = next(i for i in range(len(t)) if (t[i : i + 60] == shared).all())
            s = substring_dedup.Symbols(t.copy(), np.array([0, len(t)])).recompress()
            inside = (s.left >= at) & (s.right <= at + 60)
            found.append(set(zip(s.name[inside].tolist(), (s.left[inside] - at).tolist(), strict=True)))
        assert found[0] == found[1]
        assert found[0]


def fingerprint(text, shingle=3):
    w = [re.sub("[A-Z]+", lambda m: m[0].lower(), x) for x in words(text)]
    s = [" ".join(w[i : i + shingle]) for i in range(max(1, len(w) - shingle + 1))] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def reachable(items, near):
    root = list(range(len(items)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(items)):
        for j in range(i):
            if near(items[i], items[j]):
                root[find(i)] = find(j)
    return [find(i) for i in range(len(items))]


def test_simhash(docs, rows, none):
    fp = [fingerprint(r[1]) for r in rows]
    roots = reachable(fp, lambda a, b: (a ^ b).bit_count() <= 3)
    least = defaultdict(lambda: math.inf)
    for r, k in zip(rows, roots, strict=True):
        least[k] = min(least[k], last(r[0]))
    want = sorted([(r[0], f"{f:016x}", None if least[k] == math.inf else least[k]) for r, f, k in zip(rows, fp, roots, strict=True)], key=repr)
    assert collected(simhash.near_duplicates(docs), "doc_id", "fingerprint", "component_id") == want
    left = simhash.drop_near_duplicates(docs)
    assert left.columns == docs.columns
    assert {r["doc_id"] for r in left.collect()} == {None if x == math.inf else x for x in least.values()}
    assert simhash.near_duplicates(none).count() == 0


@pytest.mark.parametrize(("parts", "tile"), [(None, 4096), (5, 7), (4, 50), (8, 3)])
def test_simhash_links_all_for_any_tiles(spark, parts, tile):
    rng = random.Random(6)
    fps = {0}
    for _ in range(40):
        x = rng.getrandbits(64)
        fps.add(x)
        for _ in range(5):
            x ^= sum(1 << b for b in rng.sample(range(64), rng.randint(1, 4)))
            fps.add(x)
    fps = sorted(fps)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(x),) for x in fps], "fp long")
    star = simhash.links(df, parts, tile).collect()
    at = {signed(x): i for i, x in enumerate(fps)}
    got = reachable(list(range(len(fps))), lambda i, j, e={frozenset((at[r["a"]], at[r["b"]])) for r in star}: frozenset((i, j)) in e)
    want = reachable(fps, lambda a, b: (a ^ b).bit_count() <= 3)
    same = lambda roots: {frozenset(i for i, r in enumerate(roots) if r == k) for k in set(roots)}
    assert same(got) == same(want)


def test_lm_scoring(docs, rows, none):
    low = lambda t: [re.sub("[A-Z]+", lambda m: m[0].lower(), x) for x in words(t)]
    held = lambda i: zlib.crc32(str(i).encode() if i is not None else b"") % 10 == 0
    counts = Counter(x for r in rows if not held(r[0]) for x in (*low(r[1]), None))
    total, distinct = sum(counts.values()), len(counts)
    p = lambda x: math.log10((counts[x] + 0.1) / (total + 0.1 * (distinct + 1)))
    for common in (5, 1 << 16):
        got = sorted(lm_scoring.score(docs, common).collect(), key=lambda r: (repr(r["doc_id"]), r["n_tokens"]))
        for g, r in zip(got, sorted(rows, key=lambda r: (repr(r[0]), len(words(r[1])))), strict=True):
            tokens = [*low(r[1]), None]
            assert (g["doc_id"], g["held_out"], g["n_tokens"], g["n_known"], g["train_tokens"]) == (r[0], held(r[0]), len(tokens), sum(counts[x] > 0 for x in tokens), total)
            assert g["base_score"] == pytest.approx(sum(map(p, tokens)))
            assert -10 * len(tokens) < g["score"] < 0
    assert lm_scoring.score(none).count() == 0


def test_lm_is_better_than_its_base_on_held_out_text(spark):
    """Text with an order in it: the bigram model must beat the unigram base."""
    rng = random.Random(8)
    after = {k: [rng.randrange(200) for _ in range(4)] for k in range(200)}

    def text():
        at, out = rng.randrange(200), []
        for _ in range(120):
            out.append(f"w{at}")
            at = rng.choice(after[at])
        return " ".join(out)

    docs = spark.createDataFrame([(k, text()) for k in range(300)], "doc_id long, text string")
    r = lm_scoring.score(docs).filter("held_out").selectExpr("sum(score)", "sum(base_score)", "sum(n_tokens)").first()
    assert r[0] > r[1] + 0.5 * r[2]


def test_mixing(docs, rows, none):
    sizes = [len(words(r[1])) for r in rows]
    sources = sorted({r[3] for r in rows}, key=lambda s: (s is None, s or ""))
    size = {s: sum(n for n, r in zip(sizes, rows, strict=True) if r[3] == s) for s in sources}
    weight = {s: (1, 2, 3)[k % 3] for k, s in enumerate(sources)}
    target, over = {}, set()
    while True:
        free = sum(size.values()) - sum(3 * size[s] for s in over)
        shares = sum(weight[s] for s in sources if s not in over)
        target = {s: float(3 * size[s]) if s in over else free * weight[s] / shares for s in sources}
        more = {s for s in sources if target[s] > 3 * size[s]}
        if not more:
            break
        over |= more
    out = mixing.mix(docs, bucket_rows=4).collect()
    assert sorted(map(repr, ((r["doc_id"], r["size"]) for r in out))) == sorted(map(repr, zip((r[0] for r in rows), sizes, strict=True)))
    taken = Counter()
    for r in out:
        assert r["source_size"] == size[r["source"]] and r["target"] == pytest.approx(target[r["source"]])
        assert 0 <= r["taken"] <= 3 * r["size"] and r["taken"] == r["size"] * r["copies"]
        taken[r["source"]] += r["taken"]
    for s in sources:
        assert abs(taken[s] - target[s]) <= max(n for n, r in zip(sizes, rows, strict=True) if r[3] == s)
    again = mixing.mix(docs.repartition(7), bucket_rows=4).collect()
    key = lambda r: repr((r["doc_id"], r["taken"], r["size"]))
    assert sorted(map(key, out)) == sorted(map(key, again))
    mixed = mixing.sample(docs, bucket_rows=4)
    assert mixed.columns == docs.columns
    assert sum(len(words(r["text"])) for r in mixed.collect()) == sum(taken.values())
    assert mixing.mix(none).count() == mixing.sample(none).count() == 0


def test_line_dedup(docs, rows, none):
    run = 3
    unique = sorted({(r[0], r[1]) for r in rows if r[1] is not None}, key=lambda r: (last(r[0]), xxhash.xxh64_hexdigest(r[1])))
    numbered = {r: [x for x in r[1].split("\n") if WORD.search(x)] for r in unique}
    first = {}
    for r in unique:
        for k in range(len(numbered[r]) - run + 1):
            first.setdefault(tuple(numbered[r][k : k + run]), (r, k))
    by = {(g["doc_id"], g["n_lines"], g["n_removed"], g["kept"]) for g in line_dedup.deduplicate(docs).collect()}
    for r in unique:
        w = numbered[r]
        gone = {j for k in range(len(w) - run + 1) if first[tuple(w[k : k + run])] != (r, k) for j in range(k, k + run)}
        mine = [b for b in by if b[0] == r[0] and b[1] == len(w) and b[2] == len(gone)]
        assert mine, r
        if not gone:
            assert any(b[3] == r[1] for b in mine)
    assert line_dedup.deduplicate(docs).count() == len(rows)
    assert line_dedup.deduplicate(none).count() == 0


def test_url_cascade_and_rules(spark):
    hosts = [f"h{k}.{'casino' if k % 3 == 0 else 'plain'}.org" for k in range(500)]
    urls = [f"https://{h}/x" for h in hosts] + ["http://a.COM/", "http://com/x?y", "http://com", "HTTP://x.example.com/en/a#b", "s://www.example.com/en/", "http://a.net/es/", "http://anet/es/", "http://net/fr", None, "no scheme", "", "http:///p", "http://a.com/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").repartition(3)
    got = {r["page_id"]: r for r in url_filter.judge(pages).collect()}
    for k in range(500):
        assert (got[k]["rule"], got[k]["verdict"]) == (None, "block" if k % 3 == 0 else "allow")
    want = [("com/", "allow"), ("com/", "allow"), (None, "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), (None, "allow"), (None, "allow"), (None, "allow"), (None, "allow"), (None, "allow"), (None, "allow"), ("com/", "allow")]
    assert [(got[500 + i]["rule"], got[500 + i]["verdict"]) for i in range(len(want))] == want
    assert (got[503]["host"], got[503]["path"], got[508]["host"]) == ("x.example.com", "/en/a", "")
    universe = spark.createDataFrame([(f"host{i}", i % 3 == 0) for i in range(6000)], "key string, listed boolean")
    cascade = url_filter.Cascade(universe, bits_per_key=1)
    assert len(cascade.levels) > 1
    assert all(r[0] == r[1] for r in universe.select("listed", cascade.contains(universe.key)).collect())
    assert url_filter.judge(pages.limit(0)).count() == 0
    with pytest.raises(ValueError, match="level 0"):
        url_filter.Cascade(universe, most_log2_bits=4)


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    rows_ = corpus(3, 80)
    spark.createDataFrame(rows_, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k, 1, 0) for k in range(20)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "exact_dedup", "simhash", "mixing", "packing"]
    left = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = left
        left = stage(spark, left, str(tmp_path)).cache()
        if k < 4:
            assert left.columns == docs.columns, name
        if k < 3:
            assert {r["doc_id"] for r in left.collect()} <= {r["doc_id"] for r in before.collect()}
    ids = {r["doc_id"] for r in left.collect()}
    assert ids == {r["doc_id"] for r in before.collect()}
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == ids
