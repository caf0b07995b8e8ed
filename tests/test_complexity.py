import math
import random
from collections import Counter, defaultdict
from statistics import fmean

import pytest

from plainweave.operators import lexical, syntactic
from plainweave.plans import standins
from plainweave.plans.standins import TREES

TAGS = ["nn", "dt", "vb", "rb", "jj", "cd", ",", "-lrb-", "sym", "rp"]


def expected(tokens, freq, adjectives, limit, z):
    """The lexical counts and samples from the definitions."""
    words = [(w, p) for w, p in tokens if p not in lexical.PUNCTUATION and p not in ("sent", "sym")]
    frequent = {w for w, _ in sorted(freq.items(), key=lambda x: (x[1], x[0]))[-limit:]}
    kinds = {c: [] for c in lexical.CLASSES}
    for w, p in words:
        lex = p[0] in "nj" or (p[0] == "r" and (w in adjectives or (w[-2:] == "ly" and w[:-2] in adjectives))) or (p[0] == "v" and w not in ("be", "have"))
        kinds["word"].append(w)
        if w not in frequent and p != "cd":
            kinds["sword"].append(w)
        if lex:
            kinds["lex"].append(w)
            kinds[{"n": "noun", "j": "adj", "r": "adv", "v": "verb"}[p[0]]].append(w)
            if w not in frequent:
                kinds["slex"].append(w)
                if p[0] == "v":
                    kinds["sverb"].append(w)
    ws = kinds["word"]
    n = len(ws)
    runs = [len(set(ws[i : i + z])) for i in range(n - z + 1)]
    drawn = sum(1 - math.prod(max(0, n - f - i) / (n - i) for i in range(z)) for f in Counter(ws).values()) if n >= z else len(set(ws))
    segments = [len(set(ws[i : i + z])) / z for i in range(0, n - z + 1, z)]
    return kinds, {"ndwz": len(set(ws[:z])), "ndwerz": drawn, "ndwesz": fmean(runs) if runs else len(set(ws)), "msttr": fmean(segments) if segments else len(set(ws)) / max(1, n)}


def test_lexical_vectors(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}{'ly' if i % 5 == 0 else ''}" for i in range(40)] + ["be", "have", "w1", "w6"]
    docs = {f"d{k}": [(rng.choice(vocabulary), rng.choice(TAGS)) for _ in range(n)] for k, n in enumerate((1, 7, 9, 10, 11, 60, 200))}
    freq = {w: 1 + i % 7 for i, w in enumerate(dict.fromkeys(vocabulary))}
    adjectives = {"w5", "w10", "w15ly"}
    tagged = spark.createDataFrame([(d, i, w, p) for d, ts in docs.items() for i, (w, p) in enumerate(ts)], "filename string, idx int, word string, pos string").repartition(3)
    words = spark.createDataFrame([(w, f, w in adjectives) for w, f in freq.items()] + [("w5", 0, True), ("w10", 0, True)], "lemma string, freq long, is_adj boolean")
    out = {r["filename"]: r.asDict() for r in lexical.lexical_vectors(tagged, words, rank_limit=12, z=10).collect()}
    assert out.keys() == docs.keys()
    for d, tokens in docs.items():
        kinds, samples = expected(tokens, freq, adjectives, 12, 10)
        got = out[d]
        for c in ("word", "sword", "lex", "slex"):
            assert (got[f"{c}types"], got[f"{c}tokens"]) == (len(set(kinds[c])), len(kinds[c])), (d, c)
        assert got["sentences"] == len(tokens)
        if kinds["word"]:
            for name, value in samples.items():
                assert got[name] == pytest.approx(value), (d, name)
            assert got["ttr"] == pytest.approx(len(set(kinds["word"])) / len(kinds["word"]))
        if kinds["verb"]:
            assert got["vs2"] == pytest.approx(len(set(kinds["sverb"])) ** 2 / len(kinds["verb"]))
            assert got["cvv1"] == pytest.approx(len(set(kinds["verb"])) / math.sqrt(2 * len(kinds["verb"])))
        else:
            assert got["vv1"] is None
        if kinds["lex"]:
            assert got["modv"] == pytest.approx((len(set(kinds["adv"])) + len(set(kinds["adj"]))) / len(kinds["lex"]))


def test_split_tags(spark):
    rows = lexical.split_tags(spark.createDataFrame([("Run_Away_VB",), ("-LRB-_-LRB-",), (",_,",)], "token string")).collect()
    assert [(r["word"], r["pos"]) for r in rows] == [("run", "vb"), ("-lrb-", "-lrb-"), (",", ",")]


class Node:
    def __init__(self, label, parent):
        self.label, self.parent, self.kids, self.leaf = label, parent, [], False

    def below(self):
        for k in self.kids:
            yield k
            yield from k.below()

    def above(self):
        return [self.parent, *self.parent.above()] if self.parent else []

    @property
    def inner(self):
        return [k for k in self.kids if not k.leaf]

    @property
    def head(self):
        for want in syntactic.HEADS.get(self.label, "").split():
            for k in self.inner:
                if k.label == want:
                    return k
        return self.kids[0] if self.kids else None

    @property
    def after(self):
        return self.parent.kids[self.parent.kids.index(self) + 1 :] if self.parent else []

    @property
    def before(self):
        return self.parent.kids[: self.parent.kids.index(self)] if self.parent else []


def parse(text):
    top, at = [], None
    for t in text.replace("(", " ( ").replace(")", " ) ").split():
        if t == "(":
            fresh = True
        elif t == ")":
            at = at.parent
        elif fresh:
            n = Node(t, at)
            (at.kids if at else top).append(n)
            at, fresh = n, False
        else:
            leaf = Node(t, at)
            leaf.leaf = True
            at.kids.append(leaf)
    return top


def is_(n, *labels):
    return n is not None and not n.leaf and n.label in labels


def finite_head(n):
    return is_(n.head, *syntactic.FINITE)


def clause(n):
    if not is_(n, *syntactic.CLAUSES):
        return False
    first = n.kids[0] if n.kids else None
    order = is_(n.parent, "ROOT") and is_(first, "VP") and is_(first.head, "VB")
    with_vp = any(is_(k, "VP") and (finite_head(k) or (any(is_(x, "CC") for x in k.kids) and any(is_(x, "VP") and finite_head(x) for x in k.kids))) for k in n.kids)
    return order or finite_head(n) or with_vp


def unit(n):
    return is_(n, *syntactic.UNITS) and (is_(n.parent, "ROOT") or (any(is_(x, *syntactic.UNITS) for x in n.before) and not any(is_(x, "SBAR", "VP") for x in n.above())))


def dependent(n):
    return is_(n, "SBAR") and any(clause(k) for k in n.kids)


def patterns(n):
    nxt = n.after[0] if n.after else None
    pair = lambda x: is_(x, "NP") and any(is_(y, "NP") for y in x.after) and not is_(x.after[0], "CC")
    that = is_(n.head, "WHNP") or (is_(n.head, "IN") and any(k.label in ("That", "that", "For", "for") for k in n.head.kids)) or (bool(n.kids) and is_(n.kids[0], "S"))
    return {
        "S": is_(n, "ROOT"), "VP1": is_(n, "VP") and is_(n.parent, *syntactic.CLAUSES), "C1": clause(n), "T1": unit(n), "DC": dependent(n), "CT": unit(n) and any(map(dependent, n.below())),
        "CP": is_(n, "ADJP", "ADVP", "NP", "VP") and any(is_(k, "CC") for k in n.kids),
        "CN1": is_(n, "NP") and not is_(n.parent, "NP") and any(is_(x, "JJ", "POS", "PP", "S", "VBG") or pair(x) for x in n.below()),
        "CN2": is_(n, "SBAR") and that and (is_(nxt, "VP") or is_(n.parent, "VP")), "CN3": is_(n, "S") and any(is_(k, "VP") and is_(k.head, "VBG", "TO") for k in n.kids) and is_(nxt, "VP"),
        "FC": is_(n, "FRAG") and is_(n.parent, "ROOT") and not any(map(clause, n.below())), "FT": is_(n, "FRAG") and is_(n.parent, "ROOT") and not any(map(unit, n.below())),
        "VP2": is_(n, *syntactic.FINITE) and is_(n.parent, "SQ") and not any(is_(k, "VP") for k in n.parent.kids),
    }


def test_patterns_on_golden_and_random_trees(spark):
    rng = random.Random(5)
    labels = ["S", "SBAR", "SBARQ", "SINV", "SQ", "VP", "NP", "FRAG", "ADJP", "CC", "PP", "IN", "WHNP", "MD", "VB", "VBZ", "VBG", "TO", "JJ"]

    def grown(depth):
        label = rng.choice(labels)
        if depth == 0 or label in ("CC", "IN", "MD", "VB", "VBZ", "VBG", "TO", "JJ"):
            return f"({label} {rng.choice(['that', 'x', 'for'])})"
        return f"({label} {' '.join(grown(depth - 1) for _ in range(rng.randint(1, 3)))})"

    trees = [*TREES, *[f"(ROOT {grown(5)})" for _ in range(60)]]
    docs = {f"d{k}": "\n".join(trees[k::7]) for k in range(7)} | {"none": ""}
    got = {r["filename"]: r.asDict() for r in syntactic.pattern_counts(spark.createDataFrame(list(docs.items()), "filename string, tree string").repartition(3)).collect()}
    for d, text in docs.items():
        n = Counter()
        for top in parse(text):
            for node in (top, *top.below()):
                n.update(k for k, v in patterns(node).items() if v)
        want = {"S": n["S"], "VP": n["VP1"] + n["VP2"], "C": n["C1"] + n["FC"], "T": n["T1"] + n["FT"], "DC": n["DC"], "CT": n["CT"], "CP": n["CP"], "CN": n["CN1"] + n["CN2"] + n["CN3"]}
        assert {k: got[d][k] for k in want} == want, d


def test_ratios_are_0_with_a_0(spark):
    r = syntactic.syntactic_vectors(spark.createDataFrame([("d", TREES[0]), ("e", "")], "filename string, tree string")).collect()
    by = {x["filename"]: x.asDict() for x in r}
    assert list(by["d"]) == ["filename", *syntactic.FEATURES]
    assert (by["d"]["MLS"], by["d"]["DC/C"], by["d"]["C/S"]) == (2.0, 0.0, 1.0)
    assert set(by["e"].values()) == {"e", 0.0}


def test_ranks_of_all_words_and_long_lists(spark, monkeypatch):
    """Without a limit words are ranked by ranges; a list too long to be sent gives the same flags."""
    rng = random.Random(5)
    listed = [(f"w{k}", rng.randrange(9), rng.random() < 0.5) for k in range(300)]
    words = spark.createDataFrame(listed, "lemma string, freq long, is_adj boolean")
    want = {w: k + 1 for k, (w, _, _) in enumerate(sorted(listed, key=lambda x: (x[1], x[0]), reverse=True))}
    assert {r["lemma"]: r["rnk"] for r in lexical.word_ranks(words, 0).collect()} == want
    tagged = spark.createDataFrame([(f"d{k % 7}", k, rng.choice(listed)[0] + rng.choice(["", "ly"]), rng.choice(["nn", "rb", "vb"])) for k in range(2000)], "filename string, idx int, word string, pos string")
    sent = sorted(map(tuple, lexical.classified(tagged, words, rank_limit=40).collect()))
    monkeypatch.setattr(lexical, "MOST_SENT", 10)
    assert sorted(map(tuple, lexical.classified(tagged, words, rank_limit=40).collect())) == sent


def test_whole_documents_measure_as_rows_do(spark, monkeypatch):
    """Documents measured in their rows, and by rows of tokens where the lists are too long to be held, have the same figures."""
    rng = random.Random(9)
    vocabulary = [f"w{i}{'ly' if i % 3 == 0 else ''}" for i in range(60)] + ["be", "have", "--", "é", ""]
    tokens = [(k, i, rng.choice(vocabulary), rng.choice([*TAGS, "--"])) for k, n in enumerate((1, 9, 10, 11, 35, 90)) for i in range(n)]
    tagged = spark.createDataFrame(tokens, "doc_id long, idx int, word string, pos string").repartition(3)
    words = spark.createDataFrame([(f"w{i}", 1 + i % 7, i % 4 == 0) for i in range(60)] + [("w9ly", 2, True)], "lemma string, freq long, is_adj boolean")
    docs = lexical.by_document(tagged, "doc_id").cache()
    whole = sorted(map(tuple, lexical.measures(docs, words, "doc_id", 20, 10).select("doc_id", *(names := ["sentences", *[f"{c}{x}" for x in ("types", "tokens") for c in lexical.CLASSES], "n", "ndw", "ndwz", "ndwerz", "ndwesz", "msttr"])).collect()))
    monkeypatch.setattr(lexical, "MOST_HELD", 1)
    rows = sorted(map(tuple, lexical.measures(docs, words, "doc_id", 20, 10).select("doc_id", *names).collect()))
    assert len(whole) == len(rows) == 6
    for a, b in zip(whole, rows, strict=True):
        assert a == pytest.approx(b)
    by_tag = Counter((k, p) for k, _, _, p in tokens)
    first = {t: min(w.encode() for k, _, w, p in tokens if (k, p) == t).decode() for t in by_tag}
    assert {(r["doc_id"], r["pos"]): (r["n"], r["first"]) for r in lexical.tag_counts(docs, "doc_id").collect()} == {t: (n, first[t]) for t, n in by_tag.items()}


def test_tagged_documents_are_the_tagged_tokens(spark, tmp_path):
    texts = [(1, "Be  was,\n12 é'us Trees-tion\tgo "), (2, None), (3, "  "), (4, "ärly X"), (None, "the ending"), (5, "a" * 9 + " is 7")]
    for name, rows in (("once", texts), ("twice", [*texts, (1, "once more")])):
        folder = f"{tmp_path}/{name}"
        spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
        want = defaultdict(list)
        for r in standins.tagged_tokens(spark, folder).collect():
            want[r["doc_id"]].append((r["idx"], r["word"], r["pos"]))
        got = {r["doc_id"]: sorted(zip(r["words"], r["tags"], strict=True)) for r in standins.tagged_docs(spark, folder).collect()}
        assert got == {k: sorted(x[1:] for x in v) for k, v in want.items()}
