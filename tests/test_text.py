import re

import pytest
from pyspark.sql import functions as F

from plainweave.functions import namespaces as ns
from plainweave.functions import text as tx


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x")).alias("y")).first()[0]


def test_clean_keeps_line_feeds_and_0x9f(spark):
    assert one(spark, tx.clean, "a\tb\rc\nd\x9ee\x9ff") == "a b c\nd e\x9ff"


def test_paragraphs(spark):
    text = "x" * 150 + "\n\n" + "y" * 151 + "\n\n\n" + "z" * 151
    assert one(spark, tx.paragraphs, text) == ["y" * 151, "\n" + "z" * 151]
    assert one(spark, tx.paragraphs, "") == []
    assert one(spark, lambda c: tx.nb_words(tx.paragraphs(c)), None) == 0


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("Hello, world.", ["Hello", ",", "world", "."]),
        ("can't cannot", ["ca", "n't", "can", "not"]),
        ("$3.50 1,000", ["$", "3.50", "1,000"]),
        ("a -- (b) [c]", ["a", "--", "(", "b", ")", "[", "c", "]"]),
        ('"He said"', ["``", "He", "said", "''"]),
        ("They'll gonna wait...", ["They", "'ll", "gon", "na", "wait", "..."]),
        ("", []),
    ],
)
def test_tokens(spark, text, expected):
    assert one(spark, tx.tokens, text) == expected


def test_key_of_path(spark):
    assert one(spark, tx.key_of_path, "/a/b/c.d.txt") == "c.d"
    assert one(spark, tx.key_of_path, "plain") == "plain"


def test_managed_uri(spark):
    get = lambda x: one(spark, ns.managed_uri, x)
    assert get("Schema:Place") == "http://schema.org/Place"
    assert get("DBPedia:Place") == "http://dbpedia.org/ontology/Place"
    assert get("DBpedia:Place") is None
    assert get("http://dbpedia.org/class/yago/X") == "http://dbpedia.org/class/yago/X"
    assert get("http://example.org/X") is None
    nested = (("a", "http://x/"), ("b", "http://x/y/"))
    assert one(spark, lambda c: ns.suffix_in(c, *nested[0]), "http://x/y/z") == "y/z"
    assert one(spark, lambda c: ns.managed_uri(c, nested), "http://x/y/z") == "http://x/y/z"


def test_display(spark):
    assert one(spark, ns.qname, "http://schema.org/Place") == "Schema:Place"
    assert one(spark, ns.qname, ns.ROOT) == "ROOT"
    assert one(spark, ns.qname, "http://dbpedia.org/resource/Schema:x") == "Schema:x"
    assert one(spark, ns.colour, "Schema:x") == "blue"
    assert one(spark, ns.colour, "x") == "green"


def test_word_pattern_counts_tagged_words(spark):
    from plainweave.operators.syntactic import WORD, word_count

    tree = "(ROOT (S (NP (PRP$ My) (NN dog)) (VP (VBZ eats)) (. .)))"
    assert one(spark, word_count, tree) == len(re.findall(WORD, tree)) == 3


def test_merged_treebank_patterns_equal_the_published_ones(spark):
    """The engine's merged substitutions against the list that the SQL writes out, one by one."""
    import random
    import re

    from pyspark.sql import functions as F

    from plainweave.functions.text import tokens
    from plainweave.plans.oracle import TREEBANK

    rng = random.Random(2)
    pieces = ["cannot", "Can't", "d'ye", "gimme", "gonna", "gotta", "lemme", "more'n", "wanna", "'tis", "'TWAS", "don't", "we'll", "dog's", "dogs'", '"x"', "``", "''", "(a)", "[b]", "{c}", "<d>", "--", "...", "a.", "b.)", "?!", ";", ":", ",", "1,000", "a:b", "e@f", "#1", "$5", "50%", "&c", "x", "y"]
    texts = ["".join(rng.choice(pieces) + rng.choice([" ", " ", " ", "", "\n"]) for _ in range(rng.randint(1, 25))) for _ in range(800)]

    def plain(t):
        for pattern, put in TREEBANK:
            t = " " + t if pattern == "^" else t + " " if pattern == "$" else re.sub(pattern, re.sub(r"\$(\d)", r"\\\1", put), t, flags=re.ASCII)
        return t.split()

    got = [r["t"] for r in spark.createDataFrame(list(enumerate(texts)), "k int, x string").repartition(1).orderBy("k").select(tokens(F.col("x")).alias("t")).collect()]
    for x, a in zip(texts, got, strict=True):
        assert a == plain(x), x


def test_tokens_are_counted_without_being_made(spark):
    from pyspark.sql import functions as F

    from plainweave.functions import text as tx

    texts = ["", " ", "a", " a\t\x0b\f\r\n b ", "   x\u0085y", 'He said, "I can\'t..." (gonna) \U0001f600\U0001f600 国際 é.', "x" * 5000 + " xx", "''s 'tis x's", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(tx.count_words(F.col("t")).alias("n"), F.size(tx.tokens(F.col("t"))).alias("want"))
    assert all(r["n"] == r["want"] for r in df.collect() if r["want"] is not None and r["want"] >= 0)
    assert "split" not in df.select("n")._jdf.queryExecution().optimizedPlan().toString()
