"""Stand-ins for what no model here can make, derived from the given tables: mentions, taxonomy, triples, tags, trees.

They are deterministic, and ``plainweave.plans.oracle`` has the same in SQL.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plainweave.functions.namespaces import NAMESPACES
from plainweave.operators.kb import RDF_TYPE, SUBCLASS_OF
from plainweave.operators.lexical import by_document

#: A word is in the gazetteer by a rule on itself: of LETTERS letters or more, and of its hash's first byte below SHARE.
LETTERS, SHARE = 8, 24
#: Texts of 2^CHUNK_BITS bytes, or a longer one, are taken at once. Which bytes are letters, and all bytes in lower case.
CHUNK_BITS = 23
LETTER, LOW = np.array([chr(b).isascii() and chr(b).isalpha() for b in range(256)]), np.frombuffer(bytes(range(256)).lower(), np.uint8)
SIZES = {1: 4, 2: 12, 3: 40}

#: One tree for each pattern and one for each of its negations. Fixed values.
TREES = [
    "(ROOT (S (NP (PRP He)) (VP (VBZ runs)) (. .)))",
    "(ROOT (S (VP (VB Go) (ADVP (RB home)))))",
    "(ROOT (S (S (NP (PRP I)) (VP (VBD came))) (CC and) (S (NP (PRP I)) (VP (VBD saw)))))",
    "(ROOT (S (NP (PRP He)) (VP (VBZ says) (SBAR (IN that) (S (NP (PRP she)) (VP (VBZ sleeps)))))))",
    "(ROOT (S (SBAR (IN For) (S (NP (PRP him)) (VP (TO to) (VP (VB leave))))) (VP (VBD was) (ADJP (JJ hard)))))",
    "(ROOT (S (SBAR (WHNP (WP What)) (S (NP (PRP he)) (VP (VBD said)))) (VP (VBZ is) (ADJP (JJ true)))))",
    "(ROOT (S (S (VP (VBG Swimming))) (VP (VBZ is) (NP (NN fun)))))",
    "(ROOT (S (S (VP (TO To) (VP (VB err)))) (VP (VBZ is) (ADJP (JJ human)))))",
    "(ROOT (FRAG (NP (NP (DT A) (JJ red) (NN house)) (PP (IN on) (NP (DT the) (NN hill))))))",
    "(ROOT (FRAG (SBAR (IN because) (S (NP (PRP he)) (VP (VBD left))))))",
    "(ROOT (SQ (VBZ Is) (NP (DT this)) (ADJP (JJ right))))",
    "(ROOT (SQ (MD Can) (NP (PRP you)) (VP (VB come))))",
    "(ROOT (SBARQ (WHNP (WP Who)) (SQ (VP (VBD called)))))",
    "(ROOT (S (NP (NP (NNP Ann)) (CC and) (NP (NNP Bob))) (VP (VP (VBP sing)) (CC and) (VP (VBP dance)))))",
    "(ROOT (S (NP (NP (NNP Ann) (POS 's)) (NN dog)) (VP (MD will) (VP (VB bark)))))",
    "(ROOT (SINV (ADVP (RB Here)) (VP (VBZ comes)) (NP (NP (DT the) (NN sun)) (, ,) (NP (DT the) (NN star)))))",
    "(ROOT (NP (NN Nothing)))",
    "(ROOT (S (NP (PRP We)) (VP (VBP know) (SBAR (IN if) (S (NP (PRP they)) (VP (VB go)))))))",
]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents``, dealt out over the cores where the file has fewer splits than these; a table of many splits is read as it is."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    cores = spark.sparkContext.defaultParallelism
    return docs if docs.rdd.getNumPartitions() >= cores else docs.repartition(cores)


def clean_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` with each line end doubled, so that there are paragraphs to split."""
    return documents(spark, sf_dir).select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, ord, token): all texts split at single spaces."""
    return documents(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", " ", -1)).alias("ord", "token"))


def uri(w: Column) -> Column:
    return F.concat(F.lit("http://dbpedia.org/resource/"), w)


def _number(word: bytes) -> int:
    """The number of a word of letters in lower case if it is in the gazetteer, else -1."""
    h = hashlib.md5(word, usedforsecurity=False).digest()
    return h[1] * 256 + h[2] if h[0] < SHARE else -1


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, ord, offset, uri, types, rk): the words of all texts that are in the gazetteer. One in four has types from the annotator, managed ones and others.

    The words are picked within the text's own row: texts of some MB together are split and their long tokens stripped to the letters at once, and only distinct words are hashed.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy()) >> CHUNK_BITS
            for rows in np.split(np.arange(batch.num_rows), np.flatnonzero(np.diff(places)) + 1) if batch.num_rows else []:
                part = batch.slice(rows[0], len(rows))
                split = pc.split_pattern(pc.fill_null(part.column(1).cast(pa.large_string()), ""), " ")
                tokens, first = split.flatten(), split.offsets.to_numpy() - split.offsets[0].as_py()
                cut = np.frombuffer(tokens.buffers()[1], np.int64)[tokens.offset : tokens.offset + len(tokens) + 1]
                data = np.frombuffer(tokens.buffers()[2] or b"", np.uint8)[cut[0] : cut[-1]]
                cut = cut - cut[0]
                letter = LETTER[data]
                other = np.flatnonzero(~letter)
                at = np.flatnonzero(np.diff(cut) >= LETTERS)
                letters = cut[at + 1] - cut[at] - (np.searchsorted(other, cut[at + 1]) - np.searchsorted(other, cut[at]))
                at, letters = at[letters >= LETTERS], letters[letters >= LETTERS]
                long = np.zeros(len(tokens), bool)
                long[at] = True
                own = LOW[data[letter & np.repeat(long, np.diff(cut))]]
                places = np.concatenate([[0], np.cumsum(letters)]).astype(np.int64)
                coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(places), pa.py_buffer(own)]).dictionary_encode()
                ranks = np.array([_number(w) for w in coded.dictionary.to_pylist()], np.int64)[coded.indices.to_numpy()]
                listed = ranks >= 0
                at, names = at[listed], coded.filter(pa.array(listed)).dictionary_decode().cast(pa.string())
                row = np.searchsorted(first, at, "right") - 1
                # Offsets are code points, with the spaces that the tokens are without.
                inner = np.flatnonzero((data & 0xC0) == 0x80)
                before = lambda k: cut[k] + k - np.searchsorted(inner, cut[k])  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), pa.array(at - first[row]), pa.array(before(at) - before(first[row])), names, pa.array(ranks[listed])], names=["doc_id", "ord", "offset", "w", "rk"])

    docs = documents(spark, sf_dir)
    rows = docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ord long, offset long, w string, rk long")
    own = F.array(F.concat(F.lit("Schema:C3_"), (F.col("rk") % 40).cast("string")), F.lit("Unknown:Thing"))
    types = F.when(F.col("rk") % 4 == 0, own).otherwise(F.array().cast("array<string>"))
    return rows.select("doc_id", "ord", "offset", uri(F.col("w")).alias("uri"), types.alias("types"), "rk")


def class_uri(level: Column, k: Column) -> Column:
    space = F.element_at(F.array(*[F.lit(u) for _, u in NAMESPACES]), (k % 3 + 1).cast("int"))
    return F.concat(space, F.lit("C"), level.cast("string"), F.lit("_"), k.cast("string"))


def taxonomy(spark: SparkSession) -> DataFrame:
    """(cls, parent): classes in three levels with parents in all namespaces, and some with two parents."""
    out = None
    for level in (2, 3):
        up = SIZES[level - 1]
        k = spark.range(SIZES[level]).withColumnRenamed("id", "k")
        both = F.when(F.col("k") % 5 == 0, F.array(F.col("k") % up, (F.col("k") + 1) % up)).otherwise(F.array(F.col("k") % up))
        rows = k.withColumn("p", F.explode(both)).select(class_uri(F.lit(level), F.col("k")).alias("cls"), class_uri(F.lit(level - 1), F.col("p")).alias("parent"))
        out = rows if out is None else out.unionByName(rows)
    return out.distinct()


def resource_types(names: DataFrame) -> DataFrame:
    """(uri, type) from the numbers ``rk`` of ``names`` (uri, rk); some have none, some one that is not managed."""
    rk = F.col("rk")
    three = F.lit(3)
    own = F.when(rk % 11 == 0, F.array().cast("array<string>")).otherwise(F.array(class_uri(three, rk % 40), class_uri(three, rk * 7 % 40)))
    all_ = F.when(rk % 13 == 0, F.concat(own, F.array(F.lit("http://example.org/Thing")))).otherwise(own)
    return names.select("uri", F.explode(all_).alias("type")).distinct()


def triples(spark: SparkSession, sf_dir: str, found: DataFrame | None = None) -> DataFrame:
    """(s, p, o, o_kind) of the star schema's keys and names, the types, and the taxonomy. ``found``: the mentions, if they are there already."""
    table = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    iri = lambda kind, c: F.concat(F.lit(f"http://example.org/{kind}/"), F.col(c).cast("string"))

    def rows(t: DataFrame, s: Column, p: str, o: Column, kind: str = "iri") -> DataFrame:
        return t.select(s.alias("s"), F.lit(p if p.startswith("http") else f"http://example.org/{p}").alias("p"), o.cast("string").alias("o"), F.lit(kind).alias("o_kind"))

    c, n, s, o, li = (table(t) for t in ("customer", "nation", "supplier", "orders", "lineitem"))
    names = (mentions(spark, sf_dir) if found is None else found).select("uri", "rk").distinct()
    typed, classes = resource_types(names), taxonomy(spark)
    w = names.select(F.col("uri").alias("u"), F.concat(F.lit("http://example.org/nation/"), (F.col("rk") % 25).cast("string")).alias("n"))
    parts = [
        rows(c, iri("customer", "c_custkey"), "in", iri("nation", "c_nationkey")), rows(c, iri("customer", "c_custkey"), "name", F.col("c_name"), "literal"),
        rows(n, iri("nation", "n_nationkey"), "in", iri("region", "n_regionkey")), rows(n, iri("nation", "n_nationkey"), "name", F.col("n_name"), "literal"),
        rows(s, iri("supplier", "s_suppkey"), "in", iri("nation", "s_nationkey")), rows(o, iri("order", "o_orderkey"), "by", iri("customer", "o_custkey")),
        rows(li, iri("order", "l_orderkey"), "part", iri("part", "l_partkey")), rows(li, iri("order", "l_orderkey"), "from", iri("supplier", "l_suppkey")),
        rows(w, F.col("u"), "near", F.col("n")), rows(w, F.col("n"), "knows", F.col("u")),
        rows(typed, F.col("uri"), RDF_TYPE, F.col("type")), rows(classes, F.col("cls"), SUBCLASS_OF, F.col("parent")),
    ]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def tagged_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, idx, word, pos): tags by the words' endings, some of them tags of no words. No tagger."""
    w = F.lower(F.regexp_replace("token", "[^A-Za-z0-9]", ""))
    rows = words(spark, sf_dir).select("doc_id", F.col("ord").cast("long").alias("idx"), w.alias("word")).filter("word <> ''")
    return rows.withColumn("pos", tag(F.col("word")))


#: Letters in lower case, and the bytes that are neither letters, digits nor spaces.
LOWER = bytes(range(256)).lower()
OTHER = bytes(b for b in range(256) if not (chr(b).isascii() and chr(b).isalnum()) and b != 32)


def tagged_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, words, tags): ``tagged_tokens`` as arrays, a row per document that has a token. Rows of one doc_id, if there are any, are one document."""
    docs = documents(spark, sf_dir)
    if not docs.groupBy("doc_id").count().filter("count > 1").isEmpty():
        return by_document(tagged_tokens(spark, sf_dir), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                lines = [(x or b"").translate(LOWER, OTHER) for x in part.column(1).cast(pa.binary()).to_pylist()]
                data = np.frombuffer(b"\n".join(lines) + b"\n", np.uint8)
                cut = (data == 32) | (data == 10)
                ends = np.flatnonzero(cut)
                sizes = np.diff(ends, prepend=-1) - 1
                last = data[ends] == 10
                some = sizes > 0
                counts = np.bincount((np.cumsum(last) - last)[some], minlength=part.num_rows)
                places = np.concatenate([[0], np.cumsum(sizes[some])]).astype(np.int32)
                words = pa.StringArray.from_buffers(len(places) - 1, pa.py_buffer(places), pa.py_buffer(data[~cut].tobytes()))
                coded = words.dictionary_encode()
                tags = pa.array([_tag(w) for w in coded.dictionary.to_pylist()], pa.string()).take(coded.indices)
                full = np.flatnonzero(counts)
                bounds = pa.array(np.concatenate([[0], np.cumsum(counts[full])]), pa.int32())
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(full)), pa.ListArray.from_arrays(bounds, words), pa.ListArray.from_arrays(bounds, tags)], names=["doc_id", "words", "tags"])

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, words array<string>, tags array<string>")


def _tag(w: str) -> str:
    """``tag`` of a word."""
    if w.isdigit():
        return "cd"
    for ends, pos in ((("us",), ","), (("is",), "sent"), (("ar",), "sym"), (("ly",), "rb"), (("ing", "ed"), "vb"), (("tion", "er", "st"), "nn")):
        if w.endswith(ends):
            return pos
    return "dt" if len(w) <= 3 else "jj" if w.endswith(("le", "ent")) else "nn"


def tag(word: Column) -> Column:
    ends = lambda *x: reduce(lambda a, b: a | b, [F.endswith(word, F.lit(e)) for e in x])
    return (
        F.when((word != "") & (F.translate(word, "0123456789", "") == ""), "cd").when(ends("us"), ",").when(ends("is"), "sent").when(ends("ar"), "sym").when(ends("ly"), "rb").when(ends("ing", "ed"), "vb").when(ends("tion", "er", "st"), "nn")
        .when(F.length(word) <= 3, "dt").when(ends("le", "ent"), "jj").otherwise("nn")
    )


def word_list(tagged: DataFrame) -> DataFrame:
    """(lemma, freq, is_adj) of the tagged tokens; words of a length divisible by four are adjectives too."""
    return tagged.groupBy(F.col("word").alias("lemma")).agg(F.count("*").alias("freq"), F.bool_or((F.col("pos") == "jj") | (F.length("word") % 4 == 0)).alias("is_adj"))


def counted_list(counted: DataFrame) -> DataFrame:
    """``word_list`` from ``lexical.word_counts``."""
    return counted.groupBy(F.col("word").alias("lemma")).agg(F.sum("n").alias("freq"), F.bool_or((F.col("pos") == "jj") | (F.length("word") % 4 == 0)).alias("is_adj"))


def trees(spark: SparkSession, n: int = 40) -> DataFrame:
    """(doc_id, tree): n documents of some of TREES each."""
    items = F.array(*[F.lit(t) for t in TREES])
    k = len(TREES)
    some = F.filter(F.transform(items, lambda t, i: F.struct(t.alias("t"), i.alias("i"))), lambda x: (x["i"] + F.col("doc_id") * 3) % k < F.col("doc_id") % k + 1)
    return spark.range(n).withColumnRenamed("id", "doc_id").select("doc_id", F.array_join(F.transform(some, lambda x: x["t"]), "\n").alias("tree"))
