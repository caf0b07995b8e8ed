"""Lexical complexity from tagged tokens: counts by word class, sophistication, diversity.

Input is ``tagged_tokens``: a key, idx (order), word, pos. All steps are keyed by document, so one
shuffle by document serves them. Random samples are replaced by their exact expectation.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plainweave.tables import stored

#: Lists of more words are not sent to all tasks.
MOST_SENT = 200_000
#: Sets of more words are not held by the tasks that measure whole documents; ``measures`` goes by rows then.
MOST_HELD = 1_000_000
#: Documents measured at once.
AT_ONCE = 1000

#: ASCII punctuation. A tag that is a part of this string marks no word. Fixed value.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Verbs that are no lexical words. Fixed values.
PLAIN_VERBS = ("be", "have")

#: Names of the features, in the order of the output. Fixed values.
FEATURES = [
    "sentences", "wordtypes", "swordtypes", "lextypes", "slextypes", "wordtokens", "swordtokens", "lextokens", "slextokens", "ld", "ls1", "ls2", "vs1", "vs2", "cvs1",
    "ndw", "ndwz", "ndwerz", "ndwesz", "ttr", "msttr", "cttr", "rttr", "logttr", "uber", "lv", "vv1", "svv1", "cvv1", "vv2", "nv", "adjv", "advv", "modv",
]
CLASSES = ["word", "sword", "lex", "slex", "verb", "sverb", "adj", "adv", "noun"]


def split_tags(tokens: DataFrame, column: str = "token") -> DataFrame:
    """PF21: word and pos of ``word_TAG`` tokens, in lower case."""
    t = F.lower(F.trim(F.col(column)))
    return tokens.withColumns({"word": F.split_part(t, F.lit("_"), F.lit(1)), "pos": F.split_part(t, F.lit("_"), F.lit(-1))})


def is_line(token: Column) -> Column:
    """PF20: whether a line of tagger output counts as a sentence: it has an ASCII letter or digit."""
    return token.rlike("[0-9A-Za-z]")


def is_word(pos: Column) -> Column:
    """PF22: tags that are neither part of the punctuation string, nor ``sent`` or ``sym``."""
    return (F.instr(F.lit(PUNCTUATION), pos) == 0) & ~pos.isin("sent", "sym")


def word_ranks(word_list: DataFrame, limit: int = 2000) -> DataFrame:
    """(lemma, rnk): the ``limit`` most frequent words, the later one in the alphabet first among equals; 0 means all.

    With a limit, only so many rows of each task meet. Without, the words are sorted by range, and a word's rank is its place in its range and the sizes of the ranges before.
    """
    order = [F.desc("freq"), F.desc("lemma")]
    if limit:
        return word_list.select("lemma", "freq").orderBy(*order).limit(limit).select("lemma", F.row_number().over(Window.orderBy(*order)).alias("rnk"))
    ranges = stored(word_list.select("lemma", "freq").repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "ranges")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.groupBy("part").count().select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    placed = ranges.withColumn("k", F.row_number().over(Window.partitionBy("part").orderBy(*order)))
    return placed.join(F.broadcast(starts), "part").select("lemma", (F.col("start") + F.col("k")).cast("int").alias("rnk"))


def _listed(rows: DataFrame, words: DataFrame, column: str, name: str, n: int, hot: DataFrame) -> DataFrame:
    """``rows`` with whether ``column`` is one of the n stored ``words`` (w). A long list is shuffled with the rows, but for those of ``hot`` words (w), which are looked up where they are."""
    flagged = lambda t: t.select(F.col("w").alias(column), F.lit(True).alias(name))
    if n <= MOST_SENT:
        out = rows.join(F.broadcast(flagged(words)), column, "left")
    else:
        few, known = F.broadcast(hot.select(F.col("w").alias(column))), F.broadcast(flagged(words.join(F.broadcast(hot), "w", "left_semi")))
        out = rows.join(few, column, "left_semi").join(known, column, "left").unionByName(rows.join(few, column, "left_anti").join(flagged(words), column, "left"))
    return out.withColumn(name, F.coalesce(name, F.lit(False)))


def classified(tagged: DataFrame, word_list: DataFrame, key: str = "filename", rank_limit: int = 2000) -> DataFrame:
    """The word tokens with a number (``rn``, from 1) and flags is_<class>.

    ``word_list``: lemma, freq, is_adj. The words that it counts most often are looked up where their tokens are, so no common word is one task's.
    """
    lines = tagged.filter(is_line(F.concat_ws("_", "word", "pos")))
    rows = lines.filter(is_word(F.col("pos")))
    word_list = stored(word_list.select("lemma", "freq", "is_adj"), "list")
    frequent = stored(word_ranks(word_list, rank_limit).select(F.col("lemma").alias("w")), "frequent")
    hot = word_ranks(word_list, min(rank_limit or 2000, 2000)).select(F.col("lemma").alias("w"))
    adjectives = stored(word_list.filter("is_adj").select(F.col("lemma").alias("w")).distinct(), "adjectives")
    n = adjectives.count()
    stem = F.when(F.right("word", F.lit(2)) == "ly", F.expr("left(word, length(word) - 2)"))
    rows = _listed(rows.withColumn("stem", stem), frequent, "word", "frequent", frequent.count(), hot)
    rows = _listed(_listed(rows, adjectives, "word", "adj1", n, hot), adjectives, "stem", "adj2", n, hot)
    rows = rows.withColumn("adjective", F.col("adj1") | F.col("adj2"))
    first = F.left("pos", F.lit(1))
    noun, adj, adv = first == "n", first == "j", (first == "r") & F.col("adjective")
    verb = (first == "v") & ~F.col("word").isin(*PLAIN_VERBS)
    lex, rare = noun | adj | adv | verb, ~F.col("frequent")
    flags = {"word": F.lit(True), "sword": rare & (F.col("pos") != "cd"), "lex": lex, "slex": lex & rare, "verb": verb, "sverb": verb & rare, "adj": adj, "adv": adv, "noun": noun}
    rows = rows.select(key, "idx", "word", *[c.alias(f"is_{k}") for k, c in flags.items()])
    return rows.withColumn("rn", F.row_number().over(Window.partitionBy(key).orderBy("idx")))


def lexical_counts(words: DataFrame, tagged: DataFrame, key: str = "filename") -> DataFrame:
    """Types and tokens of each class, and ``sentences``, of each document of ``tagged``.

    Tokens are summed by word first, so that distinct words are counted without expanding the rows by class.
    """
    by_word = words.groupBy(key, "word").agg(*[F.count_if(f"is_{c}").alias(f"n_{c}") for c in CLASSES])
    counted = by_word.groupBy(key).agg(*[F.count_if(F.col(f"n_{c}") > 0).alias(f"{c}types") for c in CLASSES], *[F.sum(f"n_{c}").alias(f"{c}tokens") for c in CLASSES])
    lines = tagged.groupBy(key).agg(F.count_if(is_line(F.concat_ws("_", "word", "pos"))).alias("sentences"))
    out = lines.join(counted, key, "left")
    return out.select(key, "sentences", *[F.coalesce(f"{c}{x}", F.lit(0)).cast("long").alias(f"{c}{x}") for x in ("types", "tokens") for c in CLASSES])


def diversity_samples(words: DataFrame, z: int = 50, key: str = "filename") -> DataFrame:
    """(key, n, ndw, ndwz, ndwerz, ndwesz, msttr), with the plain values where there are fewer than z tokens.

    ndwz: distinct words among the first z. ndwerz and ndwesz: the expected number of distinct words in z tokens drawn without replacement,
    and in a run of z tokens from a random start. msttr: the mean ratio in the whole segments of z tokens.
    """
    doc = Window.partitionBy(key)
    rows = words.select(key, "word", "rn").withColumn("n", F.count("*").over(doc).cast("long"))
    before = F.coalesce(F.lag("rn").over(Window.partitionBy(key, "word").orderBy("rn")), F.lit(0))
    # A token is the first of its word in the runs that start after the word's last place and hold the token.
    starts = F.least("rn", F.col("n") - z + 1) - F.greatest(before + 1, F.col("rn") - z + 1, F.lit(1)) + 1
    rows = rows.withColumns({"first_in": F.greatest(starts, F.lit(0)), "segment": F.floor((F.col("rn") - 1) / z), "before": before})
    # The first of its word in its segment: the last place lies before the segment.
    new = (F.col("before") <= F.col("segment") * z) & (F.col("rn") <= F.floor(F.col("n") / z) * z)
    by_word = rows.groupBy(key, "word").agg(F.first("n").alias("n"), F.count("*").alias("f"), F.min("rn").alias("rn"), F.sum("first_in").alias("first_in"), F.count_if(new).alias("new"))
    missed = F.aggregate(F.sequence(F.lit(0), F.lit(z - 1)), F.lit(1.0), lambda p, i: p * F.greatest(F.lit(0.0), F.try_divide((F.col("n") - F.col("f") - i).cast("double"), (F.col("n") - i).cast("double"))))
    by_word = by_word.withColumn("met", F.when(F.col("n") >= z, 1 - missed))
    out = by_word.groupBy(key).agg(F.first("n").alias("n"), F.count("*").alias("ndw"), F.count_if(F.col("rn") <= z).alias("z"), F.sum("met").alias("met"), F.sum("first_in").alias("runs"), F.sum("new").alias("new"))
    whole, ndw = F.col("n") >= z, F.col("ndw").cast("double")
    return out.select(
        key, "n", "ndw", F.when(whole, F.col("z")).otherwise(F.col("ndw")).cast("double").alias("ndwz"), F.when(whole, F.col("met")).otherwise(ndw).alias("ndwerz"),
        F.when(whole, F.try_divide(F.col("runs").cast("double"), F.col("n") - z + 1)).otherwise(ndw).alias("ndwesz"),
        F.when(whole, F.try_divide(F.col("new").cast("double"), F.floor(F.col("n") / z) * z)).otherwise(F.try_divide(ndw, F.col("n"))).alias("msttr"),
    )


def ratios(c: DataFrame, key: str = "filename") -> DataFrame:
    """FEATURES from counts and samples. A division by 0, and the logarithm of 0 or in a ratio of 1, give null."""
    d = lambda x: F.col(x).cast("double")
    over = lambda a, b: F.try_divide(a, b)
    nw, nl, nv, tw, tv, tsv = d("wordtokens"), d("lextokens"), d("verbtokens"), d("wordtypes"), d("verbtypes"), d("sverbtypes")
    log = lambda f, x: F.when(x > 0, f(F.when(x > 0, x)))
    nonzero = lambda x: F.when(x != 0, x)
    made = {
        "ld": over(nl, nw), "ls1": over(d("slextokens"), nl), "ls2": over(d("swordtypes"), tw), "vs1": over(tsv, nv), "vs2": over(tsv * tsv, nv), "cvs1": over(tsv, F.sqrt(2 * nv)),
        "ndw": tw, "ndwz": F.coalesce("ndwz", F.lit(0.0)), "ndwerz": F.coalesce("ndwerz", F.lit(0.0)), "ndwesz": F.coalesce("ndwesz", F.lit(0.0)),
        "ttr": over(tw, nw), "msttr": F.col("msttr"), "cttr": over(tw, F.sqrt(2 * nw)), "rttr": over(tw, F.sqrt(nw)), "logttr": over(log(F.ln, tw), nonzero(log(F.ln, nw))),
        "uber": over(log(F.log10, nw) * log(F.log10, nw), nonzero(log(F.log10, over(nw, tw)))), "lv": over(d("lextypes"), nl), "vv1": over(tv, nv), "svv1": over(tv * tv, nv), "cvv1": over(tv, F.sqrt(2 * nv)),
        "vv2": over(tv, nl), "nv": over(d("nountypes"), d("nountokens")), "adjv": over(d("adjtypes"), nl), "advv": over(d("advtypes"), nl), "modv": over(d("advtypes") + d("adjtypes"), nl),
    }
    return c.select(key, *[made.get(x, d(x)).alias(x) for x in FEATURES])


def by_document(tagged: DataFrame, key: str = "filename") -> DataFrame:
    """(key, words, tags): the tokens of each document in order, as two arrays."""
    rows = tagged.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("idx", "word", "pos"))).alias("x"))
    return rows.select(key, F.col("x.word").alias("words"), F.col("x.pos").alias("tags"))


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, pa.DictionaryArray, pa.DictionaryArray]]:
    """Of some documents at once: keys, each token's document and place in it, words, tags."""
    for batch in batches:
        for lo in range(0, batch.num_rows, AT_ONCE):
            part = batch.slice(lo, AT_ONCE)
            sizes = pc.fill_null(pc.list_value_length(part.column(1)), 0).to_numpy(zero_copy_only=False)
            words, tags = (pc.dictionary_encode(part.column(i).flatten(), null_encoding="encode") for i in (1, 2))
            doc = np.repeat(np.arange(part.num_rows), sizes)
            yield part.column(0), doc, np.arange(len(doc)) - np.repeat(np.cumsum(sizes) - sizes, sizes), words, tags


def _pairs(words: pa.DictionaryArray, tags: pa.DictionaryArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs of a word and a tag that occur, as two arrays of codes, and each token's pair."""
    t = max(len(tags.dictionary), 1)
    pair = words.indices.to_numpy().astype(np.int64) * t + tags.indices.to_numpy()
    found, at = np.unique(pair, return_inverse=True)
    return found // t, found % t, at


def _is_line(words: pa.DictionaryArray, tags: pa.DictionaryArray, w: np.ndarray, t: np.ndarray) -> np.ndarray:
    a, b = (pc.fill_null(pc.match_substring_regex(x.dictionary.cast(pa.string()), "[0-9A-Za-z]"), False).to_numpy(zero_copy_only=False) for x in (words, tags))
    return a[w] | b[t]


def _is_word(tags: pa.DictionaryArray) -> np.ndarray:
    return np.array([x is not None and x not in PUNCTUATION and x not in ("sent", "sym") for x in tags.dictionary.to_pylist()], bool)


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, pos, n) of documents (key, words, tags): how often each word has each tag, counted in the tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, _, words, tags in _slices(batches):
            w, t, at = _pairs(words, tags)
            n = np.bincount(at, minlength=len(w))
            yield pa.RecordBatch.from_arrays([words.dictionary.take(pa.array(w)).cast(pa.string()), tags.dictionary.take(pa.array(t)).cast(pa.string()), pa.array(n, pa.int64())], names=["word", "pos", "n"])

    return docs.mapInArrow(run, "word string, pos string, n long").groupBy("word", "pos").agg(F.sum("n").alias("n"))


def tag_counts(docs: DataFrame, key: str = "filename") -> DataFrame:
    """(key, pos, n, lines, words, first, places) of documents (key, words, tags): tokens of each tag, lines and words among them, the first word by code points, and the sum of the places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, doc, place, words, tags in _slices(batches):
            w, t, at = _pairs(words, tags)
            k = max(len(tags.dictionary), 1)
            found, group = np.unique(doc * k + t[at], return_inverse=True)
            total = lambda x: np.bincount(group, weights=x, minlength=len(found)).astype(np.int64)  # noqa: B023, E731
            order = pc.sort_indices(words.dictionary.cast(pa.string())).to_numpy()
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            first = np.full(len(found), len(order))
            np.minimum.at(first, group, rank[w[at]])
            columns = [total(np.ones(len(at))), total(_is_line(words, tags, w, t)[at]), total(_is_word(tags)[t][at]), total(place)]
            n, lines, are_words, places = (pa.array(c, pa.int64()) for c in columns)
            names = words.dictionary.take(pa.array(order[first])).cast(pa.string())
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(found // k)), tags.dictionary.take(pa.array(found % k)).cast(pa.string()), n, lines, are_words, names, places], names=[key, "pos", "n", "lines", "words", "first", "places"])

    return docs.mapInArrow(run, f"{key} {docs.schema[key].dataType.simpleString()}, pos string, n long, lines long, words long, first string, places long")


def _held(df: DataFrame) -> frozenset[str] | None:
    """The words (w) as a set; none if they are more than MOST_HELD."""
    found = df.limit(MOST_HELD + 1).collect()
    return frozenset(r[0] for r in found) if len(found) <= MOST_HELD else None


def measures(docs: DataFrame, word_list: DataFrame, key: str = "filename", rank_limit: int = 2000, z: int = 50, counted: DataFrame | None = None) -> DataFrame:
    """``lexical_counts`` and ``diversity_samples`` of documents (key, words, tags), each in its row; n and what follows are null without a word.

    No token is stored or shuffled: tasks hold the frequent words, and those adverbs of the documents (from ``counted``, their ``word_counts``) that are adjectives or made of one.
    If either are more than MOST_HELD, the tokens go through ``classified`` as rows.
    """
    word_list = stored(word_list.select("lemma", "freq", "is_adj"), "list")
    adjectives = word_list.filter("is_adj").select(F.col("lemma").alias("w"))
    stem = F.when(F.right("w", F.lit(2)) == "ly", F.expr("left(w, length(w) - 2)"))
    r = (word_counts(docs) if counted is None else counted).filter(F.left("pos", F.lit(1)) == "r").select(F.col("word").alias("w")).distinct()
    by_stem = r.withColumn("stem", stem).join(adjectives.withColumnRenamed("w", "stem"), "stem", "left_semi").select("w")
    adverbs = _held(r.join(adjectives, "w", "left_semi").unionByName(by_stem).distinct())
    frequent = _held(word_ranks(word_list, rank_limit).select(F.col("lemma").alias("w")))
    if adverbs is None or frequent is None:
        tagged = docs.select(key, F.posexplode(F.arrays_zip("words", "tags")).alias("idx", "x")).select(key, "idx", F.col("x.words").alias("word"), F.col("x.tags").alias("pos"))
        rows = stored(classified(tagged, word_list, key, rank_limit), "words")
        return lexical_counts(rows, tagged, key).join(diversity_samples(rows, z, key), key, "left")
    sent = docs.sparkSession.sparkContext.broadcast((frequent, adverbs))
    whole = ["sentences", *[f"{c}{x}" for x in ("types", "tokens") for c in CLASSES], "n", "ndw"]
    parts = ["ndwz", "ndwerz", "ndwesz", "msttr"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, doc, _, words, tags in _slices(batches):
            columns = _measured(len(keys), doc, words, tags, *sent.value, z)
            yield pa.RecordBatch.from_arrays([keys, *[pa.array(c, pa.int64(), mask=m) for c, m in columns[: len(whole)]], *[pa.array(c, pa.float64(), mask=m) for c, m in columns[len(whole) :]]], names=[key, *whole, *parts])

    kinds = ", ".join([f"{key} {docs.schema[key].dataType.simpleString()}", *[f"{c} long" for c in whole], *[f"{c} double" for c in parts]])
    return docs.mapInArrow(run, kinds)


def _measured(k: int, doc: np.ndarray, words: pa.DictionaryArray, tags: pa.DictionaryArray, frequent: frozenset[str], adverbs: frozenset[str], z: int) -> list[tuple[np.ndarray, np.ndarray | None]]:
    """The columns of ``measures`` for k documents, each with where it is null."""
    w, t, at = _pairs(words, tags)
    names, first = words.dictionary.to_pylist(), np.array([(x or "")[:1] for x in tags.dictionary.to_pylist()], dtype=str)[t]
    line = _is_line(words, tags, w, t)
    lines = np.bincount(doc[line[at]], minlength=k)
    rare = np.array([x not in frequent for x in names], bool)[w]
    noun, adj, adv, verb = first == "n", first == "j", first == "r", first == "v"
    adv[adv] = [names[i] in adverbs for i in w[adv]]
    verb[verb] = [names[i] is not None and names[i] not in PLAIN_VERBS for i in w[verb]]
    lex, digits = noun | adj | adv | verb, np.array([x == "cd" for x in tags.dictionary.to_pylist()], bool)[t]
    flags = {"word": np.ones(len(w), bool), "sword": rare & ~digits, "lex": lex, "slex": lex & rare, "verb": verb, "sverb": verb & rare, "adj": adj, "adv": adv, "noun": noun}
    mask = sum((flags[c].astype(np.int64) << i for i, c in enumerate(CLASSES)), np.zeros(len(w), np.int64))
    kept = (line & _is_word(tags)[t])[at]
    doc, at = doc[kept], at[kept]
    n = np.bincount(doc, minlength=k)
    rn = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n) + 1
    # Tokens by document and word, in order.
    code = doc * max(len(names), 1) + w[at]
    order = np.argsort(code, kind="stable")
    code, rn, mask, size = code[order], rn[order], mask[at][order], n[doc][order]
    new_word = np.ones(len(code), bool)
    new_word[1:] = code[1:] != code[:-1]
    begin = np.flatnonzero(new_word)
    owner, of = doc[order], doc[order][begin]
    any_of = np.bitwise_or.reduceat(mask, begin) if len(begin) else mask
    types = [np.bincount(of[(any_of >> i & 1).astype(bool)], minlength=k) for i in range(len(CLASSES))]
    tokens = [np.bincount(owner[(mask >> i & 1).astype(bool)], minlength=k) for i in range(len(CLASSES))]
    before = np.zeros(len(code), np.int64)
    before[1:] = np.where(new_word[1:], 0, rn[:-1])
    # As in ``diversity_samples``.
    starts = np.minimum(rn, size - z + 1) - np.maximum(np.maximum(before + 1, rn - z + 1), 1) + 1
    new = (before <= (rn - 1) // z * z) & (rn <= size // z * z)
    total = lambda x, where: np.bincount(where, weights=x, minlength=k)
    ndw = np.bincount(of, minlength=k)
    f, m = np.diff(np.append(begin, len(code))), size[begin]
    many = m >= z
    nf, back = np.unique(np.stack([m[many], f[many]]), axis=1, return_inverse=True)
    missed = np.ones(nf.shape[1])
    for i in range(z):
        missed *= np.maximum(0.0, (nf[0] - nf[1] - i) / (nf[0] - i))
    met = total(1 - missed[back.reshape(-1)], of[many])
    whole, none = n >= z, n == 0
    some = lambda a, b: np.where(whole, a / np.where(whole, b, 1), ndw)
    ratio = np.where(whole, total(new, owner) / np.maximum(n // z * z, 1), ndw / np.maximum(n, 1))
    samples = [np.where(whole, np.bincount(of[rn[begin] <= z], minlength=k), ndw), np.where(whole, met, ndw), some(total(np.maximum(starts, 0), owner), n - z + 1), ratio]
    return [*[(c, None) for c in (lines, *types, *tokens)], (n, none), (ndw, none), *[(c.astype(float), none) for c in samples]]


def lexical_vectors(tagged: DataFrame, word_list: DataFrame, key: str = "filename", rank_limit: int = 2000, z: int = 50) -> DataFrame:
    """One row of FEATURES per document of ``tagged``."""
    return ratios(measures(stored(by_document(tagged, key), "tagged"), word_list, key, rank_limit, z), key)
