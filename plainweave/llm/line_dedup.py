"""Line deduplication: later copies of repeated runs of lines are deleted, with DataFrame functions only.

The lines with a word, document by document, are one sequence of line ids. Distributed prefix doubling sorts its
suffixes by their first 1, 2, 4, ... lines: each round joins a suffix's rank with that of the suffix further on, sorts the
distinct pairs of ranks by range over all tasks, and takes each pair's place in that order as the new
rank. Only ranks that occur twice go on to the next round, so the sequence shrinks, and the rounds end where no two suffixes agree:
they are as many as the logarithm of the longest repeated run. From ``min_run`` lines up, the suffixes of equal rank at a depth are the
intervals of the suffix array whose longest common prefix has that depth; from them a suffix takes the greatest depth at which it is not the first
(smallest doc_id, then first line) of its interval. Runs of ``min_run`` lines or more are found whole: two such prefixes, one from
a run's first line and one that ends with its last, cover the run. Prefixes that overlap or adjoin make up the maximal repeated runs.

A blank line is no member of a run, but goes with a run that it is in. A run of one line repeated is a
repeated run as well. Nulls: a null text has no line, a null doc_id orders last. Rows that agree in doc_id and text are one
document and share its result; rows of one doc_id with different texts order by the hash of doc_id and text. A text without a word has no line, and is kept as it is.
Texts are taken whole; a long one's lines are rows, and its runs are sorted and merged, so that what is left of it is cut out in one pass. An empty table gives an empty result.
Columns other than doc_id and text are not read, whatever their names. A line of many rows is looked up where its rows are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plainweave.llm.common import ROW_KEY, Bloom, joined_by_weight, row_key, stored

HAS_WORD = r"[^\x20\x09-\x0D]"


def _ranked(rows: DataFrame, pair: list[str]) -> DataFrame:
    """``rows`` with a ``rank`` in the order of ``pair`` for the pairs that occur twice or more; the others are left out."""
    pairs = rows.groupBy(*pair).agg(F.count("*").alias("n")).filter("n > 1")
    # Ids that grow with partition and position are the sorted order; the table fixes them.
    ranks = stored(pairs.repartitionByRange(*pair).sortWithinPartitions(*pair).withColumn("rank", F.monotonically_increasing_id()), "ranks")
    return stored(joined_by_weight(rows, ranks, pair).drop(*pair, "n"), "suffixes")


def lines(docs: DataFrame) -> DataFrame:
    """(doc_id, __pw_key, k, a, b): the lines with a word, their number among those, and two hashes."""
    split = docs.select("doc_id", row_key().alias(ROW_KEY), F.split("text", "\n").alias("line"))
    each = split.select("doc_id", ROW_KEY, F.posexplode(F.filter("line", lambda x: x.rlike(HAS_WORD))).alias("k", "x"))
    return each.select("doc_id", ROW_KEY, "k", F.xxhash64("x").alias("a"), F.xxhash64(F.lit(1), "x").alias("b"))


def _doubled(suffixes: DataFrame, step: int) -> DataFrame:
    """The suffixes that share their first ``depth + step`` lines with another, from those that share their first ``depth``, step <= depth."""
    here = suffixes.withColumn("id", F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    further = here.select("id", ROW_KEY, (F.col("k") - step).alias("k"), F.col("rank").alias("then"))
    both = here.join(further, ["id", ROW_KEY, "k"]).select("doc_id", ROW_KEY, "k", F.col("rank").alias("now"), "then")
    return _ranked(both, ["now", "then"])


def intervals(docs: DataFrame, min_run: int = 3) -> list[tuple[int, DataFrame]]:
    """Of each depth ``min_run``, 2 ``min_run``, 4 ``min_run``, ... (depth, table of doc_id, __pw_key, k, rank): the suffixes
    that share their first ``depth`` lines with another; those of one rank are an interval. Ends at the depth that no two suffixes share."""
    suffixes = _ranked(lines(docs), ["a", "b"]).dropDuplicates(["doc_id", ROW_KEY, "k"])
    depth, out = 1, []
    while depth < min_run:
        step = min(depth, min_run - depth)
        suffixes, depth = _doubled(suffixes, step), depth + step
    while not suffixes.isEmpty():
        out.append((depth, suffixes))
        suffixes, depth = _doubled(suffixes, depth), 2 * depth
    return out


def common_prefixes(docs: DataFrame, min_run: int = 3) -> DataFrame:
    """(doc_id, __pw_key, k, lcp): the suffixes with a common prefix of ``min_run`` lines or more with an earlier one; ``lcp`` is the
    greatest depth of ``intervals`` at which an earlier one shares the interval, so more than half of the longest common prefix."""
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", ROW_KEY, "k")
    out = None
    for depth, suffixes in intervals(docs, min_run):
        least = stored(suffixes.groupBy("rank").agg(F.min(order).alias("least"), F.count("*").alias("n")), "least")
        later = joined_by_weight(suffixes, least, ["rank"]).filter(order > F.col("least")).select("doc_id", ROW_KEY, "k", F.lit(depth).alias("lcp"))
        out = later if out is None else out.unionByName(later)
    if out is None:
        return lines(docs).select("doc_id", ROW_KEY, "k", F.lit(0).alias("lcp")).filter("lcp > 0")
    return out.groupBy("doc_id", ROW_KEY, "k").agg(F.max("lcp").alias("lcp"))


def runs(docs: DataFrame, min_run: int = 3) -> DataFrame:
    """(doc_id, __pw_key, k, n): the maximal runs of lines to delete, n lines from the k-th line with a word: common prefixes that overlap or adjoin."""
    doc = Window.partitionBy("doc_id", ROW_KEY).orderBy("k")
    end = F.max(F.col("k") + F.col("lcp")).over(doc.rowsBetween(Window.unboundedPreceding, -1))
    apart = F.coalesce((F.col("k") > end).cast("long"), F.lit(1).cast("long"))
    islands = common_prefixes(docs, min_run).withColumn("apart", apart).withColumn("island", F.sum("apart").over(doc))
    return islands.groupBy("doc_id", ROW_KEY, "island").agg(F.min("k").alias("k"), (F.max(F.col("k") + F.col("lcp")) - F.min("k")).cast("long").alias("n")).drop("island")


def deduplicate(docs: DataFrame, min_run: int = 3) -> DataFrame:
    """One row per document: doc_id, n_lines, n_removed (lines with a word), kept: the text that is left."""
    found = runs(docs, min_run).groupBy("doc_id", ROW_KEY).agg(F.collect_list(F.struct("k", "n")).alias("runs"))
    found = stored(found, "runs").withColumnsRenamed({"doc_id": "d_id", ROW_KEY: "d_key"})
    bloom = Bloom(found.select("d_key"), "d_key")
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select("doc_id", text.alias("text"), row_key().alias(ROW_KEY), F.size(F.filter(F.split(text, "\n"), lambda x: x.rlike(HAS_WORD))).cast("long").alias("n_lines"))
    asked = bloom.may_contain(F.col(ROW_KEY))
    whole = keyed.filter(~asked).select("doc_id", "n_lines", F.lit(0).cast("long").alias("n_removed"), F.col("text").alias("kept"))
    held = keyed.filter(asked).join(found, (F.col(ROW_KEY) == F.col("d_key")) & F.col("doc_id").eqNullSafe(F.col("d_id")), "left")
    # Places of the lines with a word, so that a run (k, n) is the places from its first to its last line.
    line = F.split("text", "\n")
    at = F.transform(F.filter(F.transform(line, lambda x, i: F.struct(x.alias("line"), i.alias("pos"))), lambda x: x["line"].rlike(HAS_WORD)), lambda x: x["pos"])
    held = held.withColumn("at", at)
    spans = F.transform(F.sort_array("runs"), lambda r: F.struct(F.get("at", r["k"]).alias("first"), F.get("at", r["k"] + r["n"].cast("int") - 1).alias("last")))
    held = held.withColumns({"line": line, "spans": F.coalesce(spans, F.array().cast("array<struct<first:int,last:int>>"))})

    def between(i: Column) -> Column:
        """The lines between the i-th run and the one before."""
        begin = F.coalesce(F.get("spans", i - 1)["last"] + 1, F.lit(0))
        return F.slice("line", begin + 1, F.coalesce(F.get("spans", i)["first"], F.size("line")) - begin)

    left = F.flatten(F.transform(F.sequence(F.lit(0), F.size("spans")), between))
    removed = F.aggregate("runs", F.lit(0).cast("long"), lambda acc, r: acc + r["n"])
    held = held.select("doc_id", "n_lines", F.coalesce(removed, F.lit(0).cast("long")).alias("n_removed"), F.when(F.col("runs").isNull(), F.col("text")).otherwise(F.array_join(left, "\n")).alias("kept"))
    return whole.unionByName(held)
