"""Exact deduplication on a log-structured merge index of digests, with DataFrame functions only.

Texts are equal if they are identical without the characters ``[\\x20\\x09-\\x0D]``.

* Each task is a memtable: it flushes what it reads as one run sorted by digest, an entry (digests, 1, identifier) a row.
* Compaction merges ``fanout`` runs of a level into one sorted run of the next, all groups of a level at once, until one run is left. An entry
  keeps the number of rows and the smallest identifier; identifiers are ordered by what is to stay: most code points, then smallest doc_id.
* An entry of more than one row is a hit. A Bloom filter of the last run's hits goes to the tasks; only rows that it lets through are looked up.
  Texts of hits are read again and compared byte by byte: they are grouped by the text itself. A digest pair (XXH64 and
  SHA-256) with two different texts would stop the job instead of merging them.
* The identifier of a hit's entry names the row that stays; it is the only place that does. Rows go where they are read, and no copy's text is shuffled but one a task for the byte comparison.

Nulls: a null text counts as empty, a null doc_id as larger than any other. Ties of code points and doc_id go by the hash of doc_id and
text; of rows that agree in these too one stays. Texts are taken whole, however long: their digests are what is kept. An empty table gives an empty result.
Other columns are carried along by ``drop_duplicates``, whatever their names, but for those that start with ``__pw_``, which are the operators' own.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plainweave.llm.cascade import drop_rows
from plainweave.llm.common import ROW_KEY, Bloom, joined, row_key, squeezed, stored


class DigestIndex:
    """A log-structured merge index: runs of (run, keys, n, first_id) by level, those of a level in tables that number them."""

    def __init__(self, fanout: int = 16, keys: tuple[str, ...] = ("digest",)):
        self.fanout, self.keys = fanout, list(keys)
        self.levels: list[list[DataFrame]] = [[]]
        self.runs = [0]

    def flush(self, rows: DataFrame, first: Column | None = None) -> DataFrame:
        """Writes rows with the keys: each task's memtable is one run in one sorted file. ``first``: a row's identifier, doc_id by default."""
        table = stored(rows.withColumn("run", F.spark_partition_id() + self.runs[0]).sortWithinPartitions(*self.keys), "run")
        self.levels[0].append(table.select("run", *self.keys, F.lit(1).cast("long").alias("n"), (F.col("doc_id") if first is None else first).alias("first_id")))
        self.runs[0] = max(self.runs[0], (table.agg(F.max("run")).first()[0] or 0) + 1)
        return table

    def _merged(self, k: int) -> None:
        """Merges each ``fanout`` runs of level k into one of the next."""
        if k + 1 == len(self.levels):
            self.levels.append([])
            self.runs.append(0)
        runs = reduce(DataFrame.unionByName, self.levels[k]).withColumn("run", F.floor(F.col("run") / self.fanout).cast("int") + self.runs[k + 1])
        merged = runs.groupBy("run", *self.keys).agg(F.sum("n").alias("n"), F.min("first_id").alias("first_id"))
        self.levels[k + 1].append(stored(merged.sortWithinPartitions("run", *self.keys), "run"))
        self.runs[k + 1] += -(-self.runs[k] // self.fanout)
        self.levels[k], self.runs[k] = [], 0

    def compact(self, whole: bool = False) -> None:
        """Merges the levels of ``fanout`` runs or more; ``whole``: all runs into one."""
        k = 0
        while k < len(self.levels):
            more = k == 0 or self.runs[k] > 1 or any(self.levels[k + 1 :])
            if self.levels[k] and (self.runs[k] >= self.fanout or whole and more):
                self._merged(k)
            k += 1

    def entries(self) -> DataFrame:
        """(keys, n, first_id), one row per key."""
        runs = [run for level in self.levels for run in level]
        out = reduce(DataFrame.unionByName, runs).select(*self.keys, "n", "first_id")
        return out if sum(self.runs) == 1 and not self.levels[0] else out.groupBy(*self.keys).agg(F.sum("n").alias("n"), F.min("first_id").alias("first_id"))


DIGESTS = ["digest", "sha"]


def _digested(docs: DataFrame) -> DataFrame:
    points = F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_points")
    bare = docs.select("doc_id", row_key().alias(ROW_KEY), points, squeezed(F.col("text")).alias("bare"))
    return bare.select("doc_id", ROW_KEY, "n_points", "bare", F.xxhash64("bare").alias("digest"), F.unhex(F.sha2("bare", 256)).alias("sha"))


def _verified(digested: DataFrame, hits: DataFrame, found: Bloom) -> DataFrame:
    """The hits, each of whose texts are one text of as many rows; two texts of the same digests are an error."""
    texts = digested.filter(found.may_contain(F.col("digest"))).groupBy(*DIGESTS, "bare").agg(F.count("*").alias("rows")).filter("rows > 1")
    seen = texts.groupBy(*DIGESTS).agg(F.count("*").alias("texts"), F.sum("rows").alias("rows"))
    both = hits.join(seen, DIGESTS, "left")
    same = (F.col("texts") == 1) & (F.col("rows") == F.col("n"))
    return both.select(*DIGESTS, "n", F.when(same, F.col("first_id")).otherwise(F.raise_error(F.lit("two texts share XXH64 and SHA-256"))).alias("stays"))


def _judged(docs: DataFrame) -> DataFrame:
    """(doc_id, __pw_key, row, sha, n, stays): all rows, with the size of their group and, in groups of two or more, the identifier that stays."""
    index = DigestIndex(keys=tuple(DIGESTS))
    digested = _digested(docs)
    rows = index.flush(
        digested.select("doc_id", ROW_KEY, "n_points", *DIGESTS, F.monotonically_increasing_id().alias("row")),
        F.struct((-F.col("n_points")).alias("less"), F.col("doc_id").isNull().alias("none"), "doc_id", ROW_KEY, "row"),
    )
    index.compact(whole=True)
    hits = stored(index.entries().filter("n > 1"), "hits")
    found = Bloom(hits, "digest")
    groups = stored(_verified(digested, hits, found), "groups")
    asked = found.may_contain(F.col("digest"))
    columns = ["doc_id", ROW_KEY, "row", "sha"]
    alone = rows.filter(~asked).select(*columns, F.lit(1).cast("long").alias("n"), F.lit(None).cast(groups.schema["stays"].dataType).alias("stays"))
    many = joined(rows.filter(asked), groups, DIGESTS, "left").select(*columns, F.coalesce("n", F.lit(1).cast("long")).alias("n"), "stays")
    return alone.unionByName(many)


def decisions(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Of a group of equal texts the row with the most code points stays, then the one with the smallest doc_id.
    """
    single = F.col("stays").isNull()
    keep_id = F.when(single, F.col("doc_id")).otherwise(F.col("stays.doc_id")).alias("keep_id")
    kept = (single | (F.col("stays.row") == F.col("row"))).alias("kept")
    return _judged(docs).select("doc_id", keep_id, F.col("n").alias("group_size"), kept, F.lower(F.hex("sha")).alias("text_sha256"))


def drop_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of equal texts; other columns are carried along."""
    best = F.col("doc_id").eqNullSafe(F.col("stays.doc_id")) & (F.col(ROW_KEY) == F.col(f"stays.{ROW_KEY}"))
    gone = (F.col("stays").isNotNull() & ~best).alias("gone")
    judged = stored(_judged(docs).select("doc_id", ROW_KEY, gone, (F.col("stays").isNotNull() & best & (F.col("stays.row") != F.col("row"))).alias("again")), "judged")
    return drop_rows(docs, judged.select("doc_id", ROW_KEY, "gone"), judged.filter("again").select("doc_id", ROW_KEY))
