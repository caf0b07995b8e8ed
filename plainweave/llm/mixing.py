"""Mixing sources to target weights by capped water-filling, with DataFrame functions only.

Each source has a weight and a size in words. Its target is its share of the whole by weight, but at most
``max_epochs`` times its size; what lies above is shared out again by weight until no target exceeds its cap.
That fixed point has a closed form: with the sources in order of cap / weight, the first k are clamped and
the others get ``weight * (total - caps of the first k) / (weights of the others)``, k being the first position at which the next source is not above its cap.

A source then takes ``floor(target / size)`` whole repetitions of each document, and one more of the
documents that come first in a seeded order, until the target is met to half a document. What is left of that order is one place in it for each source:
it is cut into buckets of about ``bucket_rows`` documents, whose sums tell the bucket in which the place lies, and only that one is
sorted. A row then sees by its own place whether it comes before, so that texts stay where they are read.

Nulls: a null text has size 0, a null source is a source of its own (last); a null doc_id is drawn by its text. Empty texts have size 0 and get the whole repetitions only. Rows that agree in
doc_id and text are documents of their own, but drawn together: all or none of them once more, whichever is nearer to the target. Ties in the order go by doc_id, size and the text's hash. A long text
is a document like any other. Sources of size 0 get target 0. An empty table gives an empty result. The sources are sorted in one task: they are assumed to be few next to the documents.
Columns may have any names: those beside doc_id and source are carried along apart from the operator's own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plainweave.llm.common import stored, words

WEIGHTS = (1, 2, 3)
MAX_SOURCES_SENT = 100_000


def _drawn(seed: str) -> list[Column]:
    """A document's size and its place in the seeded order: a hash of its doc_id, or of its text without one."""
    text = F.coalesce("text", F.lit(""))
    order = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.md5(text))))
    return [F.size(words(F.col("text"))).cast("long").alias("size"), order.alias("u"), F.xxhash64("text").alias("text_hash")]


def water_fill(sources: DataFrame, max_epochs: int = 3) -> DataFrame:
    """(source, source_size, weight) with a ``target`` each, see above. ``sources`` has a row per source."""
    by = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    capped = sources.withColumn("cap", F.col("source_size") * max_epochs)
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    total = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = capped.withColumns({
        "rest": F.sum("source_size").over(total) - F.coalesce(F.sum("cap").over(before), F.lit(0)),
        "others": F.sum("weight").over(total) - F.coalesce(F.sum("weight").over(before), F.lit(0)),
        "n": F.row_number().over(by),
    })
    fits = F.col("weight") * F.col("rest") <= F.col("cap") * F.col("others")
    out = out.withColumn("k", F.min(F.when(fits, F.col("n"))).over(total))
    out = out.withColumns({"level_rest": F.max(F.when(F.col("n") == F.col("k"), F.col("rest"))).over(total), "level_others": F.max(F.when(F.col("n") == F.col("k"), F.col("others"))).over(total)})
    level = F.col("weight") * F.col("level_rest") / F.col("level_others")
    return out.select("source", "source_size", "weight", F.when(F.col("k").isNull() | (F.col("n") < F.col("k")), F.col("cap").cast("double")).otherwise(level).alias("target"))


def weighted(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Gives the sources, by code point and null last, the weights in turn."""
    n = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    return sources.withColumn("weight", F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (n + 1).cast("int")))


def _attached(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Joins by a null-safe source; the small side is sent to all tasks only if its counted rows are few."""
    small = sources.withColumnRenamed("source", "s_source")
    return rows.join(F.broadcast(small) if small.count() <= MAX_SOURCES_SENT else small, F.col("source").eqNullSafe(F.col("s_source"))).drop("s_source")


def _bucket(buckets: Column) -> Column:
    """The first 32 bits of the order give the bucket, so buckets follow each other in the order."""
    return F.shiftright(F.conv(F.substring("u", 1, 8), 16, 10).cast("long") * buckets, 32)


_ORDER = ["u", "doc_id", "size", "text_hash"]


def plan(docs: DataFrame, seed: str = "mix-1", weights: tuple[int, ...] = WEIGHTS, max_epochs: int = 3, bucket_rows: int = 20_000) -> tuple[DataFrame, DataFrame]:
    """(rows, sources): all rows without their texts, and of each source its target and the place in the order up to which documents are taken once more.

    The buckets' sums tell in which bucket of a source that place lies; only the rows of this one are sorted.
    """
    sized = stored(docs.select("doc_id", "source", *_drawn(seed)), "sized")
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    filled = water_fill(weighted(sources.select("source", "source_size"), weights), max_epochs)
    out = filled.join(sources.select(F.col("source").alias("r_source"), "rows"), F.col("source").eqNullSafe(F.col("r_source"))).drop("r_source")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    out = out.withColumn("whole", whole).withColumn("extra", F.col("target") - F.col("whole") * F.col("source_size"))
    out = stored(out.select("source", "source_size", "target", "whole", "extra", F.ceil(F.col("rows") / bucket_rows).cast("long").alias("buckets")), "sources")
    placed = _attached(sized, out.select("source", "extra", "buckets")).withColumn("bucket", _bucket(F.col("buckets")))
    sums = stored(placed.groupBy("source", "bucket", "extra").agg(F.sum("size").alias("bucket_size")), "buckets")
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("start", F.coalesce(F.sum("bucket_size").over(before), F.lit(0)))
    # The first bucket that isn't taken as a whole.
    cut = starts.filter(F.col("start") + F.col("bucket_size") > F.col("extra")).groupBy("source").agg(F.min(F.struct("bucket", "start")).alias("cut"))
    cut = stored(cut.select("source", F.col("cut.bucket").alias("cut_bucket"), F.col("cut.start").alias("start")), "cuts")
    inside = _attached(placed, cut).filter("bucket = cut_bucket")
    same = inside.groupBy("source", "start", "extra", *_ORDER).agg(F.sum("size").alias("of"))
    upto = Window.partitionBy("source").orderBy(*_ORDER).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    taken = same.withColumn("end", F.col("start") + F.sum("of").over(upto)).filter(F.col("end").cast("double") - F.col("of") / 2 <= F.col("extra"))
    last = taken.groupBy("source").agg(F.max(F.struct(*_ORDER)).alias("last")).withColumnRenamed("source", "l_source")
    ends = cut.drop("start").join(last, F.col("source").eqNullSafe(F.col("l_source")), "left").drop("l_source").withColumnRenamed("source", "c_source")
    return sized, stored(out.join(ends, F.col("source").eqNullSafe(F.col("c_source")), "left").drop("c_source", "extra"), "plan")


def _copies(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """``rows`` (source, _ORDER) with their sources' columns and ``copies``. A source without a ``cut_bucket`` is taken once more as a whole."""
    placed = _attached(rows, sources)
    bucket = _bucket(F.col("buckets"))
    more = F.col("cut_bucket").isNull() | (bucket < F.col("cut_bucket")) | ((bucket == F.col("cut_bucket")) & F.coalesce(F.struct(*_ORDER) <= F.col("last"), F.lit(False)))
    return placed.withColumn("copies", F.col("whole") + ((F.col("size") > 0) & more).cast("long"))


def mix(docs: DataFrame, seed: str = "mix-1", **options) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies, taken."""
    rows = _copies(*plan(docs, seed, **options))
    return rows.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def sample(docs: DataFrame, seed: str = "mix-1", **options) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as ``mix`` takes it, decided and repeated where it is read: no text is shuffled."""
    _, sources = plan(docs, seed, **options)
    own = [c for c in docs.columns if c not in ("doc_id", "source")]
    bare = docs.select("doc_id", "source", F.struct(*[F.col(f"`{c}`") for c in own]).alias("__pw_row"), *_drawn(seed))
    taken = _copies(bare, sources).withColumn("__pw_n", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))))
    return taken.select(*[F.col(c) if c in ("doc_id", "source") else F.col("__pw_row")[c].alias(c) for c in docs.columns])
