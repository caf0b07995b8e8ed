"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked at 3 or fewer differing bits.

Fingerprints are made per Arrow batch. Equal ones become one node, so copies are never paired.
To find every link, the 64 bits are cut into ``blocks`` parts: two fingerprints that differ in
3 bits agree in all but 3 parts, so they meet in one of the buckets (which parts, their bits). The
number of parts grows with the number of fingerprints, so that buckets stay small; a bucket of more than ``tile`` is compared
in tiles by several tasks. Any such choice finds the same links.

In a bucket the comparison is bit-sliced. The fingerprints' bit planes are stored vertically, 64
fingerprints a word. For each distance in the sorted order, the plane XOR its shifted self gives that bit's
differences of 64 pairs at once; they are added to carry-save counters (ones, twos, over), and a
block of 64 pairs is abandoned as soon as all of them exceed the radius. A bucket's links are returned as a star, not as pairs.

Nulls: a null text has no words and fingerprint 0, like an empty one, and is linked like any other. A null doc_id
counts as larger than any other; a component of null ids has component_id null. Repeated rows
give repeated rows; ``drop_near_duplicates`` leaves one row of a component, also of rows with one doc_id or none. A bit set in just half the
hashes is 0. Texts are taken whole: a long one is a batch of its own and its bits are counted piece by piece. An empty table gives an empty result.
Columns other than doc_id and text are carried along, whatever their names, but for those that start with ``__pw_``.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plainweave.llm.cascade import drop_rows
from plainweave.llm.common import ROW_KEY, joined_by_weight, row_key, stored
from plainweave.llm.components import components
from plainweave.llm.ragged import _SPACE, LOWER, SMALL_CHUNK_BYTES, chunks, padded, split_words, tidy, xxh64

RADIUS, TILE, ROWS_A_TASK = 3, 4096, 200_000
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)
_PAIRS = 1 << 16


def fingerprint_chunk(data: np.ndarray, offsets: np.ndarray, shingle: int = 3, seed: int = 42) -> np.ndarray:
    """The fingerprint of each text of a chunk, unsigned."""
    starts, lens, by_text = split_words(data, offsets)
    out = np.zeros(len(offsets) - 1, np.uint64)
    if not len(starts):
        return out
    keep = ~_SPACE[data]
    after = starts + lens
    after = after[after < len(data)]
    keep[after] = True  # one separator after each word; the first byte of the next text stays as it is
    low = np.where(_SPACE[data], np.uint8(0x20), LOWER[data])[keep]
    at = (np.cumsum(keep) - 1)[starts]
    n = np.diff(by_text)
    width = np.minimum(n, shingle)
    shingles = np.where(n > 0, n - width + 1, 0)
    text = np.repeat(np.arange(len(n)), shingles)
    first = by_text[:-1][text] + (np.arange(len(text)) - np.repeat(np.cumsum(shingles) - shingles, shingles))
    last = first + width[text] - 1
    h = xxh64(padded(low), at[first], at[last] + lens[last] - at[first], seed)
    full = np.flatnonzero(shingles)
    begin = (np.cumsum(shingles) - shingles)[full]
    counts = np.zeros((len(full), 64), np.int64)
    lo = 0
    while lo < len(full):  # bits of a bounded number of shingles at a time
        hi = max(lo + 1, int(np.searchsorted(begin, begin[lo] + _PAIRS)))
        end = begin[hi] if hi < len(full) else len(h)
        part = h[begin[lo] : end]
        if hi == lo + 1:
            for k in range(0, len(part), _PAIRS):
                counts[lo] += np.unpackbits(part[k : k + _PAIRS].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        else:
            bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            counts[lo:hi] = np.add.reduceat(bits, begin[lo:hi] - begin[lo], axis=0, dtype=np.int32)
        lo = hi
    over = 2 * counts > shingles[full][:, None]
    out[full] = np.packbits(over, axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, __pw_key, fp): fp as a signed BIGINT of the same bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in chunks(batches, most=SMALL_CHUNK_BYTES):
            fp = fingerprint_chunk(data, offsets, shingle).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fp)], names=["doc_id", ROW_KEY, "fp"])
        tidy()

    return docs.select("doc_id", row_key().alias(ROW_KEY), "text").mapInArrow(run, f"doc_id long, {ROW_KEY} long, fp long")


def _shifted(planes: np.ndarray, words: np.ndarray, d: int) -> np.ndarray:
    """Of one plane, the bits d rows further on, for the given words. Planes end in spare zero words."""
    q, r = words + (d >> 6), np.uint64(d & 63)
    low = planes[np.minimum(q, len(planes) - 1)]
    if not r:
        return low
    return (low >> r) | (planes[np.minimum(q + 1, len(planes) - 1)] << (np.uint64(64) - r))


def linked(fps: np.ndarray, last: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """For rows in buckets (``last``: the end of each row's bucket), the first row that each is linked to, by way of others too.

    The radius may be 3 at most, what two carry-save counters hold.
    """
    n = len(fps)
    root = np.arange(n)
    if n < 2:
        return root
    bits = np.unpackbits(fps.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    spare = -n % 64 + 64
    planes = np.packbits(np.concatenate([bits, np.zeros((spare, 64), np.uint8)]).T.copy(), axis=1, bitorder="little").view(np.uint64)
    reach = last - 1 - np.arange(n)
    lanes = np.zeros(n + spare, np.uint8)

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for d in range(1, int(reach.max()) + 1):
        lanes[:n] = reach >= d
        valid = np.packbits(lanes, bitorder="little").view(np.uint64)
        words = np.flatnonzero(valid)
        ones, twos, over = np.zeros(len(words), np.uint64), np.zeros(len(words), np.uint64), ~valid[words]
        for b in range(64):
            diff = planes[b][words] ^ _shifted(planes[b], words, d)
            carry = ones & diff
            ones ^= diff
            over |= twos & carry
            twos ^= carry
            if b % 4 == 3 and b > 10:
                alive = over != _ALL
                if not alive.any():
                    words = words[:0]
                    break
                if alive.mean() < 0.7:
                    words, ones, twos, over = words[alive], ones[alive], twos[alive], over[alive]
        if not len(words):
            continue
        if radius < 3:
            count_two = twos if radius < 2 else twos & ones
            over |= count_two | (ones if radius < 1 else 0)
        hit = np.unpackbits((~over).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").reshape(len(words), 64)
        w, lane = np.nonzero(hit)
        i = words[w] * 64 + lane
        apart = root[i] != root[i + d]
        for x in i[apart]:
            a, c = find(int(x)), find(int(x) + d)
            if a != c:
                root[max(a, c)] = min(a, c)
        if apart.any():
            while (root[root] != root).any():
                root = root[root]
    return root


def _parts(n: int) -> int:
    """Into how many parts to cut the bits so that buckets of n even fingerprints hold a few hundred."""
    parts = RADIUS + 1
    while n >> (64 * (parts - RADIUS) // parts) > 512:
        parts += 1
    return parts


def links(distinct: DataFrame, parts: int | None = None, tile: int = TILE) -> DataFrame:
    """(a, b): stars that span the same components as all links among the distinct ``fp``."""
    n = distinct.count()
    parts = parts or _parts(n)
    edges = [64 * k // parts for k in range(parts + 1)]
    masks = []
    for free in combinations(range(parts), RADIUS):
        mask = sum(((1 << (edges[k + 1] - edges[k])) - 1) << edges[k] for k in range(parts) if k not in free)
        masks.append(mask - (1 << 64) if mask >> 63 else mask)
    at = F.explode(F.array(*[F.struct(F.lit(k).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("bits")) for k, m in enumerate(masks)]))
    rows = distinct.select("fp", at.alias("at")).select("fp", F.xxhash64("at.t", "at.bits").alias("bucket"))
    heavy = stored(rows.groupBy("bucket").agg(F.count("*").alias("rows")).filter(F.col("rows") > tile), "heavy")
    tiles = F.coalesce(F.ceil(F.col("rows") / tile), F.lit(1)).cast("int")
    mine = F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int")
    placed = rows.join(heavy, "bucket", "left").withColumn("tiles", tiles).withColumn("mine", mine)
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    placed = placed.select("fp", F.xxhash64("bucket", F.least("mine", "other"), F.greatest("mine", "other")).alias("bucket"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        fp = np.concatenate([b.column(0).to_numpy() for b in held]).view(np.uint64)
        bucket = np.concatenate([b.column(1).to_numpy() for b in held])
        ends = np.append(np.flatnonzero(np.diff(bucket)) + 1, len(bucket))
        last = np.repeat(ends, np.diff(ends, prepend=0))
        more = np.diff(ends, prepend=0)
        many = np.repeat(more > 1, more)  # rows alone in their bucket need no comparison
        fp, last = fp[many], np.repeat(np.cumsum(more[more > 1]), more[more > 1])
        root = linked(fp, last)
        i = np.flatnonzero(root != np.arange(len(root)))
        yield pa.RecordBatch.from_arrays([pa.array(fp[i].view(np.int64)), pa.array(fp[root[i]].view(np.int64))], names=["a", "b"])
        del held, fp, bucket, last, root
        tidy()

    spread = max(distinct.sparkSession.sparkContext.defaultParallelism, n * len(masks) // ROWS_A_TASK + 1)
    return placed.repartition(spread, "bucket").sortWithinPartitions("bucket", "fp").mapInArrow(run, "a long, b long").distinct()


def _classes(docs: DataFrame, shingle: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, __pw_key, fp) of all rows, and (fp, first) of each fingerprint: the first row (doc_id, then key) of its component."""
    prints = stored(fingerprints(docs, shingle), "prints")
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", ROW_KEY)
    distinct = stored(prints.groupBy("fp").agg(F.min(first).alias("first")), "distinct")
    roots = stored(components(links(distinct.select("fp"))).withColumnRenamed("node", "fp"), "roots")
    linked_ = distinct.join(roots, "fp")
    least = linked_.groupBy("root").agg(F.min("first").alias("first"))
    alone = distinct.join(roots, "fp", "left_anti")
    return prints, stored(alone.unionByName(linked_.drop("first").join(least, "root").select("fp", "first")), "classes")


def near_duplicates(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """One row per document: doc_id, __pw_key, fingerprint (16 hex digits), component_id.

    A fingerprint of many rows is looked up where its rows are (``joined_by_weight``).
    """
    prints, classes = _classes(docs, shingle)
    weighted = stored(classes.join(prints.groupBy("fp").agg(F.count("*").alias("n")), "fp"), "weighted")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return joined_by_weight(prints, weighted, ["fp"]).select("doc_id", ROW_KEY, hexed, F.col("first.doc_id").alias("component_id"))


def drop_near_duplicates(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """``docs`` with one row of each component, that of the smallest doc_id (then of the smallest hash of doc_id and text); other columns are carried along."""
    prints, classes = _classes(docs, shingle)
    weighted = stored(classes.join(prints.groupBy("fp").agg(F.count("*").alias("n")), "fp"), "weighted")
    best = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col(ROW_KEY) == F.col(f"first.{ROW_KEY}"))
    judged = stored(joined_by_weight(prints, weighted, ["fp"]).select("doc_id", ROW_KEY, (~best).alias("gone")), "judged")
    again = judged.filter("NOT gone").groupBy("doc_id", ROW_KEY).count().filter("count > 1")
    return drop_rows(docs, judged, stored(again.select("doc_id", ROW_KEY), "again"))
