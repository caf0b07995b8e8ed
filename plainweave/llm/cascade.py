"""A Bloom filter cascade: exact membership for every key of a known universe, without a join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plainweave.llm.common import MOST_LOG2_BITS, ROW_KEY, Bloom, log2_bits, row_key, stored


class Cascade:
    """``universe``: a stored table of the columns ``key`` and ``listed``. Level 0 holds the listed keys; each further level
    holds the keys of the other class that the level before lets through by mistake, and hashes anew. The levels end when no mistake is left.

    A level has ``bits_per_key`` bits or up to twice as many for each key it holds; one of more than ``2 ** most_log2_bits`` bits is an error.
    """

    def __init__(self, universe: DataFrame, key: list[str] | None = None, bits_per_key: int = 12, most_log2_bits: int = MOST_LOG2_BITS, most_levels: int = 40):
        self.key, self.levels = key or ["key"], []
        other, this = universe.filter("NOT listed"), universe.filter("listed")
        while True:
            k = len(self.levels)
            n = this.count()
            bits = log2_bits(n, bits_per_key)
            if bits > most_log2_bits or k >= most_levels:
                raise ValueError(f"level {k} of the cascade needs 2^{bits} bits for {n} keys")
            self.levels.append(Bloom(this.select(self._hash(k, self.key).alias("h")), "h", bits, 4))
            wrong = other.filter(self.levels[-1].may_contain(self._hash(k, self.key)))
            if wrong.isEmpty():
                return
            this, other = stored(wrong, "wrong"), this

    @staticmethod
    def _hash(level: int, key: list) -> Column:
        return F.xxhash64(F.lit(level), *key)

    def contains(self, *key: Column) -> Column:
        """Whether a key of the universe is listed: refused first by an odd level, or by none after an even last one."""
        out = F.lit(len(self.levels) % 2 == 1)
        for k in reversed(range(len(self.levels))):
            out = F.when(self.levels[k].may_contain(self._hash(k, list(key) or self.key)), out).otherwise(F.lit(k % 2 == 1))
        return out


def drop_rows(docs: DataFrame, judged: DataFrame, once: DataFrame | None = None, most_keys: int = (1 << MOST_LOG2_BITS) // 16) -> DataFrame:
    """``docs`` without the rows that ``judged`` calls ``gone``, in place: no text is shuffled.

    ``judged`` (doc_id, __pw_key, gone) is a stored table of all rows of ``docs``; rows of one key have one verdict. Rows are found
    by a cascade over these keys. Of the rows of a key in ``once`` (doc_id, __pw_key) only one is left; these alone are shuffled.
    With more keys than a cascade may hold (``most_keys`` gone, or fifty times as many left) the rows are joined to their verdicts instead.
    """
    key = ["doc_id", ROW_KEY]
    n = {r["gone"]: r["count"] for r in judged.groupBy("gone").count().collect()}
    keyed = docs.withColumn(ROW_KEY, row_key())
    if not n.get(True):
        left = keyed
    elif n[True] <= most_keys and n.get(False, 0) <= 50 * most_keys:
        left = keyed.filter(~Cascade(judged.withColumnRenamed("gone", "listed"), key).contains(*map(F.col, key)))
    else:
        gone = judged.filter("gone").select(F.col("doc_id").alias("__pw_id"), F.col(ROW_KEY).alias("__pw_key2")).distinct()
        left = keyed.join(gone, (F.col(ROW_KEY) == F.col("__pw_key2")) & F.col("doc_id").eqNullSafe(F.col("__pw_id")), "left_anti")
    if once is not None and not once.isEmpty():
        some = Bloom(once, ROW_KEY).may_contain(F.col(ROW_KEY))
        left = left.filter(~some).unionByName(left.filter(some).dropDuplicates(["doc_id", ROW_KEY]))
    return left.drop(ROW_KEY)
