"""Native word expressions, row keys, and a native Bloom filter."""

from __future__ import annotations

from math import ceil, log2

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plainweave.tables import stored

BLANKS = " \t\n\x0b\f\r"
_GAPS = r"[\x20\x09-\x0D]+"
ROW_KEY = "__pw_key"


def words(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text as an array; null gives an empty one."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), _GAPS), "")


def squeezed(text: Column) -> Column:
    """The text without any character of ``[\\x20\\x09-\\x0D]``; null gives an empty one."""
    out = F.coalesce(text, F.lit(""))
    for c in BLANKS:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """With doc_id, tells the rows of documents apart, but for exact repetitions."""
    return F.xxhash64(F.col(doc_id), F.col(text))


MOST_LOG2_BITS = 27
MOST_SENT = 100_000


def log2_bits(keys: int, bits_per_key: int = 10) -> int:
    """The size of a Bloom filter for so many keys, as a power of two."""
    return max(12, ceil(log2(max(1, keys * bits_per_key))))


class Bloom:
    """A Bloom filter over a BIGINT hash column, built and asked by built-in expressions only.

    It is sized by the counted keys unless ``bits`` says how many (2^bits), and never larger than 2^MOST_LOG2_BITS bits (16 MB), so what
    goes to the workers is bounded; beyond that a fuller filter lets more rows through to the exact join behind it and loses none.
    ``keys`` is read twice, so it should be a table.
    """

    def __init__(self, keys: DataFrame, column: str, bits: int | None = None, probes: int = 3):
        self.log2_bits, self.probes = bits or min(MOST_LOG2_BITS, log2_bits(keys.count())), probes
        at = F.explode(F.array(*self._positions(F.col(column)))).alias("at")
        one = F.lit(1).cast("long")
        words = keys.select(at).groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits"))
        zero = keys.sparkSession.range(0, 1 << (self.log2_bits - 6), 1, 4).select(F.col("id").alias("word"), (one - one).alias("bits"))
        dense = words.unionByName(zero).groupBy("word").agg(F.bit_or("bits").alias("bits"))
        packed = dense.agg(F.transform(F.array_sort(F.collect_list(F.struct("word", "bits"))), lambda x: x["bits"]).alias("bits"))
        self.table = stored(packed, "bloom")

    def _positions(self, key: Column) -> list[Column]:
        low, high = key.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(key, 32).bitwiseOR(F.lit(1))
        return [(low + high * F.lit(j).cast("long")).bitwiseAND(F.lit((1 << self.log2_bits) - 1)) for j in range(self.probes)]

    def may_contain(self, key: Column) -> Column:
        bits, found = self.table.scalar(), F.lit(True)
        for at in self._positions(key):
            found = found & (F.getbit(F.get(bits, F.shiftright(at, 6).cast("int")), at.bitwiseAND(F.lit(63)).cast("int")) == 1)
        return found


def joined(rows: DataFrame, table: DataFrame, on: list[str], how: str = "inner", most: int = MOST_SENT) -> DataFrame:
    """``rows`` joined to a stored table with a row per key; it goes to all tasks only if its counted rows are ``most`` at most."""
    return rows.join(F.broadcast(table) if table.count() <= most else table, on, how)


def joined_by_weight(rows: DataFrame, table: DataFrame, on: list[str], weight: str = "n", heavy: int = 20_000) -> DataFrame:
    """``rows`` joined to a stored table whose ``weight`` says how many of the rows have a key.

    Keys of more than ``heavy`` rows and of a ten-thousandth of them all, 10,000 keys at most, are sent to the tasks, so that no
    task gets the rows of such a key; the rows of all other keys are shuffled.
    """
    total = table.agg(F.coalesce(F.sum(weight), F.lit(0))).first()[0]
    bound = max(heavy, total // 10_000)
    hot = table.filter(F.col(weight) > bound)
    if hot.isEmpty():
        return rows.join(table, on)
    apart = rows.join(F.broadcast(hot.select(*on)), on, "left_anti")
    return rows.join(F.broadcast(hot), on).unionByName(apart.join(table.filter(F.col(weight) <= bound), on))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
