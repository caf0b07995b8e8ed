"""The corpus pipeline: rules, exact and near duplicates, source mix, packing.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet and read again as the next one's ``docs``.

Nulls: a null text has no words, and the rules reject it, like an empty one; a null doc_id is kept and orders last, so of copies one with an id stays; a null source is
a source of its own. Repeated rows are copies of each other: one stays. Ties go by doc_id, then by the hash of doc_id and text. Long texts stay whole in one row until packing cuts
their ids. Empty tables give empty results. All columns of ``documents`` are carried to the last stage, whatever their names but ``__pw_...``; that one returns pieces.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plainweave.llm import exact_dedup, mixing, packing, quality_rules, simhash
from plainweave.llm.common import documents, stored
from plainweave.llm.queries import labels, tokenizer

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the base rule or the learned decision list rejects."""
    return quality_rules.keep_good(docs, labels(spark, sf_dir))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of equal texts."""
    return exact_dedup.drop_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group linked by SimHash."""
    return simhash.drop_near_duplicates(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out documents so that each source meets its target."""
    return mixing.sample(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the tokens of all documents into sequences: one row per piece."""
    return packing.pack(docs, tokenizer())


STAGES: list[tuple[str, Stage]] = [("quality_rules", rules), ("exact_dedup", exact), ("simhash", near), ("mixing", mix), ("packing", pack)]

#: Learned rules, connected components and byte-pair ids are beyond SQL; tests/llm has brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, name)
    return docs
