"""Structured Streaming over folders of texts: counts as files arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plainweave.functions.text import key_of_path, nb_words, paragraphs


def stream_texts(spark: SparkSession, path: str, extension: str = ".txt", files_per_trigger: int = 1000) -> DataFrame:
    """(filename, text) of the files that come into a folder."""
    rows = spark.readStream.schema("value string").option("maxFilesPerTrigger", files_per_trigger).text(path, wholetext=True, pathGlobFilter=f"*{extension}")
    return rows.select(key_of_path(F.col("_metadata.file_name")).alias("filename"), F.col("value").alias("text"))


def count_stream(docs: DataFrame) -> DataFrame:
    """(filename, n_paragraphs, nb_words) without state: each file is complete when it arrives."""
    parts = paragraphs(F.col("text"))
    return docs.select("filename", F.size(parts).cast("long").alias("n_paragraphs"), nb_words(parts).alias("nb_words"))
