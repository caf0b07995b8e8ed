"""Parsers and taggers as programs of one's own: a text goes to a program's input, its output is the result.

The programs must be there on every worker. A program is started once a text, in the task that holds it; one that fails ends the task, which Spark tries again.
"""

from __future__ import annotations

import glob
import os
import subprocess
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from plainweave.sources.files import tagged_tokens


def java(classpath: str, main_class: str, memory: int, *args: str) -> list[str]:
    """The command of a Java program with ``memory`` MB."""
    if not isinstance(memory, int) or memory <= 0:
        raise ValueError("memory must be a whole number above 0")
    return ["java", f"-mx{memory}m", "-cp", classpath, main_class, *args]


def parser_command(folder: str, memory: int = 3000) -> list[str]:
    """SC18: the command of the PCFG parser in ``folder``, Penn trees out."""
    return java(os.path.join(folder, "*"), "edu.stanford.nlp.parser.lexparser.LexicalizedParser", memory, "-outputFormat", "penn", "edu/stanford/nlp/models/lexparser/englishPCFG.ser.gz", "/dev/stdin")


def tagger_models(folder: str) -> list[str]:
    """SC17: the names of the tagger models in ``folder``."""
    return sorted(os.path.basename(p).removesuffix(".tagger") for p in glob.glob(os.path.join(glob.escape(folder), "models", "*.tagger")))


def tagger_command(folder: str, model: str = "english-left3words-distsim", memory: int = 300) -> list[str]:
    """SC16: the command of the part-of-speech tagger in ``folder``; a model that isn't there is an error."""
    if model not in tagger_models(folder):
        raise ValueError(f"no tagger model {model}")
    return java(os.path.join(folder, "stanford-postagger.jar"), "edu.stanford.nlp.tagger.maxent.MaxentTagger", memory, "-model", os.path.join(folder, "models", f"{model}.tagger"))


def piped(docs: DataFrame, command: list[str], key: str = "filename") -> DataFrame:
    """(key, text), what ``command`` writes for each text that it reads; null for a null text."""

    def output(text: str | None) -> str | None:
        if text is None:
            return None
        done = subprocess.run(command, input=text.encode(), stdout=subprocess.PIPE, stderr=subprocess.DEVNULL, check=True)
        return done.stdout.decode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([output(t) for t in batch.column(1).to_pylist()], pa.string())], names=[key, "text"])

    rows = docs.select(key, "text")
    return rows.mapInArrow(run, rows.schema)


def parse_texts(docs: DataFrame, command: list[str], key: str = "filename") -> DataFrame:
    """SC18: (key, tree) from texts."""
    return piped(docs, command, key).withColumnRenamed("text", "tree")


def tag_texts(docs: DataFrame, command: list[str], key: str = "filename") -> DataFrame:
    """SC16: (key, idx, word, pos) from texts."""
    return tagged_tokens(piped(docs, command, key), key)
