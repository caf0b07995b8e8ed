"""Triples from N-Triples and Turtle."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plainweave.operators.kb import RDF_TYPE

TRIPLES = "s string, p string, o string, o_kind string"
_LINE = r'^\s*(<[^>]*>|_:\S+)\s+<([^>]*)>\s+(<[^>]*>|_:\S+|".*"\S*)\s*\.\s*(?:#.*)?$'


def _decoded(iri: Column) -> Column:
    """An IRI with its ``\\uXXXX`` and ``\\UXXXXXXXX`` as characters."""

    def of(c: Column, mark: str, digits: int) -> Column:
        parts = F.split(c, r"\\" + mark + f"(?=[0-9A-Fa-f]{{{digits}}})")
        code = lambda x: F.decode(F.unhex(F.lpad(F.substring(x, 1, digits), 8, "0")), "UTF-32")
        rest = F.transform(F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1))), lambda x: F.concat(code(x), F.substring(x, digits + 1, 1 << 30)))
        return F.concat(F.element_at(parts, 1), F.array_join(rest, ""))

    return F.when(F.contains(iri, F.lit("\\")), of(of(iri, "u", 4), "U", 8)).otherwise(iri)


def read_ntriples(spark: SparkSession, path: str) -> DataFrame:
    """SC9: (s, p, o, o_kind), a triple a line, with built-in functions; other lines are left out, literals stay as they are written."""
    rows = spark.read.text(path)
    s, p, o = (F.regexp_extract("value", _LINE, k) for k in (1, 2, 3))
    iri = lambda c: F.when(F.startswith(c, F.lit("<")), _decoded(F.substr(c, F.lit(2), F.length(c) - 2))).otherwise(c)
    literal = F.startswith("o", F.lit('"'))
    kind = F.when(literal, F.lit("literal")).when(F.startswith("o", F.lit("_:")), F.lit("bnode")).otherwise(F.lit("iri"))
    # As an array's only element, so that the filter doesn't take the line apart again.
    found = rows.select(F.explode(F.array(F.struct(s.alias("s"), p.alias("p"), o.alias("o")))).alias("t")).select("t.*").filter("p <> ''")
    text = F.substr("o", F.lit(2), F.length("o") - F.length(F.substring_index("o", '"', -1)) - 2)
    return found.select(iri(F.col("s")).alias("s"), _decoded(F.col("p")).alias("p"), F.when(literal, text).otherwise(iri(F.col("o"))).alias("o"), kind.alias("o_kind"))


_TOKEN = re.compile(
    r"""#[^\n]*|<[^>\s]*>|"{3}(?:[^"\\]|\\.|"(?!""))*"{3}|'{3}(?:[^'\\]|\\.|'(?!''))*'{3}|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'"""
    r"""|\^\^|@[A-Za-z-]+|[\[\]()]|[;,.](?=\s|$)|(?:\\.|[^\s;,<>"'()\[\]\\])+(?<!\.)|\S""",
    re.DOTALL,
)
_ESCAPE = re.compile(r"\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})")
FIRST, REST, NIL = ("http://www.w3.org/1999/02/22-rdf-syntax-ns#" + x for x in ("first", "rest", "nil"))


def _iri(text: str) -> str:
    return _ESCAPE.sub(lambda m: chr(int(m[1] or m[2], 16)), text)


class _Turtle:
    """The tokens of a Turtle text, read statement by statement; a term that is itself made of triples adds these to ``out``."""

    def __init__(self, text: str) -> None:
        self.tokens = [t for t in _TOKEN.findall(text) if not t.startswith("#")]
        self.at, self.made, self.base = 0, 0, ""
        self.prefixes: dict[str, str] = {}
        self.out: list[tuple[str, str, str, str]] = []

    def peek(self) -> str:
        return self.tokens[self.at] if self.at < len(self.tokens) else ""

    def take(self) -> str:
        token = self.peek()
        self.at += 1
        return token

    def blank(self) -> str:
        self.made += 1
        return f"_:made{self.made}"

    def term(self) -> tuple[str, str]:
        t = self.take()
        if t == "[":
            node = self.blank()
            self.verbs(node, "]")
            self.take()
            return node, "bnode"
        if t == "(":
            return self.collection()
        if t.startswith("<"):
            iri = _iri(t[1:-1])
            return (iri if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", iri) else self.base + iri), "iri"
        if t.startswith("_:"):
            return t, "bnode"
        if t[:1] in ('"', "'"):
            quotes = 3 if len(t) >= 6 and t[:3] == t[0] * 3 else 1
            if self.peek() == "^^":
                self.at += 2
            elif self.peek().startswith("@"):
                self.at += 1
            return t[quotes:-quotes], "literal"
        if t == "a":
            return RDF_TYPE, "iri"
        head, colon, tail = t.partition(":")
        return (self.prefixes[head] + re.sub(r"\\(.)", r"\1", tail), "iri") if colon and head in self.prefixes else (t, "literal")

    def collection(self) -> tuple[str, str]:
        first = last = None
        while self.peek() not in (")", ""):
            item, node = self.term(), self.blank()
            if last is None:
                first = node
            else:
                self.out.append((last, REST, node, "bnode"))
            self.out.append((node, FIRST, *item))
            last = node
        self.take()
        if last is None:
            return NIL, "iri"
        self.out.append((last, REST, NIL, "iri"))
        return first, "bnode"

    def verbs(self, subject: str, end: str) -> None:
        """``verb object , object ; verb object``, up to ``end``, which is left."""
        while self.peek() not in (end, ""):
            if self.peek() == ";":
                self.take()
                continue
            verb = self.term()[0]
            while True:
                value = self.term()
                self.out.append((subject, verb, *value))
                if self.peek() != ",":
                    break
                self.take()

    def statement(self) -> None:
        word = self.peek().lower()
        if word in ("@prefix", "prefix"):
            self.take()
            name = self.take().removesuffix(":")
            self.prefixes[name] = self.term()[0]
        elif word in ("@base", "base"):
            self.take()
            self.base = self.term()[0]
        elif word != ".":
            self.verbs(self.term()[0], ".")
        if self.peek() == ".":
            self.take()


def turtle_triples(text: str) -> Iterator[tuple[str, str, str, str]]:
    """The triples of a Turtle text with prefixes, base, ``a``, ``;``, ``,``, nested blank nodes and collections. Literals stay as they are written."""
    read = _Turtle(text)
    while read.peek():
        read.statement()
        yield from read.out
        read.out.clear()


def read_turtle(spark: SparkSession, path: str) -> DataFrame:
    """SC10: the triples of Turtle files. A file's prefixes hold for all of it, so a file is read by one task; big ontologies are better given as N-Triples."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for text in frame["value"]:
                yield pd.DataFrame(list(turtle_triples(text)), columns=["s", "p", "o", "o_kind"])

    return spark.read.text(path, wholetext=True).mapInPandas(run, TRIPLES)


def read_triples(spark: SparkSession, path: str, file_format: str = "nt") -> DataFrame:
    """A file or folder of triples: ``nt``, or ``n3`` and ``turtle``."""
    if file_format not in ("nt", "n3", "ttl", "turtle"):
        raise ValueError(f"unknown format {file_format}")
    return read_ntriples(spark, path) if file_format == "nt" else read_turtle(spark, path)
