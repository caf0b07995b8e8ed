"""Annotators and knowledge bases behind HTTP: optional, the tables of the other modules need no network.

Requests are made by the tasks, ``connections`` of them at a time at most if it is given. A request that fails is tried again; what still
fails is a paragraph that could not be annotated (null), or ends the task for a knowledge base, since missing links would be wrong counts.
"""

from __future__ import annotations

import json
import random
import re
import time
from collections.abc import Callable, Iterator
from urllib.error import HTTPError, URLError
from urllib.parse import urlencode
from urllib.request import Request, urlopen

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from plainweave.operators.kb import distinct_uris
from plainweave.operators.mentions import RESOURCE, Annotator, parse_response

#: Longer query strings go in the body of a POST, as servers refuse them in a URL.
LONGEST_QUERY = 4000
_PAGED = "x-sparql-maxrows"
_NO_IRI = re.compile(r'[\x00-\x20<>"{}|\\^`]')

_TYPES = "SELECT ?subject ?type WHERE {{ ?subject a ?type . FILTER(?subject IN ({iris})) FILTER isIRI(?type) }} ORDER BY ?subject ?type"
_LINKS_IN = "SELECT ?subject (COUNT(?other) AS ?n) WHERE {{ ?other ?p ?subject . FILTER(?subject IN ({iris})) }} GROUP BY ?subject"
_LINKS_OUT = "SELECT ?subject (COUNT(?other) AS ?n) WHERE {{ ?subject ?p ?other . FILTER(?subject IN ({iris})) }} GROUP BY ?subject"


def ask(endpoint: str, params: dict[str, object], accept: str = "application/json", attempts: int = 3, timeout: float = 60) -> tuple[str, dict[str, str]]:
    """The body and headers of the answer to ``params`` (those that are None are left out)."""
    query = urlencode({k: v for k, v in params.items() if v is not None})
    if len(query) > LONGEST_QUERY:
        request = Request(endpoint, query.encode(), {"Accept": accept, "Content-Type": "application/x-www-form-urlencoded"})
    else:
        request = Request(f"{endpoint}?{query}", headers={"Accept": accept})
    for left in reversed(range(attempts)):
        try:
            with urlopen(request, timeout=timeout) as answer:
                return answer.read().decode(), {k.lower(): v for k, v in answer.headers.items()}
        except (URLError, TimeoutError) as e:
            refused = isinstance(e, HTTPError) and 400 <= e.code < 500 and e.code != 429
            if refused or not left:
                raise
            time.sleep(2.0 ** (attempts - left - 1))
    raise ValueError("attempts must be 1 or more")


def rest_annotator(
    endpoint: str, confidence: float | None = 0.5, support: int | None = None, types: str | None = None, sparql: str | None = None, policy: str | None = None,
    connections: int | None = None, attempts: int = 3, timeout: float = 60,
) -> Annotator:
    """SC14, PF25: an annotator that asks a REST service for each paragraph; the service applies the filters."""
    params = {"confidence": confidence, "support": support, "types": types, "sparql": sparql, "policy": policy}

    def answer(text: str | None) -> str | None:
        try:
            return ask(endpoint, {"text": text or "", **params}, attempts=attempts, timeout=timeout)[0]
        except OSError:
            return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies = pa.array([answer(t) for t in batch.column("text").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, bodies], names=[*batch.schema.names, "__pw_body"])

    def annotate(parts: DataFrame) -> DataFrame:
        asked = parts.repartition(connections) if connections else parts
        schema = StructType([*parts.schema.fields, StructField("__pw_body", StringType())])
        body = F.col("__pw_body")
        return asked.mapInArrow(run, schema).withColumn("resources", F.when(body.isNotNull(), parse_response(body)).cast(f"array<{RESOURCE}>")).drop("__pw_body")

    return annotate


def select(endpoint: str, query: str, attempts: int = 3, timeout: float = 60) -> Iterator[dict[str, str]]:
    """SC15, O3: the rows of a SPARQL SELECT, page by page as long as the server says that it has cut the result."""
    offset = 0
    while True:
        body, headers = ask(endpoint, {"query": f"{query} OFFSET {offset}", "format": "json"}, "application/sparql-results+json", attempts, timeout)
        page = json.loads(body)["results"]["bindings"]
        for row in page:
            yield {k: v["value"] for k, v in row.items()}
        offset += len(page)
        if not page or _PAGED not in headers:
            return


def _groups(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[list[str]]:
    """The URIs of a task in lists of ``size``."""
    held: list[str] = []
    for batch in batches:
        held += batch.column(0).to_pylist()
        while len(held) >= size:
            yield held[:size]
            held = held[size:]
    if held:
        yield held


def sparql_info(endpoint: str, max_entities: int = 100, nice: bool = True, connections: int | None = None, attempts: int = 3, timeout: float = 60) -> Callable[[DataFrame], DataFrame]:
    """From (uri) to (uri, types, nb_links_in, nb_links_out) as ``kb.concept_info``, ``max_entities`` URIs a query.

    ``nice``: waits up to a second before each group of queries. What is no IRI is not asked for: no types, no links.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for uris in _groups(batches, max_entities):
            types: dict[str, set[str]] = {u: set() for u in uris}
            counts = [dict.fromkeys(uris, 0), dict.fromkeys(uris, 0)]
            iris = ", ".join(f"<{u}>" for u in uris if not _NO_IRI.search(u))
            if iris:
                if nice:
                    time.sleep(random.random())
                for row in select(endpoint, _TYPES.format(iris=iris), attempts, timeout):
                    types.setdefault(row["subject"], set()).add(row["type"])
                for count, query in zip(counts, (_LINKS_IN, _LINKS_OUT), strict=True):
                    for row in select(endpoint, query.format(iris=iris), attempts, timeout):
                        count[row["subject"]] = int(row["n"])
            columns = [uris, [sorted(types[u]) for u in uris], [counts[0][u] for u in uris], [counts[1][u] for u in uris]]
            kinds = [pa.string(), pa.list_(pa.string()), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["uri", "types", "nb_links_in", "nb_links_out"])

    def info(uris: DataFrame) -> DataFrame:
        once = distinct_uris(uris).filter("uri IS NOT NULL")
        once = once.repartition(connections) if connections else once
        return once.mapInArrow(run, "uri string, types array<string>, nb_links_in long, nb_links_out long")

    return info
