"""Knowledge-base queries over a table of triples (s, p, o, o_kind: iri, bnode or literal)."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RDF_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
SUBCLASS_OF = "http://www.w3.org/2000/01/rdf-schema#subClassOf"


def among(rows: DataFrame, column: str, uris: DataFrame | None) -> DataFrame:
    """PF17: the rows whose ``column`` is one of ``uris`` (uri); all rows without a list."""
    return rows if uris is None else rows.join(uris.select(F.col("uri").alias(column)).distinct(), column, "left_semi")


def distinct_uris(mentions: DataFrame) -> DataFrame:
    """A1: each URI once."""
    return mentions.select("uri").distinct()


def entity_types(triples: DataFrame, uris: DataFrame | None = None) -> DataFrame:
    """A2, PF16, PF26: (uri, types), the sorted set of the IRIs that an entity has as types."""
    typed = triples.filter((F.col("p") == RDF_TYPE) & (F.col("o_kind") == "iri")).select(F.col("s").alias("uri"), "o").distinct()
    return among(typed.groupBy("uri").agg(F.array_sort(F.collect_list("o")).alias("types")), "uri", uris)


def links_in(triples: DataFrame, uris: DataFrame | None = None) -> DataFrame:
    """A3: (uri, nb_links_in), over all predicates and repeated statements."""
    ends = triples.filter(F.col("o_kind") != "literal").select(F.col("o").alias("uri"))
    return among(ends.groupBy("uri").agg(F.count("*").alias("nb_links_in")), "uri", uris)


def links_out(triples: DataFrame, uris: DataFrame | None = None) -> DataFrame:
    """A4: (uri, nb_links_out), over all predicates and kinds of object."""
    return among(triples.groupBy(F.col("s").alias("uri")).agg(F.count("*").alias("nb_links_out")), "uri", uris)


def concept_info(uris: DataFrame, triples: DataFrame) -> DataFrame:
    """(uri, types, nb_links_in, nb_links_out) for each of ``uris``; no type is an empty array, no link 0.

    Both link counts come from one pass over the triples and one shuffle of sums by URI; a hub's triples are summed in their tasks,
    and only one row of a URI is joined. Ends that no wanted URI can equal, by what stands before its last slash, are passed over where they are read.
    """
    triples = triples.select("s", "p", "o", "o_kind")
    wanted = _beginnings(uris)
    own, other = wanted(F.col("s")), wanted(F.col("o"))
    linked = other & (F.col("o_kind") != "literal")
    ends = F.array(F.when(own, F.struct(F.col("s").alias("uri"), F.lit(False).alias("incoming"))), F.when(linked, F.struct(F.col("o").alias("uri"), F.lit(True).alias("incoming"))))
    each = triples.filter(own | linked).select(F.explode(ends).alias("e")).filter("e IS NOT NULL").select("e.uri", "e.incoming")
    links = each.groupBy("uri").agg(F.count_if("incoming").alias("nb_links_in"), F.count_if(~F.col("incoming")).alias("nb_links_out"))
    out = distinct_uris(uris).join(links, "uri", "left").join(entity_types(triples.filter(own)), "uri", "left")
    zero = F.lit(0).cast("long")
    return out.select("uri", F.coalesce("types", F.array().cast("array<string>")).alias("types"), F.coalesce("nb_links_in", zero).alias("nb_links_in"), F.coalesce("nb_links_out", zero).alias("nb_links_out"))


def _beginnings(uris: DataFrame, most: int = 100) -> Callable[[Column], Column]:
    """Whether a term begins like one of ``uris`` (uri) up to its last slash; always true if they begin in more than ``most`` ways."""
    name = F.length(F.substring_index("uri", "/", -1))
    found = [r[0] for r in uris.select(F.left("uri", F.length("uri") - name).alias("b")).filter("b IS NOT NULL").distinct().limit(most + 1).collect()]
    if len(found) > most:
        return lambda term: F.lit(True)
    return lambda term: reduce(lambda a, b: a | b, [F.startswith(term, F.lit(b)) for b in found], F.lit(False))


def number_of_types(info: DataFrame) -> DataFrame:
    """A5: all types of all entities, counted."""
    return info.agg(F.coalesce(F.sum(F.size("types")), F.lit(0)).cast("long").alias("nb_types"))


def page(rows: DataFrame, order: list[str], offset: int, limit: int) -> DataFrame:
    """O2, O3: a page of ``rows`` in the given order."""
    return rows.orderBy(*order).offset(offset).limit(limit)
