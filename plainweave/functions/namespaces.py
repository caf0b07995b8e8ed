"""References and ontology namespaces as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The node above all classes without parents. Fixed value.
ROOT = "#AbstractConcept#"

#: (key, namespace) in order of registration. Fixed values.
NAMESPACES: tuple[tuple[str, str], ...] = (
    ("DBPedia", "http://dbpedia.org/ontology/"),
    ("Schema", "http://schema.org/"),
    ("yago", "http://dbpedia.org/class/yago/"),
)

#: Colours for display, by the text before the first colon of a name. Fixed values.
COLOURS = {"DBPedia": "red", "Schema": "blue", "yago": "purple", "ROOT": "black"}
DEFAULT_COLOUR = "green"

Namespaces = tuple[tuple[str, str], ...]


def suffix_in(ref: Column, key: str, uri: str) -> Column:
    """PF12: what follows ``key:`` or the namespace in ``ref``; null if neither starts it."""
    name = F.lit(f"{key}:")
    return F.when(F.startswith(ref, name), F.substr(ref, F.lit(len(key) + 2))).when(F.startswith(ref, F.lit(uri)), F.substr(ref, F.lit(len(uri) + 1)))


def managed_uri(ref: Column, namespaces: Namespaces = NAMESPACES) -> Column:
    """PF13: ``ref`` as a URI of the namespace that leaves the shortest suffix, the earlier one of equals; null if none fits."""
    if not namespaces:
        return F.lit(None).cast("string")
    options = []
    for k, (key, uri) in enumerate(namespaces):
        suffix = suffix_in(ref, key, uri)
        options.append(F.when(suffix.isNotNull(), F.struct(F.length(suffix).alias("n"), F.lit(k).alias("k"), F.concat(F.lit(uri), suffix).alias("uri"))))
    return F.array_min(F.filter(F.array(*options), lambda x: x.isNotNull()))["uri"]


def is_managed(ref: Column, namespaces: Namespaces = NAMESPACES) -> Column:
    """PF14: whether any namespace fits."""
    return F.coalesce(managed_uri(ref, namespaces).isNotNull(), F.lit(False))


def in_namespace(node: Column, uri: str) -> Column:
    """PF15: whether a node's URI starts with the namespace."""
    return F.startswith(node, F.lit(uri))


def qname(uri: Column, namespaces: Namespaces = NAMESPACES) -> Column:
    """PF18: a short name for display: ``key:suffix``, the key alone, or the last part of the path."""
    options = []
    for k, (key, space) in enumerate((*namespaces, ("ROOT", ROOT))):
        rest = F.substr(uri, F.lit(len(space) + 1))
        name = F.when(rest == "", F.lit(key)).otherwise(F.concat(F.lit(key + ":"), rest))
        options.append(F.when(F.startswith(uri, F.lit(space)), F.struct(F.length(rest).alias("n"), F.lit(k).alias("k"), name.alias("name"))))
    best = F.array_min(F.filter(F.array(*options), lambda x: x.isNotNull()))["name"]
    return F.coalesce(best, F.element_at(F.split(uri, "/"), -1))


def colour(name: Column) -> Column:
    """PF19: the colour of a display name."""
    pairs = [F.lit(x) for pair in COLOURS.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.split(name, ":", 2)[0]), F.lit(DEFAULT_COLOUR))
