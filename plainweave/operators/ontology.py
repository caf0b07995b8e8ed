"""Class taxonomies: parents with a default root, the ancestor closure, and the set of managed ontologies."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plainweave.functions.namespaces import NAMESPACES, ROOT
from plainweave.operators.kb import SUBCLASS_OF
from plainweave.tables import stored


def subclass(triples: DataFrame, within: str | None = None) -> DataFrame:
    """(cls, parent) of all ``rdfs:subClassOf`` triples; ``within``: IRIs of that namespace only as parents."""
    rows = triples.filter(F.col("p") == SUBCLASS_OF)
    if within is not None:
        rows = rows.filter((F.col("o_kind") == "iri") & F.startswith("o", F.lit(within)))
    return rows.select(F.col("s").alias("cls"), F.col("o").alias("parent")).distinct()


def parents(classes: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """(cls, parent) of each of ``classes`` (cls); the root where there is none."""
    return classes.select("cls").distinct().join(taxonomy, "cls", "left").select("cls", F.coalesce("parent", F.lit(ROOT)).alias("parent"))


def ancestors(classes: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """(cls, child, parent), all edges on the ways from a class up to the root.

    A fixpoint by rounds of joins, as many as the taxonomy is deep: each class goes on from nodes it has not seen only, so cycles and
    diamonds end. A round is a table in the shared folder.
    """
    starts = classes.select("cls").filter(F.col("cls") != ROOT).distinct()
    frontier = stored(starts.select("cls", F.col("cls").alias("node")), "frontier")
    seen = frontier
    up = taxonomy.select(F.col("cls").alias("node"), "parent")
    while not frontier.isEmpty():
        further = frontier.join(up, "node").select("cls", F.col("parent").alias("node")).distinct()
        frontier = stored(further.join(seen, ["cls", "node"], "left_anti"), "frontier")
        seen = seen.unionByName(frontier)
    edges = seen.join(up, "node", "left")
    return edges.select("cls", F.col("node").alias("child"), F.coalesce("parent", F.lit(ROOT)).alias("parent"))


@dataclass
class Ontologies:
    """The managed ontologies by key, each a namespace and a file of triples. Adding to one gives a new value."""

    spaces: dict[str, tuple[str, str | None, str]] = field(default_factory=lambda: {k: (u, None, "nt") for k, u in NAMESPACES})

    @classmethod
    def empty(cls) -> Ontologies:
        return cls({})

    def add(self, key: str, uri: str, path: str | None = None, file_format: str = "nt") -> Ontologies:
        return Ontologies({**self.spaces, key: (uri, path, file_format)})

    def remove(self, key: str) -> Ontologies:
        return Ontologies({k: v for k, v in self.spaces.items() if k != key})

    def only(self, keys: list[str] | None) -> Ontologies:
        """SC11: the ontologies of some keys; all without keys. An unknown key is an error."""
        return self if not keys else Ontologies({k: self.spaces[k] for k in keys})

    def keys(self) -> list[str]:
        return list(self.spaces)

    def namespace(self, key: str) -> str | None:
        return self.spaces[key][0] if key in self.spaces else None

    def namespaces(self) -> tuple[tuple[str, str], ...]:
        return tuple((k, v[0]) for k, v in self.spaces.items())

    @staticmethod
    def root() -> str:
        return ROOT

    def triples(self, spark: SparkSession) -> DataFrame:
        """The union of the ontologies' files as a set of triples."""
        from plainweave.sources.rdf import TRIPLES, read_triples

        out = spark.createDataFrame([], TRIPLES)
        for _, path, file_format in self.spaces.values():
            if path is not None:
                out = out.unionByName(read_triples(spark, path, file_format))
        return out.distinct()
