"""From texts to semantic vectors, and from trees and tags to syntactic and lexical ones, as functions and transformers."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plainweave.functions.namespaces import NAMESPACES, Namespaces
from plainweave.functions.text import PARAGRAPH_THRESHOLD, join_paragraphs, paragraphs
from plainweave.operators import graphs, kb, lexical, mentions, syntactic
from plainweave.operators.ontology import Ontologies, subclass
from plainweave.sources.remote import rest_annotator, sparql_info
from plainweave.tables import stored

#: A feature of one's own: (vertices, edges) to one row per document.
FeaturePlugin = Callable[[DataFrame, DataFrame], DataFrame]


def lengths_of(concepts: DataFrame, key: str = "filename") -> DataFrame:
    return concepts.select(key, F.col("nbWords").cast("long").alias("nbWord"))


def concept_graphs(concepts: DataFrame, info: DataFrame | None, taxonomy: DataFrame, namespaces: Namespaces = NAMESPACES, key: str = "filename") -> tuple[DataFrame, DataFrame]:
    """(vertices, edges) of all documents' graphs."""
    found = stored(graphs.resources(mentions.mention_counts(mentions.explode_concepts(concepts, key), key), info, key), "resources")
    return graphs.built(found, taxonomy, namespaces, key)


@dataclass
class SemanticTransformer:
    """Texts (key, text) to semantic vectors, with an annotator, a table of triples, and the ontologies among them."""

    annotate: mentions.Annotator
    triples: DataFrame
    ontologies: Ontologies = field(default_factory=Ontologies)
    threshold: int = PARAGRAPH_THRESHOLD
    key: str = "filename"
    plugins: list[FeaturePlugin] = field(default_factory=list)
    #: Asked for types and links instead of ``triples``: from (uri) to the columns of ``kb.concept_info``.
    knowledge: Callable[[DataFrame], DataFrame] | None = None

    def feature_names(self) -> list[str]:
        return graphs.feature_names(self.ontologies.namespaces())

    def concepts(self, docs: DataFrame) -> DataFrame:
        return mentions.text_concepts(docs, self.annotate, self.key, self.threshold)

    def info(self, concepts: DataFrame) -> DataFrame:
        uris = mentions.explode_concepts(concepts, self.key)
        return self.knowledge(uris) if self.knowledge else kb.concept_info(uris, self.triples)

    def transform(self, docs: DataFrame) -> DataFrame:
        concepts = stored(self.concepts(docs), "concepts")
        info = self.info(concepts)
        return self.vectors(concepts, stored(info, "info") if self.knowledge else info)

    def vectors(self, concepts: DataFrame, info: DataFrame | None) -> DataFrame:
        spaces = self.ontologies.namespaces()
        nodes, links = concept_graphs(concepts, info, subclass(self.triples), spaces, self.key)
        out = graphs.semantic_vectors(nodes, links, lengths_of(concepts, self.key), spaces, self.key)
        for plugin in self.plugins:
            out = out.join(plugin(nodes, links), self.key, "left")
        return out


def default_semantic_transformer(annotator_endpoint: str, confidence: float, sparql_endpoint: str, taxonomy: DataFrame, connections: int = 1) -> SemanticTransformer:
    """A transformer over two services, with all ontologies and 100 entities a query; the classes above are in ``taxonomy``, triples as ``read_triples`` gives them."""
    annotate = rest_annotator(annotator_endpoint, confidence, connections=connections)
    return SemanticTransformer(annotate, taxonomy, knowledge=sparql_info(sparql_endpoint, 100, True, connections))


@dataclass
class SyntacticTransformer:
    """(key, tree) to syntactic vectors."""

    key: str = "filename"

    def feature_names(self) -> list[str]:
        return list(syntactic.FEATURES)

    def transform(self, trees: DataFrame) -> DataFrame:
        return syntactic.syntactic_vectors(trees, self.key)


@dataclass
class LexicalTransformer:
    """Tagged tokens to lexical vectors, with a word list as ``read_bnc`` or ``read_anc`` make them."""

    word_list: DataFrame
    rank_limit: int = 2000
    sample_size: int = 50
    key: str = "filename"

    def feature_names(self) -> list[str]:
        return list(lexical.FEATURES)

    def transform(self, tagged: DataFrame) -> DataFrame:
        return lexical.lexical_vectors(tagged, self.word_list, self.key, self.rank_limit, self.sample_size)


def synlex_texts(docs: DataFrame, key: str = "filename", threshold: int = PARAGRAPH_THRESHOLD) -> DataFrame:
    """PF8: what goes to a parser and a tagger: the kept paragraphs of each text, one a line."""
    return docs.select(key, join_paragraphs(paragraphs(F.col("text"), threshold)).alias("text"))


def synlex_vectors(trees: DataFrame, tagged: DataFrame, word_list: DataFrame, key: str = "filename") -> DataFrame:
    """The key and 57 features: the syntactic ones, then the lexical ones."""
    return SyntacticTransformer(key).transform(trees).join(LexicalTransformer(word_list, key=key).transform(tagged), key, "full")
