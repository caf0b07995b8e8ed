"""Command line: ``python -m plainweave.cli COMMAND ...``.

texts2vectors, texts2concepts, concepts2info, concepts2graphs, graphs2vectors, texts2synLexVectors, printGraph.
Annotators, taggers and parsers are tables: mentions come from a gazetteer file (JSON lines: word, uri, types), tagged texts
and trees from folders of their own. Or they are services and programs: --annotator-ep, --sparql-ep, --parser and --tagger.
"""

from __future__ import annotations

import argparse
import shlex
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from plainweave.functions.namespaces import colour, qname
from plainweave.operators import graphs, kb, mentions
from plainweave.operators.ontology import Ontologies, subclass
from plainweave.plans.vectors import SemanticTransformer, concept_graphs, lengths_of, synlex_texts, synlex_vectors
from plainweave.sources import files, processes, remote
from plainweave.sources.rdf import read_triples
from plainweave.tables import stored


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="plainweave", description="Texts to complexity vectors.")
    sub = top.add_subparsers(dest="command", required=True)

    def command(name: str, *places: str, about: str) -> argparse.ArgumentParser:
        p = sub.add_parser(name, help=about)
        for place in places:
            p.add_argument(place)
        p.add_argument("-ei", "--extension", default=".json" if name.startswith(("concepts", "graphs", "print")) else ".txt", help="extension of the input files")
        p.add_argument("-f", "--force", action="store_true", help="write outputs again that are there already")
        return p

    def knowledge(p: argparse.ArgumentParser) -> None:
        p.add_argument("--triples", help="file or folder of triples")
        p.add_argument("--format", default="nt", choices=["nt", "n3", "turtle"])

    def connections(p: argparse.ArgumentParser) -> None:
        p.add_argument("-nc", "--num-cores", type=int, help="requests at a time; as many as there are tasks by default")

    def service(p: argparse.ArgumentParser) -> None:
        p.add_argument("-se", "--sparql-ep", help="SPARQL endpoint to ask for types and links instead of --triples")
        p.add_argument("-mc", "--max-concepts", type=int, default=100, help="most entities a query")
        p.add_argument("--nice-server", action=argparse.BooleanOptionalAction, default=True, help="wait up to a second before each group of queries")

    def each(p: argparse.ArgumentParser) -> None:
        p.add_argument("--each", action="store_true", help="a file a document instead of a line")

    def ontologies(p: argparse.ArgumentParser) -> None:
        p.add_argument("-on", "--ontologies", nargs="*", help="keys of the ontologies to use; all by default")

    for name, about in (("texts2vectors", "texts to semantic vectors"), ("texts2concepts", "texts to concepts")):
        p = command(name, "input", "output", about=about)
        names = p.add_mutually_exclusive_group(required=True)
        names.add_argument("--gazetteer", help="JSON lines with word, uri, types, and optionally similarity and support")
        names.add_argument("--annotator-ep", help="endpoint of a REST annotator")
        p.add_argument("--sparql", help="filter that the REST annotator applies")
        connections(p)
        each(p)
        p.add_argument("-co", "--confidence", type=float, default=0.5, help="least similarity of a mention")
        p.add_argument("--support", type=int, help="least support of a mention")
        p.add_argument("--types", nargs="*", help="types that a mention must have one of")
        p.add_argument("--policy", choices=["whitelist", "blacklist"], default="whitelist", help="blacklist: none of the types instead")
        if name == "texts2vectors":
            knowledge(p)
            ontologies(p)
            service(p)
            p.add_argument("--save-info")
            p.add_argument("--save-graphs")
    p = command("concepts2info", "input", "output", about="concepts to types and links")
    knowledge(p)
    service(p)
    connections(p)
    p = command("concepts2graphs", "input", "output", about="concepts to graphs")
    p.add_argument("-t", "--info", help="JSON of types and links")
    knowledge(p)
    ontologies(p)
    each(p)
    ontologies(command("graphs2vectors", "input", "output", about="graphs to semantic vectors"))
    p = command("texts2synLexVectors", "trees", "tagged", "output", about="trees and tagged texts to syntactic and lexical vectors")
    p.add_argument("-lex-type", "--lex-type", choices=["anc", "bnc"], default="bnc")
    p.add_argument("--word-list", required=True)
    p.add_argument("--parser", help="program that turns a text into trees; TREES is a folder of texts then")
    p.add_argument("--tagger", help="program that turns a text into word_TAG tokens; TAGGED is a folder of texts then")
    command("printGraph", "input", about="names and colours of the graphs' nodes, and their edges, a line each")
    return top


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(args)
    spark = spark or SparkSession.builder.appName(f"plainweave {a.command}").getOrCreate()
    chosen = Ontologies().only(getattr(a, "ontologies", None))

    def triples():
        from plainweave.sources.rdf import TRIPLES

        return read_triples(spark, a.triples, a.format) if getattr(a, "triples", None) else spark.createDataFrame([], TRIPLES)

    def annotator():
        if a.annotator_ep:
            return remote.rest_annotator(a.annotator_ep, a.confidence, a.support, ",".join(a.types) if a.types else None, a.sparql, a.policy if a.types or a.sparql else None, a.num_cores)
        if a.sparql:
            raise ValueError("--sparql needs --annotator-ep")
        names = spark.read.schema("word string, uri string, types array<string>, similarity double, support int").json(a.gazetteer)
        return mentions.gazetteer_table(names, confidence=a.confidence, support=a.support, types=a.types, policy=a.policy)

    def knowledge():
        return remote.sparql_info(a.sparql_ep, a.max_concepts, a.nice_server, a.num_cores) if a.sparql_ep else None

    def texts_for(program: str):
        return synlex_texts(files.read_texts(spark, program, a.extension))

    for place in ("input", "trees", "tagged", "gazetteer", "triples", "info", "word_list"):
        if getattr(a, place, None):
            files.readable(spark, getattr(a, place))
    if getattr(a, "output", None):
        files.writable(spark, a.output)

    if a.command == "texts2vectors":
        made = SemanticTransformer(annotator(), triples(), chosen, knowledge=knowledge())
        concepts = made.concepts(files.read_texts(spark, a.input, a.extension))
        concepts = stored(concepts, "concepts") if a.annotator_ep else concepts
        info = made.info(concepts)
        info = stored(info, "info") if a.sparql_ep else info
        if a.save_info:
            files.write_info(info, a.save_info)
        if a.save_graphs:
            nodes, links = concept_graphs(concepts, info, subclass(triples()), chosen.namespaces())
            files.write_graphs(nodes, links, lengths_of(concepts), a.save_graphs, True, a.each)
        files.write_vectors(made.vectors(concepts, info), a.output)
    elif a.command == "texts2concepts":
        docs = files.read_texts(spark, a.input, a.extension)
        docs = docs if a.force else files.skip_existing(docs, a.output)
        files.write_concepts(mentions.text_concepts(docs, annotator()), a.output, a.force, a.each)
    elif a.command == "concepts2info":
        uris, asked = files.concept_uris(spark, a.input, a.extension), knowledge()
        files.write_info(asked(uris) if asked else kb.concept_info(uris, triples()), a.output)
    elif a.command == "concepts2graphs":
        concepts = files.read_concepts(spark, a.input, a.extension)
        concepts = concepts if a.force else files.skip_existing(concepts, a.output)
        nodes, links = concept_graphs(concepts, files.read_info(spark, a.info) if a.info else None, subclass(triples()), chosen.namespaces())
        files.write_graphs(nodes, links, lengths_of(concepts), a.output, a.force, a.each)
    elif a.command == "graphs2vectors":
        nodes, links, lengths = files.read_graphs(spark, a.input, a.extension)
        files.write_vectors(graphs.semantic_vectors(nodes, links, lengths, chosen.namespaces()), a.output)
    elif a.command == "texts2synLexVectors":
        words = (files.read_bnc if a.lex_type == "bnc" else files.read_anc)(spark, a.word_list)
        trees = processes.parse_texts(texts_for(a.trees), shlex.split(a.parser)) if a.parser else files.read_trees(spark, a.trees, a.extension)
        tagged = processes.tag_texts(texts_for(a.tagged), shlex.split(a.tagger)) if a.tagger else files.read_tagged(spark, a.tagged, a.extension)
        files.write_vectors(synlex_vectors(trees, tagged, words), a.output)
    else:
        nodes, links, _ = files.read_graphs(spark, a.input, a.extension)
        name, end = qname(F.col("id")), qname(F.col("dst"))
        rows = nodes.select("filename", F.lit("node").alias("kind"), name.alias("a"), colour(name).alias("b"))
        rows = rows.unionByName(links.select("filename", F.lit("edge").alias("kind"), qname(F.col("src")).alias("a"), end.alias("b")))
        for r in rows.orderBy("filename", F.desc("kind"), "a", "b").toLocalIterator():
            print(r["filename"], r["kind"], r["a"], r["b"], sep="\t")
    return 0


if __name__ == "__main__":
    sys.exit(main())
