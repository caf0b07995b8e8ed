"""Readers and writers of text, JSON and CSV files, through Spark only, so that any file system Spark reads will do."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from plainweave.functions.text import key_of_path, output_name
from plainweave.operators.graphs import rows_of
from plainweave.operators.lexical import split_tags
from plainweave.operators.mentions import RESOURCE
from plainweave.tables import stored

CONCEPTS = f"concepts array<{RESOURCE}>, nbWords int"
INFO = "map<string,struct<concept_iri:string,types:array<string>,nb_links_in:string,nb_links_out:string>>"
GRAPH = "directed boolean, multigraph boolean, graph struct<nb_words:int>, nodes array<struct<id:string,resource:boolean,count:bigint,offset:bigint,nbTypes:bigint,nbLinksIn:string,nbLinksOut:string>>, links array<struct<source:string,target:string>>"


#: Files of this name hold a document a line, as Spark's writers leave them; all others are one document each.
_PART = "part-%"


def _whole(spark: SparkSession, path: str, extension: str, but_parts: bool = False) -> DataFrame:
    """(filename, text), a row per file; ``but_parts``: without files of a document a line, which are not even opened."""
    rows = spark.read.text(path, wholetext=True, pathGlobFilter=f"*{extension}")
    rows = rows.filter(~F.col("_metadata.file_name").like(_PART)) if but_parts else rows
    return rows.select(key_of_path(F.col("_metadata.file_name")).alias("filename"), F.col("value").alias("text"))


def read_texts(spark: SparkSession, path: str, extension: str = ".txt") -> DataFrame:
    """SC1, SC2, SC4: (filename, text), a row per file of one folder."""
    return _whole(spark, path, extension)


def texts(spark: SparkSession, items: list[str]) -> DataFrame:
    """SC3: texts in memory, named by their number."""
    return spark.createDataFrame([(str(i), t) for i, t in enumerate(items)], "filename string, text string")


def read_concepts(spark: SparkSession, path: str, extension: str = ".json") -> DataFrame:
    """SC5: (filename, concepts, nbWords), a document per file, or a line per document with its filename as ``write_concepts`` leaves it."""
    schema = StructType.fromDDL(f"filename string, {CONCEPTS}")
    rows = spark.read.schema(schema).json(path, multiLine=False, pathGlobFilter=f"part-*{extension}")
    whole = _whole(spark, path, extension, True)
    parsed = whole.select("filename", F.from_json("text", CONCEPTS).alias("x")).select("filename", "x.concepts", "x.nbWords")
    return rows.filter("filename IS NOT NULL").select("filename", "concepts", "nbWords").unionByName(parsed)


def concept_uris(spark: SparkSession, path: str, extension: str = ".json") -> DataFrame:
    """SC6, U2: the distinct URIs of all concept files."""
    return read_concepts(spark, path, extension).select(F.explode("concepts").alias("c")).select(F.col("c.uri").alias("uri")).distinct()


def write_concepts(concepts: DataFrame, path: str, force: bool = False, each: bool = False) -> None:
    """SK3, SK6: JSON lines (filename, concepts, nbWords), or with ``each`` a file a document. Without ``force`` documents that are there already are left out."""
    _write(concepts if force else skip_existing(concepts, path), path, force, each)


def _write(rows: DataFrame, path: str, force: bool, each: bool, key: str = "filename") -> None:
    if each:
        write_each(rows.select(F.col(key).alias("filename"), F.to_json(F.struct(*[c for c in rows.columns if c != key])).alias("text")), path, ".json")
    else:
        rows.write.mode("overwrite" if force else "append").json(path)


def write_each(rows: DataFrame, folder: str, extension: str) -> int:
    """SK3, SK4, SK7: (filename, text) as a file each in ``folder``, in place of one of that name; returns how many.

    A task writes a file beside its place and then moves it there, so a task that is tried again leaves no half of a file.
    Rows of one name write one file, either of them; a null name or one with a slash is an error, a null text an empty file.
    """
    at, system = _at(rows.sparkSession, folder)
    system.mkdirs(at)
    uri = at.makeQualified(system.getUri(), system.getWorkingDirectory()).toString()
    uri = "file://" + uri.removeprefix("file:") if uri.startswith("file:/") and not uri.startswith("file://") else uri

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target, place = fs.FileSystem.from_uri(uri)
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not name or "/" in name:
                    raise ValueError(f"no name of a file: {name}")
                beside = f"{place}/.{uuid.uuid4().hex}"
                with target.open_output_stream(beside) as out:
                    out.write((text or "").encode())
                target.move(beside, f"{place}/{name}{extension}")
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    return rows.select("filename", "text").mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def skip_existing(rows: DataFrame, path: str, extension: str = ".json") -> DataFrame:
    """SK6, J12: the rows whose ``filename`` isn't among the outputs in ``path``; all if there is no such folder."""
    spark = rows.sparkSession
    at, system = _at(spark, path)
    if not system.exists(at):
        return rows
    done = spark.read.schema("filename string").json(path, pathGlobFilter=f"part-*{extension}").filter("filename IS NOT NULL")
    done = done.unionByName(_whole(spark, path, extension, True).select("filename"))
    return rows.join(done.distinct(), "filename", "left_anti")


def _at(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def readable(spark: SparkSession, path: str) -> None:
    """SK8: an error before any work if there is nothing to read."""
    at, system = _at(spark, path)
    if not system.exists(at):
        raise FileNotFoundError(path)


def writable(spark: SparkSession, path: str) -> None:
    """SK8: an error before any work if the output can't be written: a file is made beside it and deleted again."""
    at, system = _at(spark, path)
    probe = at.suffix(".probe")
    try:
        system.create(probe, True).close()
    except Exception as e:
        raise PermissionError(path) from e
    system.delete(probe, False)


def read_info(spark: SparkSession, path: str) -> DataFrame:
    """SC7: (uri, types, nb_links_in, nb_links_out) from one JSON map; link counts may be strings."""
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", INFO)).alias("uri", "x"))
    count = lambda c: F.coalesce(F.col(f"x.{c}").try_cast("bigint"), F.lit(0)).cast("long").alias(c)
    return rows.select("uri", F.coalesce("x.types", F.array().cast("array<string>")).alias("types"), count("nb_links_in"), count("nb_links_out"))


def write_info(info: DataFrame, path: str) -> None:
    """SK5: one JSON map by URI. The format asks for a single value, so this is for maps that fit a task; large ones stay tables."""
    value = F.struct(F.col("uri").alias("concept_iri"), "types", "nb_links_in", "nb_links_out")
    one = info.select("uri", value.alias("v")).agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("uri", "v"))))).alias("value"))
    one.write.mode("overwrite").text(path)


def graph_rows(nodes: DataFrame, links: DataFrame, lengths: DataFrame, key: str = "filename") -> DataFrame:
    """SK4: one row per graph in node-link form. Tables of ``graphs.built`` have these rows already, in order."""
    if (made := rows_of(nodes, links)) is not None:
        found = made.select(key, "nodes", F.transform("edges", lambda x: F.struct(x["src"].alias("source"), x["dst"].alias("target"))).alias("links"))
    else:
        by_node = nodes.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("id", "resource", "count", "offset", "nbTypes", "nbLinksIn", "nbLinksOut"))).alias("nodes"))
        by_edge = links.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col("src").alias("source"), F.col("dst").alias("target")))).alias("links"))
        found = by_node.join(by_edge, key, "full")
    out = lengths.select(key, F.struct(F.col("nbWord").cast("int").alias("nb_words")).alias("graph")).join(found, key, "left")
    full = lambda c: F.coalesce(c, F.array().cast(found.schema[c].dataType)).alias(c)
    return out.select(key, F.lit(False).alias("directed"), F.lit(False).alias("multigraph"), "graph", full("nodes"), full("links"))


def write_graphs(nodes: DataFrame, links: DataFrame, lengths: DataFrame, path: str, force: bool = False, each: bool = False, key: str = "filename") -> None:
    """SK4: JSON lines, a graph each, with its filename, the text of ``key``; with ``each`` a file a graph."""
    rows = graph_rows(nodes, links, lengths, key).withColumn(key, F.col(key).cast("string")).withColumnRenamed(key, "filename")
    _write(rows if force else skip_existing(rows, path), path, force, each)


def read_graphs(spark: SparkSession, path: str, extension: str = ".json") -> tuple[DataFrame, DataFrame, DataFrame]:
    """SC8: (vertices, edges, lengths) from node-link JSON, a graph a file or a line. The files are parsed once; edges are told apart within their row, and by a shuffle only if names repeat."""
    rows = spark.read.schema(f"filename string, {GRAPH}").json(path, pathGlobFilter=f"part-*{extension}").filter("filename IS NOT NULL")
    whole = _whole(spark, path, extension, True)
    parsed = whole.select("filename", F.from_json("text", GRAPH).alias("x")).select("filename", "x.*")
    pair = lambda x: F.struct(F.least(x["source"], x["target"]).alias("src"), F.greatest(x["source"], x["target"]).alias("dst"))
    both = stored(rows.unionByName(parsed).select("filename", "graph", "nodes", F.array_distinct(F.transform("links", pair)).alias("links")), "read")
    nodes = both.select("filename", F.explode("nodes").alias("n")).select("filename", "n.*")
    nodes = nodes.withColumns({"resource": F.coalesce("resource", F.lit(False)), "nbLinksIn": F.col("nbLinksIn").try_cast("bigint"), "nbLinksOut": F.col("nbLinksOut").try_cast("bigint")})
    links = both.select("filename", F.inline("links"))
    if not both.groupBy("filename").count().filter("count > 1").isEmpty():
        links = links.repartition("filename").distinct()
    return nodes, links, both.select("filename", F.col("graph.nb_words").cast("long").alias("nbWord"))


def write_vectors(vectors: DataFrame, path: str, one_file: bool = False) -> None:
    """SK1, SK2: CSV with a header, the key first; ``one_file`` for results that fit a task."""
    (vectors.coalesce(1) if one_file else vectors).write.mode("overwrite").option("header", True).csv(path)


def output_paths(docs: DataFrame, folder: str, extension: str) -> DataFrame:
    """SK7: the path of each document's own output file."""
    return docs.select("filename", F.concat(F.lit(folder.rstrip("/") + "/"), output_name(F.col("filename"), extension)).alias("path"))


def _list(spark: SparkSession, path: str, first: int) -> DataFrame:
    rows = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("x"), "value").filter(~F.col("value").contains("Total words") & (F.trim("value") != ""))
    return rows.select(F.get("x", F.lit(first)).alias("lemma"), F.get("x", F.lit(first + 1)).alias("pos"), F.get("x", F.lit(first + 2)).try_cast("bigint").alias("freq")).filter("freq IS NOT NULL")


def _accumulated(rows: DataFrame) -> DataFrame:
    return rows.groupBy("lemma").agg(F.sum("freq").alias("freq"), F.bool_or(F.col("class") == "adj").alias("is_adj"), F.bool_or(F.col("class") == "verb").alias("is_verb"), F.bool_or(F.col("class") == "noun").alias("is_noun"))


def read_bnc(spark: SparkSession, path: str) -> DataFrame:
    """SC12, A15: (lemma, freq, is_adj, is_verb, is_noun) from lines ``lemma pos freq``."""
    pos = F.col("pos")
    return _accumulated(_list(spark, path, 0).withColumn("class", F.when(pos == "Adj", "adj").when(pos == "Verb", "verb").when(pos.isin("NoC", "NoP"), "noun").otherwise("other")))


def read_anc(spark: SparkSession, path: str) -> DataFrame:
    """SC13, A15: the same from lines ``word lemma pos freq``."""
    first = F.left("pos", F.lit(1))
    return _accumulated(_list(spark, path, 1).withColumn("class", F.when(first == "J", "adj").when(first == "V", "verb").when(first == "N", "noun").otherwise("other")))


def read_tagged(spark: SparkSession, path: str, extension: str = ".txt") -> DataFrame:
    """SC16: (filename, idx, word, pos) from files of ``word_TAG`` tokens as a tagger writes them."""
    return tagged_tokens(_whole(spark, path, extension))


def tagged_tokens(docs: DataFrame, key: str = "filename") -> DataFrame:
    """(key, idx, word, pos) of texts of ``word_TAG`` tokens."""
    rows = docs.select(key, F.posexplode(F.filter(F.split("text", r"\s+"), lambda x: x != "")).alias("idx", "token"))
    return split_tags(rows).drop("token")


def tagged_docs(docs: DataFrame, key: str = "filename") -> DataFrame:
    """(key, words, tags): ``tagged_tokens`` as arrays, a row per text."""
    low = F.transform(F.filter(F.split("text", r"\s+"), lambda x: x != ""), lambda x: F.lower(F.trim(x)))
    part = lambda k: F.transform("low", lambda x: F.split_part(x, F.lit("_"), F.lit(k)))
    return docs.select(key, F.explode(F.array(low)).alias("low")).select(key, part(1).alias("words"), part(-1).alias("tags"))


def read_trees(spark: SparkSession, path: str, extension: str = ".txt") -> DataFrame:
    """SC18: (filename, tree) from files of Penn bracketings as a parser writes them."""
    return _whole(spark, path, extension).withColumnRenamed("text", "tree")
