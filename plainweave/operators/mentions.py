"""Entity mentions: paragraphs with offsets, annotators, and mentions by document and URI.

An annotator is a function from paragraphs (with a ``text``) to the same rows with an array ``resources``
of RESOURCE. Null ``resources`` stand for a paragraph that could not be annotated: later offsets leave it out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plainweave.functions.text import PARAGRAPH_THRESHOLD, count_words, paragraphs

SCORES = "struct<offset:int,surfaceForm:string,similarityScore:double,percentageSecondRank:double,support:int>"
RESOURCE = f"struct<uri:string,types:array<string>,scores:{SCORES}>"
RESPONSE = "struct<Resources:array<struct<`@URI`:string,`@types`:string,`@offset`:string,`@surfaceForm`:string,`@support`:string,`@similarityScore`:string,`@percentageOfSecondRank`:string>>>"

Annotator = Callable[[DataFrame], DataFrame]


def explode_paragraphs(docs: DataFrame, key: str = "filename", threshold: int = PARAGRAPH_THRESHOLD) -> DataFrame:
    """(key, par_idx, text, n_words): the kept paragraphs of each text, numbered."""
    rows = docs.select(key, F.posexplode(paragraphs(F.col("text"), threshold)).alias("par_idx", "text"))
    return rows.withColumn("n_words", count_words(F.col("text")))


def base_offsets(parts: DataFrame, key: str = "filename") -> DataFrame:
    """``base_offset``, the length of the paragraphs before that were annotated (with ``ok``: those where it is true)."""
    length = F.when(F.col("ok"), F.length("text")).otherwise(0) if "ok" in parts.columns else F.length("text")
    before = Window.partitionBy(key).orderBy("par_idx").rowsBetween(Window.unboundedPreceding, -1)
    return parts.withColumn("base_offset", F.coalesce(F.sum(length).over(before), F.lit(0)).cast("long"))


def parse_response(body: Column) -> Column:
    """PF10: an annotator's JSON as an array of RESOURCE; items without a URI go, what can't be cast is null."""
    items = F.coalesce(F.from_json(body, RESPONSE)["Resources"], F.array().cast(RESPONSE.removeprefix("struct<Resources:").removesuffix(">")))

    def resource(x: Column) -> Column:
        types = F.when(F.coalesce(x["@types"], F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(x["@types"], ","))
        scores = F.struct(
            x["@offset"].try_cast("int").alias("offset"), x["@surfaceForm"].alias("surfaceForm"), x["@similarityScore"].try_cast("double").alias("similarityScore"),
            x["@percentageOfSecondRank"].try_cast("double").alias("percentageSecondRank"), x["@support"].try_cast("int").alias("support"),
        )
        return F.struct(x["@URI"].alias("uri"), types.alias("types"), scores.alias("scores"))

    return F.transform(F.filter(items, lambda x: F.coalesce(x["@URI"], F.lit("")) != ""), resource)


def accepts(x: Column, confidence: float | None = 0.5, support: int | None = None, types: list[str] | None = None, policy: str = "whitelist") -> Column:
    """PF25: the annotator's filters. A score that is null passes."""
    ok = F.lit(True)
    if confidence is not None:
        ok = ok & F.coalesce(x["scores"]["similarityScore"] >= confidence, F.lit(True))
    if support is not None:
        ok = ok & F.coalesce(x["scores"]["support"] >= support, F.lit(True))
    if types:
        listed = F.coalesce(F.arrays_overlap(x["types"], F.array(*[F.lit(t) for t in types])), F.lit(False))
        ok = ok & (listed if policy == "whitelist" else ~listed)
    return ok


def gazetteer(names: dict[str, tuple[str, list[str]]], confidence: float | None = 0.5, **filters) -> Annotator:
    """An annotator without a network: each word of a paragraph that is a key of ``names`` is a mention of its (uri, types).

    ``names`` is given by the caller and goes to the tasks with the plan; use ``gazetteer_table`` for a list that grows.
    """

    def annotate(parts: DataFrame) -> DataFrame:
        if not names:
            return parts.withColumn("resources", F.array().cast(f"array<{RESOURCE}>"))
        known = F.create_map(*[c for k, (uri, types) in names.items() for c in (F.lit(k), F.struct(F.lit(uri).alias("uri"), F.array(*[F.lit(t) for t in types]).cast("array<string>").alias("types")))])
        split = F.split("text", " ")
        at = F.transform(F.aggregate(split, F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + F.length(x) + 1))), lambda x: x)
        words = F.transform(split, lambda x, i: F.struct(F.lower(F.regexp_replace(x, "[^A-Za-z]", "")).alias("w"), x.alias("x"), F.get(at, i).alias("offset")))

        def resource(x: Column) -> Column:
            hit = F.try_element_at(known, x["w"])
            scores = F.struct(x["offset"].alias("offset"), x["x"].alias("surfaceForm"), F.lit(1.0).alias("similarityScore"), F.lit(0.0).alias("percentageSecondRank"), F.lit(1).alias("support"))
            return F.struct(hit["uri"].alias("uri"), hit["types"].alias("types"), scores.alias("scores"))

        found = F.filter(F.transform(words, resource), lambda x: x["uri"].isNotNull())
        return parts.withColumn("resources", F.filter(found, lambda x: accepts(x, confidence, **filters)))

    return annotate


def gazetteer_table(names: DataFrame, key: str = "filename", confidence: float | None = 0.5, **filters) -> Annotator:
    """Like ``gazetteer`` with a table (word, uri, types, and optionally similarity and support of a name), joined by word: for lists of any size."""
    score = lambda c, value: F.coalesce(F.col(c), F.lit(value)) if c in names.columns else F.lit(value)

    def annotate(parts: DataFrame) -> DataFrame:
        tokens = parts.select(key, "par_idx", F.posexplode(F.split("text", " ")).alias("ord", "token"))
        before = Window.partitionBy(key, "par_idx").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
        tokens = tokens.withColumn("offset", F.coalesce(F.sum(F.length("token") + 1).over(before), F.lit(0)).cast("int"))
        tokens = tokens.withColumn("word", F.lower(F.regexp_replace("token", "[^A-Za-z]", "")))
        scores = F.struct("offset", F.col("token").alias("surfaceForm"), F.col("similarity").cast("double").alias("similarityScore"), F.lit(0.0).alias("percentageSecondRank"), F.col("support").cast("int").alias("support"))
        listed = names.select("word", "uri", "types", score("similarity", 1.0).alias("similarity"), score("support", 1).alias("support"))
        found = tokens.join(listed, "word").select(key, "par_idx", "ord", F.struct("uri", "types", scores.alias("scores")).alias("r"))
        found = found.filter(accepts(F.col("r"), confidence, **filters))
        grouped = found.groupBy(key, "par_idx").agg(F.array_sort(F.collect_list(F.struct("ord", "r"))).alias("x"))
        grouped = grouped.select(key, "par_idx", F.transform("x", lambda x: x["r"]).alias("resources"))
        return parts.join(grouped, [key, "par_idx"], "left").withColumn("resources", F.coalesce("resources", F.array().cast(f"array<{RESOURCE}>")))

    return annotate


def text_concepts(docs: DataFrame, annotate: Annotator, key: str = "filename", threshold: int = PARAGRAPH_THRESHOLD) -> DataFrame:
    """(key, concepts, nbWords) for each document, with offsets in the whole of its annotated paragraphs.

    The words of a paragraph count though it could not be annotated. A text without a kept paragraph has no concepts and 0 words.
    """
    parts = annotate(explode_paragraphs(docs, key, threshold)).withColumn("ok", F.col("resources").isNotNull())
    parts = base_offsets(parts, key)

    def moved(x: Column) -> Column:
        s = x["scores"]
        return F.struct(x["uri"].alias("uri"), x["types"].alias("types"), F.struct((s["offset"] + F.col("base_offset")).cast("int").alias("offset"), s["surfaceForm"].alias("surfaceForm"), s["similarityScore"].alias("similarityScore"), s["percentageSecondRank"].alias("percentageSecondRank"), s["support"].alias("support")).alias("scores"))

    parts = parts.withColumn("found", F.coalesce(F.transform("resources", moved), F.array().cast(f"array<{RESOURCE}>")))
    by_doc = parts.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("par_idx", "found"))).alias("x"), F.sum("n_words").cast("int").alias("nbWords"))
    by_doc = by_doc.select(key, F.flatten(F.transform("x", lambda x: x["found"])).alias("concepts"), "nbWords")
    out = docs.select(key).distinct().join(by_doc, key, "left")
    return out.select(key, F.coalesce("concepts", F.array().cast(f"array<{RESOURCE}>")).alias("concepts"), F.coalesce("nbWords", F.lit(0)).alias("nbWords"))


def explode_concepts(concepts: DataFrame, key: str = "filename") -> DataFrame:
    """(key, ord, uri, types, offset): one row per mention."""
    rows = concepts.select(key, F.posexplode("concepts").alias("ord", "c"))
    return rows.select(key, "ord", F.col("c.uri").alias("uri"), F.col("c.types").alias("types"), F.col("c.scores.offset").alias("offset"))


def mention_counts(mentions: DataFrame, key: str = "filename") -> DataFrame:
    """(key, uri, count, offset, types): the number of mentions of a URI, and the last one's offset and types."""
    last = F.max_by(F.struct("offset", "types"), "ord")
    out = mentions.groupBy(key, "uri").agg(F.count("*").alias("count"), last.alias("last"))
    return out.select(key, "uri", "count", F.col("last.offset").alias("offset"), F.col("last.types").alias("types"))
