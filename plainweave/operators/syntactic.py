"""Syntactic complexity from bracketed parse trees: a node table, thirteen pattern counts, lengths and ratios.

A tree's nodes are numbered in preorder (``pre``); a node's subtree is the interval [pre, last]. So that one
node dominates another of some kind is a difference of two running counts, and no pair of nodes is ever joined.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Names of the counts and ratios, in the order of the output. Fixed values.
COUNTS = ["W", "S", "VP", "C", "T", "DC", "CT", "CP", "CN"]
RATIOS = {
    "MLS": ("W", "S"), "MLT": ("W", "T"), "MLC": ("W", "C"), "C/S": ("C", "S"), "VP/T": ("VP", "T"), "C/T": ("C", "T"), "DC/C": ("DC", "C"), "DC/T": ("DC", "T"),
    "T/S": ("T", "S"), "CT/T": ("CT", "T"), "CP/T": ("CP", "T"), "CP/C": ("CP", "C"), "CN/T": ("CN", "T"), "CN/C": ("CN", "C"),
}
FEATURES = COUNTS + list(RATIOS)

#: A word with its tag. Fixed value.
WORD = r"\([A-Z]+\$? [^)(]+\)"

#: Head rules (Collins 1999): the first of these labels that a phrase's children have is its head's. Fixed values.
HEADS = {
    "VP": "TO VBD VBN MD VBZ VB VBG VBP VP ADJP NN NNS NP",
    "S": "TO IN VP S SBAR ADJP UCP NP",
    "SINV": "VBZ VBD VBP VB MD VP S SINV ADJP NP",
    "SQ": "VBZ VBD VBP VB MD VP SQ",
    "SBAR": "WHNP WHPP WHADVP WHADJP IN DT S SQ SINV SBAR FRAG",
}

FINITE = ("MD", "VBZ", "VBP", "VBD")
CLAUSES = ("S", "SINV", "SQ")
UNITS = ("S", "SBARQ", "SINV", "SQ")
#: Patterns that are counted, by node. Fixed values.
PATTERNS = ["S", "VP1", "C1", "T1", "DC", "CT", "CP", "CN1", "CN2", "CN3", "FC", "FT", "VP2"]


def word_count(tree: Column) -> Column:
    """PF23: the number of tagged words in a bracketing."""
    return F.regexp_count(tree, F.lit(WORD)).cast("long")


def tree_nodes(trees: DataFrame, key: str = "filename") -> DataFrame:
    """(key, pre, last, parent, sib, label, leaf): the nodes of each document's trees, which ``trees`` has as one text (key, tree).

    A node's parent is the last bracket opened one level above it; the closing bracket of a node is the next bracket at its level.
    """
    rows = trees.select(key, F.posexplode(F.regexp_extract_all("tree", F.lit(r"(\([^\s()]*|\)|[^\s()]+)"), F.lit(1))).alias("i", "x"))
    opened, closed = F.startswith("x", F.lit("(")), F.col("x") == ")"
    doc = Window.partitionBy(key).orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumns({
        "depth": F.sum(F.when(opened, 1).when(closed, -1).otherwise(0)).over(doc),
        "pre": F.sum(F.when(closed, 0).otherwise(1)).over(doc),
    })
    rows = rows.withColumns({"level": F.when(opened, F.col("depth")).otherwise(F.col("depth") + 1), "leaf": ~opened & ~closed})
    rows = rows.withColumn("last", F.when(F.col("leaf"), F.col("pre")).otherwise(F.lead("pre").over(Window.partitionBy(key, "level", "leaf").orderBy("i"))))
    # Each node asks, and each opened bracket answers, at the level above: the last answer is the parent.
    kept = rows.filter(~closed)
    ask = kept.withColumns({"at": F.col("level") - 1, "answer": F.lit(None).cast("long"), "asks": F.lit(True)})
    answer = kept.filter(~F.col("leaf")).withColumns({"at": F.col("level"), "answer": F.col("pre"), "asks": F.lit(False)})
    above = Window.partitionBy(key, "at").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    nodes = ask.unionByName(answer).withColumn("parent", F.last("answer", ignorenulls=True).over(above)).filter("asks")
    sib = F.row_number().over(Window.partitionBy(key, "parent").orderBy("pre")) - 1
    return nodes.select(key, "pre", "last", "parent", sib.alias("sib"), F.when(F.col("leaf"), F.col("x")).otherwise(F.substr("x", F.lit(2))).alias("label"), "leaf")


def _priority() -> Column:
    """Of a child in its parent: its place in the head rule of the parent's label."""
    out = None
    for phrase, order in HEADS.items():
        place = F.array_position(F.array(*[F.lit(x) for x in order.split()]), F.col("label"))
        place = F.when(place > 0, place).otherwise(F.lit(1000))
        out = F.when(F.col("parent_label") == phrase, place) if out is None else out.when(F.col("parent_label") == phrase, place)
    return out.otherwise(F.lit(1000))


def _with_children(nodes: DataFrame, key: str, **parts: Column) -> DataFrame:
    """``nodes`` with aggregates over each node's children; false or null where there are none."""
    found = nodes.filter("parent IS NOT NULL").groupBy(key, "parent").agg(*[c.alias(name) for name, c in parts.items()])
    out = nodes.join(found.withColumnRenamed("parent", "pre"), [key, "pre"], "left")
    kinds = dict(found.dtypes)
    return out.withColumns({name: F.coalesce(name, F.lit(False)) for name in parts if kinds[name] == "boolean"})


def _dominates(nodes: DataFrame, key: str, **flags: Column) -> DataFrame:
    """``nodes`` with, by flag, whether a node below has it: the running counts at its last and at its own place differ."""
    doc = Window.partitionBy(key).orderBy("pre").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    nodes = nodes.withColumns({f"upto_{name}": F.sum(c.cast("int")).over(doc) for name, c in flags.items()})
    ends = nodes.select(key, F.col("pre").alias("last"), *[F.col(f"upto_{name}").alias(f"end_{name}") for name in flags])
    out = nodes.join(ends, [key, "last"])
    return out.withColumns({name: F.col(f"end_{name}") > F.col(f"upto_{name}") for name in flags}).drop(*[f"{x}_{name}" for x in ("end", "upto") for name in flags])


def _dominated(nodes: DataFrame, key: str, name: str, flag: Column) -> DataFrame:
    """``nodes`` with, under ``name``, whether a node above has the flag: more subtrees of such nodes are open than its own."""
    events = nodes.withColumn("step", flag.cast("int")).withColumn("event", F.lit(0))
    ends = nodes.filter(flag).select(key, F.col("last").alias("pre")).withColumns({"step": F.lit(-1), "event": F.lit(1)})
    doc = Window.partitionBy(key).orderBy("pre", "event").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = events.unionByName(ends, allowMissingColumns=True).withColumn("open", F.sum("step").over(doc))
    return both.filter("event = 0").withColumn(name, F.col("open") > F.col("step")).drop("step", "event", "open")


def marked(nodes: DataFrame, key: str = "filename") -> DataFrame:
    """Each node with a flag for each of PATTERNS."""
    label, no = F.col("label"), F.lit(False)
    some = lambda c: F.bool_or(F.coalesce(c, no))
    inner = ~F.col("leaf")
    of = nodes.filter(inner).select(key, F.col("pre").alias("parent"), label.alias("parent_label"))
    n = nodes.join(of, [key, "parent"], "left")
    sisters = Window.partitionBy(key, "parent").orderBy("sib")
    earlier, later = sisters.rowsBetween(Window.unboundedPreceding, -1), sisters.rowsBetween(1, Window.unboundedFollowing)
    in_tree = F.col("parent").isNotNull()
    n = n.withColumns({
        "next": F.when(in_tree, F.lead(F.when(inner, label)).over(sisters)),
        "unit_before": in_tree & F.coalesce(F.bool_or(inner & label.isin(*UNITS)).over(earlier), no),
        "np_later": in_tree & F.coalesce(F.bool_or(inner & (label == "NP")).over(later), no),
        "rank": _priority(),
    })
    # What a node's children say: the head's label, the first child's label, and kinds of children.
    child = lambda *names: inner & label.isin(*names)
    n = _with_children(
        n, key, head=F.min_by(F.struct(F.when(inner, label).alias("label"), "pre"), F.struct("rank", "sib")), first=F.min_by(F.when(inner, label), "sib"),
        has_cc=some(child("CC")), has_s=some(child("S")), has_vp=some(child("VP")), says_that=some(F.col("leaf") & label.isin("That", "that", "For", "for")),
    )
    n = n.withColumns({"head_label": F.col("head.label"), "head_pre": F.col("head.pre")}).drop("head")
    finite = F.coalesce(F.col("head_label").isin(*FINITE), no)
    n = _with_heads(n, key, some, child, finite)
    finite_vp = child("VP") & (finite | (F.col("has_cc") & F.col("has_finite_vp")))
    n = _with_children(n, key, has_vp_like=some(finite_vp))
    root = F.coalesce(F.col("parent_label") == "ROOT", no)
    clause = child(*CLAUSES) & ((root & F.col("first_vb")) | finite | F.col("has_vp_like"))
    n = n.withColumn("clause", clause)
    n = _with_children(n, key, has_clause=some(F.col("clause")))
    n = _dominated(n, key, "under", child("SBAR", "VP"))
    n = n.withColumns({"unit": child(*UNITS) & (root | (F.col("unit_before") & ~F.col("under"))), "dependent": child("SBAR") & F.col("has_clause")})
    pair = child("NP") & F.col("np_later") & ~F.coalesce(F.col("next") == "CC", no)
    n = _dominates(n, key, over_dependent=F.col("dependent"), over_modifier=child("JJ", "POS", "PP", "S", "VBG") | pair, over_clause=F.col("clause"), over_unit=F.col("unit"))
    before_vp = F.coalesce(F.col("next") == "VP", no)
    above = lambda *names: F.coalesce(F.col("parent_label").isin(*names), no)
    that_clause = F.coalesce(F.col("head_label") == "WHNP", no) | F.col("head_says_that") | F.coalesce(F.col("first") == "S", no)
    flags = {
        "S": child("ROOT"), "VP1": child("VP") & above(*CLAUSES), "C1": F.col("clause"), "T1": F.col("unit"), "DC": F.col("dependent"),
        "CT": F.col("unit") & F.col("over_dependent"), "CP": child("ADJP", "ADVP", "NP", "VP") & F.col("has_cc"), "CN1": child("NP") & ~above("NP") & F.col("over_modifier"),
        "CN2": child("SBAR") & that_clause & (before_vp | above("VP")), "CN3": child("S") & F.col("has_ing_or_to_vp") & before_vp,
        "FC": child("FRAG") & root & ~F.col("over_clause"), "FT": child("FRAG") & root & ~F.col("over_unit"), "VP2": child(*FINITE) & above("SQ") & ~F.col("parent_has_vp"),
    }
    return n.select(key, "pre", "last", "parent", "label", *[F.coalesce(c, no).alias(f"is_{p}") for p, c in flags.items()])


def _with_heads(n: DataFrame, key: str, some, child, finite: Column) -> DataFrame:
    """Aggregates over children that need the children's own heads, and what a node must know of its parent."""
    up = n.select(key, F.col("pre").alias("parent"), F.col("head_pre").alias("up_head"), F.col("has_vp").alias("parent_has_vp"))
    n = n.join(up, [key, "parent"], "left").withColumn("parent_has_vp", F.coalesce("parent_has_vp", F.lit(False)))
    return _with_children(
        n, key, has_finite_vp=some(child("VP") & finite), has_ing_or_to_vp=some(child("VP") & F.col("head_label").isin("VBG", "TO")),
        first_vb=some((F.col("sib") == 0) & child("VP") & (F.col("head_label") == "VB")), head_says_that=some(child("IN") & F.col("says_that") & (F.col("pre") == F.col("up_head"))),
    )


def pattern_counts(trees: DataFrame, key: str = "filename") -> DataFrame:
    """(key, W, S, VP, C, T, DC, CT, CP, CN): counts of nodes, alternatives of one pattern added up."""
    flags = marked(tree_nodes(trees, key), key)
    sums = flags.groupBy(key).agg(*[F.count_if(f"is_{p}").alias(f"n_{p}") for p in PATTERNS])
    out = trees.select(key, word_count(F.col("tree")).alias("W")).join(sums, key, "left")
    n = lambda *names: reduce(lambda a, b: a + b, [F.coalesce(f"n_{x}", F.lit(0)) for x in names]).cast("long")
    return out.select(key, F.coalesce("W", F.lit(0)).alias("W"), n("S").alias("S"), n("VP1", "VP2").alias("VP"), n("C1", "FC").alias("C"), n("T1", "FT").alias("T"), n("DC").alias("DC"), n("CT").alias("CT"), n("CP").alias("CP"), n("CN1", "CN2", "CN3").alias("CN"))


def syntactic_vectors(trees: DataFrame, key: str = "filename") -> DataFrame:
    """One row of FEATURES per document; a ratio with a 0 is 0."""
    ratio = lambda a, b: F.when((F.col(a) == 0) | (F.col(b) == 0), F.lit(0.0)).otherwise(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")))
    return pattern_counts(trees, key).select(key, *[F.col(c).cast("double").alias(c) for c in COUNTS], *[ratio(a, b).alias(name) for name, (a, b) in RATIOS.items()])
