"""Connected components of an undirected graph of BIGINT nodes, by DataFrame rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plainweave.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of ``edges`` (a, b): the smallest node that it reaches.

    Each round offers the smallest label among a node's neighbours to the node and to the node of its label, so that whole
    trees are hooked to smaller ones, and then gives each node the label of its label. On paths in any order
    tried, the rounds grow with the logarithm of the length. They end when no label changes: then neighbours have equal labels. Each
    round is two tables in the shared folder; nothing goes to the driver but whether there was a change.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b")
    both = stored(both.distinct(), "links")
    labels = stored(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "node"), "labels")
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("near")).withColumnRenamed("a", "node")
        own = F.struct("node", F.least("label", "near").alias("label"), F.col("label").alias("before"))
        tree = F.struct(F.col("label").alias("node"), F.col("near").alias("label"), F.lit(None).cast("long").alias("before"))
        offers = labels.join(near, "node").select(F.inline(F.array(own, tree)))
        hooked = stored(offers.groupBy("node").agg(F.min("label").alias("label"), F.max("before").alias("before")), "hooks")
        if not hooked.filter("label <> before").limit(1).count():
            return labels.select("node", F.col("label").alias("root"))
        jump = hooked.select(F.col("node").alias("label"), F.col("label").alias("root"))
        labels = stored(hooked.join(jump, "label").select("node", F.col("root").alias("label")), "labels")
