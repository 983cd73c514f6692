"""Connected components of links in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B


def components(links: DataFrame, scratch: B.Scratch) -> DataFrame:
    """(a, b) links of any orderable type to (node, label): the least node that each linked node reaches.

    Alternates large stars (every neighbour above a node moves to the node's least neighbour) and small stars
    (every neighbour below moves there too) until each component is one star; the rounds grow with the logarithm of
    the longest path. Each round is written to the shared folder, which cuts the lineage. Nodes without links
    and nulls do not appear; an empty table gives an empty result.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = scratch.write(edges, "links")
    while True:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.expr("count_if(v < u)").alias("below"), F.expr("count_if(v > u)").alias("above"))
        least = scratch.write(least.select("u", F.least("u", "m").alias("m"), F.expr("below > 1 or (below = 1 and above > 0)").alias("inner")), "least")
        if least.where("inner").isEmpty():  # a star a component: every node is its least one or linked with that only
            return least.select(F.col("u").alias("node"), F.col("m").alias("label"))
        large = scratch.write(both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")), "stars")
        low = scratch.write(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = scratch.write(small.unionByName(low.withColumnRenamed("m", "b")).distinct(), "stars")


def extended(labels: DataFrame, links: DataFrame, scratch: B.Scratch) -> DataFrame:
    """What ``components`` gives for the links behind ``labels`` and ``links`` together. Only the components that new
    links touch are worked on, each as one node."""
    ends = scratch.write(links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node"))).where("node is not null").distinct(), "ends")
    known = scratch.write(labels.join(ends, "node", "left_semi"), "known")
    for end in ("a", "b"):
        links = links.join(known.select(F.col("node").alias(end), F.col("label").alias(f"of_{end}")), end, "left")
    over = components(links.select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b")), scratch)
    old = labels.join(over.select(F.col("node").alias("label"), F.col("label").alias("new")), "label", "left").select("node", F.coalesce("new", "label").alias("label"))
    new = over.join(ends.join(known, "node", "left_anti"), "node", "left_semi")
    return scratch.write(old.unionByName(new), "labels")
