"""Strongly connected components by trimming and by forward and backward colours."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segmentry.shared import stored


def _trimmed(edges: DataFrame) -> DataFrame:
    """Edges between nodes that have edges in and out, again and again: what is left of a graph without cycles is nothing."""
    while True:
        n = edges.count()
        inner = edges.select(F.col("src").alias("node")).intersect(edges.select(F.col("dst").alias("node")))
        inner = stored(inner, "inner")
        edges = stored(edges.join(inner.withColumnRenamed("node", "src"), "src", "left_semi").join(inner.withColumnRenamed("node", "dst"), "dst", "left_semi").select("src", "dst"), "trimmed")
        if edges.count() == n:
            return edges


def _spread(edges: DataFrame, colour: DataFrame) -> DataFrame:
    """``colour`` (node, colour) raised to the largest that edges lead from, until nothing changes."""
    while True:
        handed = edges.join(colour.withColumnRenamed("node", "src"), "src").select(F.col("dst").alias("node"), "colour")
        new = stored(colour.unionByName(handed).groupBy("node").agg(F.max("colour").alias("colour")), "colours")
        if new.join(colour.withColumnRenamed("colour", "before"), "node").where("colour <> before").isEmpty():
            return new
        colour = new


def strong_components(edges: DataFrame) -> DataFrame:
    """node and component of every node on a cycle; ``edges`` are src and dst. The component is its largest node.

    Nodes without an edge in or out are on no cycle and are trimmed. Each of the others gets the largest node that reaches it as its colour; that node's component
    is what reaches it within the colour. Components leave, and the rest goes on. Rounds are as many
    as the longest way within what is left; every round is a few equi-joins. Loops are left out.
    """
    edges = _trimmed(stored(edges.where("src <> dst").select("src", "dst").distinct(), "edges"))
    found = stored(edges.select(F.col("src").alias("node"), F.col("src").alias("component")).limit(0), "none")
    while not edges.isEmpty():
        nodes = edges.select(F.col("src").alias("node")).distinct()
        colour = _spread(edges, stored(nodes.withColumn("colour", F.col("node")), "colours"))
        # Within a colour, from its own node against the edges.
        of = lambda end: colour.select(F.col("node").alias(end), F.col("colour").alias(f"{end}_colour"))
        inside = stored(edges.join(of("src"), "src").join(of("dst"), "dst").where("src_colour = dst_colour").select("src", "dst"), "inside")
        reached = stored(colour.where("node = colour"), "reached")
        while True:
            back = inside.join(reached.withColumnRenamed("node", "dst"), "dst").select(F.col("src").alias("node"), "colour")
            more = stored(reached.unionByName(back).distinct(), "reached")
            if more.count() == reached.count():
                break
            reached = more
        own = reached.withColumnRenamed("colour", "component")
        found = stored(found.unionByName(own), "components")
        left = edges.join(own.select(F.col("node").alias("src")), "src", "left_anti").join(own.select(F.col("node").alias("dst")), "dst", "left_anti")
        edges = _trimmed(stored(left.select("src", "dst"), "left"))
    sizes = found.groupBy("component").agg(F.count("*").alias("n")).where("n > 1")
    return found.join(sizes.select("component"), "component").select("node", "component")
