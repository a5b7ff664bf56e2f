"""Connected components by alternating large-star and small-star steps."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segmentry.shared import stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step: hang a node's larger (or its own and smaller) neighbours under its smallest one."""
    if large:
        ways = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        ways = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = ways.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
    both = ways.join(low, "a")
    if large:
        out = both.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("low").alias("b"))
    else:
        out = both.select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(low.select("a", F.col("low").alias("b")))
    return out.where("a <> b").distinct()


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Give each linked node the smallest node that it reaches: columns ``node``, ``component``.

    Nulls and loops are left out; nodes without links are not in the result.
    The edges stay in Spark; only their count and a checksum reach the driver,
    to see that a round has changed nothing. Rounds are about the logarithm of the
    longest path. Nodes that many edges meet are pre-aggregated, and the join
    that follows is one that adaptive execution may split.
    """
    edges = links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    edges = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen or not now[0]:
            break
        seen = now
        edges = stored(_star(_star(edges, True), False), "edges")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
