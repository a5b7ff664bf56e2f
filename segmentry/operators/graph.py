"""Clusters and graphs of read paths.

Reads of equal paths are one structure first, so that what follows grows with the
number of different paths and no group of reads is expanded into pairs.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from segmentry.functions import cigar as C
from segmentry.operators.components import connected_components
from segmentry.shared import stored


def nodes_of(segments: DataFrame) -> DataFrame:
    """A key for each segment: chromosome, exons and strand."""
    return segments.withColumn("node", F.concat_ws(":", "chrom", C.text_of(F.col("exons")), "strand"))


def structures(segments: DataFrame) -> DataFrame:
    """One row per different path: its nodes in order, reads and smallest read as ``path_id``."""
    paths = nodes_of(segments).groupBy("read_id").agg(F.array_sort(F.collect_list(F.struct("seg_ord", "node"))).alias("steps"))
    paths = paths.select("read_id", F.array_join(F.transform("steps", lambda s: s["node"]), "|").alias("path"))
    return paths.groupBy("path").agg(F.min("read_id").alias("path_id"), F.count("*").alias("reads"))


def cluster_paths(segments: DataFrame) -> DataFrame:
    """path_id, reads and cluster_id of each structure: connected through shared nodes.

    Structures are linked to the smallest structure of each node, never to each other in
    pairs; the components are the same.
    """
    s = stored(structures(segments), "structures")
    steps = s.select("path_id", F.explode(F.split("path", r"\|")).alias("node"))
    least = steps.groupBy("node").agg(F.min("path_id").alias("least"))
    links = steps.join(least, "node").select("path_id", "least").where("path_id <> least").distinct()
    parts = connected_components(links, "path_id", "least")
    return s.join(parts, s.path_id == parts.node, "left").select("path_id", "reads", F.coalesce("component", "path_id").alias("cluster_id"))


def edges_of(segments: DataFrame) -> DataFrame:
    """Support of each edge between nodes that follow each other in a read."""
    w = Window.partitionBy("read_id").orderBy("seg_ord")
    hops = nodes_of(segments).select("read_id", F.col("node").alias("src"), F.lead("node").over(w).alias("dst")).where("dst is not null")
    return hops.groupBy("src", "dst").agg(F.count_distinct("read_id").alias("sr"))


def edges_of_structures(paths: DataFrame) -> DataFrame:
    """path, src, dst and reads of the different edges of each structure (path, reads). A read is in one structure, so an edge's reads are the sum over its structures."""
    node = F.split("path", r"\|")
    ahead, behind = F.slice(node, F.lit(2), F.size(node) - 1), F.slice(node, F.lit(1), F.size(node) - 1)
    pairs = F.array_distinct(F.zip_with(behind, ahead, lambda a, b: F.struct(a.alias("src"), b.alias("dst"))))
    return paths.select("path", "reads", F.explode(pairs).alias("e")).select("path", "e.src", "e.dst", "reads")


def graph_ends(edges: DataFrame) -> DataFrame:
    """Nodes without a predecessor (start) or without a successor (end)."""
    src, dst = edges.select(F.col("src").alias("node")).distinct(), edges.select(F.col("dst").alias("node")).distinct()
    starts = src.join(dst, "node", "left_anti").withColumn("side", F.lit("start"))
    return starts.unionByName(dst.join(src, "node", "left_anti").withColumn("side", F.lit("end")))


def weakly_connected(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """fam and whether its nodes (node_id, fam) are one component along the edges (src, dst); a node without edges is one of its own."""
    parts = connected_components(edges, "src", "dst")
    x = nodes.join(parts, nodes.node_id == parts.node, "left").select("fam", F.coalesce("component", "node_id").alias("label"))
    return x.groupBy("fam").agg((F.count_distinct("label") == 1).alias("connected"))
