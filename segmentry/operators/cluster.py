"""Clusters of paths through nodes that count as one."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segmentry.operators.compat import compatible
from segmentry.operators.components import connected_components


def similar_paths(nodes: DataFrame, steps: DataFrame, tolerance: int = 10) -> DataFrame:
    """Pairs path1 < path2 a node of one of which is, by the rule of their identities, a node of the other. ``steps`` are node_id and path_id."""
    pairs = compatible(nodes, tolerance)
    one, two = (steps.select(F.col("node_id").alias(f"node{i}"), F.col("path_id").alias(f"p{i}")) for i in (1, 2))
    x = pairs.join(one, "node1").join(two, "node2").where("p1 <> p2")
    return x.select(F.least("p1", "p2").alias("path1"), F.greatest("p1", "p2").alias("path2")).distinct()


def clusters(paths: DataFrame, pairs: DataFrame) -> DataFrame:
    """path_id and cluster_id, the smallest path that it reaches; paths without pairs are their own."""
    parts = connected_components(pairs, "path1", "path2")
    return paths.join(parts, paths.path_id == parts.node, "left").select("path_id", F.coalesce("component", "path_id").alias("cluster_id"))
