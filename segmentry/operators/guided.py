"""Ways through a graph that reads vouch for."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segmentry.operators.contraction import Graph, clusters
from segmentry.operators.strong import strong_components
from segmentry.shared import stored


def circles(graph: Graph, least: int = 1) -> DataFrame:
    """cluster_id, n_nodes, n_cyclic (nodes on cycles of edges with ``least`` reads or more) and has_circle of each cluster, whether a start node leads there or not."""
    strong = graph.support().where(F.col("sr") >= least)
    cyclic = strong_components(strong).select(F.col("node").alias("node_id"), F.lit(1).alias("on_cycle"))
    x = clusters(graph).join(cyclic, "node_id", "left").groupBy("cluster_id").agg(F.count("*").alias("n_nodes"), F.count("on_cycle").alias("n_cyclic"))
    return x.withColumn("has_circle", F.col("n_cyclic") > 0)


def transitions(graph: Graph, mids: DataFrame, least: int) -> DataFrame:
    """u, v, w: edges with ``least`` reads or more that may follow each other.

    ``mids`` are read_id and node_id of nodes within a read's path. If both edges have reads for which v is such a node, they must share one of them. Those
    that share one meet by read and node; only edges without such reads meet by the node alone.
    """
    strong = stored(graph.support().where(F.col("sr") >= least).select("src", "dst"), "strong")
    reads = graph.edge_reads.join(strong, ["src", "dst"], "left_semi")
    inner = lambda end: reads.join(mids.withColumnRenamed("node_id", end), ["read_id", end])
    into, out = stored(inner("dst").select("src", "dst", "read_id"), "into"), stored(inner("src").select("src", "dst", "read_id"), "out")
    first = strong.join(into.select("src", "dst", F.lit(True).alias("mid")).distinct(), ["src", "dst"], "left").select(F.col("src").alias("u"), F.col("dst").alias("v"), "mid")
    second = strong.join(out.select("src", "dst", F.lit(True).alias("mid2")).distinct(), ["src", "dst"], "left").select(F.col("src").alias("v"), F.col("dst").alias("w"), "mid2")
    shared = into.select(F.col("src").alias("u"), F.col("dst").alias("v"), "read_id").join(out.select(F.col("src").alias("v"), F.col("dst").alias("w"), "read_id"), ["v", "read_id"]).select("u", "v", "w").distinct()
    free = first.where("mid is null").join(second, "v").select("u", "v", "w")
    half = first.where("mid is not null").join(second.where("mid2 is null"), "v").select("u", "v", "w")
    return stored(shared.unionByName(free).unionByName(half), "transitions")


def _leading_on(follow: DataFrame, edges: DataFrame, ends: DataFrame) -> DataFrame:
    """src and dst of ``edges`` from which transitions lead to an end: found backwards from the ends, before any way is made."""
    alive = stored(edges.join(ends.select(F.col("node_id").alias("dst")), "dst", "left_semi").select("src", "dst"), "alive")
    newest = alive
    while True:
        back = follow.join(newest.select(F.col("src").alias("v"), F.col("dst").alias("w")), ["v", "w"]).select(F.col("u").alias("src"), F.col("v").alias("dst")).distinct()
        newest = stored(back.join(alive, ["src", "dst"], "left_anti"), "newest")
        if newest.isEmpty():
            return alive
        alive = stored(alive.unionByName(newest), "alive")


def guided_ways(graph: Graph, mids: DataFrame, least: int = 1, ignore_circle: bool = False) -> DataFrame:
    """cluster_id, way (an array of nodes): all ways from a node without predecessor to one without successor by ``transitions``; a node without edges is a way of its own.

    Start and end nodes are those of the whole graph. Clusters with a cycle of edges with ``least`` reads have no ways, unless ``ignore_circle`` asks for those that
    visit no node twice. What can't reach an end is cut first, so a way is only lost in a circular cluster. Rounds are as many as the longest way has nodes.
    """
    own = stored(clusters(graph), "clusters")
    if not ignore_circle:
        own = stored(own.join(circles(graph, least).where("not has_circle").select("cluster_id"), "cluster_id", "left_semi"), "clusters")
    src, dst = graph.edges.select(F.col("src").alias("node_id")).distinct(), graph.edges.select(F.col("dst").alias("node_id")).distinct()
    starts, ends = own.join(dst, "node_id", "left_anti"), own.join(src, "node_id", "left_anti")
    strong = graph.support().where(F.col("sr") >= least).join(own.select(F.col("node_id").alias("src")), "src", "left_semi").select("src", "dst")
    follow = transitions(graph, mids, least)
    alive = _leading_on(follow, strong, ends)
    follow = stored(follow.join(alive.select(F.col("src").alias("v"), F.col("dst").alias("w")), ["v", "w"], "left_semi").select("u", "v", "w"), "follow")
    ways = alive.join(starts.withColumnRenamed("node_id", "src"), "src").select("cluster_id", F.array("src", "dst").alias("way"), F.col("src").alias("u"), F.col("dst").alias("v"))
    done = [starts.join(src, "node_id", "left_anti").select("cluster_id", F.array("node_id").alias("way"))]
    while True:
        ways = stored(ways, "ways")
        if ways.isEmpty():
            break
        done.append(ways.join(ends.select(F.col("node_id").alias("v")), "v", "left_semi").select("cluster_id", "way"))
        step = ways.join(follow, ["u", "v"])
        ways = step.where(~F.array_contains("way", F.col("w"))).select("cluster_id", F.concat("way", F.array("w")).alias("way"), F.col("v").alias("u"), F.col("w").alias("v"))
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out
