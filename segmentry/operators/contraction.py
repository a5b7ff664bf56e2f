"""Graphs of read paths whose nodes have been merged: contraction, breakpoints, payloads, genes."""

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from segmentry.operators.components import connected_components
from segmentry.operators.ranges import near_pairs, range_join, union
from segmentry.shared import stored


@dataclass
class Graph:
    """Tables of a graph.

    ``nodes``: node_id, chrom, strand and exons (an array of start and end). ``edges``: src, dst, pos1 and pos2 (the breakpoints on either side) and gap (bases between them: over 0 inserted, under 0
    shared). ``edge_reads``: src, dst, read_id, a row for each read of an edge, so that no list of reads has to fit into a row. It may have ``n`` too: a row then stands for
    ``n`` reads with the same edges, by the name of one of them, and no row is there twice.
    """

    nodes: DataFrame
    edges: DataFrame
    edge_reads: DataFrame

    def support(self) -> DataFrame:
        """src, dst and sr, the different reads."""
        sr = F.sum("n") if "n" in self.edge_reads.columns else F.count_distinct("read_id")
        return self.edge_reads.groupBy("src", "dst").agg(sr.alias("sr"))


def labels(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """node_id and merged: the smallest node that pairs (node1, node2) lead to."""
    parts = connected_components(pairs, "node1", "node2").select(F.col("node").alias("node_id"), "component")
    return nodes.select("node_id").join(parts, "node_id", "left").select("node_id", F.coalesce("component", "node_id").alias("merged"))


def rewired(edges: DataFrame, merged: DataFrame) -> DataFrame:
    """``edges`` with both ends renamed by ``merged`` (node_id, merged); loops are gone."""
    for end in ("src", "dst"):
        edges = edges.join(merged.select(F.col("node_id").alias(end), F.col("merged").alias(f"_{end}")), end).drop(end).withColumnRenamed(f"_{end}", end)
    return edges.where("src <> dst")


def edge_rank(gap: str = "gap"):
    """2 for blunt junctions, 1 for shared bases, 0 for inserted ones."""
    return F.when(F.col(gap) == 0, 2).when(F.col(gap) < 0, 1).otherwise(0)


def merged_nodes(nodes: DataFrame, merged: DataFrame) -> DataFrame:
    """node_id, chrom, strand, members and exons of the nodes of each label, their exons united."""
    x = nodes.join(merged, "node_id")
    spans = union(x.select("merged", F.explode("exons").alias("e")).select("merged", "e.start", "e.end"), "merged", "start", "end")
    exons = spans.groupBy("merged").agg(F.array_sort(F.collect_list(F.struct(F.col("u_start").alias("start"), F.col("u_end").alias("end")))).alias("exons"))
    named = x.groupBy("merged").agg(F.min("chrom").alias("chrom"), F.min("strand").alias("strand"), F.count("*").alias("members")).join(exons, "merged")
    return named.withColumnRenamed("merged", "node_id")


def contract(graph: Graph, merged: DataFrame) -> Graph:
    """The graph with nodes of one label as one.

    Exons of a merged node are the unions of its members' exons. Parallel edges become one: its breakpoints are the outermost of the junction (the largest before
    it on a + strand and the smallest on a - strand, the other way round after it), its gap is the one of the edge with most reads; of equal ones blunt
    before shared before inserted, then the smallest gap. Every row is moved by equi-joins with the labels, and
    edges are aggregated before they are shuffled, so a node that many others merge into is no task of its own.
    """
    nodes = merged_nodes(graph.nodes, merged)
    strand = graph.nodes.select("node_id", "strand")
    own = graph.edges.join(graph.support(), ["src", "dst"])
    for i, end in ((1, "src"), (2, "dst")):
        own = own.join(strand.select(F.col("node_id").alias(end), F.col("strand").alias(f"strand{i}")), end)
    best = F.max_by("gap", F.struct("sr", edge_rank(), -F.col("gap"))).alias("gap")
    ends = {f"{f}{i}": getattr(F, f)(f"pos{i}").alias(f"{f}{i}") for f in ("min", "max") for i in (1, 2)}
    folded = rewired(own, merged).groupBy("src", "dst", "strand1", "strand2").agg(best, *ends.values())
    one, two = F.when(F.col("strand1") == "+", F.col("max1")).otherwise(F.col("min1")), F.when(F.col("strand2") == "+", F.col("min2")).otherwise(F.col("max2"))
    edges = folded.select("src", "dst", one.alias("pos1"), two.alias("pos2"), "gap")
    # Edges are renamed first, so the reads' rows are moved once.
    names = rewired(graph.edges.select("src", "dst", F.col("src").alias("_a"), F.col("dst").alias("_b")), merged)
    reads = graph.edge_reads.withColumnsRenamed({"src": "_a", "dst": "_b"}).join(names, ["_a", "_b"]).drop("_a", "_b").distinct()
    return Graph(nodes, edges, reads.select("src", "dst", *(c for c in reads.columns if c not in ("src", "dst"))))


def clusters(graph: Graph) -> DataFrame:
    """node_id and cluster_id, the smallest node that edges in either direction lead to."""
    return labels(graph.nodes, graph.edges.select(F.col("src").alias("node1"), F.col("dst").alias("node2"))).withColumnRenamed("merged", "cluster_id")


def breakpoint_votes(graph: Graph, merged: DataFrame) -> DataFrame:
    """node_id, side, pos and votes of each start and end node of the contracted graph: the position of its junctions that most members have; of equal ones the smallest.

    ``graph`` is the graph before contraction. A start node is one that no edge of the contracted graph leads to; its junctions are those of its members' outgoing edges.
    """
    edges = rewired(graph.edges, merged).select("src", "dst", "pos1", "pos2")
    start = edges.select(F.col("src").alias("node_id"), F.lit("start").alias("side"), F.col("pos1").alias("pos")).join(edges.select(F.col("dst").alias("node_id")).distinct(), "node_id", "left_anti")
    end = edges.select(F.col("dst").alias("node_id"), F.lit("end").alias("side"), F.col("pos2").alias("pos")).join(edges.select(F.col("src").alias("node_id")).distinct(), "node_id", "left_anti")
    votes = start.unionByName(end).groupBy("node_id", "side", "pos").agg(F.count("*").alias("votes"))
    best = votes.groupBy("node_id", "side").agg(F.max_by(F.struct("pos", "votes"), F.struct("votes", -F.col("pos"))).alias("b"))
    return best.select("node_id", "side", "b.pos", "b.votes")


def majority_genes(graph: Graph, genes: DataFrame) -> DataFrame:
    """cluster_id, gene and votes: the gene over most nodes of a cluster; of equal ones the first by name. ``genes``: gene, chrom, g_start, g_end."""
    spans = graph.nodes.select("node_id", "chrom", F.element_at("exons", 1)["start"].alias("n_start"), F.element_at("exons", -1)["end"].alias("n_end")).join(clusters(graph), "node_id")
    on = (F.col("n_start") < F.col("g_end")) & (F.col("g_start") < F.col("n_end"))
    hit = range_join(spans, genes.withColumnRenamed("chrom", "g_chrom"), on, ("chrom", "g_chrom"), ("n_start", "n_end"), ("g_start", "g_end"))
    votes = hit.groupBy("cluster_id", "gene").agg(F.count_distinct("node_id").alias("votes"))
    first = Window.partitionBy("cluster_id").orderBy(F.desc("votes"), "gene")
    return votes.withColumn("_r", F.row_number().over(first)).where("_r = 1").select("cluster_id", "gene", "votes")


def node_reads(graph: Graph) -> DataFrame:
    """node_id and reads, the different reads of its edges."""
    ends = F.explode(F.array("src", "dst")).alias("node_id")
    return graph.edge_reads.select(ends, "read_id").groupBy("node_id").agg(F.count_distinct("read_id").alias("reads"))


def refine(graph: Graph, tolerance: int = 10) -> tuple[Graph, DataFrame]:
    """The graph without near nodes, and node_id and merged (its name in the result) of each node.

    Nodes of one chromosome, strand and list of introns whose spans agree within ``tolerance`` at both ends, directly or through
    others, become one, named by the one of most reads, then the smallest. As unions widen spans, new pairs may come near: contraction goes on until there
    is none. Edges of common neighbours are folded, others move, and the reads of the graph stay what they are but for edges within a merged node.
    """
    names = stored(graph.nodes.select("node_id", F.col("node_id").alias("merged")), "names")
    while True:
        inner = F.transform(F.sequence(F.lit(2), F.size("exons")), lambda i: F.struct(F.element_at("exons", (i - 1).cast("int"))["end"], F.element_at("exons", i.cast("int"))["start"]))
        introns = F.when(F.size("exons") > 1, F.to_json(inner)).otherwise("")
        spans = graph.nodes.select("node_id", "chrom", "strand", introns.alias("introns"), F.element_at("exons", 1)["start"].alias("n_start"), F.element_at("exons", -1)["end"].alias("n_end"))
        pairs = stored(near_pairs(spans, ["chrom", "strand", "introns"], "node_id", "n_start", "n_end", tolerance).select(F.col("node_id1").alias("node1"), F.col("node_id2").alias("node2")), "near")
        if pairs.isEmpty():
            return graph, names
        own = labels(graph.nodes, pairs).join(node_reads(graph), "node_id", "left")
        first = own.groupBy("merged").agg(F.min_by("node_id", F.struct(-F.coalesce("reads", F.lit(0)), F.col("node_id"))).alias("primary"))
        step = stored(own.join(first, "merged").select("node_id", F.col("primary").alias("merged")), "step")
        names = stored(names.join(step.select(F.col("node_id").alias("merged"), F.col("merged").alias("_to")), "merged").select("node_id", F.col("_to").alias("merged")), "names")
        made = contract(Graph(graph.nodes.select("node_id", "chrom", "strand", "exons"), graph.edges, graph.edge_reads), step)
        graph = Graph(stored(made.nodes, "nodes"), stored(made.edges, "edges"), stored(made.edge_reads, "edge_reads"))
