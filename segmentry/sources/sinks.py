"""Text forms of results: one line per row, written by Spark as text files.

Lines of a file have ``place``, by which they are ordered: part (0 for the header), n, key and pos.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def place(part: int, n: Column | int = 0, key: Column | str = "", pos: Column | int = 0) -> Column:
    of = lambda x, kind: (x if isinstance(x, Column) else F.lit(x)).cast(kind)
    return F.struct(F.lit(part).alias("part"), of(n, "long").alias("n"), of(key, "string").alias("key"), of(pos, "long").alias("pos")).alias("place")


def write_lines(lines: DataFrame, path: str) -> None:
    """Write ``lines`` (place and line) into the folder ``path``: its part files in turn are one file, header first.

    The lines are dealt by ranges of their places and sorted within them, so no task holds more than its range.
    """
    lines.repartitionByRange("place", "line").sortWithinPartitions("place", "line").select("line").write.text(path)


def gtf_lines(transcripts: DataFrame, steps: DataFrame) -> DataFrame:
    """A line of each transcript (path_id, sr) and the exon lines of its nodes (path_id, place, node, chrom, strand, exons, ptc, ptf): 1-based starts, exons numbered on the strand."""
    tag = lambda name, c: F.concat(F.lit(f'{name} "'), c.cast("string"), F.lit('"'))
    about = lambda *tags: F.concat(F.concat_ws("; ", *tags), F.lit(";"))
    dots = lambda n: [F.lit(".")] * n
    whole = transcripts.select(F.concat_ws("\t", F.lit("."), F.lit("segmentry"), F.lit("transcript"), *dots(5), about(tag("transcript_id", F.col("path_id")), tag("sr", F.col("sr")), tag("osr", F.col("sr")))).alias("line"), place(1, F.col("path_id"), pos=-1))
    x = steps.select("*", F.size("exons").alias("n"), F.posexplode("exons").alias("p", "exon"))
    number = F.lpad(F.when(F.col("strand") == "-", F.col("n") - F.col("p")).otherwise(F.col("p") + 1).cast("string"), 3, "0")
    tags = about(tag("transcript_id", F.col("path_id")), tag("segment_id", F.col("node")), tag("exon_id", number), tag("ptc", F.col("ptc")), tag("ptf", F.format_string("%.9f", "ptf")))
    fields = [F.col("chrom"), F.lit("segmentry"), F.lit("exon"), (F.col("exon.start") + 1).cast("string"), F.col("exon.end").cast("string"), F.lit("."), F.col("strand"), F.lit(".")]
    at = F.col("place").cast("long") * (1 << 24) + F.when(F.col("strand") == "-", F.col("n") - F.col("p")).otherwise(F.col("p"))
    return whole.unionByName(x.select(F.concat_ws("\t", *fields, tags).alias("line"), place(1, F.col("path_id"), pos=at)))


#: Names, numbers, types and meanings of what a record tells.
INFO = (
    ("SVTYPE", "1", "String", "Type of the link"), ("CHR2", "1", "String", "Chromosome of the other side"), ("SVEND", "1", "Integer", "Position of the other side"), ("SR", "1", "Integer", "Reads"),
    ("OSR", "1", "Integer", "Reads before rescue"), ("SR_ID", ".", "String", "Names of the reads"), ("TRANSCRIPT_ID", ".", "String", "Paths with the link"), ("SEGMENT1", ".", "String", "Nodes on this side"), ("SEGMENT2", ".", "String", "Nodes on the other side"),
)


def vcf_lines(links: DataFrame, contigs: DataFrame) -> DataFrame:
    """Header lines for the contigs (chrom) and types, and one record per link (link, chrom1, pos1, chrom2, pos2, sr, sr_ids, paths, segments1, segments2), by contig and position. Semicolons part the entries of a record, so within them they become ``&``."""
    text = lambda name, c: F.concat(F.lit(f";{name}="), F.replace(F.col(c).cast("string"), F.lit(";"), F.lit("&")))
    info = F.concat(F.lit("SVTYPE="), "link", *(text(n, c) for n, c in (("CHR2", "chrom2"), ("SVEND", "pos2"), ("SR", "sr"), ("OSR", "sr"), ("SR_ID", "sr_ids"), ("TRANSCRIPT_ID", "paths"), ("SEGMENT1", "segments1"), ("SEGMENT2", "segments2"))))
    body = links.select(F.concat_ws("\t", "chrom1", F.col("pos1").cast("string"), F.lit("."), F.lit("N"), F.concat(F.lit("<"), "link", F.lit(">")), F.lit("."), F.lit("PASS"), info).alias("line"), place(1, key=F.col("chrom1"), pos=F.col("pos1")))
    head = contigs.select(F.concat(F.lit("##contig=<ID="), "chrom", F.lit(">")).alias("line"), place(0, 1, F.col("chrom")))
    kinds = links.select("link").distinct().select(F.concat(F.lit("##ALT=<ID="), "link", F.lit(',Description="Link">')).alias("line"), place(0, 2, F.col("link")))
    fixed = [("##fileformat=VCFv4.2", 0), *((f'##INFO=<ID={name},Number={n},Type={kind},Description="{about}">', 3) for name, n, kind, about in INFO), ("\t".join(("#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO")), 4)]
    fixed = links.sparkSession.createDataFrame(fixed, "line string, n long").select("line", place(0, F.col("n")))
    return fixed.unionByName(head).unionByName(kinds).unionByName(body)


def graph_json(edges: DataFrame) -> DataFrame:
    """One line of JSON per start node: its edges with their support, in order."""
    item = F.struct("dst", "sr")
    return edges.groupBy("src").agg(F.array_sort(F.collect_list(item)).alias("edges")).select(F.to_json(F.struct("src", "edges")).alias("line"))


def parse_graph_json(lines: DataFrame) -> DataFrame:
    """Edges (src, dst, sr) of lines as ``graph_json`` makes them; lines that are no such JSON give none."""
    x = lines.select(F.from_json("line", "src string, edges array<struct<dst:string,sr:bigint>>").alias("x"))
    return x.select("x.src", F.explode("x.edges").alias("e")).select("src", "e.dst", "e.sr")


def nodelink_json(nodes: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """One graph per key as JSON: its nodes and its links with their support, in order."""
    n = nodes.groupBy(key).agg(F.array_sort(F.collect_set(F.struct(F.col("node").alias("id")))).alias("nodes"))
    e = edges.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col("src").alias("source"), F.col("dst").alias("target"), "sr"))).alias("links"))
    none = F.array().cast("array<struct<source:string,target:string,sr:bigint>>")
    return n.join(e, key, "left").select(F.to_json(F.struct(F.lit(True).alias("directed"), F.col(key).alias("graph"), "nodes", F.coalesce("links", none).alias("links"))).alias("line"))


def tsg_lines(nodes: DataFrame, edges: DataFrame, paths: DataFrame, key: str) -> DataFrame:
    """Records of graphs by tabs: H (version), G (nodes of a graph), N, E with support, and P with the reads of a path."""
    line = lambda *cs: F.concat_ws("\t", *(F.lit(c) if len(c) == 1 or ":" in c else F.col(c).cast("string") for c in cs)).alias("line")
    tag = lambda name, c: F.concat(F.lit(f"{name}:i:"), F.col(c).cast("string")).alias(name)
    at = lambda pos: place(1, F.col(key), pos=pos)
    out = nodes.select(key).distinct().select(line("H", "VN:Z:1", key), at(0))
    out = out.unionByName(nodes.groupBy(key).agg(F.count("*").alias("n_nodes")).select(line("G", key, "n_nodes"), at(1))).unionByName(nodes.select(line("N", key, "node"), at(2)))
    out = out.unionByName(edges.withColumn("tag", tag("sr", "sr")).select(line("E", key, "src", "dst", "tag"), at(3)))
    steps = paths.withColumn("steps", F.replace("path", F.lit("|"), F.lit(","))).withColumn("tag", tag("ptc", "reads"))
    return out.unionByName(steps.select(line("P", key, "path_id", "steps", "tag"), at(4)))


def cluster_json(paths: DataFrame, pairs: DataFrame) -> DataFrame:
    """One graph per cluster as JSON, undirected: its paths (path_id, cluster_id, read_id, path_info) and the similar pairs (path1, path2)."""
    n = paths.withColumn("id", F.col("path_id").cast("string")).groupBy("cluster_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("path_id", F.struct(F.struct("id", "cluster_id", "read_id", "path_info").alias("data")).alias("x")))), lambda s: s["x"]).alias("nodes")
    )
    edge = F.struct(F.struct(F.col("path1").cast("string").alias("source"), F.col("path2").cast("string").alias("target")).alias("data")).alias("x")
    e = pairs.join(paths.select(F.col("path_id").alias("path1"), "cluster_id"), "path1").groupBy("cluster_id")
    e = e.agg(F.transform(F.array_sort(F.collect_list(F.struct("path1", "path2", edge))), lambda s: s["x"]).alias("edges"))
    none = F.array().cast("array<struct<data:struct<source:string,target:string>>>")
    parts = F.struct("nodes", F.coalesce("edges", none).alias("edges")).alias("elements")
    whole = F.struct(F.array().cast("array<string>").alias("data"), F.lit(False).alias("directed"), F.lit(False).alias("multigraph"), parts)
    return n.join(e, "cluster_id", "left").select("cluster_id", F.to_json(whole).alias("line"))


def parse_nodelink(lines: DataFrame) -> DataFrame:
    """Edges (graph, src, dst, sr) of lines of node-link JSON; lines that are none give none."""
    x = lines.select(F.from_json("line", "graph bigint, links array<struct<source:string,target:string,sr:bigint>>").alias("x"))
    return x.select("x.graph", F.explode("x.links").alias("e")).select("graph", F.col("e.source").alias("src"), F.col("e.target").alias("dst"), "e.sr")


def parse_cytoscape(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (id) and edges (src, dst) of lines of Cytoscape JSON."""
    x = lines.select(F.from_json("line", "elements struct<nodes:array<struct<data:struct<id:string>>>,edges:array<struct<data:struct<source:string,target:string>>>>").alias("x"))
    nodes = x.select(F.explode("x.elements.nodes").alias("n")).select("n.data.id")
    return nodes, x.select(F.explode("x.elements.edges").alias("e")).select(F.col("e.data.source").alias("src"), F.col("e.data.target").alias("dst"))
