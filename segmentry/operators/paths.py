"""Hops in transcription order, payloads of edges, and measures of paths."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segmentry.operators.events import classify, microhomology
from segmentry.operators.graph import nodes_of, structures
from segmentry.shared import stored


def with_donor(hops: DataFrame) -> DataFrame:
    """Add ``donor``, the upstream side (1 or 2): a + side that matches before its clip, or a - side after it. Null where strands and modes don't fit."""
    fits = (F.col("strand1") == F.col("strand2")) == (F.col("mode1") != F.col("mode2"))
    return hops.withColumn("donor", F.when(fits, F.when((F.col("strand1") == "+") == (F.col("mode1") == "MS"), 1).otherwise(2)))


def order_transcription(hops: DataFrame) -> DataFrame:
    """Hops upstream first: segments ``up`` and ``down``; a read's hops are numbered backwards where its second doesn't go on from its first."""
    first = F.col("donor") == 1
    x = with_donor(hops).where("donor is not null")
    x = x.withColumn("up", F.when(first, F.col("seg_ord1")).otherwise(F.col("seg_ord2"))).withColumn("down", F.when(first, F.col("seg_ord2")).otherwise(F.col("seg_ord1")))
    read = Window.partitionBy("read_id")
    w = read.orderBy("seg_ord1")
    x = x.withColumn("i", F.row_number().over(w) - 1).withColumn("breaks", (F.lag("down").over(w) != F.col("up")) & (F.row_number().over(w) == 2))
    back = F.coalesce(F.bool_or("breaks").over(read), F.lit(False))
    number = F.when(back, F.count("*").over(read) - 1 - F.col("i")).otherwise(F.col("i"))
    return x.withColumn("hop_ord", number.cast("int")).drop("i", "breaks")


def with_payload(hops: DataFrame) -> DataFrame:
    """Add what a junction holds: an insertion (gap over 0), shared sequence (under 0) or nothing, its length and its score."""
    x = microhomology(hops)
    kind = F.when(F.col("gap") > 0, "NovelInsertion").when(F.col("gap") < 0, "MicroHomology").otherwise("none")
    score = F.when(F.col("gap") == 0, 2).when(F.col("gap") < 0, 1).otherwise(0)
    return x.withColumn("payload", kind).withColumn("payload_len", F.abs("gap")).withColumn("payload_score", score)


def filter_microinsertion(hops: DataFrame, most: int = 500) -> DataFrame:
    """Hops with at most ``most`` bases between their sides."""
    return microhomology(hops).where(F.col("gap") <= most)


def filter_max_insertion(hops: DataFrame, most: int = 50) -> DataFrame:
    """Reads whose longest insertion at a junction has ``most`` bases or fewer, with its length."""
    return microhomology(hops).groupBy("read_id").agg(F.max(F.greatest("gap", F.lit(0))).alias("longest")).where(F.col("longest") <= most)


def filter_rt_switching(hops: DataFrame, most: int = 10) -> DataFrame:
    """Hops whose sides share ``most`` bases at most; more points to template switching."""
    return microhomology(hops).where(F.col("gap") >= -most)


def filter_all_hops_kept(kept: DataFrame, segments: DataFrame) -> DataFrame:
    """Reads of two segments or more all of whose hops are in ``kept``."""
    n = segments.groupBy("read_id").agg((F.count("*") - 1).alias("hops")).where("hops > 0")
    return n.join(kept.groupBy("read_id").agg(F.count("*").alias("left")), "read_id").where("left = hops").select("read_id", "hops")


def path_steps(segments: DataFrame) -> DataFrame:
    """path_id, place and node of each step of the different paths."""
    return structures(segments).select("path_id", F.posexplode(F.split("path", r"\|")).alias("place", "node"))


def path_support(segments: DataFrame, edges: DataFrame) -> DataFrame:
    """Smallest and summed support over a path's edges."""
    w = Window.partitionBy("path_id").orderBy("place")
    hops = path_steps(segments).select("path_id", F.col("node").alias("src"), F.lead("node").over(w).alias("dst")).where("dst is not null")
    return hops.join(edges, ["src", "dst"]).groupBy("path_id").agg(F.min("sr").alias("sr"), F.sum("sr").alias("sum_sr"))


def most_voted(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The most frequent value of each key with its votes; ties go to the smallest."""
    votes = df.groupBy(*keys, value).agg(F.count("*").alias("votes"))
    w = Window.partitionBy(*keys).orderBy(F.desc("votes"), value)
    return votes.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def read_shapes(segments: DataFrame) -> DataFrame:
    """steps (seg_ord, node, chrom and, where another segment follows, link, pos1 and pos2 of the hop by ``classify``), the path's text and ``own``, the reads of these steps in order.

    ``segments`` are ``nodes_of`` ones. Reads that are alike in all of it are one row, so what follows moves each read once and not with each of its hops.
    """
    w = Window.partitionBy("read_id").orderBy("seg_ord")
    sides = ("chrom", "strand", "ref_start", "ref_end", "mode")
    x = segments.select("read_id", "seg_ord", "node", *(F.col(c).alias(f"{c}1") for c in sides), *(F.lead(c).over(w).alias(f"{c}2") for c in sides))
    x = classify(x)
    hop = (F.when(F.col("chrom2").isNotNull(), F.col(c)).alias(c) for c in ("link", "pos1", "pos2"))
    x = x.select("read_id", F.struct("seg_ord", "node", F.col("chrom1").alias("chrom"), *hop).alias("step"))
    x = x.groupBy("read_id").agg(F.array_sort(F.collect_list("step")).alias("steps"))
    path = F.array_join(F.transform("steps", lambda s: s["node"]), "|")
    return x.groupBy("steps").agg(F.array_sort(F.collect_list("read_id")).alias("own")).withColumn("path", path)


def links_with_paths(shapes: DataFrame) -> DataFrame:
    """Each link with its reads counted and listed, the ids of its paths and the nodes on both sides, joined by commas. ``shapes`` are ``read_shapes``; a path's id is its smallest read."""
    keys = ["link", "chrom1", "pos1", "chrom2", "pos2"]
    ids = shapes.groupBy("path").agg(F.min(F.element_at("own", 1)).alias("path_id"))
    # A read of a shape may have a link twice, but is counted once.
    n = F.size("steps") - 1
    hop = lambda a, b: F.struct(a["link"].alias("link"), a["chrom"].alias("chrom1"), a["pos1"].alias("pos1"), b["chrom"].alias("chrom2"), a["pos2"].alias("pos2"), a["node"].alias("node1"), b["node"].alias("node2"))
    between = F.zip_with(F.slice("steps", F.lit(1), n), F.slice("steps", F.lit(2), n), hop)
    hops = shapes.join(ids, "path").select("path_id", "own", F.explode(between).alias("hop")).select("path_id", "own", "hop.*")
    text = lambda c: F.array_join(F.transform(F.array_sort(c), lambda p: p.cast("string")), ",")
    out = hops.groupBy(*keys).agg(F.array_distinct(F.flatten(F.collect_list("own"))).alias("own"), text(F.collect_set("path_id")).alias("paths"), *(text(F.collect_set(f"node{i}")).alias(f"segments{i}") for i in (1, 2)))
    return out.select(*keys, F.size("own").cast("long").alias("sr"), "paths", text("own").alias("sr_ids"), "segments1", "segments2")


def enumerate_paths(edges: DataFrame, least: int = 1) -> DataFrame:
    """All ways from a node without predecessor to one without successor over edges of support ``least``: ``path``, ``n_nodes``, ``circle``.

    One join per step; a way that comes back to a node of its own ends there and is marked.
    Rounds are as many as the longest way has nodes.
    """
    e = stored(edges.where(F.col("sr") >= least).select("src", "dst"), "edges")
    src, dst = e.select(F.col("src").alias("node")).distinct(), e.select(F.col("dst").alias("node")).distinct()
    ways = src.join(dst, "node", "left_anti").select(F.array("node").alias("way"), F.lit(False).alias("circle"))
    done = []
    while True:
        ways = stored(ways.withColumn("last", F.element_at("way", -1)), "ways")
        live = ways.where("not circle")
        done.append(ways.where("circle").select("way", "circle").unionByName(live.join(src, F.col("last") == F.col("node"), "left_anti").select("way", "circle")))
        if live.isEmpty():
            break
        step = live.join(e, F.col("last") == F.col("src"))
        ways = step.select(F.concat("way", F.array("dst")).alias("way"), F.array_contains("way", F.col("dst")).alias("circle"))
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out.select(F.array_join("way", "|").alias("path"), F.size("way").alias("n_nodes"), "circle")


def best_hits(hits: DataFrame, key: str, score: Column, tie: str, top: int = 3, identity: Column | None = None, over: float = 0.9) -> DataFrame:
    """The ``top`` hits of each key by score with a quality from 0 to 60 by the lead over the next; of them those over an ``identity`` and on no patch contig."""
    w = Window.partitionBy(key).orderBy(F.desc("score"), tie)
    x = hits.withColumn("score", score).withColumn("rank", F.row_number().over(w)).withColumn("next", F.lead("score").over(w)).where(F.col("rank") <= top)
    lead = F.least(F.floor(F.lit(60) * (F.col("score") - F.col("next")) / F.col("score")), F.lit(60))
    if identity is not None:
        x = x.where((identity > over) & ~F.col("chrom").contains("_"))
    return x.withColumn("hit_mapq", F.when(F.col("next").isNull(), 60).when(F.col("next") == F.col("score"), 0).otherwise(lead).cast("int"))
