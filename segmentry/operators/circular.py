"""Paths that look like circular RNA: repeated or nested segments behind tandem duplications.

Rows of a path's hops hold both nodes as structs ``a`` and ``b`` (node_id, chrom, strand, exons), ``i`` (from 1), ``n`` (hops of the path) and ``kind``.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segmentry.functions import cigar as C
from segmentry.operators.absorb import best_annotated
from segmentry.operators.ranges import range_join


def _start(x: str) -> Column:
    return F.element_at(f"{x}.exons", 1)["start"]


def _end(x: str) -> Column:
    return F.element_at(f"{x}.exons", -1)["end"]


def _within(small: Column, large: Column) -> Column:
    return F.size(F.array_except(small, large)) == 0


def back_ordered() -> Column:
    """The nodes share no exon, and on their strand the first lies wholly behind the second."""
    plus = F.col("a.strand") == "+"
    apart = ~F.arrays_overlap("a.exons", "b.exons") & (F.col("a.chrom") == F.col("b.chrom")) & (F.col("a.strand") == F.col("b.strand"))
    return apart & F.when(plus, _start("a") > _end("b")).otherwise(_end("a") < _start("b"))


def common_annotated(hops: DataFrame, spans: DataFrame, anchors: list[Column], name: str) -> DataFrame:
    """path_id, i and ``name`` of the annotated items of which each anchor lies in a span: chrom, strand, ``name``, s, e."""
    at = hops.select("path_id", "i", F.concat("a.chrom", "a.strand").alias("_k1"), F.posexplode(F.array(*anchors)).alias("anchor", "pos"))
    known = spans.select(name, F.concat("chrom", "strand").alias("_k2"), "s", "e")
    hit = range_join(at, known, (F.col("pos") >= F.col("s")) & (F.col("pos") < F.col("e")), ("_k1", "_k2"), ("pos", "pos"), ("s", "e"), width=1000)
    return hit.groupBy("path_id", "i", name).agg(F.count_distinct("anchor").alias("c")).where(F.col("c") == len(anchors)).select("path_id", "i", name)


def in_one_intron(hops: DataFrame, introns: DataFrame) -> DataFrame:
    """path_id and i of hops between back-ordered nodes that lie in one annotated intron, or have one exon each. ``introns`` has chrom, strand, intron, s and e."""
    back = hops.where(back_ordered())
    plus = F.col("a.strand") == "+"
    outer = [F.when(plus, _end("a")).otherwise(_start("a")), F.when(plus, _start("b")).otherwise(_end("b"))]
    inside = common_annotated(back, introns, outer, "intron").select("path_id", "i").distinct()
    return inside.unionByName(back.where((F.size("a.exons") == 1) & (F.size("b.exons") == 1)).select("path_id", "i")).distinct()


def in_one_transcript(hops: DataFrame, exons: DataFrame) -> DataFrame:
    """path_id and i of hops between nodes of a strand without a common exon, all of whose ends lie in exons of one transcript. ``exons`` has chrom, strand, tx, s and e."""
    apart = hops.where(~F.arrays_overlap("a.exons", "b.exons") & (F.col("a.chrom") == F.col("b.chrom")) & (F.col("a.strand") == F.col("b.strand")))
    return common_annotated(apart, exons, [_start("a"), _end("a"), _start("b"), _end("b")], "tx").select("path_id", "i").distinct()


def superposed(nodes: DataFrame, exons: DataFrame, margin: int = 10) -> DataFrame:
    """node_id of nodes all of whose exons lie on the annotated exon that they fill most. ``exons`` has chrom, strand, e_start and e_end."""
    e = nodes.select("node_id", F.concat("chrom", "strand").alias("k1"), F.posexplode("exons").alias("i", "x")).select("node_id", "k1", "i", "x.start", "x.end")
    known = exons.select(F.concat("chrom", "strand").alias("k2"), "e_start", "e_end").distinct().withColumn("s", F.col("e_start") - margin).withColumn("t", F.col("e_end") + margin)
    hit = range_join(e, known, (F.col("start") >= F.col("s")) & (F.col("end") <= F.col("t")), ("k1", "k2"), ("start", "end"), ("s", "t"), width=1000)
    return best_annotated(e, hit, margin).groupBy("node_id").agg(F.bool_and("fits").alias("all")).where("all").select("node_id")


def circular_paths(hops: DataFrame, exons: DataFrame, introns: DataFrame, near: int = 10) -> DataFrame:
    """path_id of paths that look circular.

    One hop, a tandem duplication: nested nodes or a common end, the longer one on annotated exons; or a loop
    in one transcript; or ends within ``near`` and equal introns; or a loop in an intron. More hops: all are duplications, the
    first node lies in the second, the last in that before it, and those between are equal; or one duplication has near ends and equal introns.
    """
    x = hops.withColumn("ia", C.gaps(F.col("a.exons"))).withColumn("ib", C.gaps(F.col("b.exons")))
    tdup = F.col("kind") == "TDUP"
    spliced = (F.size("ia") > 0) & (F.size("ib") > 0)
    a_in_b = _within(F.col("a.exons"), F.col("b.exons")) | (spliced & _within(F.col("ia"), F.col("ib")))
    b_in_a = _within(F.col("b.exons"), F.col("a.exons")) | (spliced & _within(F.col("ib"), F.col("ia")))
    starts, ends = F.abs(_start("a") - _start("b")) <= near, F.abs(_end("a") - _end("b")) <= near
    alike = tdup & (starts | ends) & (F.col("ia") == F.col("ib"))
    size = lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda s, e: s + e["end"] - e["start"])
    longest = F.when(size("a.exons") >= size("b.exons"), F.col("a.node_id")).otherwise(F.col("b.node_id"))
    nested = a_in_b | b_in_a | (_start("a") == _start("b")) | (_end("a") == _end("b"))

    one = x.where(tdup & (F.col("n") == 1))
    on = superposed(one.select(F.explode(F.array("a", "b")).alias("x")).select("x.node_id", "x.chrom", "x.strand", "x.exons").dropDuplicates(["node_id"]), exons)
    found = one.where(nested).withColumn("node_id", longest).join(on, "node_id", "left_semi").select("path_id")
    margin = exons.select("chrom", "strand", "tx", (F.col("e_start") - near).alias("s"), (F.col("e_end") + near).alias("e"))
    found = found.unionByName(in_one_transcript(one, margin).select("path_id")).unionByName(in_one_intron(one, introns).select("path_id"))
    found = found.unionByName(x.where(alike).select("path_id"))

    bare = lambda c: F.size(c) == 0
    first = a_in_b | (bare("ia") & (starts | ends))
    last = b_in_a | (bare("ib") & (starts | ends))
    middle = (F.array_sort("a.exons") == F.array_sort("b.exons")) | (starts & ends)
    fits = F.when(F.col("i") == 1, first).when(F.col("i") == F.col("n"), last).otherwise(middle)
    whole = x.where("n > 1").groupBy("path_id").agg(F.bool_and(tdup & fits).alias("all")).where("all").select("path_id")
    return found.unionByName(whole).distinct()


def filter_circular(paths: DataFrame, hops: DataFrame, exons: DataFrame, introns: DataFrame, mode: str = "remove") -> DataFrame:
    """``paths`` (path_id) without those that look circular, or only those (``extract``), or all (``keep``)."""
    if mode == "keep":
        return paths
    return paths.join(circular_paths(hops, exons, introns), "path_id", "left_anti" if mode == "remove" else "left_semi")


def hops_of(steps: DataFrame, kind: Column) -> DataFrame:
    """Hops of paths from their ``steps``: path_id, place and node, a struct; ``kind`` may use both nodes, ``a`` and ``b``."""
    w = Window.partitionBy("path_id").orderBy("place")
    x = steps.select("path_id", "place", F.col("node").alias("a"), F.lead("node").over(w).alias("b")).where("b is not null")
    x = x.withColumn("i", F.row_number().over(w)).withColumn("n", F.count("*").over(Window.partitionBy("path_id")))
    return x.withColumn("kind", kind).drop("place")
