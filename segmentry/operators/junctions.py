"""What lies at junctions, and where segments of a read are found again."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segmentry.functions import cigar as C
from segmentry.operators.events import microhomology
from segmentry.operators.genome import genome_slice, stranded


def matched(bases: Column, strand: Column, lt: Column, rt: Column) -> Column:
    """The read's bases inside the clips, in the read's own direction; the clips are the alignment's."""
    # What the left clip of a turned alignment covers is the read's end.
    return F.substring(bases, F.when(strand == "-", rt).otherwise(lt) + 1, F.length(bases) - lt - rt)


def mean_quality(qualities: Column, lt: Column, rt: Column, missing: float = 40.0) -> Column:
    """Mean quality inside the clips; ``missing`` where there are no qualities."""
    part = F.slice(qualities, lt + 1, F.size(qualities) - lt - rt)
    return F.coalesce(F.aggregate(part, F.lit(0).cast("bigint"), lambda a, q: a + q) / F.size(part), F.lit(missing))


def mean_quality_at(quality: Callable[[Column], Column], start: Column, size: Column) -> Column:
    """Mean of the qualities that ``quality`` gives for ``size`` places from ``start`` (from 0) on; no other place is looked at, and no array is made of them."""
    return F.aggregate(F.sequence(start, start + size - 1), F.lit(0).cast("bigint"), lambda a, i: a + quality(i)) / size


def base_affix_length(a: Column, b: Column, right: bool) -> Column:
    """``affix_length`` of short bases, by one pattern and without a list of all lengths; texts must have no ``|``."""
    if right:
        a, b = F.reverse(a), F.reverse(b)
    found = F.coalesce(F.length(F.regexp_extract(F.concat(a, F.lit("|"), b), r"^([^|]*)[^|]*\|\1", 1)), F.lit(0))
    return found if right else F.when(a == b, 0).otherwise(found)


def affix_length(a: Column, b: Column, right: bool) -> Column:
    """Length of the longest common suffix, or prefix; the prefix of equal texts counts as 0."""
    cut = F.right if right else F.left
    n = F.least(F.length(a), F.length(b))
    sizes = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    found = F.coalesce(F.array_max(F.filter(sizes, lambda i: cut(a, i) == cut(b, i))), F.lit(0))
    return found if right else F.when(a == b, 0).otherwise(found)


def insertion_flanks(cigar: Column, size: Column) -> dict[str, Column]:
    """Text before and after the first insertion of ``size`` and the read lengths (M, I, S) of both."""
    mark = F.concat(size.cast("string"), F.lit("I"))
    # The mark must not be the end of a longer number.
    at = F.regexp_instr(F.concat(F.lit("="), cigar), F.concat(F.lit("[A-Z=]"), mark))
    before = F.when(at > 0, F.substring(cigar, F.lit(1), at - 1))
    after = F.when(at > 0, F.substring(cigar, at + F.length(mark), F.length(cigar)))
    length = lambda c: C.total(C.operations(c), "MIS")
    return {"before": before, "after": after, "before_len": length(before), "after_len": length(after)}


def junction_sequence(hops: DataFrame, reads: DataFrame, genome: DataFrame) -> DataFrame:
    """Add ``payload``: ``+`` and the bases between the sides of a hop, ``-`` and the reference bases that they share, or an empty text.

    Shared bases are the last of the first side, on its strand; null where the genome lacks them.
    """
    plus = F.col("strand1") == "+"
    x = microhomology(hops).join(reads.select("read_id", "bases"), "read_id")
    inside = F.when(plus, F.col("lt1")).otherwise(F.col("rt1")) + F.col("q_match1")
    x = x.withColumn("_from", F.when(plus, F.col("ref_end1") + F.least("gap", F.lit(0))).otherwise(F.col("ref_start1")))
    x = x.withColumn("_to", F.when(plus, F.col("ref_end1")).otherwise(F.col("ref_start1") - F.least("gap", F.lit(0))))
    shared = genome_slice(x.where("gap < 0"), genome, "chrom1", "_from", "_to", "_shared").withColumn("payload", F.concat(F.lit("-"), stranded(F.col("_shared"), F.col("strand1")))).drop("_shared")
    own = F.when(F.col("gap") > 0, F.concat(F.lit("+"), F.substring(F.col("bases"), inside + 1, F.col("gap")))).otherwise("")
    return shared.unionByName(x.where("gap >= 0").withColumn("payload", own)).drop("_from", "_to", "bases")


def node_sequences(nodes: DataFrame, genome: DataFrame) -> DataFrame:
    """Bases of each node (node, chrom, strand, exons) on its strand; N where the genome has none."""
    x = nodes.select("node", "chrom", "strand", F.posexplode("exons").alias("place", "e")).select("node", "chrom", "strand", "place", "e.start", "e.end")
    x = genome_slice(x, genome, "chrom", "start", "end", "_b")
    bases = F.coalesce("_b", F.repeat(F.lit("N"), (F.col("end") - F.col("start")).cast("int")))
    rows = x.groupBy("node", "strand").agg(F.array_sort(F.collect_list(F.struct("place", bases.alias("b")))).alias("bs"))
    return rows.select("node", stranded(F.array_join(F.transform("bs", lambda b: b["b"]), ""), F.col("strand")).alias("bases"))


def united(intervals: Column, touch: int = 0) -> Column:
    """The union of an array of intervals (start, end): the next joins if it starts at the largest end so far plus ``touch`` at most."""
    kind = "array<struct<start:bigint,end:bigint>>"

    def add(done: Column, x: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        longer = F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))
        joins = F.coalesce(x["start"] <= last["end"] + touch, F.lit(False))
        return F.when(joins, F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(longer))).otherwise(F.concat(done, F.array(x))).cast(kind)

    return F.aggregate(F.array_sort(intervals.cast(kind)), F.array().cast(kind), add)


def squeezed(segments: DataFrame, links: DataFrame) -> DataFrame:
    """Paths of reads without deletions: the segments on both sides of one are a node, with the union of their exons; other hops stay between nodes.

    ``segments``: read_id, seg_ord, chrom, strand, ref_start, ref_end and exons; ``links``: the read's hops with seg_ord1 and kind. Gives read_id, place (from 0), segments, chrom, strand, exons
    (adjacent ones are united), n_start and n_end, and ident: the first node is HEAD, the last TAIL, others MID; a read that becomes one node is a HEAD.
    """
    before = links.select("read_id", (F.col("seg_ord1") + 1).alias("seg_ord"), (F.col("kind") != "DEL").cast("long").alias("stays"))
    w = Window.partitionBy("read_id").orderBy("seg_ord")
    x = segments.join(before, ["read_id", "seg_ord"], "left").withColumn("place", F.sum(F.coalesce("stays", F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    x = x.withColumn("last", F.max("place").over(Window.partitionBy("read_id")))
    exons = united(F.flatten(F.collect_list("exons")), 1).alias("exons")
    x = x.groupBy("read_id", "place", "last").agg(F.count("*").alias("segments"), F.min("chrom").alias("chrom"), F.min("strand").alias("strand"), exons, F.min("ref_start").alias("n_start"), F.max("ref_end").alias("n_end"))
    ident = F.when(F.col("place") == 0, "HEAD").when(F.col("place") == F.col("last"), "TAIL").otherwise("MID")
    return x.withColumn("ident", ident).drop("last")
