"""Segments of reads: profiles, chains and filters."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segmentry.functions import cigar as C


def cigar_profile(a: DataFrame) -> DataFrame:
    """Clips, read and reference matches, net deletion and query length of each segment."""
    ops = C.operations(F.col("cigar"))
    read, ref = C.total(ops, "MI"), C.total(ops, "MDN")
    return a.select(
        "read_id", "seg_ord", C.clip(F.col("cigar"), False).alias("lt_clip"), C.clip(F.col("cigar"), True).alias("rt_clip"), read.alias("read_match"),
        ref.alias("ref_match"), (C.total(ops, "DN") - C.total(ops, "I")).alias("indel"), C.total(ops, "MIS").alias("query_len"),
    )


def with_ends(a: DataFrame) -> DataFrame:
    """Add exons, the end on the genome and the mode of each segment."""
    x = a.withColumn("exons", C.exons(F.col("ref_start"), F.col("cigar")))
    return x.withColumn("ref_end", F.element_at("exons", -1)["end"]).withColumn("mode", C.mode(F.col("lt"), F.col("rt")))


def _by_read(a: DataFrame, keep: Column) -> DataFrame:
    """Reads all of whose segments satisfy ``keep``, found by an aggregate and a semi-join."""
    bad = a.groupBy("read_id").agg(F.min(F.coalesce(keep, F.lit(False)).cast("int")).alias("ok")).where("ok = 1").select("read_id")
    return a.join(bad, "read_id", "left_semi")


def filter_contig(a: DataFrame, unwanted: str = "_|^chrM$|MT") -> DataFrame:
    """Reads without a segment on a contig that ``unwanted`` matches."""
    return _by_read(a, ~F.col("chrom").rlike(unwanted))


def filter_complete_chain(a: DataFrame, mapq: int = 20) -> DataFrame:
    """Reads that kept all their segments, the worst of a quality of at least ``mapq``."""
    ok = a.groupBy("read_id").agg(F.count("*").alias("c"), F.max("nseg").alias("n"), F.min("mapq").alias("q")).where((F.col("c") == F.col("n")) & (F.col("q") >= mapq))
    return a.join(ok.select("read_id"), "read_id", "left_semi")


def filter_primary(a: DataFrame, mapq: int = 20) -> DataFrame:
    """Records whose ``flag`` is of a mapped alignment, neither secondary nor supplementary, with a quality of ``mapq`` or more and no other place (``xa``)."""
    return a.where((F.col("flag").bitwiseAND(4 + 256 + 2048) == 0) & (F.col("mapq") >= mapq) & F.col("xa").isNull())


def filter_min_node_len(a: DataFrame, least: int = 10) -> DataFrame:
    """Reads whose shortest segment has exons of more than ``least`` bases, with that length."""
    length = F.aggregate("exons", F.lit(0).cast("bigint"), lambda s, e: s + e["end"] - e["start"])
    return a.groupBy("read_id").agg(F.min(length).alias("least")).where(F.col("least") > least)


def filter_nm(a: DataFrame, most: int = 100) -> DataFrame:
    """First segments with at most ``most`` mismatches, the others with fewer."""
    return a.where(F.when(F.col("seg_ord") == 0, F.col("nm") <= most).otherwise(F.col("nm") < most))


def pair_modes(hops: DataFrame) -> DataFrame:
    """Give each side of a hop the mode that it has toward the other one: the first side's clip is behind it in the read, the second's before it."""
    ahead, behind = F.col("strand1") == "+", F.col("strand2") == "+"
    return hops.withColumn("mode1", F.when(ahead, "MS").otherwise("SM")).withColumn("mode2", F.when(behind, "SM").otherwise("MS"))


def swapped(hops: DataFrame, where: Column) -> DataFrame:
    """Exchange both sides of the hops that satisfy ``where``."""
    names = [c[:-1] for c in hops.columns if c.endswith("1") and f"{c[:-1]}2" in hops.columns]
    take = lambda c, i, j: F.when(where, F.col(f"{c}{j}")).otherwise(F.col(f"{c}{i}")).alias(f"{c}{i}")
    rest = [c for c in hops.columns if c[:-1] not in names or c[-1] not in "12"]
    return hops.select(*rest, *(take(c, i, j) for c in names for i, j in ((1, 2), (2, 1))))


def segment_pairs(a: DataFrame) -> DataFrame:
    """All pairs of a read's segments, of which a read has a handful."""
    x = a.select("read_id", *(F.col(c).alias(f"{c}1") for c in ("seg_ord", "chrom", "strand", "ref_start", "ref_end", "mapq")))
    y = a.select("read_id", *(F.col(c).alias(f"{c}2") for c in ("seg_ord", "chrom", "strand", "ref_start", "ref_end", "mapq")))
    return x.join(y, "read_id").where("seg_ord1 < seg_ord2")


def filter_rt_artifact(a: DataFrame, near: int = 20, far: int = 200, gap: int = 10) -> DataFrame:
    """Reads without a pair on one chromosome and opposite strands that starts or ends too close."""
    d = lambda c: F.abs(F.col(f"{c}1") - F.col(f"{c}2"))
    between = lambda c: (d(c) > near) & (d(c) < far)
    close = (d("ref_start") <= near) | (d("ref_end") <= near) | ((between("ref_start") | between("ref_end")) & (d("mapq") > gap))
    bad = segment_pairs(a).where((F.col("chrom1") == F.col("chrom2")) & (F.col("strand1") != F.col("strand2")) & close)
    return a.join(bad.select("read_id").distinct(), "read_id", "left_anti")


def chain_segments(a: DataFrame, tolerance: int = 10) -> DataFrame:
    """Segments in the order of the read, with the gap to the one before and whether the whole chain fits."""
    w = Window.partitionBy("read_id").orderBy("q_at", "seg_ord")
    at = F.when(F.col("strand") == "+", F.col("lt")).otherwise(F.col("rt"))
    x = a.withColumn("q_at", at).withColumn("chain_ord", F.row_number().over(w) - 1)
    x = x.withColumn("gap", F.col("q_at") - F.lag(F.col("q_at") + F.col("q_match")).over(w))
    fits = F.min(F.coalesce(F.abs("gap") <= tolerance, F.lit(True)).cast("int")).over(Window.partitionBy("read_id"))
    return x.withColumn("fits", fits == 1)


def adjacent_segments(a: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    """Hops: each segment of a chain with the next one; ``more`` columns of both are kept too."""
    w = Window.partitionBy("read_id").orderBy("seg_ord")
    cols = ("seg_ord", "chrom", "strand", "ref_start", "ref_end", "mode", "lt", "rt", "q_match", *more)
    nxt = F.lead(F.struct(*cols)).over(w)
    x = a.withColumn("nxt", nxt).where("nxt is not null")
    return x.select("read_id", "fam", "q_len", *(F.col(c).alias(f"{c}1") for c in cols), *(F.col(f"nxt.{c}").alias(f"{c}2") for c in cols))


def segment_identity(a: DataFrame) -> DataFrame:
    """HEAD for the first segment of a read, TAIL for the last, MID between."""
    w = Window.partitionBy("read_id")
    identity = F.when(F.col("seg_ord") == F.min("seg_ord").over(w), "HEAD").when(F.col("seg_ord") == F.max("seg_ord").over(w), "TAIL").otherwise("MID")
    return a.withColumn("identity", identity)


def candidates(a: DataFrame) -> DataFrame:
    """read_id, seg_ord, off and rank of each segment of a read but the one that its chain starts with: how far its clip toward the start is from what is matched there.

    The chain starts with the segment of the shortest clip, then of the smaller number. What is matched reaches from its longer clip to the read's end; the other segments must
    have it in their clip on the same side of the read, which on the other strand is the other side of the alignment. Where the start's clips are equally long, the nearer of both clips counts.
    """
    first = F.min_by(F.struct("lt", "rt", "strand", "q_match", "seg_ord"), F.struct(F.least("lt", "rt"), F.col("seg_ord"))).over(Window.partitionBy("read_id"))
    x = a.withColumn("s", first).where(F.col("seg_ord") != F.col("s.seg_ord"))
    same, behind = F.col("strand") == F.col("s.strand"), F.col("s.lt") > F.col("s.rt")  # is the start's longer clip before it?
    held = F.col("s.q_match") + F.least("s.lt", "s.rt")
    off = lambda c: F.abs(F.col(c) - held)
    either = F.least(F.abs(F.col("lt") - F.col("s.q_match")), F.abs(F.col("rt") - F.col("s.q_match")))
    x = x.withColumn("off", F.when(F.col("s.lt") == F.col("s.rt"), either).when(behind == same, off("rt")).otherwise(off("lt")))
    return x.select("read_id", "seg_ord", "off", F.row_number().over(Window.partitionBy("read_id").orderBy("off", "seg_ord")).alias("place"))
