"""Splice sites at the two sides of a hop: confirmed where bases lie between them, corrected along what they share."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segmentry.operators.genome import genome_slice
from segmentry.operators.paths import with_donor
from segmentry.operators.ranges import range_join
from segmentry.shared import stored

#: Bases at a donor and at an acceptor on either strand.
DONOR, ACCEPTOR = {"+": "GT", "-": "AC"}, {"+": "AG", "-": "CT"}


def _by_role(hops: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """Add the columns of the donor's side as ``do_*`` and of the acceptor's as ``ac_*``, and the bases that belong there."""
    x = with_donor(hops).where("donor is not null")
    for i in ("1", "2"):
        x = x.withColumn(f"pos{i}", F.when(F.col(f"mode{i}") == "MS", F.col(f"ref_end{i}")).otherwise(F.col(f"ref_start{i}")))
    first = F.col("donor") == 1
    for c in ("chrom", "strand", "pos", *names):
        x = x.withColumn(f"do_{c}", F.when(first, F.col(f"{c}1")).otherwise(F.col(f"{c}2"))).withColumn(f"ac_{c}", F.when(first, F.col(f"{c}2")).otherwise(F.col(f"{c}1")))
    target = lambda c, table: F.when(F.col(c) == "+", table["+"]).otherwise(table["-"])
    return x.withColumn("do_target", target("do_strand", DONOR)).withColumn("ac_target", target("ac_strand", ACCEPTOR))


def _annotated(x: DataFrame, sites: DataFrame, side: str) -> DataFrame:
    """Add ``{side}_known``: is the smallest motif of the annotated sites around this side's position the one that belongs there?"""
    spots = x.select(F.col(f"{side}_chrom").alias("_c"), F.col(f"{side}_pos").alias("_p")).distinct()
    hit = range_join(spots, sites, (F.col("_p") >= F.col("s_start")) & (F.col("_p") < F.col("s_end")), ("_c", "chrom"), ("_p", "_p"), ("s_start", "s_end"), width=1000)
    found = hit.groupBy("_c", "_p").agg(F.min("motif").alias("_m"))
    out = x.join(found, (F.col(f"{side}_chrom") == F.col("_c")) & (F.col(f"{side}_pos") == F.col("_p")), "left")
    return out.withColumn(f"{side}_known", F.coalesce(F.col("_m") == F.col(f"{side}_target"), F.lit(False))).drop("_c", "_p", "_m")


def confirmed(hops: DataFrame, sites: DataFrame, genome: DataFrame, near: int = 5, motif_required: bool = True) -> DataFrame:
    """Add ``boundary``, ``canonical`` and ``report`` to hops whose sides share nothing (``gap`` of 0 or more).

    boundary: 1 if the acceptor stands at an annotated site of its motif, 2 if the donor does, 3 for both, else 0. Canonical
    is a hop whose other sides have their motif among the bases ``near`` them; only such are reported, or all if no motif is required.
    """
    x = _by_role(hops.where("gap >= 0"), ())
    for side in ("do", "ac"):
        x = _annotated(x, sites, side)
        x = x.withColumn("_a", F.col(f"{side}_pos") - near).withColumn("_b", F.col(f"{side}_pos") + near)
        x = genome_slice(x, genome, f"{side}_chrom", "_a", "_b", "_w").withColumn(f"{side}_near", F.coalesce(F.contains("_w", F.col(f"{side}_target")), F.lit(False))).drop("_a", "_b", "_w")
    boundary = F.when(F.col("do_known"), 2).otherwise(0) + F.when(F.col("ac_known"), 1).otherwise(0)
    canonical = (F.col("do_known") | F.col("do_near")) & (F.col("ac_known") | F.col("ac_near"))
    return x.withColumn("boundary", boundary).withColumn("canonical", canonical).withColumn("report", canonical | F.lit(not motif_required))


def corrected(hops: DataFrame, genome: DataFrame, motif_required: bool = True) -> DataFrame:
    """Add ``shift1``, ``shift2``, ``boundary``, ``canonical`` and ``report`` to hops whose sides share h bases (``gap`` below 0).

    The h bases may belong to either side: the donor gives up d of them and the acceptor h - d. The smallest d that puts both motifs behind the
    ends and leaves something of both border exons wins. Without one the acceptor gives up all, or, if its border exon is
    too short, the donor. Hops have ``read_id`` and ``seg_ord1`` and the lengths ``first_exon`` and ``last_exon`` of both sides.
    """
    x = _by_role(hops.where("gap < 0"), ("first_exon", "last_exon")).withColumn("h", -F.col("gap"))
    plus = lambda side: F.col(f"{side}_strand") == "+"
    x = x.withColumn("do_border", F.when(plus("do"), F.col("do_last_exon")).otherwise(F.col("do_first_exon")))
    x = x.withColumn("ac_border", F.when(plus("ac"), F.col("ac_first_exon")).otherwise(F.col("ac_last_exon")))
    # One window a side holds all its motifs: h + 2 bases, which begin 2 before the position or h before it.
    ahead = {"do": ~plus("do"), "ac": plus("ac")}
    x = stored(x, "overlaps")
    for side, from_2 in ahead.items():
        x = x.withColumn("_a", F.col(f"{side}_pos") - F.when(from_2, 2).otherwise(F.col("h"))).withColumn("_b", F.col("_a") + F.col("h") + 2)
        x = genome_slice(x, genome, f"{side}_chrom", "_a", "_b", f"{side}_window", pad=True).drop("_a", "_b")
    first_at = lambda d: F.when(ahead["do"], d).otherwise(F.col("h") - d)
    second_at = lambda d: F.when(ahead["ac"], F.col("h") - d).otherwise(d)
    fits = lambda d: (
        (d < F.col("do_border")) & (F.col("h") - d < F.col("ac_border"))
        & (F.substring("do_window", first_at(d) + 1, F.lit(2)) == F.col("do_target")) & (F.substring("ac_window", second_at(d) + 1, F.lit(2)) == F.col("ac_target"))
    )
    x = x.withColumn("best", F.array_min(F.filter(F.sequence(F.lit(0), "h"), fits)))
    keeps = (F.col("do_border") > 0) & (F.col("ac_border") > F.col("h"))
    x = x.withColumn("d", F.coalesce("best", F.when(keeps, 0).otherwise(F.col("h")))).withColumn("a", F.col("h") - F.col("d"))
    first, canonical = F.col("donor") == 1, F.col("best").isNotNull()
    x = x.withColumn("shift1", F.when(first, F.col("d")).otherwise(F.col("a"))).withColumn("shift2", F.when(first, F.col("a")).otherwise(F.col("d")))
    return x.withColumn("boundary", F.when(canonical, 3).otherwise(0)).withColumn("canonical", canonical).withColumn("report", canonical | F.lit(not motif_required))


def moved_ends(hops: DataFrame) -> DataFrame:
    """Starts, ends and positions of both sides after ``shift1`` and ``shift2``: a side is cut where it meets the other one."""
    x = hops
    for i in ("1", "2"):
        ms, by = F.col(f"mode{i}") == "MS", F.coalesce(F.col(f"shift{i}"), F.lit(0))
        x = x.withColumn(f"ref_end{i}", F.col(f"ref_end{i}") - F.when(ms, by).otherwise(0)).withColumn(f"ref_start{i}", F.col(f"ref_start{i}") + F.when(ms, 0).otherwise(by))
        x = x.withColumn(f"pos{i}", F.when(ms, F.col(f"ref_end{i}")).otherwise(F.col(f"ref_start{i}")))
    return x


def propagated(hops: DataFrame) -> DataFrame:
    """read_id, seg_ord, ref_start and ref_end of the segments of corrected hops.

    The middle segment of two hops has the end that the earlier one moved from that, and the other end from the later one; where both meet it at
    the same end, the earlier one holds. Each segment is one row of its two hops, so nothing is carried along the read.
    """

    def side(i: Column | str, later: bool) -> Column:
        at_start = F.col(f"mode{i}") == "SM"
        return F.struct(F.col(f"seg_ord{i}").alias("seg_ord"), F.lit(later).alias("later"), F.col(f"ref_start{i}").alias("s"), F.col(f"ref_end{i}").alias("e"), at_start.alias("at_start"))

    # The side with the smaller number in the read is where the hop begins.
    one = F.col("seg_ord1") < F.col("seg_ord2")
    begins, ends = F.when(one, side("1", True)).otherwise(side("2", True)), F.when(one, side("2", False)).otherwise(side("1", False))
    x = hops.select("read_id", F.explode(F.array(begins, ends)).alias("x")).select("read_id", "x.*")
    pick = lambda later: F.max(F.when(F.col("later") == later, F.struct("s", "e", "at_start")))
    x = x.groupBy("read_id", "seg_ord").agg(pick(False).alias("p"), pick(True).alias("n"))
    both = F.col("p").isNotNull() & F.col("n").isNotNull()
    start = F.when(both & ~F.col("p.at_start") & F.col("n.at_start"), F.col("n.s")).otherwise(F.coalesce("p.s", "n.s"))
    end = F.when(both & F.col("p.at_start") & ~F.col("n.at_start"), F.col("n.e")).otherwise(F.coalesce("p.e", "n.e"))
    return x.select("read_id", "seg_ord", start.alias("ref_start"), end.alias("ref_end"))
