"""Classification of hops between segments, annotation and support of links."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segmentry.functions import cigar as C
from segmentry.operators.ranges import range_join
from segmentry.shared import stored


def microhomology(hops: DataFrame) -> DataFrame:
    """Gap in the read between the sides of a hop; below 0 it is shared sequence."""
    clip1 = F.when(F.col("strand1") == "+", F.col("lt1")).otherwise(F.col("rt1"))
    clip2 = F.when(F.col("strand2") == "+", F.col("rt2")).otherwise(F.col("lt2"))
    return hops.withColumn("gap", F.col("q_len") - clip1 - clip2 - F.col("q_match1") - F.col("q_match2"))


def classify(hops: DataFrame) -> DataFrame:
    """Type of each hop and its two breakpoints.

    One chromosome and strand: with the sides in the order of the read's strand, what the
    reference spans exceed the distance of the outer ends; 0 or less is a deletion, more a
    tandem duplication. Other strands: an inversion, or a duplication where both breakpoints
    are the same. Other chromosomes: a translocation.
    """
    same_chrom, same_strand, plus = F.col("chrom1") == F.col("chrom2"), F.col("strand1") == F.col("strand2"), F.col("strand1") == "+"
    up = lambda c: F.when(plus, F.col(f"{c}1")).otherwise(F.col(f"{c}2"))
    down = lambda c: F.when(plus, F.col(f"{c}2")).otherwise(F.col(f"{c}1"))
    over = (up("ref_end") - up("ref_start")) + (down("ref_end") - down("ref_start")) - (down("ref_end") - up("ref_start"))
    out1 = F.when(F.col("strand1") == "+", F.col("ref_end1")).otherwise(F.col("ref_start1"))
    in2 = F.when(F.col("strand2") == "+", F.col("ref_start2")).otherwise(F.col("ref_end2"))
    kind = (
        F.when(same_chrom & same_strand & (over <= 0), "DEL").when(same_chrom & same_strand, "TDUP").when(same_chrom & (out1 == in2), "IDUP").when(same_chrom, "INV").otherwise("TRA")
    )
    x = hops.withColumn("kind", kind).withColumn("pos1", out1).withColumn("pos2", in2)
    return x.withColumn("link", C.link_type(F.col("kind"), F.col("mode1"), F.col("mode2")))


def between(hops: DataFrame, segments: DataFrame) -> DataFrame:
    """Hops both of whose sides are among ``segments`` (read_id, seg_ord), as those whose introns have been found canonical."""
    good = stored(segments.select("read_id", "seg_ord"), "good")
    for i in (1, 2):
        hops = hops.join(good.withColumnRenamed("seg_ord", f"seg_ord{i}"), ["read_id", f"seg_ord{i}"], "left_semi")
    return hops


#: Types of links that are events.
SV_TYPES = ("TDUP", "INV", "TRA", "DEL", "IDUP")


def filter_sv_types(links: DataFrame, kinds: tuple[str, ...] = SV_TYPES) -> DataFrame:
    return links.where(F.col("kind").isin(*kinds))


#: What a link is told by.
LINK = ("kind", "link", "chrom1", "pos1", "strand1", "chrom2", "pos2", "strand2")


def supported(links: DataFrame, with_reads: bool = False) -> DataFrame:
    """Number and smallest of the reads behind each link, on wish their ids in order as a text; partial sums before the shuffle, so a hot link is no hot task."""
    if not with_reads:
        return links.groupBy(*LINK).agg(F.count_distinct("read_id").alias("support"), F.min("read_id").alias("first_read"))
    found = links.groupBy(*LINK).agg(F.array_sort(F.collect_set("read_id")).alias("ids"))
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return found.select(*LINK, F.size("ids").cast("bigint").alias("support"), F.element_at("ids", 1).alias("first_read"), ids.alias("reads"))


def genes_at(points: DataFrame, genes: DataFrame, *at: tuple[str, str, str], margin: int = 5) -> DataFrame:
    """For each (chromosome, position, name) add as ``name`` the sorted names of the genes over the position, joined by ``&``; INTERGENIC if there is none.

    The distinct positions of all of them are looked up once, then joined back. The points are stored, as both read them.
    """
    points = stored(points, "points")
    spots = points.select(F.explode(F.array(*(F.struct(F.col(c).alias("_c"), F.col(p).cast("long").alias("_p")) for c, p, _ in at))).alias("s")).select("s.*").distinct()
    spans = genes.select("gene", F.col("chrom").alias("_gc"), (F.col("g_start") - margin).alias("_s"), (F.col("g_end") + margin).alias("_e"))
    hit = range_join(spots, spans, (F.col("_p") >= F.col("_s")) & (F.col("_p") < F.col("_e")), ("_c", "_gc"), ("_p", "_p"), ("_s", "_e"))
    names = hit.groupBy("_c", "_p").agg(F.array_join(F.array_sort(F.collect_set("gene")), "&").alias("_names"))
    names = stored(names, "names") if len(at) > 1 else names
    for c, p, name in at:
        found = names.select(F.col("_c").alias(f"_c_{name}"), F.col("_p").alias(f"_p_{name}"), F.col("_names").alias(name))
        points = points.join(found, (F.col(c) == F.col(f"_c_{name}")) & (F.col(p) == F.col(f"_p_{name}")), "left").drop(f"_c_{name}", f"_p_{name}").withColumn(name, F.coalesce(name, F.lit("INTERGENIC")))
    return points


def filter_same_exon(links: DataFrame, exons: DataFrame, boundary: int = 5, least: int = 30) -> DataFrame:
    """Links without those, but for translocations and deletions, both of whose breakpoints lie in one exon of ``least`` bases or more, ``boundary`` within its ends."""
    inside = lambda p: (F.col(p) >= F.col("e_start") + boundary) & (F.col(p) < F.col("e_end") - boundary)
    asked = links.where("kind not in ('TRA', 'DEL') and chrom1 = chrom2")
    spots = asked.select("chrom1", "pos1", "pos2").distinct()
    hit = range_join(spots, exons.where(F.col("e_end") - F.col("e_start") >= least).select("chrom", "e_start", "e_end"), inside("pos1") & inside("pos2"), ("chrom1", "chrom"), ("pos1", "pos1"), ("e_start", "e_end"), width=1000).select("chrom1", "pos1", "pos2").distinct()
    bad = asked.join(hit, ["chrom1", "pos1", "pos2"], "left_semi").select("read_id", "seg_ord1")
    return links.join(bad, ["read_id", "seg_ord1"], "left_anti")
