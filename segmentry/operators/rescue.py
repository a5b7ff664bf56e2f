"""Reads that may support a link though they don't span it, and insertions in the coordinates of their read."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segmentry.functions import cigar as C
from segmentry.shared import stored


def rebased(source: tuple[Column, Column, Column], left: Column, source_strand: Column, strand: Column, cigar: Column) -> dict[str, Column]:
    """Clips of an insertion cut from the left or right clip of ``source`` (left clip, match, right clip), and its CIGAR with them."""
    lt, match, rt = source
    own = C.total(C.operations(cigar), "MIS")
    before, after = F.when(left, lt - own).otherwise(lt + match), F.when(left, rt + match).otherwise(rt - own)
    same = source_strand == strand
    new_lt, new_rt = F.when(same, before).otherwise(after), F.when(same, after).otherwise(before)
    clip = lambda n: F.concat(n.cast("string"), F.lit("S"))
    return {"lt": new_lt, "rt": new_rt, "cigar": C.normalized(F.concat(clip(new_lt), cigar, clip(new_rt)))}


def intron_lengths(exons: Column) -> Column:
    """Lengths of introns as a text."""
    sizes = F.transform(C.gaps(exons), lambda i: i["end"] - i["start"])
    return F.when(F.size(exons) < 2, "").otherwise(F.concat_ws(",", F.transform(sizes, lambda n: n.cast("string"))))


_SHAPE = ("chrom", "strand", "_i", "ref_start", "ref_end")


def own_sides(segments: DataFrame, tolerance: int = 10) -> DataFrame:
    """``segments`` (read_id, chrom, strand, ref_start, ref_end, _i, ``link``: is it the first side of a link?) with ``own``, whether a link of the read has this very side, and
    ``others``, the sides of the read's links where the read has a segment near another one (else null). Both stay within the read."""
    w = Window.partitionBy("read_id", "chrom", "strand").orderBy("ref_start")
    at = F.col("ref_start")
    crowded = F.coalesce(at - F.lag(at).over(w) <= tolerance, F.lit(False)) | F.coalesce(F.lead(at).over(w) - at <= tolerance, F.lit(False))
    sides = F.collect_set(F.when(F.col("link") & F.col("_crowded"), F.struct(*_SHAPE))).over(Window.partitionBy("read_id"))
    x = segments.withColumn("_crowded", crowded).withColumn("others", F.when(F.col("_crowded"), sides))
    # Segments of one read that have the same side are near each other.
    return x.withColumn("own", F.col("link") | F.coalesce(F.array_contains("others", F.struct(*_SHAPE)), F.lit(False))).drop("_crowded")


def near_sides(segments: DataFrame, keep: list[str], mapq: int = 20, tolerance: int = 10) -> tuple[DataFrame, DataFrame]:
    """(sides of links: id, chrom1, strand1, ref_start1, ref_end1; for each segment of ``own_sides`` of quality and each side that it is like, as in ``rescue_reads``: id, ``keep`` columns and candidate).

    Sides are few and get a number each, so they are not dragged along; whose a side is comes with the segment, so reads aren't joined with what they own.
    """
    sides = segments.where("own").groupBy("chrom", "strand", "ref_start", "ref_end").agg(F.collect_set("_i").alias("_is"))
    sides = stored(sides.withColumn("id", F.monotonically_increasing_id()), "sides")
    at = lambda c: F.floor(F.col(c) / (tolerance + 1))
    x = sides.select("id", "chrom", "strand", F.explode("_is").alias("_i"), F.col("ref_start").alias("_s"), F.col("ref_end").alias("_e"))
    x = x.withColumn("_bin", F.explode(F.array(*(at("_s") + d for d in (-1, 0, 1)))))
    good = segments.where(F.col("mapq") >= mapq).select(*keep, *_SHAPE, "own", "others").withColumn("_bin", at("ref_start"))
    near = (F.abs(F.col("_s") - F.col("ref_start")) <= tolerance) & (F.abs(F.col("_e") - F.col("ref_end")) <= tolerance)
    side = F.struct("chrom", "strand", "_i", F.col("_s").alias("ref_start"), F.col("_e").alias("ref_end"))
    own = F.when((F.col("_s") == F.col("ref_start")) & (F.col("_e") == F.col("ref_end")), F.col("own")).otherwise(F.coalesce(F.array_contains("others", side), F.lit(False)))
    hit = good.join(x, ["chrom", "strand", "_i", "_bin"]).where(near).select("id", *keep, (~own).alias("candidate"))
    return sides.select("id", *(F.col(c).alias(f"{c}1") for c in ("chrom", "strand", "ref_start", "ref_end"))), hit


def rescue_reads(links: DataFrame, segments: DataFrame, mapq: int = 20, tolerance: int = 10) -> DataFrame:
    """Segments like the first side of a link: strand, lengths of introns, both ends within ``tolerance``, and quality.

    ``candidate`` is whether the segment's read is none of the link's own. A segment meets
    the few different sides near it, so rows grow with the segments.
    """
    lengths = intron_lengths(F.col("exons"))
    # All three uses read what is stored, so introns are told once for each segment and not again in every join.
    segs = stored(segments.select("read_id", "seg_ord", "chrom", "strand", "ref_start", "ref_end", "mapq", lengths.alias("_i")), "segments")
    own = links.join(segs.select("read_id", F.col("seg_ord").alias("seg_ord1"), "_i"), ["read_id", "seg_ord1"]).select("read_id", F.struct("chrom1", "strand1", "ref_start1", "ref_end1", "pos1", "_i").alias("side")).distinct()
    # Starts within the tolerance are in neighbouring bins; the few sides are in three each, so a segment stays one row.
    at = lambda c: F.floor(F.col(c) / (tolerance + 1))
    sides = own.select("side").distinct().select("side", F.col("side.chrom1").alias("chrom"), F.col("side.strand1").alias("strand"), F.col("side._i").alias("_i"), F.explode(F.array(*(at("side.ref_start1") + d for d in (-1, 0, 1)))).alias("_bin"))
    good = segs.where(F.col("mapq") >= mapq).withColumn("_bin", at("ref_start"))
    near = (F.abs(F.col("side.ref_start1") - F.col("ref_start")) <= tolerance) & (F.abs(F.col("side.ref_end1") - F.col("ref_end")) <= tolerance)
    hit = good.join(sides, ["chrom", "strand", "_i", "_bin"]).where(near).select("read_id", "seg_ord", "side")
    found = hit.join(own.withColumn("_own", F.lit(True)), ["read_id", "side"], "left")
    return found.select("read_id", "seg_ord", "side.chrom1", "side.strand1", "side.pos1", "side.ref_start1", "side.ref_end1", F.col("_own").isNull().alias("candidate"))
