"""Queries over reads to rescue and insertions; they join those of ``queries`` in its two tables."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segmentry.operators import rescue
from segmentry.plans.path_queries import _hops
from segmentry.plans.queries import _HOP, _WITH, _segments, query
from segmentry.sources import adapters as A


@query(f"""{_WITH}, x as (select *, nm + 1 as own, mapq % 2 = 0 as same, lt > nm as is_left from alignments), y as (select *, case when is_left then lt - own else lt + q_match end as b, case when is_left then rt + q_match else rt - own end as a from x),
 z as (select read_id, seg_ord, own, case when same then b else a end as new_lt, case when same then a else b end as new_rt from y where is_left or rt > nm)
 select read_id, seg_ord, new_lt, new_rt, concat(case when new_lt > 0 then concat(new_lt, 'S') else '' end, own, 'M', case when new_rt > 0 then concat(new_rt, 'S') else '' end) as new_cigar from z""")
def insertion_rebase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An insertion of one more than its mismatches is taken from a clip of each segment that is long enough, the left one first."""
    x = A.alignments(spark, sf_dir).where("lt > nm or rt > nm")
    other = F.when(F.col("mapq") % 2 == 0, F.col("strand")).otherwise(F.when(F.col("strand") == "+", "-").otherwise("+"))
    own = rescue.rebased((F.col("lt"), F.col("q_match"), F.col("rt")), F.col("lt") > F.col("nm"), F.col("strand"), other, F.concat((F.col("nm") + 1).cast("string"), F.lit("M")))
    return x.select("read_id", "seg_ord", *(c.alias(f"new_{n}") for n, c in own.items()))


@query(f"""{_HOP}, side as (select distinct h.read_id, h.chrom1, h.strand1, h.ref_start1, h.ref_end1, p.pos1, contains(s.cigar, 'N') as intron from hop h join placed p using (read_id, seg_ord1) join seg s on s.read_id = h.read_id and s.seg_ord = h.seg_ord1),
 d as (select distinct chrom1, strand1, ref_start1, ref_end1, pos1, intron from side)
 select s.read_id, s.seg_ord, d.chrom1, d.strand1, d.pos1, d.ref_start1, d.ref_end1, o.read_id is null as candidate from d join seg s on s.chrom = d.chrom1 and s.strand = d.strand1 and contains(s.cigar, 'N') = d.intron and s.mapq >= 25
  and abs(s.ref_start - d.ref_start1) <= 10 and abs(s.ref_end - d.ref_end1) <= 10
 left join side o on o.read_id = s.read_id and o.chrom1 = d.chrom1 and o.strand1 = d.strand1 and o.ref_start1 = d.ref_start1 and o.ref_end1 = d.ref_end1 and o.pos1 = d.pos1 and o.intron = d.intron""")
def join_rescue_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = F.when(F.col("strand1") == "+", F.col("ref_end1")).otherwise(F.col("ref_start1"))
    return rescue.rescue_reads(_hops(spark, sf_dir).withColumn("pos1", out), _segments(spark, sf_dir), mapq=25)
