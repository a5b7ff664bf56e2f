"""Queries over splice sites of hops; they join those of ``queries`` in its two tables."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segmentry.operators import segments as S
from segmentry.operators import splicing
from segmentry.operators.events import microhomology
from segmentry.plans.queries import _SEG, _segments, query
from segmentry.plans.sequence_queries import _SITES, _sites, _slice
from segmentry.sources import adapters as A

# Sides of odd reads are exchanged, so that either side is the donor. Exons hardly end near a junction in the data: segments with a mismatch count of 11 count as
# ending in exons of 0 to 3 bases.
_SIDE = ("chrom", "strand", "ref_start", "ref_end", "mode", "first_exon", "last_exon", "seg_ord")
_PAIRS = f"""{_SEG}, genome as ({A.SITES_GENOME}), {_SITES}, b as (select *, case when nm = 11 then mapq % 4 when contains(cigar, 'N') then 100 else ref_end - ref_start end as first_exon,
  case when nm = 11 then mapq % 4 when contains(cigar, 'N') then ref_end - ref_start - 800 else ref_end - ref_start end as last_exon from seg),
 h as (select a.read_id, a.seg_ord as hop, a.q_len - (case when a.strand = '+' then a.lt else a.rt end) - (case when b.strand = '+' then b.rt else b.lt end) - a.q_match - b.q_match as gap,
  {", ".join(f"a.{c} as {c}_p, b.{c} as {c}_q" for c in _SIDE if c != "mode")}, case when a.strand = '+' then 'MS' else 'SM' end as mode_p, case when b.strand = '+' then 'SM' else 'MS' end as mode_q
  from b a join b on a.read_id = b.read_id and b.seg_ord = a.seg_ord + 1),
 r as (select *, case when mode_p = 'MS' then ref_end_p else ref_start_p end as pos_p, case when mode_q = 'MS' then ref_end_q else ref_start_q end as pos_q from h)"""
# The read's earlier side is the donor, as its modes are those of a read in the direction of transcription.
_CONFIRM = f"""{_PAIRS}, k as (select * from r where gap >= 0),
 wd as (select read_id, hop, chrom_p as chrom, strand_p as strand, pos_p as p from k), wa as (select read_id, hop, chrom_q as chrom, strand_q as strand, pos_q as p from k),
 dd as (select read_id, hop, case when strand = '+' then 'GT' else 'AC' end as t, (select min(motif) from sites s where s.chrom = x.chrom and p >= s_start and p < s_end) as m, {_slice("p - 5", "p + 5")} as w from wd x),
 aa as (select read_id, hop, case when strand = '+' then 'AG' else 'CT' end as t, (select min(motif) from sites s where s.chrom = x.chrom and p >= s_start and p < s_end) as m, {_slice("p - 5", "p + 5")} as w from wa x),
 j as (select d.read_id, d.hop, coalesce(d.m = d.t, false) as dk, coalesce(a.m = a.t, false) as ak, coalesce(contains(d.w, d.t), false) as dn, coalesce(contains(a.w, a.t), false) as an from dd d join aa a using (read_id, hop)),
 confirmed as (select read_id, cast(hop as int) as hop, cast(case when dk and ak then 3 when dk then 2 when ak then 1 else 0 end as int) as boundary, (dk or dn) and (ak or an) as canonical from j)"""
_CORRECT = f"""{_PAIRS}, k as (select *, -gap as h, case when strand_p = '+' then last_exon_p else first_exon_p end as db, case when strand_q = '+' then first_exon_q else last_exon_q end as ab from r where gap < 0),
 t as (select k.*, d, h - d as a from (select *, unnest(generate_series(0, h)) as d from k) k),
 ds as (select read_id, hop, d, {_slice("p", "p + 2")} as m from (select read_id, hop, d, chrom_p as chrom, case when strand_p = '+' then pos_p - d else pos_p + d - 2 end as p from t) x),
 s as (select read_id, hop, d, {_slice("p", "p + 2")} as m from (select read_id, hop, d, chrom_q as chrom, case when strand_q = '+' then pos_q + a - 2 else pos_q - a end as p from t) x),
 best as (select read_id, hop, min(d) as best from t join ds using (read_id, hop, d) join s using (read_id, hop, d)
  where ds.m = case when strand_p = '+' then 'GT' else 'AC' end and s.m = case when strand_q = '+' then 'AG' else 'CT' end and d < db and a < ab group by 1, 2),
 c as (select k.*, best, coalesce(best, case when db > 0 and ab > h then 0 else h end) as cd from k left join best using (read_id, hop)),
 corrected as (select *, h - cd as ca from c)"""


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    length = lambda i: F.element_at("exons", i)["end"] - F.element_at("exons", i)["start"]
    tiny = F.col("nm") == 11
    segs = _segments(spark, sf_dir).withColumn("first_exon", F.when(tiny, F.col("mapq") % 4).otherwise(length(1))).withColumn("last_exon", F.when(tiny, F.col("mapq") % 4).otherwise(length(-1)))
    hops = microhomology(S.adjacent_segments(segs, ("first_exon", "last_exon"))).withColumn("hop", F.col("seg_ord1"))
    return S.swapped(S.pair_modes(hops), F.col("read_id") % 2 == 1)


@query(f"{_CONFIRM} select *, canonical as report from confirmed")
def splice_confirm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotated and canonical sites of hops whose sides share no bases."""
    return splicing.confirmed(_pairs(spark, sf_dir), _sites(spark, sf_dir), A.sites_genome(_segments(spark, sf_dir))).select("read_id", "hop", "boundary", "canonical", "report")


@query(f"""{_CORRECT} select read_id, cast(hop as int) as hop, cast(case when read_id % 2 = 0 then cd else ca end as int) as shift1, cast(case when read_id % 2 = 0 then ca else cd end as int) as shift2,
  cast(case when best is null then 0 else 3 end as int) as boundary, best is not null as canonical from corrected""")
def splice_correct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of the bases that the sides of a hop share each gives up."""
    x = splicing.corrected(_pairs(spark, sf_dir), A.sites_genome(_segments(spark, sf_dir)))
    return x.select("read_id", "hop", F.col("shift1").cast("int").alias("shift1"), F.col("shift2").cast("int").alias("shift2"), "boundary", "canonical")


@query(f"""{_CORRECT}, m as (select r.*, coalesce(cd, 0) as cd, coalesce(ca, 0) as ca from r left join (select read_id, hop, cd, ca from corrected) using (read_id, hop)),
 e as (select *, ref_start_p + case when mode_p = 'SM' then cd else 0 end as sp, ref_end_p - case when mode_p = 'MS' then cd else 0 end as ep, ref_start_q + case when mode_q = 'SM' then ca else 0 end as sq, ref_end_q - case when mode_q = 'MS' then ca else 0 end as eq from m),
 ends as (select coalesce(p.read_id, n.read_id) as read_id, coalesce(p.seg_ord_q, n.seg_ord_p) as seg_ord, p.sq, p.eq, p.mode_q, n.sp, n.ep, n.mode_p, p.read_id is not null as has_p, n.read_id is not null as has_n
  from e p full join e n on p.read_id = n.read_id and n.hop = p.hop + 1)
 select read_id, seg_ord, cast(case when not has_p then sp when has_n and mode_q = 'MS' and mode_p = 'SM' then sp else sq end as bigint) as ref_start,
  cast(case when not has_p then ep when has_n and mode_q = 'SM' and mode_p = 'MS' then ep else eq end as bigint) as ref_end from ends""")
def propagate_segment_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ends of all segments after the correction of both hops that they take part in."""
    pairs = _pairs(spark, sf_dir)
    shifts = splicing.corrected(pairs, A.sites_genome(_segments(spark, sf_dir))).select("read_id", "hop", "shift1", "shift2")
    return splicing.propagated(splicing.moved_ends(pairs.join(shifts, ["read_id", "hop"], "left"))).select("read_id", "seg_ord", "ref_start", "ref_end")
