"""Queries over parts of reads that are placed again, and rescued reads; they join those of ``queries`` in its two tables."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from segmentry.functions import cigar as C
from segmentry.operators import realign, rescue
from segmentry.operators import segments as S
from segmentry.plans.queries import _HOP, _SEG, _WITH, _segments, _total, query
from segmentry.plans.sequence_queries import _rc, _slice
from segmentry.shared import stored
from segmentry.sources import adapters as A

#: Bases of the transcriptome of a species, by its names.
TRANSCRIPTOMES = {"Homo_sapiens": 150_000_000, "Mus_musculus": 128_265_015, "human": 150_000_000, "mouse": 128_265_015}
_DIM = "dim as (select * from (values " + ", ".join(f"('{k}', {v})" for k, v in TRANSCRIPTOMES.items()) + ") t(species, bases))"
_SPECIES = "case read_id % 5 when 0 then 'human' when 1 then 'mouse' when 2 then 'Homo_sapiens' when 3 then 'Mus_musculus' else 'rat' end"


def transcriptomes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(TRANSCRIPTOMES.items()), "species string, bases long")


@query(f"{_WITH}, {_DIM} select species, cast(bases as bigint) as bases, count(*) as reads from (select distinct read_id, {_SPECIES} as species from alignments) left join dim using (species) group by 1, 2")
def dim_transcriptome(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads of each species with the length of its transcriptome; null for a species that isn't known."""
    reads = A.alignments(spark, sf_dir).select("read_id", F.expr(_SPECIES).alias("species")).distinct()
    return reads.groupBy("species").agg(F.count("*").alias("reads")).join(F.broadcast(transcriptomes(spark)), "species", "left").select("species", "bases", "reads")


@query(f"{_WITH}, {_DIM} select cast(sum(n) as bigint) as read_bases, cast(ceil(sum(n) / cast((select bases from dim where species = 'mouse') as double)) as bigint) as avg_cov from (select {_total('MIS')} as n from alignments)")
def agg_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bases of reads over the length of the transcriptome."""
    total = A.alignments(spark, sf_dir).agg(F.sum(C.total(C.operations(F.col("cigar")), "MIS")).alias("read_bases"))
    return total.crossJoin(F.broadcast(transcriptomes(spark).where("species = 'mouse'"))).select("read_bases", F.ceil(F.col("read_bases") / F.col("bases")).alias("avg_cov"))


# Letters of each document as the bases of a contig; 60 of them, on the other strand for odd ones, ask.
_CONTIGS = "select doc_id as contig, regexp_replace(translate(lower(text), 'abcdefghijklmnopqrstuvwxyz', 'ACGTTGCAACGTGCTAACTGACGTAC'), '[^ACGT]', ''GLOBAL) as bases from documents"
_SEEDS = f"""with contigs as ({_CONTIGS.replace('GLOBAL', ", 'g'")}),
 q as (select contig as query, case when contig % 2 = 1 then {_rc('b')} else b end as bases from (select contig, substr(bases, cast(contig * 37 % (length(bases) - 59) + 1 as int), 60) as b from contigs where length(bases) >= 60)),
 t as (select query, '+' as strand, bases from q union all select query, '-', {_rc('bases')} from q),
 qs as (select query, strand, i, substr(bases, cast(i + 1 as int), 14) as seed from (select *, unnest(range(0, length(bases) - 13)) as i from t)),
 rs as (select contig, pos, substr(bases, cast(pos + 1 as int), 14) as seed from (select *, unnest(range(0, length(bases) - 13)) as pos from contigs where length(bases) >= 14)),
 th as (select * from rs semi join qs using (seed)), fr as (select seed, count(*) as n from th group by 1),
 few as (select query, strand, contig, i, pos from qs join (select seed from fr where n <= 64) using (seed) join th using (seed)),
 rn as (select *, sum(new) over (partition by query, strand, contig, pos - i order by i rows unbounded preceding) as run from (select *, case when i - lag(i, 1, -28) over (partition by query, strand, contig, pos - i order by i) > 14 then 1 else 0 end as new from few)),
 bl as (select query, strand, contig, min(i) as q0, max(i) + 14 as q1, min(pos) as p0, max(pos) + 14 as p1, count(*) as n from rn group by query, strand, contig, pos - i, run),
 wh as (select query, strand, count(*) as seeds, first({{'i': i, 'seed': seed}} order by n, i) filter (n > 64) as r from qs left join fr using (seed) group by 1, 2 having count(*) filter (n > 64) > 0 and count(*) - count(*) filter (n > 64) < 20 and count(*) filter (n is null) = 0),
 isl as (select contig, seed, min(pos) as first, max(pos) as last from (select *, pos - row_number() over (partition by contig, seed order by pos) as run from th where seed in (select r.seed from wh)) group by contig, seed, run),
 ex as (select distinct query, strand, contig, 0 as q0, length(t.bases) as q1, pos - r.i as p0, pos - r.i + length(t.bases) as p1, seeds as n from wh join (select contig, seed, unnest([first, last]) as pos from isl) s on s.seed = r.seed
   join t using (query, strand) join contigs c using (contig) where pos >= r.i and substr(c.bases, cast(pos - r.i + 1 as int), length(t.bases)) = t.bases),
 ab as (select * from bl anti join wh using (query, strand) union all select * from ex),
 ch as (select *, sum(new) over (partition by query, strand, contig order by p0, q0, p1 rows unbounded preceding) as hit from (select *, case when q0 > lag(q0) over w and q1 > lag(q1) over w and p0 > lag(p0) over w and p1 > lag(p1) over w
   and p0 - lag(p1) over w <= 1000 and p0 - q0 - lag(p0) over w + lag(q0) over w >= -100 then 0 else 1 end as new from ab window w as (partition by query, strand, contig order by p0, q0, p1))),
 hits as (select * from (select *, sum(n) over h as score, min(p0) over h as hit_start, max(p1) over h as hit_end from ch window h as (partition by query, strand, contig, hit)) where score >= 20)"""


def _contigs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(queries, contigs)."""
    # Texts are dealt out if their files are fewer than the cores, as a file may be one task, and made into bases once; those are four letters, so they pack well.
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    if documents.rdd.getNumPartitions() < spark.sparkContext.defaultParallelism:
        documents = documents.repartition("doc_id")
    contigs = stored(spark.sql(_CONTIGS.replace("[^ACGT]", "[^ACGT]+").replace("GLOBAL", "").replace("from documents", "from {documents}"), documents=documents), "contigs", "zstd")
    part = F.substring(F.col("bases"), (F.col("contig") * 37 % (F.length("bases") - 59) + 1).cast("int"), F.lit(60))
    return contigs.where(F.length("bases") >= 60).select(F.col("contig").alias("query"), F.when(F.col("contig") % 2 == 1, C.reverse_complement(part)).otherwise(part).alias("bases")), contigs


@query(f"{_SEEDS} select query, strand, contig, cast(hit_start as int) as hit_start, cast(hit_end as int) as hit_end, cast(score as bigint) as score, count(*) as n_blocks from hits group by query, strand, contig, hit, hit_start, hit_end, score")
def realign_seed_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where sixty bases of each contig are found in all contigs."""
    return realign.seed_hits(*_contigs(spark, sf_dir))


@query(f"""{_SEEDS}, g as (select *, greatest(coalesce(lag(q1) over w - q0, 0), coalesce(lag(p1) over w - p0, 0), 0) as cut, lag(q1) over w as eq, lag(p1) over w as ep from hits window w as (partition by query, strand, contig, hit order by p0)),
 m as (select query, strand, contig, hit, q0 + cut as q0, p0 + cut as p0, q1, least(q0 + cut - eq, p0 + cut - ep) as common, p0 - ep - q0 + eq as more, eq, ep from g),
 o as (select m.*, length(t.bases) as q_len, coalesce(len(list_filter(range(1, common + 1), lambda i: substr(t.bases, cast(eq + i as int), 1) <> substr(c.bases, cast(ep + i as int), 1))), 0) as off from m join t using (query, strand) join contigs c using (contig)),
 a as (select *, q1 - q0 + coalesce(lead(common) over w, 0) as matched, lead(more) over w as next, sum(case when more = 0 then 0 else 1 end) over (w rows unbounded preceding) as part from o window w as (partition by query, strand, contig, hit order by p0)),
 b as (select query, strand, contig, hit, part, min(p0) as p0, min(q0) as q0, max(q1) as q1, max(q_len) as q_len, sum(matched) as matched, last(next order by p0) as next, sum(off + case when more >= 70 then 0 else abs(coalesce(more, 0)) end) as off from a group by all)
 select query, strand, contig, cast(min(p0) as int) as pos, concat(case when min(q0) > 0 then concat(min(q0), 'S') else '' end, string_agg(concat(matched, 'M', case when next >= 70 then concat(next, 'N') when next > 0 then concat(next, 'D') when next < 0 then concat(-next, 'I') else '' end), '' order by p0),
   case when max(q_len) > max(q1) then concat(max(q_len) - max(q1), 'S') else '' end) as cigar, cast(sum(off) as int) as nm from b group by query, strand, contig, hit""")
def hit_to_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same hits as alignments with their unequal bases."""
    queries, contigs = _contigs(spark, sf_dir)
    return realign.hit_alignments(realign.chained(realign.seed_blocks(queries, contigs)), queries, contigs)


def _affix(a: str, b: str, side: str) -> str:
    found = f"len(list_filter(range(1, least(len({a}), len({b})) + 1), lambda i: {side}({a}, i) = {side}({b}, i)))"
    return found if side == "right" else f"case when {a} = {b} then 0 else {found} end"


# The clip toward the next segment is placed there; every third hit begins and ends with an operation that isn't a match. The read shares with the genome what stands before the hit, from 0 to 14 bases.
_CLIPPED = f"""{_SEG}, genome as ({A.SITES_GENOME}), h as (select a.read_id, a.seg_ord, a.strand, a.q_len, a.nm, case when a.strand = '+' then 'MS' else 'SM' end as mode, case when a.strand = '+' then a.rt else a.lt end as clip_len,
  b.chrom, b.ref_start as hit_start, b.ref_end as hit_end, b.strand as hit_strand, b.nm * 10 as hit_nm, case when b.nm % 3 = 0 then concat('2S', b.q_match, 'M3S') else concat(b.q_match, 'M') end as hit_cigar, b.ref_end - b.ref_start - b.q_match as skip
  from seg a join seg b on a.read_id = b.read_id and b.seg_ord = a.seg_ord + 1),
 x as (select *, case when (strand = hit_strand) = (mode = 'MS') then hit_start - 15 else hit_end end as a, (strand = hit_strand) = (mode = 'MS') as is_left from h),
 r as (select *, case when hit_strand = '-' then {_rc(_slice('a', 'a + 15'))} else {_slice('a', 'a + 15')} end as ref from x),
 s as (select *, read_id % 15 as k, is_left = (hit_strand = '+') as suffix from r),
 o as (select *, case when suffix then repeat('N', cast(15 - k as int)) || right(ref, cast(k as int)) else left(ref, cast(k as int)) || repeat('N', cast(15 - k as int)) end as own from s),
 g as (select *, case when hit_cigar like '2S%' then 0 when suffix then {_affix('ref', 'own', 'right')} else {_affix('ref', 'own', 'left')} end as shared from o)"""


@query(f"""{_CLIPPED} select read_id, seg_ord, chrom, case when is_left then hit_start - shared else hit_start end as sa_start, hit_strand, cast(shared as int) as shared,
 case when hit_cigar like '2S%' and is_left then concat(q_len - clip_len + 2, substr(hit_cigar, 2)) when hit_cigar like '2S%' then concat(left(hit_cigar, len(hit_cigar) - 2), q_len - clip_len + 3, 'S')
   when is_left then concat(case when q_len - clip_len > shared then concat(q_len - clip_len - shared, 'S') else '' end, hit_end - hit_start - skip + shared, 'M')
   else concat(hit_end - hit_start - skip + shared, 'M', case when q_len - clip_len > shared then concat(q_len - clip_len - shared, 'S') else '' end) end as sa_cigar
 from g where shared <= 10 and hit_nm < 100""")
def softclip_to_chimeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of a read's list made of placed clips: start, the bases grown over, and the CIGAR of the whole read."""
    # The hops are made once; the genome is looked up beside their second sides only.
    h = S.pair_modes(S.adjacent_segments(_segments(spark, sf_dir), ("nm",)))
    h = stored(h.select("read_id", "q_len", *(f"{c}1" for c in ("seg_ord", "strand", "mode", "lt", "rt")), *(f"{c}2" for c in ("chrom", "strand", "ref_start", "ref_end", "q_match", "nm"))), "hops")
    genome = A.sites_genome(h.select(*(F.col(f"{c}2").alias(c) for c in ("chrom", "ref_start", "ref_end"))))
    hit = F.when(F.col("nm2") % 3 == 0, F.concat(F.lit("2S"), F.col("q_match2").cast("string"), F.lit("M3S"))).otherwise(F.concat(F.col("q_match2").cast("string"), F.lit("M")))
    x = h.select(
        "read_id", F.col("seg_ord1").alias("seg_ord"), F.col("strand1").alias("strand"), F.col("mode1").alias("mode"), "q_len", F.when(F.col("strand1") == "+", F.col("rt1")).otherwise(F.col("lt1")).alias("clip_len"),
        F.col("chrom2").alias("chrom"), F.col("ref_start2").alias("hit_start"), F.col("ref_end2").alias("hit_end"), F.col("strand2").alias("hit_strand"), (F.col("nm2") * 10).alias("hit_nm"), hit.alias("hit_cigar"),
    )
    # Bases of the read: those of the genome beside the hit stand where the read's own part ends.
    left = (F.col("strand") == F.col("hit_strand")) == (F.col("mode") == "MS")
    x = x.withColumn("_a", F.when(left, F.col("hit_start") - 15).otherwise(F.col("hit_end"))).withColumn("_b", F.col("_a") + 15)
    x = realign.genome_slice(x, genome, "chrom", "_a", "_b", "_r").withColumn("_r", realign.stranded(F.col("_r"), F.col("hit_strand"))).withColumn("k", (F.col("read_id") % 15).cast("int"))
    suffix = left == (F.col("hit_strand") == "+")
    pad = F.repeat(F.lit("N"), 15 - F.col("k"))
    own = F.when(suffix, F.concat(pad, F.right("_r", F.col("k")))).otherwise(F.concat(F.left("_r", F.col("k")), pad))
    outer = (F.col("strand") == "+") == (F.col("mode") == "MS")
    fill = lambda n: F.repeat(F.lit("N"), n)
    bases = F.when(outer, F.concat(fill(F.col("q_len") - F.col("clip_len") - 15), own, fill(F.col("clip_len")))).otherwise(F.concat(fill(F.col("clip_len")), own, fill(F.col("q_len") - F.col("clip_len") - 15)))
    x = realign.clip_alignment(x.withColumn("bases", bases).drop("_a", "_b", "_r"), genome)
    return x.select("read_id", "seg_ord", "chrom", "sa_start", "hit_strand", "shared", "sa_cigar")


# An insertion of 20 and more after the first 100 bases; its hit lies up to 15 beside it, on another chromosome or strand now and then.
_INSERTED = f"""{_SEG}, y as (select *, nm + 20 as ins_len, ref_start + 100 as ins_pos, ref_start + q_match as end_, case when mapq % 7 = 0 then 'chrX' else chrom end as hit_chrom, case when nm % 5 = 4 then '*' else strand end as hit_strand from seg),
 z as (select *, case when seg_ord % 2 = 0 then ins_pos + mapq % 30 - 15 else ins_pos - ins_len + mapq % 30 - 15 end as hit_start from y)"""


@query(f"""{_INSERTED} select read_id, seg_ord, concat(lt + 100 + ins_len, 'S', q_match - 100, 'M', case when rt > 0 then concat(rt, 'S') else '' end) as primary_cigar,
 concat(case when lt > 0 then concat(lt, 'S') else '' end, 100 + ins_len, 'M', q_match - 100 + rt, 'S') as sa_cigar, cast(nm + 100 - ins_len + 3 as int) as sa_nm
 from z where hit_chrom = chrom and hit_strand = strand and ((abs(hit_start - ins_pos) <= 10 and hit_start + ins_len <= end_) or (abs(hit_start + ins_len - ins_pos) <= 10 and hit_start >= ref_start))""")
def insertion_to_chimeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads parted at an insertion that was placed beside its own locus."""
    text = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    x = _segments(spark, sf_dir).withColumn("ins_len", F.col("nm") + 20).withColumn("ins_pos", F.col("ref_start") + 100).withColumn("ref_end", F.col("ref_start") + F.col("q_match"))
    cigar = text(F.col("lt"), "S", F.lit(100), "M", F.col("ins_len"), "I", F.col("q_match") - 100, "M", F.col("rt"), "S")
    off = F.col("mapq") % 30 - 15
    start = F.when(F.col("seg_ord") % 2 == 0, F.col("ins_pos") + off).otherwise(F.col("ins_pos") - F.col("ins_len") + off)
    x = x.withColumn("cigar", cigar).withColumn("hit_chrom", F.when(F.col("mapq") % 7 == 0, "chrX").otherwise(F.col("chrom"))).withColumn("hit_strand", F.when(F.col("nm") % 5 == 4, "*").otherwise(F.col("strand")))
    x = x.withColumn("hit_start", start).withColumn("hit_end", start + F.col("ins_len")).withColumn("hit_cigar", text(F.col("ins_len"), "M")).withColumn("hit_nm", F.lit(3)).withColumn("nm", F.col("nm") + 100)
    return realign.insertion_alignment(x).select("read_id", "seg_ord", "primary_cigar", "sa_cigar", F.col("sa_nm").cast("int").alias("sa_nm"))


# Chains lack their first segment, which is where the unaligned part is found again, if at all; the part's length is made shorter for most.
_CHAIN = f"""{_WITH}, c as (select * from alignments where seg_ord > 0), e as (select read_id, greatest(q_start - 50 * (nm % 5), 0) as part_len from c where seg_ord = 1),
 h as (select read_id, case when mapq % 11 = 0 then 'chrM' else chrom end as chrom, ref_start, strand, case when mapq % 4 = 0 then 0 else 60 end as mapq from alignments where seg_ord = 0 and mapq % 3 > 0),
 p as (select e.read_id, part_len, h.chrom, h.ref_start, h.strand, h.mapq, h.read_id is not null as has from e left join h using (read_id) where part_len >= 20),
 bad as (select read_id from p where part_len >= 200 and coalesce(mapq, 0) < 20)"""


@query(f"""{_CHAIN} select read_id, seg_ord as place, chrom, ref_start, strand, mapq, false as added from c where read_id not in (select read_id from bad)
 union all select read_id, 0, chrom, ref_start, strand, mapq, true from p where has and chrom <> 'chrM' and read_id not in (select read_id from bad)""")
def read_end_extension(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains with the segment that their unaligned start gives, without reads whose long start is found nowhere."""
    a = A.alignments(spark, sf_dir)
    chains = a.where("seg_ord > 0").withColumnRenamed("seg_ord", "place")
    ends = chains.where("place = 1").select("read_id", F.lit("start").alias("side"), F.greatest(F.col("q_start") - 50 * (F.col("nm") % 5), F.lit(0)).alias("part_len"))
    hits = a.where("seg_ord = 0 and mapq % 3 > 0").select("read_id", F.lit("start").alias("side"), F.when(F.col("mapq") % 11 == 0, "chrM").otherwise(F.col("chrom")).alias("chrom"), "ref_start", "strand", F.when(F.col("mapq") % 4 == 0, 0).otherwise(F.col("mapq")).alias("mapq"))
    return realign.extended_chains(chains, ends, hits)


# Clips are made of the family's digest, with up to six bases overwritten; reads of one family are much alike.
_CLIP = "concat(substr(b, 1, 8), repeat('T', cast(read_id % 7 as int)), substr(b, cast(9 + read_id % 7 as int), cast(10 + read_id % 3 as int)))"
# For rescue_score the links of all reads; for agg_rescued_support those of every fourth read.
_RESCUE_ALL = f"""{_HOP}, side as (select distinct h.read_id, h.chrom1, h.strand1, h.ref_start1, h.ref_end1, contains(s.cigar, 'N') as intron from hop h join seg s on s.read_id = h.read_id and s.seg_ord = h.seg_ord1),
 d as (select distinct chrom1, strand1, ref_start1, ref_end1, intron from side),
 m as (select s.read_id, s.fam, d.*, exists (select 1 from side o where o.read_id = s.read_id and o.chrom1 = d.chrom1 and o.strand1 = d.strand1 and o.ref_start1 = d.ref_start1 and o.ref_end1 = d.ref_end1 and o.intron = d.intron) as own
  from d join seg s on s.chrom = d.chrom1 and s.strand = d.strand1 and contains(s.cigar, 'N') = d.intron and s.mapq >= 25 and abs(s.ref_start - d.ref_start1) <= 10 and abs(s.ref_end - d.ref_end1) <= 10),
 cl as (select *, {_CLIP} as clip from (select *, translate(md5(cast(fam as varchar)), '0123456789abcdef', 'ACGTACGTACGTACGT') as b from m)),
 ok as (select distinct q.chrom1, q.strand1, q.ref_start1, q.ref_end1, q.read_id from cl q join cl t on q.chrom1 = t.chrom1 and q.strand1 = t.strand1 and q.ref_start1 = t.ref_start1 and q.ref_end1 = t.ref_end1
  where not q.own and t.own and levenshtein(q.clip, t.clip) <= 3 and least(len(q.clip), len(t.clip)) >= 0.8 * greatest(len(q.clip), len(t.clip)))"""
_RESCUE = _RESCUE_ALL.replace("s.seg_ord = h.seg_ord1),", "s.seg_ord = h.seg_ord1 where h.read_id % 4 = 0),")
_PLACE = ["chrom", "strand", "ref_start", "ref_end"]
_SIDE, _SIDE2 = ([f"{c}{i}" for c in _PLACE] for i in (1, 2))


def _rescued(spark: SparkSession, sf_dir: str, linked: str = "true") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(reads that the links of ``linked`` reads rescue, by segment: id and read_id; id and columns of the sides that they look like; those links: read_id, columns of both sides)."""
    segs = S.with_ends(A.alignments(spark, sf_dir, ranged=True))
    ahead = F.lead(F.struct(*(F.col(c).alias(f"{c}2") for c in _PLACE))).over(Window.partitionBy("read_id").orderBy("seg_ord"))
    segs = segs.select("read_id", "fam", *_PLACE, "mapq", rescue.intron_lengths(F.col("exons")).alias("_i"), ahead.alias("nxt"), F.expr(linked).alias("_linked"))
    # Written once for all uses. Where the next segment is, the segment is the first side of a link.
    segs = segs.withColumn("link", F.col("nxt").isNotNull() & F.col("_linked")).select("*", F.when(F.col("link"), F.col("nxt")).alias("to")).drop("nxt", "_linked")
    segs = stored(rescue.own_sides(segs), "segments", "zstd")
    sides, near = rescue.near_sides(segs, ["read_id", "fam"], mapq=25)
    near = near.withColumn("b", F.translate(F.md5(F.col("fam").cast("string")), "0123456789abcdef", "ACGTACGTACGTACGT"))
    near = stored(near.select("id", "read_id", F.expr(_CLIP).alias("clip"), "candidate"), "near", "zstd")
    found = realign.rescued(near.where("candidate"), near.where("not candidate"), ["id"]).select("id", "read_id")
    hops = segs.where("link").select("read_id", *(F.col(c).alias(f"{c}1") for c in _PLACE), "to.*")
    return found, sides, hops


@query(f"{_RESCUE_ALL} select * from ok")
def rescue_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads whose clip is like that of a read of the link."""
    found, sides, _ = _rescued(spark, sf_dir)
    return found.distinct().join(sides, "id").select(*_SIDE, "read_id")


@query(f"""{_RESCUE}, nodes as (select distinct chrom1 as chrom, strand1 as strand, ref_start1 as s, ref_end1 as e from ok),
 l as (select concat_ws(':', chrom1, strand1, ref_start1, ref_end1, '>', chrom2, strand2, ref_start2, ref_end2) as link, chrom1, strand1, ref_start1, ref_end1, chrom2, strand2, ref_start2, ref_end2, count(distinct read_id) as sr from hop where read_id % 4 = 0 group by all),
 n1 as (select l.link, count(distinct o.read_id) as n from l join ok o using (chrom1, strand1, ref_start1, ref_end1) group by 1),
 n2 as (select l.link, count(distinct o.read_id) as n from l join ok o on o.chrom1 = l.chrom2 and o.strand1 = l.strand2 and o.ref_start1 = l.ref_start2 and o.ref_end1 = l.ref_end2
  where not exists (select 1 from ok u where u.read_id = o.read_id and u.chrom1 = l.chrom1 and u.strand1 = l.strand1 and u.ref_start1 = l.ref_start1 and u.ref_end1 = l.ref_end1) group by 1)
 select link, sr as original_sr, sr + least(coalesce(n1.n, 0), 3) + least(coalesce(n2.n, 0), 3) as sr from l left join n1 using (link) left join n2 using (link)""")
def agg_rescued_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Support of links with the reads that were rescued at both sides, three at most at each."""
    text = lambda i: F.concat_ws(":", f"chrom{i}", f"strand{i}", F.col(f"ref_start{i}").cast("string"), F.col(f"ref_end{i}").cast("string"))
    found, sides, hops = _rescued(spark, sf_dir, "read_id % 4 = 0")
    links = hops.groupBy(*_SIDE, *_SIDE2).agg(F.count_distinct("read_id").alias("sr"))
    # Sides are numbers from here on; a second side that is no link's first one has no reads that look like it.
    ids = lambda i: sides.select(F.col("id").alias(f"node{i}"), *(F.col(c).alias(f"{c[:-1]}{i}") for c in _SIDE))
    links = links.join(ids(1), _SIDE, "left").join(ids(2), _SIDE2, "left").select(F.concat_ws(":", text(1), F.lit(">"), text(2)).alias("link"), "node1", "node2", "sr")
    found = stored(found.withColumnRenamed("id", "node"), "found", "zstd")
    return realign.rescued_support(stored(links, "links", "zstd"), found, found, 3)
