"""Queries over the given tables, each with the same result in DuckDB's SQL."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from segmentry.functions import cigar as C
from segmentry.operators import events, graph
from segmentry.operators import segments as S
from segmentry.operators.ranges import range_join, union
from segmentry.sources import adapters as A
from segmentry.shared import stored
from segmentry.sources import sam

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# SQL over lists of CIGAR operations, for the oracle.
_OPS = r"regexp_extract_all(cigar, '\d+[MIDNSHPX=]')"


def _total(kinds: str) -> str:
    inside = ", ".join(f"'{k}'" for k in kinds)
    return f"cast(coalesce(list_sum(list_transform(list_filter({_OPS}, lambda o: right(o, 1) in ({inside})), lambda o: cast(left(o, len(o) - 1) as int))), 0) as int)"


_CLIPS = r"cast(coalesce(nullif(regexp_extract(cigar, '^(\d+)S', 1), ''), '0') as int)", r"cast(coalesce(nullif(regexp_extract(cigar, '(\d+)S$', 1), ''), '0') as int)"
_WITH = f"with alignments as ({A.ALIGNMENTS}), exons as ({A.EXONS})"
# The data's reads have one intron at most, so the oracle states exons directly.
_SEG = f"""{_WITH}, seg as (select *, ref_start + {_total("MDN")} as ref_end, case when lt > rt then 'SM' else 'MS' end as mode,
  case when contains(cigar, 'N') then concat(ref_start, '-', ref_start + 100, ';', ref_start + 800, '-', ref_start + {_total("MDN")})
    else concat(ref_start, '-', ref_start + {_total("MDN")}) end as exons from alignments),
node as (select *, concat(chrom, ':', exons, ':', strand) as node from seg)"""
_COLS = ("seg_ord", "chrom", "strand", "ref_start", "ref_end", "mode", "lt", "rt", "q_match")
_HOP = f"""{_SEG}, hop as (select a.read_id, a.fam, a.q_len, {", ".join(f"a.{c} as {c}1, b.{c} as {c}2" for c in _COLS)}
  from seg a join seg b on a.read_id = b.read_id and b.seg_ord = a.seg_ord + 1),
placed as (select *, case when strand1 = '+' then ref_end1 else ref_start1 end as pos1, case when strand2 = '+' then ref_start2 else ref_end2 end as pos2,
  case when strand1 = '+' then ref_start1 else ref_start2 end as us, case when strand1 = '+' then ref_end1 else ref_end2 end as ue,
  case when strand1 = '+' then ref_start2 else ref_start1 end as ds, case when strand1 = '+' then ref_end2 else ref_end1 end as de from hop),
typed as (select *, case when chrom1 = chrom2 and strand1 = strand2 and (ue - us) + (de - ds) - (de - us) <= 0 then 'DEL'
  when chrom1 = chrom2 and strand1 = strand2 then 'TDUP' when chrom1 = chrom2 and pos1 = pos2 then 'IDUP' when chrom1 = chrom2 then 'INV' else 'TRA' end as kind from placed),
link as (select *, case when kind = 'TDUP' then 'ICRL' when kind = 'INV' then 'ICTL' when kind = 'TRA' and mode1 = mode2 then 'ITTL' when kind = 'TRA' then 'ITPL' else 'NA' end as link from typed)"""


def query(sql: str) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return keep


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.with_ends(A.alignments(spark, sf_dir))


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.classify(S.adjacent_segments(_segments(spark, sf_dir)))


@query(f"{_WITH} select read_id, seg_ord, chrom, ref_start, strand, mapq, nm, cigar from alignments")
def scan_alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a SAM text, made of the alignments, read back; tags have the place in the read and the mismatches."""
    text = lambda c: F.col(c).cast("string")
    flag = (F.when(F.col("strand") == "-", 16).otherwise(0) + F.when(F.col("seg_ord") > 0, 2048).otherwise(0)).cast("string")
    fields = [text("read_id"), flag, "chrom", (F.col("ref_start") + 1).cast("string"), text("mapq"), "cigar", *(F.lit(c) for c in "*00**")]
    lines = A.alignments(spark, sf_dir).select(F.concat_ws("\t", *fields, F.concat(F.lit("NM:i:"), text("nm")), F.concat(F.lit("ZO:i:"), text("seg_ord"))).alias("line"))
    head = lines.limit(1).select(F.explode(F.array(F.lit("@HD\tVN:1.6\tSO:coordinate"), F.lit("cut\tshort"))).alias("line"))
    tag = lambda name: F.col("tags")[name].cast("int")
    sam.check_header(head)
    return sam.parse_sam(lines.unionByName(head)).select(F.col("name").cast("bigint").alias("read_id"), tag("ZO").alias("seg_ord"), "chrom", "ref_start", "strand", "mapq", tag("NM").alias("nm"), "cigar")


@query(f"{_WITH} select distinct chrom from alignments where not contains(chrom, '_') and not contains(chrom, 'M')")
def scan_contigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.alignments(spark, sf_dir).select("chrom").where(~F.col("chrom").contains("_") & ~F.col("chrom").contains("M")).distinct()


@query(f"{_WITH} select read_id, seg_ord, {_CLIPS[0]} as lt_clip, {_CLIPS[1]} as rt_clip, {_total('MI')} as read_match, {_total('MDN')} as ref_match, {_total('DN')} - {_total('I')} as indel, {_total('MIS')} as query_len from alignments")
def cigar_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.cigar_profile(A.alignments(spark, sf_dir))


@query(f"{_WITH} select read_id, seg_ord, cigar from alignments")
def cigar_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = F.regexp_replace("cigar", r"^100M", "60M0I40M")  # operations to be merged again
    return A.alignments(spark, sf_dir).select("read_id", "seg_ord", C.normalized(split).alias("cigar"))


@query(f"{_SEG} select read_id, seg_ord, exons, ref_end from seg")
def exons_from_cigar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _segments(spark, sf_dir).select("read_id", "seg_ord", C.text_of(F.col("exons")).alias("exons"), "ref_end")


@query(f"{_WITH} select read_id, seg_ord, case when contains(cigar, 'N') then concat(ref_start + 100, '-', ref_start + 800) else '' end as introns from alignments")
def introns_from_exons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _segments(spark, sf_dir).select("read_id", "seg_ord", C.text_of(C.gaps(F.col("exons"))).alias("introns"))


@query(f"{_WITH} select read_id, seg_ord, cast({_total('M')} + {_total('D')} as bigint) as exon_len from alignments")
def segment_exon_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _segments(spark, sf_dir).select("read_id", "seg_ord", F.aggregate("exons", F.lit(0).cast("bigint"), lambda a, x: a + x["end"] - x["start"]).alias("exon_len"))


@query("select doc_id, reverse(translate(text, 'ACGT', 'TGCA')) as revcomp from documents")
def revcomp_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", C.reverse_complement(F.col("text")).alias("revcomp"))


@query(f"""{_SEG}, r as ({A.READS.replace("as string", "as varchar")}), t as (select seg.*, case when strand = '-' then reverse(translate(bases, 'ACGT', 'TGCA')) else bases end as turned from seg join r using (read_id))
 select read_id, seg_ord, case when lt = rt then null when lt > rt then lt else rt end as clip_len, case when lt = rt then null when lt > rt then ref_start else ref_end end as anchor, case when lt = rt then null else mode end as mode,
 case when lt = rt then null when lt > rt then left(turned, lt) else right(turned, rt) end as bases, rt as ms_len, ref_end as ms_anchor, lt as sm_len, ref_start as sm_anchor from t""")
def softclip_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longer clip of each segment with its bases, null where both are equal; then that of either side."""
    s, tie = _segments(spark, sf_dir).join(A.reads(spark, sf_dir).select("read_id", "bases"), "read_id"), F.col("lt") == F.col("rt")
    left = F.col("lt") > F.col("rt")
    turned = F.when(F.col("strand") == "-", C.reverse_complement(F.col("bases"))).otherwise(F.col("bases"))
    pick = lambda l, r: F.when(~tie, F.when(left, l).otherwise(r))  # noqa: E731, E741
    return s.select(
        "read_id", "seg_ord", pick(F.col("lt"), F.col("rt")).alias("clip_len"), pick(F.col("ref_start"), F.col("ref_end")).alias("anchor"), F.when(~tie, F.col("mode")).alias("mode"),
        pick(F.left(turned, F.col("lt")), F.right(turned, F.col("rt"))).alias("bases"), F.col("rt").alias("ms_len"), F.col("ref_end").alias("ms_anchor"), F.col("lt").alias("sm_len"), F.col("ref_start").alias("sm_anchor"),
    )


@query(f"{_SEG} select a.read_id, a.seg_ord, a.mode, case when b.strand is null then null when (a.strand = b.strand) = (a.mode = 'MS') then 'SM' else 'MS' end as partner from seg a left join seg b on b.read_id = a.read_id and b.seg_ord = a.seg_ord + 1")
def segment_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mode of each segment, and the one that the next segment must have to go with it; null for the last."""
    nxt = F.lead("strand").over(Window.partitionBy("read_id").orderBy("seg_ord"))
    x = _segments(spark, sf_dir).withColumn("next", nxt)
    other = F.when(F.col("mode") == "MS", "SM").otherwise("MS")
    return x.select("read_id", "seg_ord", "mode", F.when(F.col("strand") == F.col("next"), other).when(F.col("next").isNotNull(), F.col("mode")).alias("partner"))


@query(f"{_HOP} select read_id, seg_ord1, (strand1 = strand2) = (mode1 <> mode2) as valid from hop")
def strand_mode_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.adjacent_segments(_segments(spark, sf_dir)).select("read_id", "seg_ord1", ((F.col("strand1") == F.col("strand2")) == (F.col("mode1") != F.col("mode2"))).alias("valid"))


@query(f"{_WITH}, sa as (select a.read_id, string_agg(concat_ws(',', b.chrom, b.ref_start + 1, b.strand, b.cigar, b.mapq, b.nm), ';' order by b.seg_ord) as sa from alignments a join alignments b on a.read_id = b.read_id and a.seg_ord = 0 and b.seg_ord > 0 group by 1) select a.read_id, a.chrom, a.ref_start, a.strand, a.cigar, a.mapq, a.nm from alignments a join sa using (read_id) where a.seg_ord > 0")
def sa_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = A.alignments(spark, sf_dir).where("seg_ord > 0")
    text = F.concat_ws(",", "chrom", (F.col("ref_start") + 1).cast("string"), "strand", "cigar", F.col("mapq").cast("string"), F.col("nm").cast("string"))
    tags = a.groupBy("read_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seg_ord", text.alias("t")))), lambda x: x["t"]), ";").alias("sa"))
    p = F.split("entry", ",")
    rows = tags.select("read_id", F.explode(F.split("sa", ";")).alias("entry"))
    return rows.select("read_id", p[0].alias("chrom"), (p[1].cast("bigint") - 1).alias("ref_start"), p[2].alias("strand"), p[3].alias("cigar"), p[4].cast("int").alias("mapq"), p[5].cast("int").alias("nm"))


@query(f"{_HOP} select read_id, seg_ord1, q_len - (case when strand1 = '+' then lt1 else rt1 end) - (case when strand2 = '+' then rt2 else lt2 end) - q_match1 - q_match2 as gap from hop")
def microhomology_len(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.microhomology(S.adjacent_segments(_segments(spark, sf_dir))).select("read_id", "seg_ord1", "gap")


@query(f"{_HOP} select link, count(*) as hops from link group by 1")
def link_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _links(spark, sf_dir).groupBy("link").agg(F.count("*").alias("hops"))


@query(f"{_SEG} select read_id, seg_ord, concat(chrom, ':', case when strand = '+' then ref_start else ref_end end) as prev_bp, concat(chrom, ':', case when strand = '+' then ref_end else ref_start end) as next_bp from seg")
def breakpoint_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    plus = F.col("strand") == "+"
    at = lambda c: F.concat_ws(":", "chrom", c.cast("string"))
    return _segments(spark, sf_dir).select("read_id", "seg_ord", at(F.when(plus, F.col("ref_start")).otherwise(F.col("ref_end"))).alias("prev_bp"), at(F.when(plus, F.col("ref_end")).otherwise(F.col("ref_start"))).alias("next_bp"))


@query(f"""{_SEG} select read_id, seg_ord, concat(chrom, ':', exons, ':', strand) as node, concat(chrom, '_[', case when contains(cigar, 'N') then concat(ref_start + 100, '-', ref_start + 800) else '' end, ']') as merge_key,
 concat_ws('-', chrom, ref_start, ref_end, strand, read_id) as unique_key, chrom as similar_key from seg""")
def node_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of nodes: all exons; introns only; the span and the read; the chromosome."""
    n = graph.nodes_of(_segments(spark, sf_dir))
    merge = F.concat("chrom", F.lit("_["), F.replace(C.text_of(C.gaps(F.col("exons"))), F.lit(";"), F.lit(",")), F.lit("]"))
    unique = F.concat_ws("-", "chrom", F.col("ref_start").cast("string"), F.col("ref_end").cast("string"), "strand", F.col("read_id").cast("string"))
    return n.select("read_id", "seg_ord", "node", merge.alias("merge_key"), unique.alias("unique_key"), F.col("chrom").alias("similar_key"))


@query(f"{_WITH} select read_id, seg_ord, mapq from alignments where seg_ord = 0 and mapq >= 25 and nm < 10 and read_id % 13 > 0")
def filter_primary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many mismatches stand for secondary (11) and unmapped (10) records, every thirteenth read has other places."""
    flag = F.when(F.col("seg_ord") > 0, 2048).otherwise(0) + F.when(F.col("nm") == 11, 256).when(F.col("nm") == 10, 4).otherwise(0)
    x = A.alignments(spark, sf_dir).withColumn("flag", flag).withColumn("xa", F.when(F.col("read_id") % 13 == 0, "chr1,+5,9M,0;"))
    return S.filter_primary(x, mapq=25).select("read_id", "seg_ord", "mapq")


@query(f"{_WITH} select read_id, seg_ord, nm from alignments where case when seg_ord = 0 then nm <= 8 else nm < 8 end")
def filter_nm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.filter_nm(A.alignments(spark, sf_dir), 8).select("read_id", "seg_ord", "nm")


@query(f"{_WITH} select read_id, seg_ord, chrom from alignments where read_id not in (select read_id from alignments where regexp_matches(chrom, '_|^chrM$|MT|2$'))")
def filter_contig(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contigs that end in 2 stand for the unwanted ones, which the data haven't."""
    return S.filter_contig(A.alignments(spark, sf_dir), "_|^chrM$|MT|2$").select("read_id", "seg_ord", "chrom")


@query(f"{_WITH} select read_id, seg_ord from alignments where read_id in (select read_id from alignments group by 1 having count(*) = max(nseg) and min(mapq) >= 22)")
def filter_complete_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.filter_complete_chain(A.alignments(spark, sf_dir), 22).select("read_id", "seg_ord")


@query(f"""{_SEG}, near as (select * exclude (ref_start, ref_end), ref_start - case when read_id % 4 = 0 then 5000 * seg_ord - read_id % 50 * seg_ord * 5 else 0 end as ref_start,
   ref_end - case when read_id % 4 = 0 then 5000 * seg_ord - read_id % 50 * seg_ord * 5 else 0 end as ref_end from seg)
 select read_id, seg_ord from near where read_id not in (select a.read_id from near a join near b on a.read_id = b.read_id and a.seg_ord < b.seg_ord
  where a.chrom = b.chrom and a.strand <> b.strand and (abs(a.ref_start - b.ref_start) <= 20 or abs(a.ref_end - b.ref_end) <= 20
  or ((abs(a.ref_start - b.ref_start) between 21 and 199 or abs(a.ref_end - b.ref_end) between 21 and 199) and abs(a.mapq - b.mapq) > 10)))""")
def filter_rt_artifact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of every fourth read are moved to its first locus, as the data have none that close. Mapping quality stands for base quality."""
    by = F.when(F.col("read_id") % 4 == 0, 5000 * F.col("seg_ord") - F.col("read_id") % 50 * F.col("seg_ord") * 5).otherwise(0)
    x = _segments(spark, sf_dir).withColumn("ref_start", F.col("ref_start") - by).withColumn("ref_end", F.col("ref_end") - by)
    return S.filter_rt_artifact(x).select("read_id", "seg_ord")


@query(f"{_HOP} select read_id, seg_ord1, kind from link where kind in ('TDUP', 'INV', 'TRA', 'DEL', 'IDUP') and read_id % 17 > 0")
def filter_sv_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hops of every seventeenth read are given a type that isn't kept."""
    x = _links(spark, sf_dir).withColumn("kind", F.when(F.col("read_id") % 17 == 0, "BND").otherwise(F.col("kind")))
    return events.filter_sv_types(x).select("read_id", "seg_ord1", "kind")


@query(f"{_HOP} select read_id, count(*) as hops from link group by 1 having not bool_and(kind = 'DEL')")
def filter_not_all_del(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = _links(spark, sf_dir).groupBy("read_id").agg(F.count("*").alias("hops"), F.bool_and(F.col("kind") == "DEL").alias("all_del"))
    return kept.where("not all_del").select("read_id", "hops")


@query(f"{_SEG} select read_id, cast(min({_total('MD')}) as bigint) as least from seg group by 1 having min({_total('MD')}) > 203")
def filter_min_node_len(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The data's segments are long, so 203 stands for the limit."""
    return S.filter_min_node_len(_segments(spark, sf_dir), 203)


@query(f"""{_WITH}, c as (select *, case when strand = '+' then lt else rt end as q_at from alignments),
 o as (select *, row_number() over w - 1 as chain_ord, q_at - lag(q_at + q_match) over w as gap from c window w as (partition by read_id order by q_at, seg_ord))
 select read_id, seg_ord, cast(chain_ord as int) as chain_ord, gap, bool_and(coalesce(abs(gap) <= 10, true)) over (partition by read_id) as fits from o""")
def chain_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.chain_segments(A.alignments(spark, sf_dir)).select("read_id", "seg_ord", "chain_ord", "gap", "fits")


@query(f"{_HOP} select read_id, seg_ord1, seg_ord2, chrom1, chrom2, mode1, mode2 from hop")
def join_adjacent_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.adjacent_segments(_segments(spark, sf_dir)).select("read_id", "seg_ord1", "seg_ord2", "chrom1", "chrom2", "mode1", "mode2")


@query(f"{_SEG} select a.read_id, a.seg_ord as seg_ord1, b.seg_ord as seg_ord2, a.chrom = b.chrom as same_chrom from seg a join seg b on a.read_id = b.read_id and a.seg_ord < b.seg_ord")
def join_segment_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.segment_pairs(_segments(spark, sf_dir)).select("read_id", "seg_ord1", "seg_ord2", (F.col("chrom1") == F.col("chrom2")).alias("same_chrom"))


@query(f"{_WITH} select read_id, seg_ord, case when seg_ord = min(seg_ord) over w then 'HEAD' when seg_ord = max(seg_ord) over w then 'TAIL' else 'MID' end as identity from alignments window w as (partition by read_id)")
def segment_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.segment_identity(A.alignments(spark, sf_dir)).select("read_id", "seg_ord", "identity")


@query(f"{_HOP} select kind, link, chrom1, pos1, strand1, chrom2, pos2, strand2, count(distinct read_id) as support, min(read_id) as first_read, string_agg(distinct read_id, ',' order by read_id) as reads from link group by all")
def agg_link_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Support of each link with the list of its reads; ``agg_link_reads`` has a row for each."""
    return events.supported(_links(spark, sf_dir), with_reads=True)


@query(f"{_HOP} select distinct kind, link, chrom1, pos1, strand1, chrom2, pos2, strand2, read_id from link")
def agg_link_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reads behind each link, a row for each, so that a link of many reads is no long row."""
    return _links(spark, sf_dir).select(*events.LINK, "read_id").distinct()


_GENE = "genes as (select gene, chrom, min(e_start) as g_start, max(e_end) as g_end from exons group by gene, chrom, floor(e_start / 5000))"
_GENES_AT = "(select string_agg(distinct gene, '&' order by gene) from genes g where g.chrom = l.chrom{0} and l.pos{0} >= g_start - 5 and l.pos{0} < g_end + 5)"


@query(f"{_HOP}, {_GENE}, p as (select distinct chrom1, pos1 from link) select chrom1, pos1, coalesce({_GENES_AT.format(1)}, 'INTERGENIC') as gene1 from p l")
def join_breakpoint_gene(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _links(spark, sf_dir).select("chrom1", "pos1").distinct()
    return events.genes_at(points, A.genes(spark, sf_dir), ("chrom1", "pos1", "gene1"))


@query(f"""{_HOP}, {_GENE}, s as (select kind, link, chrom1, pos1, strand1, chrom2, pos2, strand2, count(distinct read_id) as support, min(read_id) as first_read from link group by all)
 select *, coalesce({_GENES_AT.format(1)}, 'INTERGENIC') as gene1, coalesce({_GENES_AT.format(2)}, 'INTERGENIC') as gene2 from s l""")
def supported_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: links with their type, support and genes."""
    links, spans = events.supported(_links(spark, sf_dir)), A.genes(spark, sf_dir)
    return events.genes_at(links, spans, ("chrom1", "pos1", "gene1"), ("chrom2", "pos2", "gene2"))


@query(f"{_SEG}, n as (select distinct chrom, ref_start, ref_end from seg), {_GENE} select n.*, gene from n join genes g on n.chrom = g.chrom and n.ref_start < g_end and g_start < n.ref_end")
def join_node_gene(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = _segments(spark, sf_dir).select("chrom", "ref_start", "ref_end").distinct()
    spans = A.genes(spark, sf_dir).withColumnRenamed("chrom", "g_chrom")
    hit = range_join(nodes, spans, (F.col("ref_start") < F.col("g_end")) & (F.col("g_start") < F.col("ref_end")), ("chrom", "g_chrom"), ("ref_start", "ref_end"), ("g_start", "g_end"))
    return hit.select("chrom", "ref_start", "ref_end", "gene")


_PAIR = "a.tx as tx1, a.exon_no as no1, b.tx as tx2, b.exon_no as no2"


def _exon_pairs(spark: SparkSession, sf_dir: str, on) -> DataFrame:
    e = A.exons(spark, sf_dir)
    x = e.select(F.col("tx").alias("tx1"), F.col("exon_no").alias("no1"), F.col("chrom").alias("c1"), F.col("e_start").alias("s1"), F.col("e_end").alias("e1"))
    y = e.select(F.col("tx").alias("tx2"), F.col("exon_no").alias("no2"), F.col("chrom").alias("c2"), F.col("e_start").alias("s2"), F.col("e_end").alias("e2"))
    return range_join(x, y, on, ("c1", "c2"), ("s1", "e1"), ("s2", "e2"), width=1000)


@query(f"with exons as ({A.EXONS}) select {_PAIR}, greatest(a.e_start, b.e_start) as o_start, least(a.e_end, b.e_end) as o_end, least(a.e_start, b.e_start) as u_start, greatest(a.e_end, b.e_end) as u_end from exons a join exons b on a.chrom = b.chrom and a.tx < b.tx and a.e_start <= b.e_end and b.e_start <= a.e_end")
def interval_overlap_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _exon_pairs(spark, sf_dir, (F.col("tx1") < F.col("tx2")) & (F.col("s1") <= F.col("e2")) & (F.col("s2") <= F.col("e1")))
    return x.select("tx1", "no1", "tx2", "no2", F.greatest("s1", "s2").alias("o_start"), F.least("e1", "e2").alias("o_end"), F.least("s1", "s2").alias("u_start"), F.greatest("e1", "e2").alias("u_end"))


@query(f"with exons as ({A.EXONS}) select {_PAIR}, a.e_start = b.e_start as same_left, a.e_end = b.e_end as same_right, a.e_start = b.e_start and a.e_end = b.e_end as equal from exons a join exons b on a.chrom = b.chrom and a.tx <> b.tx and a.e_start <= b.e_start and b.e_end <= a.e_end")
def interval_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals in closed ones, and which of their ends are the same."""
    x = _exon_pairs(spark, sf_dir, (F.col("tx1") != F.col("tx2")) & (F.col("s1") <= F.col("s2")) & (F.col("e2") <= F.col("e1")))
    left, right = F.col("s1") == F.col("s2"), F.col("e1") == F.col("e2")
    return x.select("tx1", "no1", "tx2", "no2", left.alias("same_left"), right.alias("same_right"), (left & right).alias("equal"))


@query(f"""with exons as ({A.EXONS}), u as (select chrom, e_start, e_end, count(*) as k from exons group by 1, 2, 3), f as (select *, case when e_start <= max(e_end) over (partition by chrom order by e_start, e_end rows between unbounded preceding and 1 preceding) then 0 else 1 end as new from u),
 g as (select *, sum(new) over (partition by chrom order by e_start, e_end rows unbounded preceding) as island from f) select chrom, min(e_start) as u_start, max(e_end) as u_end, cast(sum(k) as bigint) as n from g group by chrom, island""")
def interval_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return union(A.exons(spark, sf_dir), "chrom", "e_start", "e_end")


@query(f"with exons as ({A.EXONS}) select tx, exon_no, chrom, e_start + 10 as s_start, e_end - 10 as s_end from exons where e_end - e_start >= 120")
def exon_table_shrunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.exons(spark, sf_dir).where("e_end - e_start >= 120").select("tx", "exon_no", "chrom", (F.col("e_start") + 10).alias("s_start"), (F.col("e_end") - 10).alias("s_end"))


@query(f"""with exons as ({A.EXONS}), i as (select tx, chrom, strand, 'intron' as kind, e_end as s, lead(e_start) over (partition by tx order by e_start) as e from exons)
 select tx, chrom, strand, 'exon' as kind, e_start - 10 as s, e_end + 10 as e from exons union all select tx, chrom, strand, kind, s - 10, e + 10 from i where e is not null""")
def exon_intron_table_expanded(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = A.exons(spark, sf_dir)
    introns = e.withColumn("e", F.lead("e_start").over(Window.partitionBy("tx").orderBy("e_start"))).where("e is not null")
    introns = introns.select("tx", "chrom", "strand", F.lit("intron").alias("kind"), (F.col("e_end") - 10).alias("s"), (F.col("e") + 10).alias("e"))
    return e.select("tx", "chrom", "strand", F.lit("exon").alias("kind"), (F.col("e_start") - 10).alias("s"), (F.col("e_end") + 10).alias("e")).unionByName(introns)


@query(f"with exons as ({A.EXONS}) select gene, chrom, min(e_start) - 5 as g_start, max(e_end) + 5 as g_end from exons group by gene, chrom, floor(e_start / 5000)")
def gene_region_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.genes(spark, sf_dir).select("gene", "chrom", (F.col("g_start") - 5).alias("g_start"), (F.col("g_end") + 5).alias("g_end"))


@query(f"{_WITH} select count(*) as chimeric from (select distinct read_id, lt, rt from alignments where seg_ord > 0)")
def agg_chimeric_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.alignments(spark, sf_dir).where("seg_ord > 0").agg(F.count_distinct("read_id", "lt", "rt").alias("chimeric"))


@query(f"{_HOP}, d as (select distinct chrom1, pos1 from link) select chrom1, pos1, count(s.read_id) as depth from d left join seg s on s.chrom = d.chrom1 and s.ref_start < d.pos1 + 1 and s.ref_end > d.pos1 - 1 group by 1, 2")
def agg_breakpoint_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads over each breakpoint. Equal segments are counted first, so the join sees them once."""
    spots = stored(_links(spark, sf_dir).select("chrom1", "pos1").distinct(), "spots")
    spans = _segments(spark, sf_dir).groupBy("chrom", "ref_start", "ref_end").agg(F.count("*").alias("n"))
    hit = range_join(spots, spans, (F.col("ref_start") < F.col("pos1") + 1) & (F.col("ref_end") > F.col("pos1") - 1), ("chrom1", "chrom"), ("pos1", "pos1"), ("ref_start", "ref_end"))
    depth = hit.groupBy("chrom1", "pos1").agg(F.sum("n").alias("depth"))
    return spots.join(depth, ["chrom1", "pos1"], "left").select("chrom1", "pos1", F.coalesce("depth", F.lit(0)).alias("depth"))


_GRAPH = f"""{_SEG}, n2 as (select *, concat(chrom, ':', exons, ':', strand) as node2 from seg),
edges as (select a.node2 as src, b.node2 as dst, count(distinct a.read_id) as sr from n2 a join n2 b on a.read_id = b.read_id and b.seg_ord = a.seg_ord + 1 group by 1, 2)"""


@query(f"{_GRAPH} select src, dst, sr from edges")
def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.edges_of(_segments(spark, sf_dir))


@query(f"{_GRAPH} select src, dst, sr from edges where sr >= 2")
def filter_min_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.edges_of(_segments(spark, sf_dir)).where("sr >= 2")


@query(f"{_GRAPH} select distinct src as node, 'start' as side from edges where src not in (select dst from edges) union all select distinct dst, 'end' from edges where dst not in (select src from edges)")
def graph_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.graph_ends(graph.edges_of(_segments(spark, sf_dir)))


# Structures share nodes only within a family, and all of a family share the first; so a cluster is a family here.
@query(f"""{_SEG}, p as (select read_id, fam, string_agg(concat(chrom, ':', exons, ':', strand), '|' order by seg_ord) as path from seg group by 1, 2),
 s as (select path, fam, min(read_id) as path_id, count(*) as reads from p group by 1, 2) select path_id, reads, min(path_id) over (partition by fam) as cluster_id from s""")
def cluster_structures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.cluster_paths(_segments(spark, sf_dir))


@query(f"{_HOP}, p as (select read_id, count(*) as hops, bool_or(kind = 'TRA') as crosses from link group by 1) select hops, crosses, count(*) as reads from p group by 1, 2")
def path_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    per_read = _links(spark, sf_dir).groupBy("read_id").agg(F.count("*").alias("hops"), F.bool_or(F.col("kind") == "TRA").alias("crosses"))
    return per_read.groupBy("hops", "crosses").agg(F.count("*").alias("reads"))
