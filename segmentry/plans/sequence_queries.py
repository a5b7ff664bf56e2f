"""Queries over the genome, splice sites, tags and intervals; they join those of ``queries`` in its two tables."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from segmentry.functions import cigar as C
from segmentry.operators import genome as G
from segmentry.operators import events, ranges
from segmentry.plans.queries import _HOP, _SEG, _WITH, _links, _segments, query
from segmentry.sources import adapters as A

_GENOME = f"{_SEG}, genome as ({A.GENOME})"


def _slice(a: str, b: str) -> str:
    """SQL for a slice that starts at ``a`` (20 bases at most), or null."""
    first, last = f"(({a}) + 100) // 5000", f"(({b}) + 99) // 5000"
    one = f"(select substr(seq, cast(({a}) + 100 - 5000 * ({first}) + 1 as int), cast(({b}) - ({a}) as int)) from genome g where g.chrom = x.chrom and g.chunk_no = {first})"
    two = f"(select substr(seq, 1, cast(({b}) + 100 - 5000 * ({last}) as int)) from genome g where g.chrom = x.chrom and g.chunk_no = {last})"
    return f"case when {first} = {last} then {one} else {one} || {two} end"


def _rc(x: str) -> str:
    return f"reverse(translate({x}, 'ACGT', 'TGCA'))"


@query(f"with genome as ({A.GENOME}) select chrom, chunk_no, md5(seq) as digest from genome")
def scan_genome(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.genome(spark, sf_dir).select("chrom", "chunk_no", F.md5("seq").alias("digest"))


@query(f"{_GENOME}, x as (select distinct chrom, strand, ref_start, ref_end from seg) select chrom, strand, ref_start, ref_end, {_slice('ref_end - 110', 'ref_end - 90')} as bases from x")
def genome_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _segments(spark, sf_dir).select("chrom", "strand", "ref_start", "ref_end").distinct()
    x = x.withColumn("s", F.col("ref_end") - 110).withColumn("e", F.col("ref_end") - 90)
    return G.genome_slice(x, A.genome(spark, sf_dir), "chrom", "s", "e", "bases").drop("s", "e")


# An intron of the data runs from 100 to 800 after a segment's start.
_GOOD = f"""x as (select distinct chrom, strand, ref_start from seg where contains(cigar, 'N')),
 m as (select *, {_slice('ref_start + 100', 'ref_start + 102')} as l, {_slice('ref_start + 798', 'ref_start + 800')} as r from x),
 c as (select chrom, strand, ref_start, coalesce(case when strand = '+' then l || '-' || r else {_rc('r')} || '-' || {_rc('l')} end in ('GT-AG', 'GC-AG', 'AT-AC'), false) as good from m),
 gd as (select read_id, seg_ord from seg left join c using (chrom, strand, ref_start) where coalesce(good, true) or not contains(cigar, 'N'))"""


@query(f"{_GENOME}, {_GOOD} select read_id, seg_ord from gd")
def filter_canonical_introns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments six tenths of whose introns are canonical, or that have none."""
    return G.canonical_share(_segments(spark, sf_dir), A.genome(spark, sf_dir)).where("canonical >= 0.6 * introns").select("read_id", "seg_ord")


@query(f"""{_HOP}, genome as ({A.GENOME}), {_GOOD}, ok as (select * from gd union select read_id, seg_ord from seg where mapq >= 40) select read_id, seg_ord1, kind, pos1, pos2 from link semi join (select read_id, seg_ord as seg_ord1 from ok) using (read_id, seg_ord1) semi join (select read_id, seg_ord as seg_ord2 from ok) using (read_id, seg_ord2)""")
def classify_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types and breakpoints of the hops both of whose segments have canonical introns, or none. Introns of the data hardly ever are, so those of segments with a quality of 40 count as such."""
    good = filter_canonical_introns(spark, sf_dir).unionByName(_segments(spark, sf_dir).where("mapq >= 40").select("read_id", "seg_ord"))
    return events.between(_links(spark, sf_dir), good).select("read_id", "seg_ord1", "kind", "pos1", "pos2")


@query(f"""{_GENOME}, x as (select distinct chrom, strand, ref_start, ref_end from seg),
 t as (select *, case when strand = '+' then {_slice('ref_end', 'ref_end + 20')} else {_rc(_slice('ref_start - 20', 'ref_start'))} end as tail from x)
 select chrom, strand, ref_start, ref_end, len(tail) - len(replace(tail, 'A', '')) <= 6 as genuine from t""")
def filter_polya(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Is an end genuine, or null where the genome has no bases after it? The data have no runs of A, so a share of 0.3 stands for the limit."""
    nodes = _segments(spark, sf_dir).select("chrom", "strand", "ref_start", "ref_end").distinct()
    return G.genuine_ends(nodes, A.genome(spark, sf_dir), share=0.3).select("chrom", "strand", "ref_start", "ref_end", "genuine")


_SITES = f"""sites as (select distinct chrom, e_start - 5 as s_start, e_start + 5 as s_end, case when exon_no = 0 then 'XX' when strand = '+' then 'AG' else 'AC' end as motif from exons
 union select distinct chrom, e_end - 5, e_end + 5, case when exon_no = 2 then 'XX' when strand = '+' then 'GT' else 'CT' end from exons)"""


def _sites(spark: SparkSession, sf_dir: str, near: int = 5) -> DataFrame:
    w = Window.partitionBy("tx")
    x = A.exons(spark, sf_dir).withColumn("first", F.col("e_start") == F.min("e_start").over(w)).withColumn("last", F.col("e_start") == F.max("e_start").over(w))
    plus = F.col("strand") == "+"
    begin = F.struct(F.col("e_start").alias("at"), F.when(F.col("first"), "XX").when(plus, "AG").otherwise("AC").alias("motif"))
    end = F.struct(F.col("e_end").alias("at"), F.when(F.col("last"), "XX").when(plus, "GT").otherwise("CT").alias("motif"))
    x = x.select("chrom", F.explode(F.array(begin, end)).alias("s"))
    return x.select("chrom", (F.col("s.at") - near).alias("s_start"), (F.col("s.at") + near).alias("s_end"), "s.motif").distinct()


@query(f"with exons as ({A.EXONS}), {_SITES} select * from sites")
def splice_site_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sites(spark, sf_dir)


@query(f"{_HOP}, {_SITES}, d as (select distinct chrom1, pos1 from link) select chrom1, pos1, min(motif) as motif from d left join sites s on s.chrom = chrom1 and pos1 >= s_start and pos1 < s_end group by 1, 2")
def join_breakpoint_splice_site(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The smallest motif of the annotated sites around each breakpoint."""
    spots = _links(spark, sf_dir).select("chrom1", "pos1").distinct()
    on = (F.col("pos1") >= F.col("s_start")) & (F.col("pos1") < F.col("s_end"))
    hit = ranges.range_join(spots, _sites(spark, sf_dir), on, ("chrom1", "chrom"), ("pos1", "pos1"), ("s_start", "s_end"), width=1000)
    return spots.join(hit.groupBy("chrom1", "pos1").agg(F.min("motif").alias("motif")), ["chrom1", "pos1"], "left")


@query(f"""with exons as ({A.EXONS}), u as (select chrom, e_start, e_end, count(*) as k from exons group by 1, 2, 3), f as (select *, case when e_start <= max(e_end) over (partition by chrom order by e_start, e_end rows between unbounded preceding and 1 preceding) + 690 then 0 else 1 end as new from u),
 g as (select *, sum(new) over (partition by chrom order by e_start, e_end rows unbounded preceding) as island from f) select chrom, min(e_start) as u_start, max(e_end) as u_end, cast(sum(k) as bigint) as n from g group by chrom, island""")
def interval_union_adjacent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unions that bridge gaps; the data have none of one base, so gaps of 690 are bridged here."""
    return ranges.union(A.exons(spark, sf_dir), "chrom", "e_start", "e_end", touch=690)


@query(f"""with exons as ({A.EXONS}), p as (select a.tx as tx1, b.tx as tx2, count(*) filter (a.e_start = b.e_start and a.e_end = b.e_end) as same from exons a join exons b on b.tx = a.tx + 4 and a.tx % 8 < 4 group by 1, 2)
 select tx1, tx2, same, same = 3 as equal from p""")
def interval_set_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exons that the two transcripts of a locus share, and whether they have the same."""
    e = A.exons(spark, sf_dir).groupBy("tx").agg(F.sort_array(F.collect_set(F.struct("e_start", "e_end"))).alias("set"))
    x = e.where("tx % 8 < 4").select(F.col("tx").alias("tx1"), F.col("set").alias("s1")).join(e.select((F.col("tx") - 4).alias("tx1"), F.col("tx").alias("tx2"), F.col("set").alias("s2")), "tx1")
    return x.select("tx1", "tx2", F.size(F.array_intersect("s1", "s2")).cast("long").alias("same"), (F.col("s1") == F.col("s2")).alias("equal"))


@query(f"""with exons as ({A.EXONS}), n as (select tx * 3 + exon_no as node, chrom, strand, e_start as s, e_end as e from exons)
 select a.chrom, a.strand, a.node as node1, b.node as node2 from n a join n b on a.chrom = b.chrom and a.strand = b.strand and a.node < b.node and abs(a.s - b.s) <= 10 and abs(a.e - b.e) <= 10""")
def join_refine_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of exons of one strand whose ends are within 10."""
    n = A.exons(spark, sf_dir).select((F.col("tx") * 3 + F.col("exon_no")).alias("node"), "chrom", "strand", "e_start", "e_end")
    return ranges.near_pairs(n, ["chrom", "strand"], "node", "e_start", "e_end", 10)


@query(f"""with exons as ({A.EXONS}), b as (select *, e_start - lag(e_end) over (partition by tx order by e_start) as gap from exons)
 select tx, min(e_start) as pos, string_agg(concat(case when gap is null then '' when gap >= 690 then concat(gap, 'N') else concat(gap, 'D') end, e_end - e_start, 'M'), '' order by e_start) as cigar from b group by 1""")
def exons_to_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of a hit as one alignment: gaps up from a length are introns, shorter ones deletions."""
    b = A.exons(spark, sf_dir).withColumn("gap", F.col("e_start") - F.lag("e_end").over(Window.partitionBy("tx").orderBy("e_start")))
    gap = F.when(F.col("gap").isNull(), "").otherwise(F.concat(F.col("gap").cast("string"), F.when(F.col("gap") >= 690, "N").otherwise("D")))
    text = F.concat(gap, (F.col("e_end") - F.col("e_start")).cast("string"), F.lit("M"))
    rows = b.groupBy("tx").agg(F.min("e_start").alias("pos"), F.array_sort(F.collect_list(F.struct("e_start", text.alias("t")))).alias("ts"))
    return rows.select("tx", "pos", F.array_join(F.transform("ts", lambda x: x["t"]), "").alias("cigar"))


def _cs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Difference strings: matches, ``nm`` substitutions, and an insertion of 12 where ``nm`` is over 9."""
    a, nm = A.alignments(spark, sf_dir), F.col("nm")
    cs = F.concat(F.lit(":"), (F.col("q_match") - nm).cast("string"), F.repeat(F.lit("*ag"), nm), F.when(nm > 9, "+acgtacgtacgt").otherwise(""))
    return C.cs_stats(a.withColumn("cs", cs), "cs", 10)


@query(f"{_WITH} select read_id, seg_ord, q_match as ref_len, round(nm / cast(q_match as double), 9) as subs, round(case when nm > 9 then 1 else 0 end / cast(q_match as double), 9) as long_ins, 0.0::double as long_del from alignments")
def cs_variant_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cs(spark, sf_dir).select("read_id", "seg_ord", "ref_len", *(F.round(c, 9).alias(c) for c in ("subs", "long_ins", "long_del")))


@query(f"{_WITH} select read_id, seg_ord from alignments where seg_ord > 0 and nm <= 0.02 * q_match and case when nm > 9 then 1 else 0 end <= 0.001 * q_match")
def filter_supp_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cs(spark, sf_dir).where("seg_ord > 0 and subs <= 0.02 and long_ins <= 0.001 and long_del <= 0.001").select("read_id", "seg_ord")


@query(f"{_WITH} select read_id, seg_ord, ref_start + case when 45 + nm >= 25 + mapq then 100 else 150 end as ins_pos, greatest(45 + nm, 25 + mapq) as ins_len from alignments where greatest(45 + nm, 25 + mapq) >= 50")
def longest_insertion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest insertion of 50 or more; two are put into each segment from its mismatches and quality."""
    cigar = F.concat(F.lit("100M"), (F.col("nm") + 45).cast("string"), F.lit("I50M"), (F.col("mapq") + 25).cast("string"), F.lit("I50M"))
    found = C.longest_insertion(F.col("ref_start"), cigar)
    x = A.alignments(spark, sf_dir).select("read_id", "seg_ord", found.alias("i")).where("i.len >= 50")
    return x.select("read_id", "seg_ord", F.col("i.at").alias("ins_pos"), F.col("i.len").alias("ins_len"))
