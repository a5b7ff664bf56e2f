"""Queries over hops, paths and graphs; they join those of ``queries`` in its two tables."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from segmentry.operators import graph, pathnodes, paths, ranges
from segmentry.operators import segments as S
from segmentry.operators.components import connected_components
from segmentry.plans.queries import _GENE, _GRAPH, _HOP, _SEG, _WITH, _links, _segments, query
from segmentry.shared import stored
from segmentry.sources import adapters as A
from segmentry.sources import sinks

_FITS = "(strand1 = strand2) = (mode1 <> mode2)"
_GAP = "q_len - (case when strand1 = '+' then lt1 else rt1 end) - (case when strand2 = '+' then rt2 else lt2 end) - q_match1 - q_match2"
_GAPS = f"{_HOP}, gaps as (select *, {_GAP} as gap from hop)"
_PATHS = """p as (select read_id, fam, string_agg(node, '|' order by seg_ord) as path from node group by 1, 2),
 s as (select path, fam, min(read_id) as path_id, count(*) as reads from p group by 1, 2)"""


def _hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.adjacent_segments(_segments(spark, sf_dir))


@query(f"{_HOP} select read_id, seg_ord1, cast(case when {_FITS} then case when (strand1 || mode1) in ('+MS', '-SM') then 1 else 2 end end as int) as donor from hop")
def donor_acceptor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.with_donor(_hops(spark, sf_dir)).select("read_id", "seg_ord1", "donor")


@query(f"""{_HOP}, o as (select read_id, seg_ord1, (strand1 || mode1) in ('+MS', '-SM') as f from hop where {_FITS}),
 d as (select read_id, case when f then seg_ord1 else seg_ord1 + 1 end as up, case when f then seg_ord1 + 1 else seg_ord1 end as down,
  row_number() over (partition by read_id order by seg_ord1) - 1 as i, count(*) over (partition by read_id) as n from o),
 b as (select x.read_id from d x join d y on x.read_id = y.read_id and x.i = 0 and y.i = 1 where x.down <> y.up)
 select read_id, up, down, cast(case when read_id in (select read_id from b) then n - 1 - i else i end as int) as hop_ord from d""")
def order_transcription(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.order_transcription(_hops(spark, sf_dir)).select("read_id", "up", "down", "hop_ord")


def _kind(one: str, two: str) -> str:
    """The type of a hop between two sides, given by the prefixes of their columns."""
    c = lambda side, name: f"{side}_{name}"
    before, after = (f"case when {c(one, 'strand')} = '+' then {c(x, e)} else {c(y, e)} end" for x, y, e in ((one, two, "e"), (two, one, "s")))
    out1, in2 = f"case when {c(one, 'strand')} = '+' then {c(one, 'e')} else {c(one, 's')} end", f"case when {c(two, 'strand')} = '+' then {c(two, 's')} else {c(two, 'e')} end"
    return f"case when {c(one, 'chrom')} <> {c(two, 'chrom')} then 'TRA' when {c(one, 'strand')} = {c(two, 'strand')} then case when ({before}) - ({after}) <= 0 then 'DEL' else 'TDUP' end when ({out1}) = ({in2}) then 'IDUP' else 'INV' end"


# Insertions of 2 bases and more are placed 2,000 after the upstream segment, on the other strand in odd reads, or over the downstream one in every third.
_NODES = f"""{_GAPS}, o as (select read_id, seg_ord1, (strand1 || mode1) in ('+MS', '-SM') as f from hop where {_FITS}),
 d as (select read_id, seg_ord1, case when f then seg_ord1 else seg_ord1 + 1 end as up, case when f then seg_ord1 + 1 else seg_ord1 end as down, row_number() over (partition by read_id order by seg_ord1) - 1 as i, count(*) over (partition by read_id) as n from o),
 b as (select x.read_id from d x join d y on x.read_id = y.read_id and x.i = 0 and y.i = 1 where x.down <> y.up),
 x as (select d.read_id, case when d.read_id in (select read_id from b) then n - 1 - i else i end as hop_ord, link.kind, gap, u.chrom as u_chrom, u.strand as u_strand, u.ref_start as u_s, u.ref_end as u_e, w.chrom as d_chrom, w.strand as d_strand, w.ref_start as d_s, w.ref_end as d_e,
   link.chrom1, link.strand1, link.ref_end1, link.chrom2, link.ref_start2 from d join seg u on u.read_id = d.read_id and u.seg_ord = up join seg w on w.read_id = d.read_id and w.seg_ord = down join gaps g on g.read_id = d.read_id and g.seg_ord1 = d.seg_ord1 join link on link.read_id = d.read_id and link.seg_ord1 = d.seg_ord1),
 y as (select *, case when read_id % 3 = 0 then chrom2 else chrom1 end as i_chrom, case when read_id % 2 = 0 then strand1 when strand1 = '+' then '-' else '+' end as i_strand, case when read_id % 3 = 0 then ref_start2 else ref_end1 + 2000 end as i_s from x),
 z as (select *, i_s + gap as i_e from y), k as (select *, {_kind('u', 'i')} as k1, {_kind('i', 'd')} as k2 from z), sp as (select *, gap >= 2 and k1 in ('DEL', 'TDUP', 'TRA') and k2 in ('DEL', 'TDUP', 'TRA') as split, max(hop_ord) over (partition by read_id) as last from k),
 nd as (select read_id, 2 * hop_ord as key, u_chrom as chrom, u_strand as strand, u_s as n_start, u_e as n_end, 'segment' as source, case when split then k1 else kind end as kind, case when split then 'Insertion' when gap > 0 then 'NovelInsertion' when gap < 0 then 'MicroHomology' else 'none' end as payload, cast(abs(gap) as int) as payload_len from sp
  union all select read_id, 2 * hop_ord + 1, i_chrom, i_strand, i_s, i_e, 'insertion', k2, 'none', 0 from sp where split union all select read_id, 2 * hop_ord + 2, d_chrom, d_strand, d_s, d_e, 'segment', null, null, null from sp where hop_ord = last),
 pl as (select *, cast(row_number() over (partition by read_id order by key) - 1 as int) as place, count(*) over (partition by read_id) as n from nd)"""


@query(f"{_NODES} select read_id, place, chrom, strand, n_start, n_end, source, kind, payload, payload_len, case when place = 0 then 'HEAD' when place = n - 1 then 'TAIL' else 'MID' end as ident from pl")
def build_path_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of each read's path in the direction of transcription, with those that its placed insertions make."""
    hops = paths.with_payload(_links(spark, sf_dir))
    far, odd = F.col("read_id") % 3 == 0, F.col("read_id") % 2 == 1
    turned = F.when(odd, F.when(F.col("strand1") == "+", "-").otherwise("+")).otherwise(F.col("strand1"))
    start = F.when(far, F.col("ref_start2")).otherwise(F.col("ref_end1") + 2000)
    placed = hops.where("gap >= 2").select("read_id", "seg_ord1", F.when(far, F.col("chrom2")).otherwise(F.col("chrom1")).alias("chrom"), turned.alias("strand"), start.alias("ref_start"), (start + F.col("gap")).alias("ref_end"))
    return pathnodes.path_nodes(hops, placed, ("DEL", "TDUP", "TRA"))


@query(f"{_GAPS} select read_id, cast(sum(case when gap = 0 then 2 when gap < 0 then 1 else 0 end) as bigint) as score from gaps group by 1")
def agg_edge_payload_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.with_payload(_hops(spark, sf_dir)).groupBy("read_id").agg(F.sum("payload_score").alias("score"))


@query(f"{_GAPS} select read_id, cast(max(greatest(gap, 0)) as int) as longest from gaps group by 1 having max(greatest(gap, 0)) <= 2")
def filter_max_insertion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Insertions of the data have 3 bases at most, so 2 stands for the limit."""
    return paths.filter_max_insertion(_hops(spark, sf_dir), 2)


@query(f"{_GAPS} select read_id, seg_ord1, gap from gaps where gap <= 2")
def filter_microinsertion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2 stands for the limit here too."""
    return paths.filter_microinsertion(_hops(spark, sf_dir), 2).select("read_id", "seg_ord1", "gap")


@query(f"{_GAPS} select read_id, seg_ord1, gap from gaps where gap >= -4")
def filter_rt_switching(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.filter_rt_switching(_hops(spark, sf_dir), 4).select("read_id", "seg_ord1", "gap")


@query(f"{_GAPS} select read_id, count(*) as hops from gaps group by 1 having bool_and(gap >= -4)")
def filter_all_hops_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.filter_all_hops_kept(paths.filter_rt_switching(_hops(spark, sf_dir), 4), _segments(spark, sf_dir))


@query(f"""{_WITH}, sa as (select read_id, seg_ord, lt, rt, nm from alignments where seg_ord > 0), supp as (select distinct read_id, lt, rt from sa where nm <= 9)
 select read_id, seg_ord from sa where read_id not in (select read_id from sa left join supp using (read_id, lt, rt) where supp.read_id is null)""")
def join_supp_to_sa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of reads all of whose entries have a supplementary alignment of few mismatches."""
    sa = A.alignments(spark, sf_dir).where("seg_ord > 0").select("read_id", "seg_ord", "lt", "rt", "nm")
    supp = sa.where("nm <= 9").select("read_id", "lt", "rt").distinct().withColumn("found", F.lit(1))
    all_found = F.count("found").over(Window.partitionBy("read_id")) == F.count("*").over(Window.partitionBy("read_id"))
    return sa.join(supp, ["read_id", "lt", "rt"], "left").withColumn("whole", all_found).where("whole").select("read_id", "seg_ord")


@query(f"""{_HOP}, n2 as (select read_id, seg_ord, node from node) select distinct a.node as src, b.node as dst, pos1, pos2
 from link l join n2 a on a.read_id = l.read_id and a.seg_ord = l.seg_ord1 join n2 b on b.read_id = l.read_id and b.seg_ord = l.seg_ord2""")
def polish_breakpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Breakpoints of each edge from the ends of its nodes."""
    segs = graph.nodes_of(_segments(spark, sf_dir))
    plus = F.col("strand") == "+"
    ends = segs.select("node", F.when(plus, F.col("ref_end")).otherwise(F.col("ref_start")).alias("out"), F.when(plus, F.col("ref_start")).otherwise(F.col("ref_end")).alias("in")).distinct()
    e = graph.edges_of(_segments(spark, sf_dir)).select("src", "dst")
    e = e.join(ends.select(F.col("node").alias("src"), F.col("out").alias("pos1")), "src")
    return e.join(ends.select(F.col("node").alias("dst"), F.col("in").alias("pos2")), "dst").select("src", "dst", "pos1", "pos2")


@query(f"""{_GRAPH}, p as (select read_id, string_agg(node2, '|' order by seg_ord) as path from n2 group by 1), s as (select path, min(read_id) as path_id from p group by 1),
 st as (select path_id, unnest(string_split(path, '|')) as node, unnest(range(0, len(string_split(path, '|')))) as i from s),
 h as (select a.path_id, a.node as src, b.node as dst from st a join st b on a.path_id = b.path_id and b.i = a.i + 1)
 select path_id, min(sr) as sr, cast(sum(sr) as bigint) as sum_sr from h join edges using (src, dst) group by 1""")
def agg_path_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    segs = _segments(spark, sf_dir)
    return paths.path_support(segs, graph.edges_of(segs))


@query(f"{_SEG}, {_PATHS}, st as (select path_id, fam, unnest(string_split(path, '|')) as node from s), c as (select fam, count(*) as n from s group by 1) select node, count(*) as ptc, round(count(*) / cast(max(n) as double), 9) as ptf from st join c using (fam) group by node")
def agg_traversal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths through each node, and their share of the cluster's paths."""
    segs = _segments(spark, sf_dir)
    own = graph.cluster_paths(segs).select("path_id", "cluster_id")
    total = own.groupBy("cluster_id").agg(F.count("*").alias("n"))
    x = paths.path_steps(segs).select("path_id", "node").distinct().join(own, "path_id").join(total, "cluster_id")
    return x.groupBy("node").agg(F.count("*").alias("ptc"), F.round(F.count("*") / F.max("n"), 9).alias("ptf"))


@query(f"{_SEG}, {_PATHS} select path_id, cast(len(string_split(path, '|')) as int) as n_nodes, replace(path, '|', '>') as elements from s")
def agg_path_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = graph.structures(_segments(spark, sf_dir))
    return s.select("path_id", F.size(F.split("path", r"\|")).alias("n_nodes"), F.replace("path", F.lit("|"), F.lit(">")).alias("elements"))


@query(f"{_SEG}, {_PATHS} select path_id, cast(len(string_split(path, '|')) as int) as n_nodes, path from s order by 2, 3")
def sort_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = graph.structures(_segments(spark, sf_dir)).select("path_id", F.size(F.split("path", r"\|")).alias("n_nodes"), "path")
    return s.orderBy("n_nodes", "path")


_VCF = f"""{_HOP}, {_PATHS}, l as (select link, chrom1, pos1, chrom2, pos2, count(distinct link.read_id) as sr, string_agg(distinct s.path_id, ',' order by s.path_id) as paths,
 string_agg(distinct link.read_id, ',' order by link.read_id) as sr_ids, string_agg(distinct n1.node, ',' order by n1.node) as segments1, string_agg(distinct n2.node, ',' order by n2.node) as segments2
 from link join p using (read_id) join s using (path) join node n1 on n1.read_id = link.read_id and n1.seg_ord = seg_ord1 join node n2 on n2.read_id = link.read_id and n2.seg_ord = seg_ord2 group by all)"""


@query(f"{_VCF} select * from l")
def agg_links_vcf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.links_with_paths(stored(paths.read_shapes(graph.nodes_of(_segments(spark, sf_dir))), "shapes"))


@query(f"""{_VCF} select concat_ws(chr(9), chrom1, pos1, '.', 'N', concat('<', link, '>'), '.', 'PASS', concat('SVTYPE=', link, ';CHR2=', chrom2, ';SVEND=', pos2, ';SR=', sr, ';OSR=', sr, ';SR_ID=', sr_ids, ';TRANSCRIPT_ID=', paths, ';SEGMENT1=', replace(segments1, ';', '&'), ';SEGMENT2=', replace(segments2, ';', '&'))) as line from l
 union all select concat('##contig=<ID=', chrom, '>') from (select distinct chrom from alignments) union all select concat('##ALT=<ID=', link, ',Description="Link">') from (select distinct link from l)
 union all select '##fileformat=VCFv4.2' {"".join(f" union all select '##INFO=<ID={name},Number={n},Type={kind},Description={chr(34)}{about}{chr(34)}>'" for name, n, kind, about in sinks.INFO)} union all select concat_ws(chr(9), '#CHROM', 'POS', 'ID', 'REF', 'ALT', 'QUAL', 'FILTER', 'INFO')""")
def sink_vcf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Header lines and a record of each link."""
    return vcf_file(spark, sf_dir).select("line")


def vcf_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines and places, for ``sinks.write_lines``."""
    # Header and records read the same tables, which are made once.
    shapes = stored(paths.read_shapes(graph.nodes_of(_segments(spark, sf_dir))), "shapes")
    links = stored(paths.links_with_paths(shapes), "links")
    return sinks.vcf_lines(links, shapes.select(F.explode("steps.chrom").alias("chrom")).distinct())


@query(f"""{_GRAPH}, p as (select read_id, fam, string_agg(node2, '|' order by seg_ord) as path from n2 group by 1, 2), s as (select path, fam, min(read_id) as path_id from p group by 1, 2),
 st as (select path_id, fam, unnest(string_split(path, '|')) as node, unnest(range(0, len(string_split(path, '|')))) as i from s),
 sup as (select a.path_id, min(sr) as sr from st a join st b on a.path_id = b.path_id and b.i = a.i + 1 join edges on src = a.node and dst = b.node group by 1),
 cl as (select fam, count(*) as n from s group by 1), tr as (select node, count(distinct path_id) as ptc, count(distinct path_id) / cast(max(n) as double) as ptf from st join cl using (fam) group by 1),
 u as (select distinct node2 as node, chrom, strand, exons from n2), x as (select path_id, u.*, ptc, ptf, unnest(string_split(exons, ';')) as e, unnest(range(0, len(string_split(exons, ';')))) as k, len(string_split(exons, ';')) as n from st join u using (node) join tr using (node))
 select concat_ws(chr(9), '.', 'segmentry', 'transcript', '.', '.', '.', '.', '.', concat('transcript_id "', path_id, '"; sr "', sr, '"; osr "', sr, '";')) as line from sup
 union all select concat_ws(chr(9), chrom, 'segmentry', 'exon', cast(split_part(e, '-', 1) as bigint) + 1, split_part(e, '-', 2), '.', strand, '.',
  concat('transcript_id "', path_id, '"; segment_id "', node, '"; exon_id "', lpad(cast(case when strand = '-' then n - k else k + 1 end as varchar), 3, '0'), '"; ptc "', ptc, '"; ptf "', printf('%.9f', ptf), '";')) from x""")
def sink_gtf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcripts with their support, and their exons with how many paths of the cluster go through the node."""
    segs = _segments(spark, sf_dir)
    nodes = graph.nodes_of(segs).select("node", "chrom", "strand", "exons").distinct()
    steps = paths.path_steps(segs).join(nodes, "node").join(agg_traversal(spark, sf_dir), "node")
    return sinks.gtf_lines(paths.path_support(segs, graph.edges_of(segs)).select("path_id", "sr"), steps).select("line")


@query(f"""{_GRAPH} select concat('{{"src":"', src, '","edges":[', string_agg(concat('{{"dst":"', dst, '","sr":', sr, '}}'), ',' order by dst), ']}}') as line from edges group by src""")
def sink_graph_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.graph_json(graph.edges_of(_segments(spark, sf_dir)))


_WAYS = f"""{_GRAPH}, e as (select src, dst from edges where sr >= 2), ends as (select distinct dst as node from e where dst not in (select src from e))"""


def _recursive(sql: str) -> str:
    return sql.replace("with ", "with recursive ", 1)


# Nodes of a family follow each other by edges, of which one in eleven is missing.
@query(_recursive(f"""with n as (select p_partkey as node, cast(floor(p_partkey / 8) as bigint) as fam from part), e as (select a.node as src, b.node as dst, a.fam from n a join n b on a.fam = b.fam and b.node = a.node + 1 where a.node % 11 > 0),
 w as (select node, node as reach, fam from n union select w.node, case when e.src = w.reach then e.dst else e.src end, w.fam from w join e on w.reach in (e.src, e.dst)),
 c as (select node, fam, min(reach) as label from w group by 1, 2) select fam, count(distinct label) = 1 as connected from c group by 1"""))
def weakly_connected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Is a family's graph in one piece?"""
    n = A.nodes(spark, sf_dir).select("node_id", "fam")
    e = n.select(F.col("node_id").alias("src"), "fam").join(n.select((F.col("node_id") - 1).alias("src"), "fam", F.col("node_id").alias("dst")), ["src", "fam"]).where("src % 11 > 0")
    return graph.weakly_connected(n, e)


@query(f"{_HOP} select distinct read_id from link where kind = 'TDUP' except select read_id from link where kind in ('TRA', 'INV')")
def setop_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads with a tandem duplication but no translocation or inversion."""
    x = _links(spark, sf_dir)
    return x.where("kind = 'TDUP'").select("read_id").distinct().join(x.where("kind in ('TRA', 'INV')"), "read_id", "left_anti")


@query(f"""{_WITH}, r as (select read_id, seg_ord, nm, q_match, chrom, q_match - nm as score, lead(q_match - nm) over w as next, row_number() over w as rank from alignments window w as (partition by read_id order by q_match - nm desc, seg_ord))
 select read_id, seg_ord, score, cast(rank as int) as rank, cast(case when next is null then 60 when next = score then 0 else floor(60 * (score - next) / cast(score as double)) end as int) as hit_mapq from r where rank <= 3 and score / cast(q_match as double) > 0.98 and not contains(chrom, '_')""")
def best_hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of the data are nearly equal to what they were found for, so an identity of 0.98 stands for the limit."""
    score = F.col("q_match") - F.col("nm")
    return paths.best_hits(A.alignments(spark, sf_dir), "read_id", score, "seg_ord", identity=score / F.col("q_match"), over=0.98).select("read_id", "seg_ord", "score", "rank", "hit_mapq")
