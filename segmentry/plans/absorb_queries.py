"""Queries over contained paths, refined nodes, annotated nodes and graph texts; they join those of ``queries`` in its two tables."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from segmentry.operators import absorb, contraction, graph, paths
from segmentry.operators import segments as S
from segmentry.operators.ranges import range_join
from segmentry.plans.graph_queries import _BASE, _CLUSTERS, _folded, _merged
from segmentry.plans.node_queries import _MERGED, _ORDER
from segmentry.plans.path_queries import _PATHS, _hops
from segmentry.plans.queries import _GRAPH, _HOP, _SEG, _WITH, _segments, query
from segmentry.shared import stored
from segmentry.sources import adapters as A
from segmentry.sources import sinks


_STEPS = f"""{_BASE}, st as (select least_id as path_id, cast(row_number() over (partition by least_id order by node_id) - 1 as int) as place, count(*) over (partition by least_id) as n, node_id, ident, chrom, strand, genuine, t, lo, hi
   from (select nodes.node_id, nodes.ident, nodes.chrom, nodes.strand, nodes.genuine, nodes.t, lo, hi, min(nodes.node_id) over (partition by floor(nodes.node_id / 3), floor(nodes.node_id / 16)) as least_id from nodes join spans using (node_id))),
 sp as (select st.*, gap, pos1, pos2 from st left join ({A.PATH_EDGES}) x on x.src = node_id),
 dp as (select node1 as i, node2 as o from pairs where {_ORDER} and {_MERGED} and t1 = t2 and concat(kind1, kind2) <> 'HEADTAIL' union all select node2, node1 from pairs where {_ORDER} and {_MERGED} and t1 = t2 and kind1 = kind2),
 cv as (select p.path_id, q.path_id as container, q.place - p.place as shift, count(*) as votes, p.n from dp join sp p on p.node_id = i join sp q on q.node_id = o
   where p.path_id <> q.path_id and q.n >= p.n and (p.gap is null or p.gap = q.gap) group by all),
 ct as (select path_id, container, cast(min(shift) as int) as shift from cv where votes = n group by all)"""
# Ranks as texts; the fold is unrolled as often as the data need.
_FOLD = f"""{_STEPS}, xt as (select node_id, string_agg(concat(e_start, '-', e_end), ';' order by i) as exons from raw group by 1),
 rk as (select path_id, row_number() over (order by max(n), string_agg(concat(chrom, ':', exons, ':', strand), '|' order by place), path_id) as r from sp join xt using (node_id) group by 1),
 ab as (select ct.*, b.r from ct join rk a on a.path_id = ct.path_id join rk b on b.path_id = container where b.r > a.r),
 s1 as (select path_id from rk where path_id not in (select path_id from ab)), g1 as (select distinct path_id from ab where container in (from s1)),
 s2 as (select path_id from rk where path_id not in (from s1) and path_id not in (from g1) and path_id not in (select path_id from ab where container not in (from g1))),
 g2 as (select distinct path_id from ab where container in (from s1) or container in (from s2)), s3 as (select path_id from rk where path_id not in (from g2) and path_id not in (select path_id from ab where container not in (from g2))),
 g3 as (select distinct path_id from ab where container in (from s3)),
 gone as (select path_id, container as absorber, shift from (select ab.*, row_number() over (partition by path_id order by r desc) as k from ab where container in (from s3)) where k = 1 and path_id in (from g3)),
 mv as (select coalesce(absorber, sp.path_id) as path_id, place + coalesce(shift, 0) as place, sp.path_id as origin, place as origin_place, lo, hi, pos1, pos2, strand from sp left join gone using (path_id)),
 hr as (select mv.path_id, mv.place, count(distinct read_id) as sr from mv join sp on sp.path_id = origin and sp.place = origin_place join er on er.src = sp.node_id group by all),
 gr as (select path_id, place, min(lo) as lo, max(hi) as hi, min(pos1) as a1, max(pos1) as b1, min(pos2) as a2, max(pos2) as b2 from mv group by all),
 fin as (select sp.path_id, sp.place, gr.lo as n_start, gr.hi as n_end, sp.gap, case when sp.gap is null then null when strand = '+' then b1 else a1 end as pos1,
   case when sp.gap is null then null when lead(strand) over (partition by sp.path_id order by sp.place) = '+' then a2 else b2 end as pos2 from sp join gr using (path_id, place) where sp.path_id not in (select path_id from gone))"""


def _paths(spark: SparkSession, sf_dir: str) -> absorb.Paths:
    nodes, graph, _ = A.path_graph(spark, sf_dir)
    own = Window.partitionBy(F.floor(F.col("node_id") / 3), F.floor(F.col("node_id") / 16))
    steps = nodes.select("*", F.min("node_id").over(own).alias("path_id"), (F.row_number().over(own.orderBy("node_id")) - 1).alias("place"), F.count("*").over(own).alias("n"))
    steps = stored(steps.join(graph.edges.withColumnRenamed("src", "node_id").drop("dst"), "node_id", "left").drop("fam"), "steps")
    hops = graph.edge_reads.select(F.col("src").alias("node_id"), "read_id").join(steps.select("node_id", "path_id", "place"), "node_id").select("path_id", "place", "read_id")
    return absorb.Paths(steps, hops)


@query(f"{_STEPS} select path_id, container, shift from ct")
def join_path_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths that are, node by node and hop by hop, within another, and from which place on."""
    return absorb.contained_paths(_paths(spark, sf_dir).steps).select("path_id", "container", F.col("shift").cast("int").alias("shift"))


@query(f"{_FOLD} select path_id, place, n_start, n_end, gap, pos1, pos2, sr from fin left join hr using (path_id, place)")
def absorb_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The steps of the paths that stay: what their nodes span, and the breakpoints and reads of their hops with those of the paths taken in."""
    kept, _ = absorb.absorb(_paths(spark, sf_dir))
    steps = kept.steps.select("path_id", "place", F.element_at("exons", 1)["start"].alias("n_start"), F.element_at("exons", -1)["end"].alias("n_end"), "gap", "pos1", "pos2")
    return steps.join(kept.hop_reads.groupBy("path_id", "place").agg(F.count_distinct("read_id").alias("sr")), ["path_id", "place"], "left")


@query(f"{_FOLD} select coalesce(absorber, path_id) as path_id, count(*) as merge_factor from rk left join gone using (path_id) group by 1")
def agg_merge_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many paths one that stays stands for, itself included."""
    return absorb.absorb(_paths(spark, sf_dir))[1].groupBy(F.col("absorber").alias("path_id")).agg(F.count("*").alias("merge_factor"))


@query(f"""{_SEG}, {_PATHS}, reads as ({A.READS.replace("as string", "as varchar")}), l as (select path_id, unnest(string_split(bases, '')) as base, unnest(range(0, q_len)) as place from p join s using (path) join reads using (read_id)),
 c as (select path_id, place, base, row_number() over (partition by path_id, place order by count(*) desc, base) as r from l group by 1, 2, 3) select path_id, string_agg(base, '' order by place) as consensus from c where r = 1 group by 1""")
def agg_consensus_seq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consensus of the reads of each path, place by place; this suits reads without insertions and deletions."""
    n = graph.nodes_of(_segments(spark, sf_dir)).groupBy("read_id").agg(F.array_sort(F.collect_list(F.struct("seg_ord", "node"))).alias("steps"))
    own = n.select("read_id", F.array_join(F.transform("steps", lambda s: s["node"]), "|").alias("path"))
    ids = own.groupBy("path").agg(F.min("read_id").alias("path_id"))
    x = own.join(ids, "path").select("read_id", "path_id").join(A.reads(spark, sf_dir), "read_id")
    return absorb.consensus(x, "path_id", "bases")


_NE = f"with exons as ({A.EXONS}), raw as ({A.NODES})"


@query(f"""{_NE}, c as (select node_id, r.i, r.e_start as s, r.e_end as e, x.e_start as a, x.e_end as b from raw r join exons x on x.chrom = r.chrom and x.strand = r.strand and r.e_start >= x.e_start - 10 and r.e_end <= x.e_end + 10),
 k as (select * from (select *, row_number() over (partition by node_id, i order by (e - s) / cast(b - a as double) desc, a, b) as r from c) where r = 1)
 select node_id, count(*) as exons, count(*) filter (exists (select 1 from k where k.node_id = raw.node_id and k.i = raw.i and abs(s - a) <= 10 and abs(e - b) <= 10)) as fitting from raw group by 1""")
def join_exon_superposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many exons of a node lie on annotated ones; all must for the node to."""
    e = A.nodes(spark, sf_dir).select("node_id", "chrom", "strand", F.posexplode("exons").alias("i", "x")).select("node_id", F.concat("chrom", "strand").alias("k1"), "i", "x.start", "x.end")
    known = A.exons(spark, sf_dir).select(F.concat("chrom", "strand").alias("k2"), "e_start", "e_end").distinct().withColumn("s10", F.col("e_start") - 10).withColumn("e10", F.col("e_end") + 10)
    on = (F.col("start") >= F.col("s10")) & (F.col("end") <= F.col("e10"))
    hit = range_join(e, known, on, ("k1", "k2"), ("start", "end"), ("s10", "e10"), width=1000)
    return absorb.best_annotated(e, hit).groupBy("node_id").agg(F.count("*").alias("exons"), F.count_if("fits").alias("fitting"))


@query(f"""{_NE}, n as (select node_id, chrom, strand, min(e_start) as a, max(e_end) as b from raw group by 1, 2, 3),
 q as (select x.node_id, x.chrom, x.strand, unnest([x.a, x.b, y.a, y.b]) as pos, unnest([1, 2, 3, 4]) as anchor from n x join n y on y.node_id = x.node_id + 4 and x.node_id % 8 < 4 and x.chrom = y.chrom and x.strand = y.strand)
 select node_id, tx from q join exons x on x.chrom = q.chrom and x.strand = q.strand and pos >= e_start - 10 and pos < e_end + 10 group by 1, 2 having count(distinct anchor) = 4""")
def join_anchor_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcripts of the strand in whose exons, and 10 around them, all four ends of a pair of nodes lie."""
    n = A.nodes(spark, sf_dir).select("node_id", F.concat("chrom", "strand").alias("k1"), F.col("exons")[0]["start"].alias("a"), F.element_at("exons", -1)["end"].alias("b"))
    two = n.select((F.col("node_id") - 4).alias("node_id"), "k1", F.col("a").alias("c"), F.col("b").alias("d"))
    q = n.where("node_id % 8 < 4").join(two, ["node_id", "k1"]).select("node_id", "k1", F.posexplode(F.array("a", "b", "c", "d")).alias("anchor", "pos"))
    x = A.exons(spark, sf_dir).select("tx", F.concat("chrom", "strand").alias("k2"), (F.col("e_start") - 10).alias("s"), (F.col("e_end") + 10).alias("e"))
    hit = range_join(q, x, (F.col("pos") >= F.col("s")) & (F.col("pos") < F.col("e")), ("k1", "k2"), ("pos", "pos"), ("s", "e"), width=1000)
    return hit.groupBy("node_id", "tx").agg(F.count_distinct("anchor").alias("n")).where("n = 4").select("node_id", "tx")


@query(f"{_HOP} select read_id, seg_ord1, seg_ord1 as found1, seg_ord2 as found2 from hop")
def join_hop_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The segments behind both sides of a hop whose ends moved by the read's longest shared sequence: same read and strand, both ends within it."""
    h = paths.with_payload(_hops(spark, sf_dir)).withColumn("slack", F.max(F.greatest(-F.col("gap"), F.lit(0))).over(Window.partitionBy("read_id")))
    side = lambda i: F.struct(F.lit(i).alias("side"), F.col(f"chrom{i}").alias("chrom"), F.col(f"strand{i}").alias("strand"), (F.col(f"ref_start{i}") + F.col("slack")).alias("s"), (F.col(f"ref_end{i}") - F.col("slack")).alias("e"))
    x = h.select("read_id", "seg_ord1", "slack", F.explode(F.array(side(1), side(2))).alias("x")).select("read_id", "seg_ord1", "slack", "x.*")
    found = x.join(_segments(spark, sf_dir).select("read_id", "seg_ord", "chrom", "strand", "ref_start", "ref_end"), ["read_id", "chrom", "strand"])
    found = found.where("abs(ref_start - s) <= slack and abs(ref_end - e) <= slack").groupBy("read_id", "seg_ord1", "side").agg(F.min("seg_ord").alias("seg"))
    pick = lambda i: F.max(F.when(F.col("side") == i, F.col("seg")))
    return found.groupBy("read_id", "seg_ord1").agg(pick(1).alias("found1"), pick(2).alias("found2"))


@query(f"""{_WITH}, s as (select * from (select read_id, lt as slt, rt as srt, strand as sstrand, q_match as sm, seg_ord as s_ord, row_number() over (partition by read_id order by least(lt, rt), seg_ord) as r from alignments) where r = 1),
 r as (select read_id, seg_ord, cast(case when slt = srt then least(abs(lt - sm), abs(rt - sm)) when (slt > srt) = (strand = sstrand) then abs(rt - sm - least(slt, srt)) else abs(lt - sm - least(slt, srt)) end as int) as off from alignments join s using (read_id) where seg_ord <> s_ord)
 select read_id, seg_ord, off, cast(row_number() over (partition by read_id order by off, seg_ord) as int) as place from r""")
def topk_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of a read by how well what its chain starts with fits into their clips."""
    return S.candidates(A.alignments(spark, sf_dir)).withColumn("off", F.col("off").cast("int"))


@query(f"""{_FOLD}, {_folded('c')}, {_CLUSTERS}, mf as (select coalesce(absorber, path_id) as path_id, count(*) as factor from rk left join gone using (path_id) group by 1),
 fx as (select fin.path_id, max(sp.n) as n, sum(case when fin.gap is null then 0 when fin.gap = 0 then 2 when fin.gap < 0 then 1 else 0 end) as score, string_agg(concat(sp.chrom, ':', fin.n_start, '-', fin.n_end, ':', sp.strand), '|' order by fin.place) as text, first(sp.node_id order by fin.place) as head from fin join sp using (path_id, place) group by 1)
 select path_id, cluster_id, cast(row_number() over (partition by cluster_id order by n desc, factor desc, score desc, text desc, path_id) as int) as place from fx join mf using (path_id) join c on c.node_id = head join cl on cl.node = c.merged""")
def sort_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths that stay after absorption, in their order within a cluster: longest first, then by what they took in, their payloads and the spans of their nodes."""
    made, merged, _, _ = _merged(spark, sf_dir)
    kept, names = absorb.absorb(_paths(spark, sf_dir))
    of = merged.join(contraction.clusters(made).withColumnRenamed("node_id", "merged"), "merged").select("node_id", "cluster_id")
    return absorb.sorted_paths(kept, names, of)


_FAM = f"{_GRAPH}, f as (select distinct fam, node2 as node from n2), fe as (select fam, src, dst, sr from edges join f on f.node = src)"


def _families(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    segs = _segments(spark, sf_dir)
    own = graph.nodes_of(segs).select("fam", "node").distinct()
    return own, graph.edges_of(segs).join(own.withColumnRenamed("node", "src"), "src").select("fam", "src", "dst", "sr")


@query(f"{_FAM} select fam, src, dst, sr from fe")
def scan_graph_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges read back from the graphs that ``sink_nodelink_json`` writes."""
    return sinks.parse_nodelink(sinks.nodelink_json(*_families(spark, sf_dir), "fam")).select(F.col("graph").alias("fam"), "src", "dst", "sr")


@query(f"""{_FAM} select concat('{{"directed":true,"graph":', fam, ',"nodes":[', (select string_agg(concat('{{"id":"', node, '"}}'), ',' order by node) from f where f.fam = g.fam), '],"links":[',
 coalesce((select string_agg(concat('{{"source":"', src, '","target":"', dst, '","sr":', sr, '}}'), ',' order by src, dst) from fe where fe.fam = g.fam), ''), ']}}') as line from (select distinct fam from f) g""")
def sink_nodelink_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.nodelink_json(*_families(spark, sf_dir), "fam")


@query(f"""{_FAM} select concat_ws(chr(9), 'H', 'VN:Z:1', fam) as line from (select distinct fam from f) union all select concat_ws(chr(9), 'G', fam, count(*)) from f group by fam
 union all select concat_ws(chr(9), 'N', fam, node) from f union all select concat_ws(chr(9), 'E', fam, src, dst, concat('sr:i:', sr)) from fe
 union all select concat_ws(chr(9), 'P', min(fam), min(read_id), path, concat('ptc:i:', count(*))) from (select read_id, fam, string_agg(node2, ',' order by seg_ord) as path from n2 group by 1, 2) group by path""")
def sink_tsg(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = _families(spark, sf_dir)
    s = graph.structures(_segments(spark, sf_dir)).withColumn("node", F.split("path", r"\|")[0]).join(nodes, "node")
    return sinks.tsg_lines(nodes, edges, s, "fam").select("line")
