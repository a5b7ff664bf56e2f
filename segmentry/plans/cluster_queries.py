"""Queries over paths of nodes: similarity, clusters, circular ones; they join those of ``queries`` in its two tables."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from segmentry.operators import circular, cluster
from segmentry.plans.node_queries import _MERGED, _N, _ORDER
from segmentry.plans.queries import query
from segmentry.sources import adapters as A
from segmentry.sources import sinks

# Three nodes in turn, a head, a middle and a tail, are a path; their loci may differ.
_SIMILAR = f"""{_N}, l as (select distinct least(node1 // 3, node2 // 3) as path1, greatest(node1 // 3, node2 // 3) as path2 from pairs where {_ORDER} and {_MERGED} and node1 // 3 <> node2 // 3)"""
_REACHED = _SIMILAR.replace("with ", "with recursive ", 1) + """, w as (select distinct node_id // 3 as path_id, node_id // 3 as reach from nodes
 union select w.path_id, case when l.path1 = w.reach then l.path2 else l.path1 end from w join l on w.reach in (l.path1, l.path2)),
 c as (select path_id, min(reach) as cluster_id from w group by 1)"""


def _path(c: str):
    return F.floor(F.col(c) / 3).cast("long")


def _steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.nodes(spark, sf_dir).select("node_id", _path("node_id").alias("path_id"))


@query(f"{_SIMILAR} select path1, path2 from l")
def join_path_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of paths two of whose nodes count as one."""
    return cluster.similar_paths(A.nodes(spark, sf_dir), _steps(spark, sf_dir), 10)


@query(f"{_REACHED} select path_id, cluster_id from c")
def cluster_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths that similar pairs connect; a path that is like no other is a cluster."""
    return cluster.clusters(_steps(spark, sf_dir).select("path_id").distinct(), cluster.similar_paths(A.nodes(spark, sf_dir), _steps(spark, sf_dir), 10))


@query(f"""{_REACHED}, t as (select node_id // 3 as path_id, string_agg(node_id, '-' order by node_id) as info from nodes group by 1),
 cn as (select cluster_id, string_agg(concat('{{"data":{{"id":"', path_id, '","cluster_id":', cluster_id, ',"read_id":', path_id * 3, ',"path_info":"', info, '"}}}}'), ',' order by path_id) as ns from c join t using (path_id) group by 1),
 ce as (select cluster_id, string_agg(concat('{{"data":{{"source":"', path1, '","target":"', path2, '"}}}}'), ',' order by path1, path2) as es from l join c on c.path_id = l.path1 group by 1)
 select cluster_id, concat('{{"data":[],"directed":false,"multigraph":false,"elements":{{"nodes":[', ns, '],"edges":[', coalesce(es, ''), ']}}}}') as line from cn left join ce using (cluster_id)""")
def sink_cluster_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph of each cluster: its paths and the similar pairs."""
    pairs = cluster.similar_paths(A.nodes(spark, sf_dir), _steps(spark, sf_dir), 10)
    steps = _steps(spark, sf_dir)
    own = cluster.clusters(steps.select("path_id").distinct(), pairs)
    info = steps.groupBy("path_id").agg(F.min("node_id").alias("read_id"), F.array_join(F.transform(F.array_sort(F.collect_list("node_id")), lambda n: n.cast("string")), "-").alias("path_info"))
    return sinks.cluster_json(own.join(info, "path_id"), pairs)


# Paths of even numbers are one hop long. Three of four hops are duplications.
_KIND = "case when (a.node_id + b.node_id) % 16 = 1 then 'DEL' else 'TDUP' end"
_CIRC = f"""with exons as ({A.EXONS}), raw as ({A.NODES}), n as (select node_id, chrom, strand, list(e_start order by i) as s, list(e_end order by i) as e, min(e_start) as a, max(e_end) as b, sum(e_end - e_start) as size,
  list(concat(e_start, '~', e_end) order by i) as x from raw group by 1, 2, 3),
 m as (select *, list_transform(range(1, len(s)), lambda k: concat(e[k], '~', s[k + 1])) as t from n),
 h as (select a.node_id // 3 as path_id, a.node_id % 3 + 1 as i, case when (a.node_id // 3) % 2 = 0 then 1 else 2 end as hops, {_KIND} as kind, a.node_id as id1, b.node_id as id2, a.chrom as c1, b.chrom as c2, a.strand as st1, b.strand as st2,
   a.a as a1, a.b as b1, b.a as a2, b.b as b2, a.x as x1, b.x as x2, a.t as t1, b.t as t2, a.size as z1, b.size as z2 from m a join m b on b.node_id = a.node_id + 1 and b.node_id // 3 = a.node_id // 3 where (a.node_id // 3) % 2 = 1 or a.node_id % 3 = 0),
 f as (select *, list_has_all(x2, x1) or (len(t1) > 0 and len(t2) > 0 and list_has_all(t2, t1)) as ab, list_has_all(x1, x2) or (len(t1) > 0 and len(t2) > 0 and list_has_all(t1, t2)) as ba,
   abs(a1 - a2) <= 10 as st, abs(b1 - b2) <= 10 as en, c1 = c2 and st1 = st2 and not list_has_any(x1, x2) as apart from h),
 o as (select *, apart and case when st1 = '+' then a1 > b2 else b1 < a2 end as back from f),
 intr as (select tx, chrom, strand, e_end - 10 as s, lead(e_start) over (partition by tx order by e_start) + 10 as e from exons),
 best as (select node_id, r.i, r.e_start as s, r.e_end as e, x.e_start as a, x.e_end as b, row_number() over (partition by node_id, r.i order by (r.e_end - r.e_start) / cast(x.e_end - x.e_start as double) desc, x.e_start, x.e_end) as k
   from raw r join exons x on x.chrom = r.chrom and x.strand = r.strand and r.e_start >= x.e_start - 10 and r.e_end <= x.e_end + 10),
 sup as (select node_id from raw r left join (select node_id, i, abs(s - a) <= 10 and abs(e - b) <= 10 as ok from best where k = 1) q using (node_id, i) group by 1 having bool_and(coalesce(ok, false))),
 looped as (select path_id, i from o where back and ((len(x1) = 1 and len(x2) = 1) or exists (select 1 from intr q where q.chrom = c1 and q.strand = st1 and q.e is not null
   and case when st1 = '+' then b1 else a1 end >= q.s and case when st1 = '+' then b1 else a1 end < q.e and case when st1 = '+' then a2 else b2 end >= q.s and case when st1 = '+' then a2 else b2 end < q.e))),
 tx4 as (select path_id, i from (select path_id, i, c1, st1, unnest([a1, b1, a2, b2]) as pos, unnest([1, 2, 3, 4]) as anchor from o where apart) p join exons x on x.chrom = c1 and x.strand = st1 and pos >= e_start - 10 and pos < e_end + 10 group by path_id, i, tx having count(distinct anchor) = 4),
 one as (select path_id from o where hops = 1 and kind = 'TDUP' and (((ab or ba or a1 = a2 or b1 = b2) and case when z1 >= z2 then id1 else id2 end in (select node_id from sup)) or (path_id, i) in (select path_id, i from tx4) or (path_id, i) in (select path_id, i from looped))
   union select path_id from o where kind = 'TDUP' and (st or en) and t1 = t2),
 more as (select path_id from o where hops > 1 group by 1 having bool_and(kind = 'TDUP' and case when i = 1 then ab or (len(t1) = 0 and (st or en)) when i = hops then ba or (len(t2) = 0 and (st or en)) else (x1 = x2) or (st and en) end))"""


def _hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = A.nodes(spark, sf_dir).withColumn("path_id", _path("node_id")).where("path_id % 2 = 1 or node_id % 3 < 2")
    steps = n.select("path_id", F.col("node_id").alias("place"), F.struct("node_id", "chrom", "strand", "exons").alias("node"))
    return circular.hops_of(steps, F.when((F.col("a.node_id") + F.col("b.node_id")) % 16 == 1, "DEL").otherwise("TDUP"))


def _introns(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = A.exons(spark, sf_dir).withColumn("e", F.lead("e_start").over(Window.partitionBy("tx").orderBy("e_start")) + 10).where("e is not null")
    return e.select("chrom", "strand", F.struct("tx", "exon_no").alias("intron"), (F.col("e_end") - 10).alias("s"), "e")


@query(f"{_CIRC} select distinct path_id, i from looped")
def join_anchor_introns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hops back to a node before, both in one annotated intron or of one exon each."""
    return circular.in_one_intron(_hops(spark, sf_dir), _introns(spark, sf_dir)).select("path_id", F.col("i").cast("long").alias("i"))


@query(f"{_CIRC} select distinct path_id from o where path_id not in (select path_id from one) and path_id not in (select path_id from more)")
def filter_circrna(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths that don't look circular."""
    hops = _hops(spark, sf_dir)
    return circular.filter_circular(hops.select("path_id").distinct(), hops, A.exons(spark, sf_dir), _introns(spark, sf_dir))
