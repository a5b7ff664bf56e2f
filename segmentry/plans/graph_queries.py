"""Queries over graphs of read paths with merged nodes; they join those of ``queries`` in its two tables."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segmentry.operators import compat, contraction, guided
from segmentry.operators.contraction import Graph
from segmentry.plans.node_queries import _MERGED, _N, _ORDER
from segmentry.plans.queries import query
from segmentry.shared import stored
from segmentry.sources import adapters as A

#: Reads that an edge needs to be walked along; the paths of the data have some 90.
LEAST = 85


def _folded(labels: str) -> str:
    """``me``: edges between labels; ``cr``: their reads; ``mn``: merged nodes. ``labels`` is a table of node_id and merged."""
    return f"""re as (select a.merged as src, b.merged as dst, x.pos1, x.pos2, x.gap, s0.sr as own, sa.strand as strand1, sb.strand as strand2 from e0 x join s0 using (src, dst) join {labels} a on a.node_id = x.src join {labels} b on b.node_id = x.dst
   join spans sa on sa.node_id = x.src join spans sb on sb.node_id = x.dst where a.merged <> b.merged),
 cr as (select distinct a.merged as src, b.merged as dst, read_id from er join {labels} a on a.node_id = er.src join {labels} b on b.node_id = er.dst where a.merged <> b.merged),
 cs as (select src, dst, count(*) as sr from cr group by all),
 me as (select src, dst, any_value(sr) as sr, case when strand1 = '+' then max(pos1) else min(pos1) end as pos1, case when strand2 = '+' then min(pos2) else max(pos2) end as pos2,
   cast(first(gap order by own desc, case when gap = 0 then 2 when gap < 0 then 1 else 0 end desc, gap) as int) as gap from re join cs using (src, dst) group by src, dst, strand1, strand2),
 ux as (select merged, e_start as s, e_end as e, max(e_end) over (partition by merged order by e_start, e_end rows between unbounded preceding and 1 preceding) as top from (select distinct merged, e_start, e_end from {labels} join raw using (node_id))),
 ui as (select merged, s, e, sum(case when s <= top then 0 else 1 end) over (partition by merged order by s, e rows unbounded preceding) as g from ux),
 un as (select merged, g, min(s) as s, max(e) as e from ui group by all),
 mn as (select merged, string_agg(concat(s, '-', e), ';' order by s) as exons, min(s) as n_start, max(e) as n_end from un group by 1)"""


# Recursion goes over merges (w), over edges both ways (y) and along edges (z).
_BASE = f"""{_N.replace("with ", "with recursive ", 1)}, l as (select node1, node2 from pairs where {_ORDER} and {_MERGED}), w as (select node_id as node, node_id as reach from nodes
 union select w.node, case when l.node1 = w.reach then l.node2 else l.node1 end from w join l on w.reach in (l.node1, l.node2)),
 c as (select node as node_id, min(reach) as merged from w group by 1),
 spans as (select node_id, chrom, strand, min(e_start) as lo, max(e_end) as hi from raw group by all), pr as ({A.PATH_READS}),
 er as (select src, dst, read_id from ({A.PATH_EDGES}) join pr on three = floor(src / 3) and two = floor(src / 16)), s0 as (select src, dst, count(distinct read_id) as sr from er group by all),
 e0 as (select * from ({A.PATH_EDGES}) semi join s0 using (src, dst))"""
_GRAPH = f"{_BASE}, {_folded('c')}"
_CLUSTERS = """y as (select distinct merged as node, merged as reach from c union select y.node, case when me.src = y.reach then me.dst else me.src end from y join me on y.reach in (me.src, me.dst)),
 cl as (select node, min(reach) as cluster_id from y group by 1)"""
_CYCLES = f"""st as (select src, dst from me where sr >= {LEAST}), z as (select src as node, dst as reach from st union select z.node, st.dst from z join st on st.src = z.reach),
 circ as (select cluster_id, count(*) as n_nodes, count(*) filter (node in (select node from z where node = reach)) as n_cyclic from cl group by 1)"""


def _merged(spark: SparkSession, sf_dir: str) -> tuple[Graph, DataFrame, DataFrame, Graph]:
    """(the contracted graph, labels, middle nodes of reads under their labels, the graph before)."""
    nodes, graph, mids = A.path_graph(spark, sf_dir, grouped=True)
    merged = stored(contraction.labels(nodes, compat.compatible(nodes)), "merged")
    made = contraction.contract(graph, merged)
    made = Graph(stored(made.nodes, "nodes"), stored(made.edges, "edges"), stored(made.edge_reads, "edge_reads"))
    return made, merged, mids.join(merged, "node_id").select("read_id", F.col("merged").alias("node_id")).distinct(), graph


def _text(exons: str = "exons"):
    return F.array_join(F.transform(exons, lambda e: F.concat_ws("-", e["start"].cast("string"), e["end"].cast("string"))), ";")


def _rows(graph: Graph) -> DataFrame:
    """Nodes and edges as one table."""
    none = lambda kind: F.lit(None).cast(kind)
    nodes = graph.nodes.select(F.lit("node").alias("kind"), F.col("node_id").alias("id"), none("long").alias("next"), none("long").alias("sr"), none("long").alias("pos1"), none("long").alias("pos2"), none("int").alias("gap"), _text().alias("exons"))
    edges = graph.edges.join(graph.support(), ["src", "dst"])
    return nodes.unionByName(edges.select(F.lit("edge").alias("kind"), F.col("src").alias("id"), F.col("dst").alias("next"), "sr", "pos1", "pos2", "gap", none("string").alias("exons")))


_ROWS = "select 'node' as kind, merged as id, null::bigint as next, null::bigint as sr, null::bigint as pos1, null::bigint as pos2, null::int as gap, exons from mn union all select 'edge', src, dst, sr, pos1, pos2, gap, null from me"


@query(f"{_GRAPH} {_ROWS}")
def build_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The paths' graph with compatible nodes merged: its nodes with the union of their exons, its edges with reads, breakpoints and payload."""
    return _rows(_merged(spark, sf_dir)[0])


@query(f"{_GRAPH} select src, dst, pos1, pos2, sr from me")
def agg_edge_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges between merged nodes, with the outermost breakpoints and all reads of the edges that became one."""
    graph = _merged(spark, sf_dir)[0]
    return graph.edges.join(graph.support(), ["src", "dst"]).select("src", "dst", "pos1", "pos2", "sr")


@query(f"{_GRAPH} select src, dst, gap from me")
def agg_payload_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The payload that an edge between merged nodes keeps."""
    return _merged(spark, sf_dir)[0].edges.select("src", "dst", "gap")


@query(f"""{_GRAPH}, v as (select src as node_id, 'start' as side, pos1 as pos, count(*) as votes from re where src not in (select dst from re) group by all
 union all select dst, 'end', pos2, count(*) from re where dst not in (select src from re) group by all)
 select node_id, side, pos, votes from (select *, row_number() over (partition by node_id, side order by votes desc, pos) as r from v) where r = 1""")
def agg_breakpoint_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The junction of each start and end node that most of its members have."""
    _, merged, _, before = _merged(spark, sf_dir)
    return contraction.breakpoint_votes(before, merged)


@query(f"""{_GRAPH}, {_CLUSTERS}, exons as ({A.EXONS}), gn as (select gene, chrom, min(e_start) as g_start, max(e_end) as g_end from exons group by gene, chrom, floor(e_start / 5000)),
 v as (select cluster_id, gene, count(distinct merged) as votes from mn join cl on cl.node = merged join spans on spans.node_id = merged join gn on gn.chrom = spans.chrom and n_start < g_end and g_start < n_end group by all)
 select cluster_id, gene, votes from (select *, row_number() over (partition by cluster_id order by votes desc, gene) as r from v) where r = 1""")
def agg_majority_gene(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gene over most nodes of a cluster."""
    # Nodes and edges are enough: which reads an edge has makes no difference.
    nodes, edges, reads = A.path_places(spark, sf_dir)
    merged = stored(contraction.labels(nodes, compat.compatible(nodes)), "merged")
    own = nodes.select("node_id", "chrom", "strand", "exons")
    return contraction.majority_genes(Graph(stored(contraction.merged_nodes(own, merged), "nodes"), contraction.rewired(A.walked(edges, reads), merged).select("src", "dst").distinct(), reads), A.genes(spark, sf_dir))


@query(f"{_GRAPH}, {_CLUSTERS}, {_CYCLES} select cluster_id, n_nodes, n_cyclic, n_cyclic > 0 as has_circle from circ")
def detect_circles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters, and how many of their nodes are on cycles, by strongly connected components."""
    return guided.circles(_merged(spark, sf_dir)[0], LEAST)


_GUIDED = f"""{_GRAPH}, {_CLUSTERS}, {_CYCLES}, md as (select distinct read_id, merged as node from pr join nodes on three = floor(node_id / 3) and two = floor(node_id / 16) and ident = 'MID' join c using (node_id)),
 kn as (select cr.* from cr semi join st using (src, dst)), ki as (select src as u, dst as v, read_id from kn semi join md on md.read_id = kn.read_id and md.node = dst), ko as (select src as v, dst as w, read_id from kn semi join md on md.read_id = kn.read_id and md.node = src),
 tr as (select a.src as u, a.dst as v, b.dst as w from st a join st b on b.src = a.dst where (a.src, a.dst, b.dst) in (select (u, v, w) from (select distinct ki.u, ki.v, ko.w from ki join ko using (v, read_id)))
   or (a.src, a.dst) not in (select (u, v) from ki) or (b.src, b.dst) not in (select (v, w) from ko))"""
_WALK = """, ok as (select cl.node, cluster_id from cl join circ using (cluster_id) where CIRCLES),
 p as (select cluster_id, [st.src, st.dst] as way, st.src as u, st.dst as v from st join ok on ok.node = st.src where st.src not in (select dst from me)
 union all select cluster_id, list_append(way, tr.w), p.v, tr.w from p join tr on tr.u = p.u and tr.v = p.v where not list_contains(way, tr.w))
 select cluster_id, array_to_string(way, '|') as path, cast(len(way) as int) as n_nodes from p where v not in (select src from me)
 union all select cluster_id, cast(node as varchar), 1 from ok where node not in (select src from me) and node not in (select dst from me)"""


def _ways(spark: SparkSession, sf_dir: str, ignore_circle: bool) -> DataFrame:
    graph, _, mids, _ = _merged(spark, sf_dir)
    ways = guided.guided_ways(graph, mids, LEAST, ignore_circle)
    return ways.select("cluster_id", F.array_join(F.transform("way", lambda n: n.cast("string")), "|").alias("path"), F.size("way").alias("n_nodes"))


@query(_GUIDED + _WALK.replace("CIRCLES", "n_cyclic = 0"))
def enumerate_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ways from start to end nodes along edges with enough reads, where reads in the middle of their path lead on; clusters with a cycle have none."""
    return _ways(spark, sf_dir, False)


@query(_GUIDED + _WALK.replace("CIRCLES", "true"))
def enumerate_paths_with_circles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, also in clusters with a cycle, where a way visits no node twice."""
    return _ways(spark, sf_dir, True)


_NEAR = f"""{_BASE}, i1 as (select node_id, chrom, strand, lo, hi, (select array_to_string(t, ';') from nodes n where n.node_id = spans.node_id) as t from spans),
 np as (select a.node_id as n1, b.node_id as n2 from i1 a join i1 b on a.chrom = b.chrom and a.strand = b.strand and a.t = b.t and a.node_id <> b.node_id and abs(a.lo - b.lo) <= 10 and abs(a.hi - b.hi) <= 10),
 rw as (select node_id as node, node_id as reach from nodes union select rw.node, np.n2 from rw join np on np.n1 = rw.reach),
 nr as (select node_id, count(distinct read_id) as reads from (select src as node_id, read_id from er union all select dst, read_id from er) group by 1),
 rl as (select node as node_id, first(reach order by coalesce(reads, 0) desc, reach) as merged from rw left join nr on nr.node_id = reach group by 1), {_folded('rl')}"""


@query(f"{_NEAR} {_ROWS}")
def refine_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graph of the reads' paths with near nodes merged into the one of most reads, and its edges wired anew."""
    return _rows(contraction.refine(A.path_graph(spark, sf_dir)[1])[0])
