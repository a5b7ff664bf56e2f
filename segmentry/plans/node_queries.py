"""Queries over nodes and when they are one; they join those of ``queries`` in its two tables."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segmentry.operators import compat, ranges
from segmentry.operators.components import connected_components
from segmentry.plans.queries import query
from segmentry.sources import adapters as A

# The oracle lists mirrored starts (s) and ends (e) of each node's exons, and introns as texts.
_N = f"""with raw as ({A.NODES}), n as (select node_id, fam, chrom, strand, ident, genuine,
  case when strand = '+' then list(e_start order by i) else list(-e_end order by i desc) end as s,
  case when strand = '+' then list(e_end order by i) else list(-e_start order by i desc) end as e from raw group by node_id, fam, chrom, strand, ident, genuine),
nodes as (select *, list_transform(range(1, len(s)), lambda k: concat(e[k], '~', s[k + 1])) as t from (select * from n)),
pairs as (select a.node_id as node1, b.node_id as node2, a.ident as kind1, b.ident as kind2, a.s as s1, a.e as e1, a.t as t1, len(a.t) as n1, a.genuine as g1,
  b.s as s2, b.e as e2, b.t as t2, len(b.t) as n2, b.genuine as g2, a.strand as strand, a.fam as fam from nodes a join nodes b on a.chrom = b.chrom and a.strand = b.strand and a.node_id <> b.node_id and a.fam = b.fam)"""


def _contained(also: str = "true", a: int = 1, b: int = 2) -> str:
    longer = lambda p, q: f"t{q}[1:] = t{p}[n{p} - n{q} + 1:] and s{p}[len(s{p}) - n{q}] <= s{q}[1]"
    return f"case when n{a} = n{b} then t{a} = t{b} and {also} when least(n{a}, n{b}) = 0 then false when n{a} > n{b} then {longer(a, b)} else {longer(b, a)} end"


def _tails(p: int, q: int) -> str:
    return f"""(g{p} or not g{q}) and case when n{p} = 0 and n{q} = 0 then e{p}[-1] >= e{q}[-1] when n{q} = 0 then e{p}[1] >= e{q}[-1] when n{p} = 0 then false
      else {_contained(f"e{p}[-1] >= e{q}[-1]", p, q)} end"""


_BOTH = "list_filter(t1, lambda x: list_contains(t2, x))"
_RULE = {
    "HEAD-HEAD": f"abs(e1[-1] - e2[-1]) <= 10 and case when n1 = 0 and n2 = 0 then true when n1 = 0 then s2[-1] <= s1[1] when n2 = 0 then s1[-1] <= s2[1] else {_contained()} end",
    "TAIL-TAIL": f"abs(s1[1] - s2[1]) <= 10 and case when g1 and g2 then t1 = t2 and abs(e1[-1] - e2[-1]) <= 10 when e1[-1] - s1[1] >= e2[-1] - s2[1] then {_tails(1, 2)} else {_tails(2, 1)} end",
    "HEAD-TAIL": f"""not g2 and s2[1] <= s1[1] and s1[1] < e2[-1] and e2[-1] <= e1[-1] and e2[-1] - s1[1] >= 10 and case when n1 = 0 and n2 = 0 then true when n2 = 0 then e1[1] >= e2[-1]
      when n1 = 0 then s2[-1] <= s1[1] when len({_BOTH}) = 0 then e2[-1] <= e1[1] and s2[-1] <= s1[1] when strand = '-' and t1 = t2 then s1[1] = s2[1] and e1[-1] = e2[-1]
      when t1[:len({_BOTH})] = t2[n2 - len({_BOTH}) + 1:] then e2[-1] <= e1[len({_BOTH}) + 1] and s1[1] >= s2[n2 - len({_BOTH}) + 1] else false end""",
    "HEAD-MID": f"""abs(e1[-1] - e2[-1]) <= 10 and case when n1 = 0 and n2 = 0 then s2[1] <= s1[1] when n1 = 0 then s2[-1] <= s1[1] else n1 <= n2 and {_contained("s2[1] <= s1[1]")} end""",
    "TAIL-MID": f"""not g1 and abs(s1[1] - s2[1]) <= 10 and case when n1 = 0 and n2 = 0 then e1[-1] <= e2[-1] when n1 = 0 then e2[1] >= e1[-1] else n1 <= n2 and {_contained("e1[-1] <= e2[-1]")} end""",
    "MID-MID": "t1 = t2 and s1[1] = s2[1] and e1[-1] = e2[-1]",
}
_ORDER = "(kind1 <> kind2 or node1 < node2)"
_MERGED = "case concat(kind1, '-', kind2) " + " ".join(f"when '{k}' then {v}" for k, v in _RULE.items()) + " else false end"


def _rule(kind: str) -> str:
    return f"{_N} select node1, node2 from pairs where concat(kind1, '-', kind2) = '{kind}' and {_ORDER} and {_RULE[kind]}"


def _of(spark: SparkSession, sf_dir: str, *kind: str) -> DataFrame:
    return compat.compatible(A.nodes(spark, sf_dir), kinds=[kind]).select("node1", "node2")


@query(_rule("HEAD-HEAD"))
def compat_head_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _of(spark, sf_dir, "HEAD", "HEAD")


@query(_rule("TAIL-TAIL"))
def compat_tail_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _of(spark, sf_dir, "TAIL", "TAIL")


@query(_rule("HEAD-TAIL"))
def compat_head_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _of(spark, sf_dir, "HEAD", "TAIL")


@query(_rule("HEAD-MID"))
def compat_head_mid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _of(spark, sf_dir, "HEAD", "MID")


@query(_rule("TAIL-MID"))
def compat_tail_mid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _of(spark, sf_dir, "TAIL", "MID")


@query(_rule("MID-MID"))
def compat_mid_mid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _of(spark, sf_dir, "MID", "MID")


@query(f"{_N} select node1, node2, kind1, kind2 from pairs where {_ORDER} and {_MERGED}")
def compat_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compat.compatible(A.nodes(spark, sf_dir))


@query(f"{_N} select node1, node2 from pairs where node1 < node2 and n1 > 0 and n2 > 0 and {_contained()}")
def intron_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = compat.Side("a"), compat.Side("b")
    pairs = compat.sharing_intron(A.nodes(spark, sf_dir), last_only=True).where(compat.introns_contained(a, b))
    return pairs.select(a.node_id.alias("node1"), b.node_id.alias("node2"))


@query(f"""{_N}, x as (select node1, node2, n2, list_filter(range(0, n1), lambda i: list_contains(t2, t1[i + 1])) as p, list_filter(range(0, n2), lambda i: list_contains(t1, t2[i + 1])) as q from pairs where node1 < node2 and n1 > 0 and n2 > 0)
 select node1, node2, array_to_string(p, ',') as at1, array_to_string(q, ',') as at2, p = range(0, len(p)) and len(p) > 0 as from_first, len(q) > 0 and q = range(n2 - len(q), n2) as to_last from x""")
def shared_intron_indices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a family's nodes with introns, and where in both lists the common ones stand."""
    a, b = compat.Side("a"), compat.Side("b")
    x = compat.spliced_pairs(A.nodes(spark, sf_dir)).select(a.node_id.alias("node1"), b.node_id.alias("node2"), compat.shared_at(a.introns, b.introns).alias("p"), compat.shared_at(b.introns, a.introns).alias("q"), b.n.alias("n"))
    text = lambda c: F.array_join(F.transform(c, lambda i: i.cast("string")), ",")
    return x.select("node1", "node2", text("p").alias("at1"), text("q").alias("at2"), compat.from_first(F.col("p")).alias("from_first"), compat.to_last(F.col("q"), F.col("n")).alias("to_last"))


# A path here is the two nodes of a locus whose numbers differ by 4.
@query(f"{_N} select node_id, fam from nodes where node_id not in (select unnest([node1, node2]) from pairs where abs(node1 - node2) = 4 and kind1 <> kind2 and {_MERGED})")
def filter_circle_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of paths none of whose nodes would be merged with another of the path."""
    n = A.nodes(spark, sf_dir)
    path = lambda c: F.concat_ws(":", F.floor(F.col(c) / 8).cast("string"), (F.col(c) % 4).cast("string"))
    circles = compat.compatible(n).where(path("node1") == path("node2")).where("kind1 <> kind2").select(path("node1").alias("path")).distinct()
    return n.withColumn("path", path("node_id")).join(circles, "path", "left_anti").select("node_id", "fam")


@query(f"""with raw as ({A.NODES}), l as (select node_id, chrom, strand, ident, list(e_end order by i)[1] as p1, list(e_start order by i)[2] as p2 from raw group by all having count(*) > 1)
 select a.chrom, a.strand, a.ident, a.node_id as node1, b.node_id as node2 from l a join l b on a.chrom = b.chrom and a.strand = b.strand and a.ident = b.ident and a.node_id < b.node_id and abs(a.p1 - b.p1) <= 10 and abs(a.p2 - b.p2) <= 10""")
def compat_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of links of one kind both of whose breakpoints are within 10."""
    n = A.nodes(spark, sf_dir).where(F.size("exons") > 1)
    links = n.select("node_id", "chrom", "strand", "ident", F.col("exons")[0]["end"].alias("p1"), F.col("exons")[1]["start"].alias("p2"))
    x = ranges.near_pairs(links.withColumnRenamed("node_id", "node"), ["chrom", "strand", "ident"], "node", "p1", "p2", 10)
    return x.select("chrom", "strand", "ident", "node1", "node2")
