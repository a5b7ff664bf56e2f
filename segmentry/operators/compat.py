"""Rules by which two nodes of a graph count as one.

Nodes of the - strand are mirrored first, so that every rule is stated once, in the
direction of transcription: a head's inner end is its last, a tail's its first.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segmentry.functions import cigar as C
from segmentry.operators.ranges import range_join
from segmentry.shared import stored


def oriented(nodes: DataFrame) -> DataFrame:
    """Add ``o`` (exons in the direction of transcription, mirrored on the - strand), ``introns``, ``start`` and ``end``."""
    mirrored = F.reverse(F.transform("exons", lambda e: F.struct((-e["end"]).alias("start"), (-e["start"]).alias("end"))))
    x = nodes.withColumn("o", F.when(F.col("strand") == "-", mirrored).otherwise(F.col("exons")))
    return x.withColumn("introns", C.gaps(F.col("o"))).withColumn("start", F.element_at("o", 1)["start"]).withColumn("end", F.element_at("o", -1)["end"])


def sharing_intron(nodes: DataFrame, last_only: bool = False) -> DataFrame:
    """Pairs (a, b) of nodes of a strand with a common intron, a with the smaller id; with ``last_only`` their last introns are the same. Nodes meet by the intron, so those of a locus that share none don't."""
    x = stored(oriented(nodes).where(F.size("introns") > 0), "spliced")
    keys = x.select("chrom", "strand", "node_id", (F.element_at("introns", -1) if last_only else F.explode("introns")).alias("_intron"))
    pairs = keys.withColumnRenamed("node_id", "_a").join(keys.withColumnRenamed("node_id", "_b"), ["chrom", "strand", "_intron"]).where("_a < _b").select("_a", "_b").distinct()
    one, two = (x.select(F.col("node_id").alias(f"_{side}"), F.struct("*").alias(side)) for side in "ab")
    return pairs.join(one, "_a").join(two, "_b").select("a", "b")


def spliced_pairs(nodes: DataFrame, keys: tuple[str, ...] = ("chrom", "strand", "fam")) -> DataFrame:
    """Pairs (a, b) of nodes with introns and equal ``keys``, a with the smaller id, whether they share an intron or not."""
    x = stored(oriented(nodes).where(F.size("introns") > 0), "spliced")
    one, two = (x.select(*keys, F.struct("*").alias(side)) for side in "ab")
    return one.join(two, list(keys)).where("a.node_id < b.node_id").select("a", "b")


@dataclass
class Side:
    """Columns of one node of a pair."""

    name: str

    def __getattr__(self, field: str) -> Column:
        return F.col(f"{self.name}.{field}")

    @property
    def n(self) -> Column:
        return F.size(self.introns)

    @property
    def bare(self) -> Column:
        return self.n == 0

    def exon(self, i: int | Column) -> Column:
        return F.try_element_at(self.o, F.lit(i) if isinstance(i, int) else i)


def near(x: Column, y: Column, tolerance: int) -> Column:
    return F.abs(x - y) <= tolerance


def introns_contained(a: Side, b: Side, equal_also: Column | None = None) -> Column:
    """The shorter list of introns ends the longer one, whose exon before them begins no later than the other node. Lists of one length must be equal, and ``equal_also`` hold."""
    k, more = F.least(a.n, b.n), a.n > b.n
    full, part = F.when(more, a.introns).otherwise(b.introns), F.when(more, b.introns).otherwise(a.introns)
    before, start = F.when(more, a.exon(-(k + 1))["start"]).otherwise(b.exon(-(k + 1))["start"]), F.when(more, b.start).otherwise(a.start)
    same = a.introns == b.introns
    ends = F.slice(full, F.greatest(F.size(full) - k + 1, F.lit(1)), F.greatest(k, F.lit(0))) == part
    return F.when(a.n == b.n, same if equal_also is None else same & equal_also).otherwise((k >= 1) & ends & (before <= start))


def head_head(a: Side, b: Side, tolerance: int) -> Column:
    inside = F.when(a.bare & b.bare, True).when(a.bare, b.exon(-1)["start"] <= a.start).when(b.bare, a.exon(-1)["start"] <= b.start).otherwise(introns_contained(a, b))
    return near(a.end, b.end, tolerance) & inside


def tail_tail(a: Side, b: Side, tolerance: int) -> Column:
    a_long = a.end - a.start >= b.end - b.start

    def holds(long: Side, short: Side) -> Column:
        reach = long.end >= short.end
        inside = F.when(long.bare & short.bare, reach).when(short.bare, long.exon(1)["end"] >= short.end).when(long.bare, False).otherwise(introns_contained(long, short, reach))
        return (long.genuine | ~short.genuine) & inside

    both = (a.introns == b.introns) & near(a.start, b.start, tolerance) & near(a.end, b.end, tolerance)
    return near(a.start, b.start, tolerance) & F.when(a.genuine & b.genuine, both).when(a_long, holds(a, b)).otherwise(holds(b, a))


def shared_at(introns: Column, others: Column) -> Column:
    """Positions, from 0, of the intervals that ``others`` has too."""
    hits = F.transform(introns, lambda x, i: F.when(F.array_contains(others, x), i))
    return F.filter(hits, lambda i: i.isNotNull())


def from_first(at: Column) -> Column:
    """Are the positions 0, 1, ... without a gap?"""
    return (F.size(at) > 0) & (F.element_at(at, -1) == F.size(at) - 1)


def to_last(at: Column, n: Column) -> Column:
    """Are the positions the last ones without a gap?"""
    return (F.size(at) > 0) & (F.element_at(at, 1) == n - F.size(at)) & (F.element_at(at, -1) == n - 1)


def introns_shared(head: Side, tail: Side) -> Column:
    """The tail's last introns are the head's first; without shared ones the tail's last exon ends within the head's first. On the - strand, equal lists need equal spans."""
    at, other = shared_at(head.introns, tail.introns), shared_at(tail.introns, head.introns)
    last, first = tail.exon(-1), head.exon(1)
    apart = (last["end"] <= first["end"]) & (last["start"] <= first["start"])
    fits = (tail.end <= head.exon(F.size(at) + 1)["end"]) & (head.start >= tail.exon(F.try_element_at(other, F.lit(1)) + 1)["start"])
    equal = (head.introns == tail.introns) & (head.strand == "-")
    whole = (head.start == tail.start) & (head.end == tail.end)
    return F.when(F.size(at) == 0, apart).when(equal, whole).when(from_first(at) & to_last(other, tail.n), fits).otherwise(False)


def head_tail(head: Side, tail: Side, tolerance: int) -> Column:
    staggered = (tail.start <= head.start) & (head.start < tail.end) & (tail.end <= head.end) & (tail.end - head.start >= tolerance)
    rule = F.when(head.bare & tail.bare, True).when(tail.bare, head.exon(1)["end"] >= tail.end).when(head.bare, tail.exon(-1)["start"] <= head.start)
    return ~tail.genuine & staggered & rule.otherwise(introns_shared(head, tail))


def head_mid(head: Side, mid: Side, tolerance: int) -> Column:
    starts = mid.start <= head.start
    rule = F.when(head.bare & mid.bare, starts).when(head.bare, mid.exon(-1)["start"] <= head.start)
    return near(head.end, mid.end, tolerance) & rule.otherwise(~mid.bare & (head.n <= mid.n) & introns_contained(head, mid, starts))


def tail_mid(tail: Side, mid: Side, tolerance: int) -> Column:
    ends = tail.end <= mid.end
    rule = F.when(tail.bare & mid.bare, ends).when(tail.bare, mid.exon(1)["end"] >= tail.end)
    return ~tail.genuine & near(tail.start, mid.start, tolerance) & rule.otherwise(~mid.bare & (tail.n <= mid.n) & introns_contained(tail, mid, ends))


def mid_mid(a: Side, b: Side, tolerance: int) -> Column:
    return (a.introns == b.introns) & (a.start == b.start) & (a.end == b.end)


RULES = {("HEAD", "HEAD"): head_head, ("TAIL", "TAIL"): tail_tail, ("HEAD", "TAIL"): head_tail, ("HEAD", "MID"): head_mid, ("TAIL", "MID"): tail_mid, ("MID", "MID"): mid_mid}


def _met(x: DataFrame, kind: tuple[str, str], tolerance: int) -> DataFrame:
    """Pairs (a, b) of nodes of these identities that may be one: by equal exons, ends where a junction is in neighbouring bins, or overlap."""
    one = x.where(F.col("ident") == kind[0]).select("chrom", "strand", F.struct("*").alias("a"))
    two = x.where(F.col("ident") == kind[1]).select("chrom", "strand", F.struct("*").alias("b"))
    if kind == ("MID", "MID"):
        return one.withColumn("_o", F.col("a.o")).join(two.withColumn("_o", F.col("b.o")), ["chrom", "strand", "_o"]).select("a", "b")
    if kind == ("HEAD", "TAIL"):
        one = one.select(F.concat("chrom", "strand").alias("_k1"), "a", F.col("a.start").alias("_p"))
        two = two.where("not b.genuine").select(F.concat("chrom", "strand").alias("_k2"), "b", F.col("b.start").alias("_s"), F.col("b.end").alias("_e"))
        return range_join(one, two, (F.col("_s") <= F.col("_p")) & (F.col("_p") < F.col("_e")), ("_k1", "_k2"), ("_p", "_p"), ("_s", "_e"), width=2000).select("a", "b")
    end = "end" if kind[0] == "HEAD" else "start"
    at = lambda side, by: F.floor(F.col(f"{side}.{end}") / (tolerance + 1)) + by
    two = two.withColumn("_bin", F.explode(F.array(*(at("b", by) for by in (-1, 0, 1)))))
    return one.withColumn("_bin", at("a", 0)).join(two, ["chrom", "strand", "_bin"]).select("a", "b")


def compatible(nodes: DataFrame, tolerance: int = 10, kinds: list[tuple[str, str]] | None = None) -> DataFrame:
    """Pairs of nodes that are one, by the rule of their identities: node1, node2, kind1, kind2; equal kinds with the smaller id first.

    Each rule has its own equi-join, so nodes of a locus that can't be one by it don't meet.
    """
    a, b, out = Side("a"), Side("b"), None
    x = stored(oriented(nodes), "nodes")
    for kind in kinds or list(RULES):
        order = (a.node_id < b.node_id) if kind[0] == kind[1] else (a.node_id != b.node_id)
        pairs = _met(x, kind, tolerance).where(order & RULES[kind](a, b, tolerance))
        pairs = pairs.select(a.node_id.alias("node1"), b.node_id.alias("node2"), a.ident.alias("kind1"), b.ident.alias("kind2"))
        out = pairs if out is None else out.unionByName(pairs)
    return out
