"""Nodes of a read's path on hops made by hand."""

from segmentry.operators.events import classify
from segmentry.operators.pathnodes import path_nodes
from segmentry.operators.paths import with_payload

HOP = "read_id long, seg_ord1 int, seg_ord2 int, q_len int, " + ", ".join(f"chrom{i} string, strand{i} string, ref_start{i} long, ref_end{i} long, mode{i} string, lt{i} int, rt{i} int, q_match{i} int" for i in (1, 2))
HIT = "read_id long, seg_ord1 int, chrom string, strand string, ref_start long, ref_end long"


def hop(read: int, at: int, one: tuple, two: tuple, gap: int) -> tuple:
    """Sides are (chrom, strand, start, end); a read of 1,000 bases."""
    n1, n2 = one[3] - one[2], two[3] - two[2]
    rest = 1000 - n1 - n2 - gap
    lt1, rt1 = (100, 1000 - 100 - n1) if one[1] == "+" else (1000 - 100 - n1, 100)
    behind = rest - 100
    lt2, rt2 = (1000 - behind - n2, behind) if two[1] == "+" else (behind, 1000 - behind - n2)
    return (read, at, at + 1, 1000, *one, "MS" if one[1] == "+" else "SM", lt1, rt1, n1, *two, "SM" if two[1] == "+" else "MS", lt2, rt2, n2)


def nodes(spark, hops: list, hits: list, **options) -> dict:
    made = with_payload(classify(spark.createDataFrame(hops, HOP)))
    got: dict = {}
    for r in sorted(path_nodes(made, spark.createDataFrame(hits, HIT), **options).collect(), key=lambda r: (r.read_id, r.place)):
        got.setdefault(r.read_id, []).append((r.chrom, r.n_start, r.n_end, r.ident, r.source, r.kind, r.payload, r.payload_len))
    return got


A, B, C = ("chr1", "+", 1000, 1200), ("chr2", "+", 5000, 5200), ("chr2", "+", 9000, 9100)


def test_hops_become_typed_nodes(spark):
    got = nodes(spark, [hop(1, 0, A, B, 0), hop(1, 1, B, C, -4), hop(2, 0, A, C, 30)], [])
    assert got[1] == [("chr1", 1000, 1200, "HEAD", "segment", "TRA", "none", 0), ("chr2", 5000, 5200, "MID", "segment", "DEL", "MicroHomology", 4), ("chr2", 9000, 9100, "TAIL", "segment", None, None, None)]
    assert got[2][0][5:] == ("TRA", "NovelInsertion", 30) and [n[3] for n in got[2]] == ["HEAD", "TAIL"]


def test_a_placed_insertion_parts_its_hop(spark):
    hops = [hop(1, 0, A, B, 30), hop(1, 1, B, C, 0), hop(2, 0, A, B, 30)]
    got = nodes(spark, hops, [(1, 0, "chr1", "+", 3000, 3030), (2, 0, "chr1", "-", 3000, 3030)], kinds=("DEL", "TRA"))
    assert got[1] == [
        ("chr1", 1000, 1200, "HEAD", "segment", "DEL", "Insertion", 30), ("chr1", 3000, 3030, "MID", "insertion", "TRA", "none", 0),
        ("chr2", 5000, 5200, "MID", "segment", "DEL", "none", 0), ("chr2", 9000, 9100, "TAIL", "segment", None, None, None),
    ]
    # The hit of the other read would be an inversion, which isn't asked for, so the insertion stays a payload.
    assert [(n[3], n[4], n[5], n[6]) for n in got[2]] == [("HEAD", "segment", "TRA", "NovelInsertion"), ("TAIL", "segment", None, None)]


def test_a_read_on_the_other_strand_is_turned(spark):
    one, two = ("chr2", "-", 5000, 5200), ("chr1", "-", 1000, 1200)
    forward, turned = (nodes(spark, [hop(1, 0, *sides, 30)], [(1, 0, "chr3", "+", 70, 100)])[1] for sides in ((A, B), (one, two)))
    assert [n[0] for n in forward] == ["chr1", "chr3", "chr2"] and [n[0] for n in turned] == ["chr2", "chr3", "chr1"]
    assert [n[3:5] for n in turned] == [("HEAD", "segment"), ("MID", "insertion"), ("TAIL", "segment")]
