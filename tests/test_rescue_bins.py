"""Reads that are like a link's first side: every pair within the tolerance once, below 0 too."""

import random

from segmentry.operators import rescue
from segmentry.operators.realign import rescued_support
from segmentry.plans import realign_queries


def test_rescue_reads_is_all_pairs_within_the_tolerance(spark, monkeypatch):
    calls, keep = [], rescue.stored
    monkeypatch.setattr(rescue, "stored", lambda df, name="t": calls.append(name) or keep(df, name))
    starts = [-30, -11, -10, 0, 1, 10, 11, 12, 21, 22, 33]
    segs = [(i, 0, "chr1" if i % 4 else "chr2", "+", s, s + 50 + i, 30 - i % 2 * 20, [(s, s + 50 + i)]) for i, s in enumerate(starts)]
    df = spark.createDataFrame(segs, "read_id long, seg_ord int, chrom string, strand string, ref_start long, ref_end long, mapq int, exons array<struct<start:bigint,end:bigint>>")
    links = df.where("read_id % 3 = 0").selectExpr("read_id", "seg_ord as seg_ord1", "chrom as chrom1", "strand as strand1", "ref_start as ref_start1", "ref_end as ref_end1", "ref_end as pos1")
    found = sorted((x.read_id, x.ref_start1, x.candidate) for x in rescue.rescue_reads(links, df).collect())
    like = lambda a, b: a[2] == b[2] and abs(a[4] - b[4]) <= 10 and abs(a[5] - b[5]) <= 10
    assert found == sorted((b[0], a[4], a[0] != b[0]) for a in segs[::3] for b in segs if b[6] >= 20 and like(a, b))
    assert calls == ["segments"]  # told once, not in each of the three joins


def test_sides_of_a_reads_own_links_are_known_without_a_join(spark):
    rnd = random.Random(3)
    rows = []
    for i in range(40):
        for _ in range(rnd.randint(1, 6)):
            s = rnd.choice([-12, -3, 0, 4, 9, 20])
            rows.append((i, rnd.choice(["chr1", "chr2"]), rnd.choice("+-"), s, s + rnd.choice([50, 55, 62]), rnd.choice(["", "", "700"]), rnd.choice([20, 40]), rnd.random() < 0.4))
    df = spark.createDataFrame(rows, "read_id long, chrom string, strand string, ref_start long, ref_end long, _i string, mapq int, link boolean")
    sides, near = rescue.near_sides(rescue.own_sides(df), ["read_id"], mapq=25)
    got = sorted((x.chrom1, x.strand1, x.ref_start1, x.ref_end1, x.read_id, x.candidate) for x in near.join(sides, "id").collect())
    shapes = {(*r[1:6],) for r in rows if r[7]}
    assert sides.count() == len({s[:4] for s in shapes})
    own = {(r[0], *r[1:6]) for r in rows if r[7]}
    like = lambda r, d: (r[1], r[2], r[5]) == (d[0], d[1], d[4]) and abs(r[3] - d[2]) <= 10 and abs(r[4] - d[3]) <= 10
    assert got == sorted((*d[:4], r[0], (r[0], *d) not in own) for r in rows if r[6] >= 25 for d in shapes if like(r, d))
    assert {x[5] for x in got} == {True, False}


def lineitem(spark, folder, reads: dict[int, int]) -> str:
    rows = [(r, k, 5, 30, float(k), "1995-01-01") for r, n in reads.items() for k in range(n)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_extendedprice double, l_shipdate string").write.parquet(f"{folder}/lineitem.parquet")
    return str(folder)


def test_links_of_all_reads_rescue(spark, tmp_path):
    got = realign_queries.rescue_score(spark, lineitem(spark, tmp_path, {1: 3, 8: 2, 9: 1})).select("ref_start1", "read_id").collect()
    # Once only the links of reads divisible by four were looked at: 8 has one, whose side is like the first segment of 9.
    assert sorted(map(tuple, got)) == [(100000, 9), (105003, 8)]


def test_segments_are_made_once_for_rescued_support(spark, tmp_path):
    made = realign_queries.agg_rescued_support(spark, lineitem(spark, tmp_path, {4: 3, 5: 2, 9: 1, 10: 3, 12: 2}))
    assert "lineitem" not in made._jdf.queryExecution().optimizedPlan().toString()  # alignments were once made anew in each branch
    # 5, 9 and 10 have the first side, 5 and 10 the second; 5 and 10 count at the first already.
    assert sorted((x.original_sr, x.sr) for x in made.collect()) == [(1, 4), (2, 5)]


def test_a_link_counts_reads_by_its_nodes(spark):
    links = spark.createDataFrame([("a", 1, 2, 1), ("b", 3, 2, 1), ("c", 1, None, 4)], "link string, node1 long, node2 long, sr long")
    reads = spark.createDataFrame([(1, 7), (1, 7), (2, 7), (2, 8), (3, 8), (2, 9)], "node long, read_id long")
    got = sorted((x.link, x.original_sr, x.sr) for x in rescued_support(links, reads, reads, None).collect())
    assert got == [("a", 1, 4), ("b", 1, 4), ("c", 4, 5)]
