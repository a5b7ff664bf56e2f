"""Queries that had become smaller: reads of links, and pairs of nodes without a common intron."""

from pyspark.sql import Row

from segmentry.operators import compat, events


def test_support_lists_reads_in_order_of_number(spark):
    link = dict(kind="TRA", link="ITPL", chrom1="chr1", pos1=5, strand1="+", chrom2="chr2", pos2=9, strand2="-")
    rows = [Row(**link, read_id=r) for r in (10, 9, 10, 101)] + [Row(**{**link, "pos1": 6}, read_id=3)]
    found = {x.pos1: (x.support, x.first_read, x.reads) for x in events.supported(spark.createDataFrame(rows), with_reads=True).collect()}
    assert found == {5: (3, 9, "9,10,101"), 6: (1, 3, "3")}


def test_pairs_of_a_family_need_no_common_intron(spark):
    node = lambda i, fam, *exons: (i, fam, "chr1", "+", "HEAD", True, list(exons))
    nodes = [node(1, 0, (0, 10), (20, 30)), node(2, 0, (0, 12), (22, 30)), node(3, 0, (0, 30)), node(4, 1, (0, 10), (20, 30))]
    df = spark.createDataFrame(nodes, "node_id long, fam long, chrom string, strand string, ident string, genuine boolean, exons array<struct<start:bigint,end:bigint>>")
    assert [(x.a.node_id, x.b.node_id) for x in compat.spliced_pairs(df).collect()] == [(1, 2)]
