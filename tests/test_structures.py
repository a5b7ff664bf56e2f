"""Structures stand for their reads."""

import random

from pyspark.sql import functions as F

from segmentry.operators import graph


def test_edges_of_structures_have_the_reads_of_edges(spark):
    r = random.Random(4)
    kinds = [[r.randint(0, 6) for _ in range(r.randint(1, 6))] for _ in range(8)]  # nodes may come again
    rows = [(read, i, "chr1", "+", [(n * 10, n * 10 + 5)]) for read in range(60) for i, n in enumerate(kinds[read % 8])]
    segs = spark.createDataFrame(rows, "read_id long, seg_ord int, chrom string, strand string, exons array<struct<start:bigint,end:bigint>>")
    found = graph.edges_of_structures(graph.structures(segs)).groupBy("src", "dst").agg(F.sum("reads").alias("sr"))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, graph.edges_of(segs).select("src", "dst", "sr").collect()))
