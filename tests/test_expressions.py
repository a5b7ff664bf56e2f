"""Small literal cases of expressions and helpers."""

import pytest
from pyspark.sql import functions as F

from segmentry.operators import junctions as J
from segmentry.operators.rescue import rebased
from segmentry.plans.junction_queries import letter_id, numeric_id
from segmentry.sources.gtf import parse_gtf
from segmentry.functions import cigar as C
from segmentry.operators.components import connected_components
from segmentry.operators.ranges import range_join


def one(spark, cigar, expr):
    return spark.createDataFrame([(cigar,)], "cigar string").select(expr.alias("x")).first().x


@pytest.mark.parametrize(("cigar", "want"), [("10S50M5S", (10, 5, 50, 50, 65)), ("15S5I1D80M", (15, 0, 85, 81, 100)), ("5M", (0, 0, 5, 5, 5))])
def test_profile(spark, cigar, want):
    ops = C.operations(F.col("cigar"))
    parts = F.array(C.clip(F.col("cigar"), False), C.clip(F.col("cigar"), True), C.total(ops, "MI"), C.total(ops, "MDN"), C.total(ops, "MIS"))
    assert tuple(one(spark, cigar, parts)) == want


def test_normalized(spark):
    assert one(spark, "1S2S5M3S2S", C.normalized(F.col("cigar"))) == "3S5M5S"
    assert one(spark, "3M0I2M", C.normalized(F.col("cigar"))) == "5M"


def test_exons_and_introns(spark):
    exons = C.exons(F.lit(1), F.col("cigar"))
    assert one(spark, "15S2M2N3I50M2S", C.text_of(exons)) == "1-3;5-55"
    assert one(spark, "15S2M2N3I50M2S", C.text_of(C.gaps(exons))) == "3-5"
    assert one(spark, "5M", C.text_of(C.gaps(C.exons(F.lit(1), F.col("cigar"))))) == ""


def test_merged(spark):
    rows = F.from_json(F.lit('[{"start":5,"end":9},{"start":1,"end":3},{"start":4,"end":5}]'), "array<struct<start:bigint,end:bigint>>")
    assert one(spark, "", C.text_of(C.merged(rows))) == "1-3;4-9"
    assert one(spark, "", C.text_of(C.merged(rows, 1))) == "1-9"


def test_reverse_complement(spark):
    assert one(spark, "AACGTN", C.reverse_complement(F.col("cigar"))) == "NACGTT"


def test_components(spark):
    links = [(1, 2), (3, 2), (3, 4), (10, 11), (5, 5), (None, 7), *((i, i + 1) for i in range(100, 140))]
    found = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {1: 1, 2: 1, 3: 1, 4: 1, 10: 10, 11: 10} | dict.fromkeys(range(100, 141), 100)
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_range_join_meets_each_pair_once(spark):
    x = spark.createDataFrame([("c", i * 7, i * 7 + 30) for i in range(40)], "k string, s long, e long")
    y = spark.createDataFrame([("c", i * 11, i * 11 + 5) for i in range(40)], "k2 string, s2 long, e2 long")
    on = (F.col("s") <= F.col("e2")) & (F.col("s2") <= F.col("e"))
    got = range_join(x, y, on, ("k", "k2"), ("s", "e"), ("s2", "e2"), width=10).collect()
    want = x.join(y, on).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_stable_ids(spark):
    key = "chr16-84995921-85011535---m64135_220623_212714/123471672/ccs"
    assert one(spark, key, numeric_id(F.col("cigar"))) == "7236494217"
    assert one(spark, "Hello World!", letter_id(F.col("cigar"))) == "a" + __import__("hashlib").sha256(b"Hello World!").hexdigest()[1:16]


def test_affix_length(spark):
    size = lambda a, b, right: one(spark, a, J.affix_length(F.col("cigar"), F.lit(b), right))
    assert [size("ACGT", "ACGA", False), size("ACGT", "ACGT", False), size("ACGT", "TCGT", True), size("ACGT", "ACGT", True), size("", "A", True)] == [3, 0, 3, 4, 0]


def test_gtf(spark):
    lines = ["#x", 'chr1\ts\texon\t10\t20\t.\t-\t.\tgene_id "g"; gene "B"; gene "C";', 'chr_1\ts\texon\t1\t2\t.\t+\t.\tgene "a";', "short", "", 'chr2\ts\tgene\t1\t2\t.\t+\t.\t']
    rows = {r.chrom: r for r in parse_gtf(spark.createDataFrame([(x,) for x in lines], "line string")).collect()}
    assert set(rows) == {"chr1", "chr2"}
    assert (rows["chr1"].start, rows["chr1"].end, rows["chr1"].gene, rows["chr2"].gene) == (9, 20, "B", None)


def test_rebased(spark):
    own = rebased((F.lit(5), F.lit(10), F.lit(2)), F.lit(True), F.lit("+"), F.lit("+"), F.col("cigar"))
    assert [one(spark, "1S2M1S", own[k]) for k in ("lt", "rt", "cigar")] == [1, 12, "2S2M13S"]
