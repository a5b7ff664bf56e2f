"""Written files: header first, lines in order; graphs read back; paths without deletions."""

import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from segmentry.operators.junctions import squeezed, united
from segmentry.plans import absorb_queries, path_queries
from segmentry.sources import sam, sinks

DATA = "/root/testdata/sf0.001"


def joined(folder) -> list[str]:
    return "".join(p.read_text() for p in sorted(Path(folder).glob("part-*"))).splitlines()


def test_a_written_vcf_is_one_sorted_file(spark, tmp_path):
    lines = path_queries.vcf_file(spark, DATA)
    sinks.write_lines(lines.repartition(7), f"{tmp_path}/vcf")
    got = joined(tmp_path / "vcf")
    assert sorted(got) == sorted(r.line for r in lines.collect()) and got[0] == "##fileformat=VCFv4.2"
    heads = [i for i, x in enumerate(got) if x.startswith("#")]
    assert heads == list(range(len(heads))) and got[heads[-1]].startswith("#CHROM\t") and not any(x.startswith("#CHROM") for x in got[: heads[-1]])
    rows = [x.split("\t") for x in got[len(heads) :]]
    assert len(rows) > 50 and all(len(r) == 8 for r in rows)
    assert [(r[0], int(r[1])) for r in rows] == sorted((r[0], int(r[1])) for r in rows)
    told = set(re.findall(r"##INFO=<ID=(\w+)", "\n".join(got)))
    assert all({x.partition("=")[0] for x in r[7].split(";")} == told for r in rows)
    assert {r[0] for r in rows} <= set(re.findall(r"##contig=<ID=(\w+)", "\n".join(got)))


def test_a_written_gtf_has_each_transcript_before_its_exons(spark, tmp_path):
    steps = spark.createDataFrame(
        [(4, 1, "b", "chr2", "-", [(10, 20), (30, 45)], 1, 0.5), (4, 0, "a", "chr1", "+", [(1, 5), (7, 9)], 2, 1.0), (3, 0, "a", "chr1", "+", [(1, 5), (7, 9)], 2, 1.0)],
        "path_id long, place int, node string, chrom string, strand string, exons array<struct<start:long,end:long>>, ptc long, ptf double",
    )
    sinks.write_lines(sinks.gtf_lines(spark.createDataFrame([(3, 7), (4, 2)], "path_id long, sr long"), steps).repartition(5), f"{tmp_path}/gtf")
    got = [x.split("\t") for x in joined(tmp_path / "gtf")]
    assert [(r[2], re.search(r'transcript_id "(\d+)"', r[8])[1], r[3], (re.search(r'exon_id "(\d+)"', r[8]) or [0, ""])[1]) for r in got] == [
        ("transcript", "3", ".", ""), ("exon", "3", "2", "001"), ("exon", "3", "8", "002"),
        ("transcript", "4", ".", ""), ("exon", "4", "2", "001"), ("exon", "4", "8", "002"), ("exon", "4", "31", "001"), ("exon", "4", "11", "002"),
    ]


def test_a_written_graph_file_keeps_graphs_together(spark, tmp_path):
    nodes, edges = absorb_queries._families(spark, DATA)
    s = absorb_queries.graph.structures(absorb_queries._segments(spark, DATA)).withColumn("node", F.split("path", r"\|")[0]).join(nodes, "node")
    sinks.write_lines(sinks.tsg_lines(nodes, edges, s, "fam"), f"{tmp_path}/tsg")
    got = [x.split("\t") for x in joined(tmp_path / "tsg")]
    of = [int(r[2] if r[0] == "H" else r[1]) for r in got]
    assert of == sorted(of)
    for fam in set(of):
        kinds = "".join(r[0] for r, f in zip(got, of, strict=True) if f == fam)
        assert re.fullmatch("HGN+E*P*", kinds)


def test_graphs_read_back(spark):
    text = '{"data":[],"directed":false,"elements":{"nodes":[{"data":{"id":"a"}},{"data":{"id":"b"}}],"edges":[{"data":{"source":"a","target":"b"}}]}}'
    nodes, edges = sinks.parse_cytoscape(spark.createDataFrame([(text,), ("no json",)], "line string"))
    assert sorted(r.id for r in nodes.collect()) == ["a", "b"] and [tuple(r) for r in edges.collect()] == [("a", "b")]
    made = spark.createDataFrame([("a", "b", 2), ("a", "c", 1), ("b", "c", 5)], "src string, dst string, sr long")
    assert sorted(map(tuple, sinks.parse_graph_json(sinks.graph_json(made)).collect())) == sorted(map(tuple, made.collect()))


def test_squeezed_paths(spark):
    rows = [(1, i, "c", "+", 100 * i, 100 * i + 50, [(100 * i, 100 * i + 50)]) for i in range(5)] + [(2, 0, "c", "+", 0, 50, [(0, 20), (30, 50)]), (2, 1, "c", "+", 51, 90, [(51, 60), (62, 90)]), (3, 0, "c", "-", 5, 9, [(5, 9)])]
    segments = spark.createDataFrame(rows, "read_id long, seg_ord int, chrom string, strand string, ref_start long, ref_end long, exons array<struct<start:long,end:long>>")
    hops = [(1, 0, "DEL"), (1, 1, "TDUP"), (1, 2, "INV"), (1, 3, "DEL"), (2, 0, "DEL")]
    got = squeezed(segments, spark.createDataFrame(hops, "read_id long, seg_ord1 int, kind string"))
    found = {(r.read_id, r.place): (r.ident, r.segments, [(e.start, e.end) for e in r.exons]) for r in got.collect()}
    assert found == {
        (1, 0): ("HEAD", 2, [(0, 50), (100, 150)]), (1, 1): ("MID", 1, [(200, 250)]), (1, 2): ("TAIL", 2, [(300, 350), (400, 450)]),
        (2, 0): ("HEAD", 2, [(0, 20), (30, 60), (62, 90)]), (3, 0): ("HEAD", 1, [(5, 9)]),
    }
    odd = spark.createDataFrame([([(5, 6), (1, 9), (9, 9), (20, 30), (31, 40)],), ([],)], "x array<struct<start:long,end:long>>")
    assert [[tuple(e) for e in r.u] for r in odd.select(united(F.col("x"), 1).alias("u")).collect()] == [[(1, 9), (20, 40)], []]


def test_headers_and_repeated_tags(spark):
    lines = lambda *x: spark.createDataFrame([(y,) for y in x], "line string")
    sam.check_header(lines("@HD\tVN:1.6\tSO:coordinate", "@SQ\tSN:c"))
    for wrong in (("@SQ\tSN:c",), ("@HD\tVN:1.6",), ("@HD\tVN:1.6\tSO:queryname",)):
        with pytest.raises(ValueError, match="SO:coordinate"):
            sam.check_header(lines(*wrong))
    row = sam.parse_sam(lines("r\t0\tc\t5\t60\t4M\t*\t0\t0\tACGT\tIIII\tNM:i:3\tSA:Z:a:b\tNM:i:7")).first()
    assert row.tags == {"NM": "3", "SA": "a:b"} and row.ref_start == 4
