"""Header and records of a VCF are made of one pass over the alignments."""

from segmentry.plans import path_queries
from segmentry.sources import adapters as A


def test_vcf_reads_alignments_once(spark, monkeypatch):
    calls, keep = [], A.alignments
    monkeypatch.setattr(A, "alignments", lambda *a: calls.append(1) or keep(*a))
    lines = [r.line for r in path_queries.sink_vcf(spark, "/root/testdata/sf0.001").collect()]
    assert calls == [1]
    assert sum(x.startswith("##contig") for x in lines) == len({x for x in lines if x.startswith("##contig")}) > 0
