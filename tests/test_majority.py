"""Genes of clusters."""

from segmentry.plans import graph_queries
from segmentry.sources import adapters as A


def test_majority_genes_make_no_rows_of_reads(spark, monkeypatch):
    calls, keep = [], A.path_graph
    monkeypatch.setattr(A, "path_graph", lambda *a, **k: calls.append(1) or keep(*a, **k))
    graph_queries.agg_majority_gene(spark, "/root/testdata/sf0.001")
    assert not calls
