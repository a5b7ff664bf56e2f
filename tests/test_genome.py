"""The genome's bases and the motifs of introns."""

import re

from segmentry.operators.genome import intron_motifs
from segmentry.sources import adapters as A


def test_every_sign_but_a_letter_is_n(spark, tmp_path):
    text = "Ab c\n\t'\\\"{}|é-9_%$~^`" + "xyz" * 2000
    spark.createDataFrame([(3, text), (4, "")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    turn = str.maketrans("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", "ACGTACGTACGTACGTACGTACGTACACGTACGTACGTACGTACGTACGTAC")
    want = {80 + p: re.sub("[^ACGT]", "N", text[5000 * p : 5000 * p + 5000].translate(turn)).ljust(5000, "N") for p in (0, 1)}
    assert {r.chunk_no: r.seq for r in A.genome(spark, str(tmp_path)).collect()} == want


def test_motifs_of_both_ends_are_found_in_one_look(spark):
    genome = spark.createDataFrame([("c", 0, "A" * 100 + "GT" + "C" * 46 + "AG" + "T" * 4850)], "chrom string, chunk_no long, seq string")
    rows = [("c", "+", 0, 50), ("c", "-", 0, 50), ("c", "+", 0, 2), ("c", "+", 0, 6000)]
    x = intron_motifs(spark.createDataFrame(rows, "chrom string, strand string, i_start long, i_end long"), genome)
    assert {(r.strand, r.i_end): r.motif for r in x.collect()} == {("+", 50): "GT-AG", ("-", 50): "CT-AC", ("+", 2): "GT-GT", ("+", 6000): None}
