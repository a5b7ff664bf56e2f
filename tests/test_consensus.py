"""Consensus of reads by votes of places."""

import random
from collections import Counter

from segmentry.operators import absorb


def plain(reads: list[tuple[int, str]]) -> dict[int, str]:
    out = {}
    for k in {k for k, _ in reads}:
        own = [b for j, b in reads if j == k]
        at = [Counter(b[i] for b in own if i < len(b)) for i in range(max(map(len, own)))]
        out[k] = "".join(min(c, key=lambda x: (-c[x], x)) for c in at)
    return out


def test_consensus_is_that_of_plain_votes(spark):
    r = random.Random(5)
    text = lambda letters, most: "".join(r.choice(letters) for _ in range(r.randint(0, most)))
    reads = [(k, text("ACGT" if k % 3 else "acGTN\u00e9\u4e2d\U0001f600", 700)) for k in range(12) for _ in range(r.randint(1, 9))] + [(90, ""), (91, ""), (91, "A" * 256), (92, "C" * 257)]
    found = absorb.consensus(spark.createDataFrame(reads, "k long, b string"), "k", "b").collect()
    assert {x.k: x.consensus for x in found} == plain(reads) and len(found) == len(plain(reads))


def test_votes_go_on_over_batches(spark):
    reads = [(k % 2, "ACGT"[(k // 3) % 4] * 300 + "G" * (k % 5)) for k in range(400)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        found = absorb.consensus(spark.createDataFrame(reads, "k long, b string"), "k", "b").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {x.k: x.consensus for x in found} == plain(reads)


def test_no_row_is_made_for_a_base(spark):
    """Letters were rows of the plan; now pieces of 256 are."""
    df = spark.createDataFrame([(1, "ACGT" * 1000)] * 3, "k long, b string")
    plan = absorb.consensus(df, "k", "b")._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode" not in plan and absorb.consensus(df, "k", "b").first().consensus == "ACGT" * 1000
