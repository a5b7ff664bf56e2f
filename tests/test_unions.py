"""Unions of intervals of which many are equal, and means over places."""

from pathlib import Path

import duckdb
import pytest

from segmentry.plans import queries as plans
from segmentry.plans import sequence_queries  # noqa: F401  (it adds to the tables of queries)

PART = Path("/root/testdata/sf0.01/part.parquet")


@pytest.mark.parametrize("name", ["interval_union", "interval_union_adjacent"])
def test_union_sql_leaves_no_ties_to_chance(spark, tmp_path, name):
    c = duckdb.connect()
    c.execute("set preserve_insertion_order = false")
    c.execute(f"create table part as select p.* from '{PART}' p, range(60) r(i) order by hash(p_partkey, i)")
    c.execute(f"copy part to '{tmp_path / 'part.parquet'}' (format parquet)")
    ours = sorted(map(tuple, plans.QUERIES[name](spark, str(tmp_path)).select("chrom", "u_start", "u_end", "n").collect()))
    for threads in (1, 3, 4):
        c.execute(f"set threads = {threads}")
        assert c.execute(f"select chrom, u_start, u_end, n from ({plans.ORACLES[name]}) order by all").fetchall() == ours
