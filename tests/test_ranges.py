"""Range joins and unions against brute force, with intervals of all lengths."""

import random

import pytest
from pyspark.sql import functions as F

from segmentry.operators.ranges import range_join, union


def intervals(seed):
    rnd = random.Random(seed)
    starts = [rnd.randint(-1000, 500_000) for _ in range(200)]
    return [(i, f"c{i % 2}", s, s + rnd.randint(0, rnd.choice([0, 5, 100, 9999, 10_001, 160_000, 3_000_000]))) for i, s in enumerate(starts)]


def test_every_pair_once(spark):
    a, b = intervals(1), intervals(2)
    x, y = spark.createDataFrame(a, "i long, k string, s long, e long"), spark.createDataFrame(b, "j long, k2 string, s2 long, e2 long")
    got = range_join(x, y, (F.col("s") <= F.col("e2")) & (F.col("s2") <= F.col("e")), ("k", "k2"), ("s", "e"), ("s2", "e2")).collect()
    assert sorted((r.i, r.j) for r in got) == [(p[0], q[0]) for p in a for q in b if p[1] == q[1] and p[2] <= q[3] and q[2] <= p[3]]


@pytest.mark.parametrize(("touch", "width"), [(0, 1000), (50, 20_000), (0, 1_000_000)])
def test_union(spark, touch, width):
    rows = [(i, k, s, s + (e - s) % 3000) for i, k, s, e in intervals(3)]
    rows += rows[:20]
    wanted: list[list] = []
    for _, k, s, e in sorted(rows, key=lambda r: r[1:]):
        if wanted and wanted[-1][0] == k and s <= wanted[-1][2] + touch:
            wanted[-1][2:] = [max(wanted[-1][2], e), wanted[-1][3] + 1]
        else:
            wanted.append([k, s, e, 1])
    got = union(spark.createDataFrame(rows, "i long, k string, s long, e long"), "k", "s", "e", touch, width).collect()
    assert sorted(tuple(r) for r in got) == sorted(map(tuple, wanted))
