"""Reads with the same places are one row, and graphs of such rows have the support of all reads."""

import random

from segmentry.operators import contraction
from segmentry.sources import adapters as A


def test_grouped_reads_stand_for_all_reads(spark):
    r = random.Random(2)
    rows = [(i, p, p // 5) for i in range(200) for p in r.choices(range(6), k=1 if i % 3 else r.randint(1, 4))]
    made = A.grouped_reads(spark.createDataFrame(rows, "read_id long, three long, two long")).collect()
    places = {}
    for i, three, two in rows:
        places.setdefault(i, set()).add((three, two))
    want = {}
    for i, own in places.items():
        for p in own:
            key = p if len(own) == 1 else (p, i)
            want[key] = (min(want.get(key, (i, 0))[0], i), want.get(key, (i, 0))[1] + 1)
    assert sorted((x.three, x.two, x.read_id, x.n) for x in made) == sorted((k[0] if isinstance(k[0], tuple) else k) + v for k, v in want.items())


def test_support_after_contraction_counts_grouped_reads(spark):
    folder = "/root/testdata/sf0.001"
    supports = []
    for grouped in (False, True):
        nodes, graph, _ = A.path_graph(spark, folder, grouped=grouped)
        labels = nodes.selectExpr("node_id", "node_id - node_id % 2 as merged")
        supports.append(sorted(map(tuple, contraction.contract(graph, labels).support().collect())))
        supports.append(sorted(map(tuple, graph.support().collect())))
    assert supports[0] == supports[2] and supports[1] == supports[3] and supports[0]
