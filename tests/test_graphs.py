"""Contraction, strong components, read-guided ways and refinement against plain versions on made graphs."""

import random
from collections import Counter

import pytest

from segmentry.operators.contraction import Graph, breakpoint_votes, contract, labels, refine
from segmentry.operators.guided import circles, guided_ways
from segmentry.operators.strong import strong_components

NODES = "node_id long, chrom string, strand string, exons array<struct<start:long,end:long>>"
EDGES = "src long, dst long, pos1 long, pos2 long, gap int"


def made(spark, nodes: list, reads: dict, gaps: dict | None = None) -> Graph:
    """``reads``: read to its nodes in order."""
    hops = [(a, b, r) for r, path in reads.items() for a, b in zip(path, path[1:], strict=False)]
    spans = {n[0]: n for n in nodes}
    edges = {}
    for a, b, _ in hops:
        one, two = spans[a], spans[b]
        pos1, pos2 = one[3][-1][1] if one[2] == "+" else one[3][0][0], two[3][0][0] if two[2] == "+" else two[3][-1][1]
        edges[a, b] = (a, b, pos1, pos2, (gaps or {}).get((a, b), 0))
    return Graph(spark.createDataFrame(nodes, NODES), spark.createDataFrame(list(edges.values()), EDGES), spark.createDataFrame(hops, "src long, dst long, read_id long"))


def simple(n: int) -> list:
    return [(i, "chr1", "+" if i % 3 else "-", [(1000 * i, 1000 * i + 100)]) for i in range(n)]


def paths(seed: int, nodes: int, reads: int) -> dict:
    rnd = random.Random(seed)
    kinds = [rnd.sample(range(nodes), rnd.randint(2, 6)) for _ in range(max(3, reads // 3))]
    return {r: rnd.choice(kinds) for r in range(reads)}


@pytest.mark.parametrize("seed", [1])
def test_contraction(spark, seed):
    rnd = random.Random(seed)
    reads = paths(seed, 30, 60)
    gaps = {(a, b): rnd.randint(-2, 2) for p in reads.values() for a, b in zip(p, p[1:], strict=False)}
    nodes = simple(30)
    pairs = [(a, b) for a, b in (rnd.sample(range(30), 2) for _ in range(14)) if nodes[a][2] == nodes[b][2]]
    graph = made(spark, nodes, reads, gaps)
    merged = labels(graph.nodes, spark.createDataFrame(pairs, "node1 long, node2 long"))
    part = {i: i for i in range(30)}
    for _ in range(30):
        for a, b in pairs:
            part[a] = part[b] = min(part[a], part[b])
    assert {r.node_id: r.merged for r in merged.collect()} == part
    got = contract(graph, merged)

    support = Counter((a, b) for p in reads.values() for a, b in zip(p, p[1:], strict=False))
    of, edges, ends = {}, {}, {}
    for r, p in reads.items():
        for a, b in zip(p, p[1:], strict=False):
            if part[a] != part[b]:
                of.setdefault((part[a], part[b]), set()).add(r)
    for a, b in support:
        if part[a] != part[b]:
            rank = 2 if gaps[a, b] == 0 else 1 if gaps[a, b] < 0 else 0
            edges.setdefault((part[a], part[b]), []).append((support[a, b], rank, -gaps[a, b]))
            x, y = nodes[a], nodes[b]
            ends.setdefault((part[a], part[b]), []).append((x[2], x[3][0][1] if x[2] == "+" else x[3][0][0], y[2], y[3][0][0] if y[2] == "+" else y[3][0][1]))
    wanted = {}
    for e, choices in edges.items():
        first, second = ends[e][0][0], ends[e][0][2]
        wanted[e] = (
            (max if first == "+" else min)(p for _, p, _, _ in ends[e]), (min if second == "+" else max)(p for *_, p in ends[e]), -max(choices)[2], len(of[e]),
        )
    found = {(r.src, r.dst): (r.pos1, r.pos2, r.gap, r.sr) for r in got.edges.join(got.support(), ["src", "dst"]).collect()}
    assert found == wanted
    degree = Counter(n for e in wanted for n in e)
    assert Counter(n for e in found for n in e) == degree and all(a != b for a, b in found)
    for r in got.nodes.collect():
        assert [(e.start, e.end) for e in r.exons] == sorted(nodes[i][3][0] for i in range(30) if part[i] == r.node_id) and r.members == sum(p == r.node_id for p in part.values())
    votes = {(r.node_id, r.side): (r.pos, r.votes) for r in breakpoint_votes(graph, merged).collect()}
    starts = {a for a, _ in wanted} - {b for _, b in wanted}
    assert {n for n, side in votes if side == "start"} == starts
    for n in starts:
        poses = Counter(p for e, x in ends.items() if e[0] == n for _, p, _, _ in x)
        assert votes[n, "start"] == min(((p, k) for p, k in poses.items()), key=lambda x: (-x[1], x[0]))


def tarjan(edges: set) -> dict:
    after: dict[int, list[int]] = {}
    for a, b in edges:
        after.setdefault(a, []).append(b)
    index, low, stack, out = {}, {}, [], {}

    def visit(v: int) -> None:
        index[v] = low[v] = len(index)
        stack.append(v)
        for w in after.get(v, []):
            if w not in index:
                visit(w)
                low[v] = min(low[v], low[w])
            elif w in stack:
                low[v] = min(low[v], index[w])
        if low[v] == index[v]:
            at = stack.index(v)
            own = stack[at:]
            del stack[at:]
            if len(own) > 1:
                out.update(dict.fromkeys(own, max(own)))

    for v in {x for e in edges for x in e}:
        if v not in index:
            visit(v)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_strong_components_are_tarjans(spark, seed):
    rnd = random.Random(seed)
    edges = {tuple(rnd.sample(range(40 + 10 * k, 60 + 10 * k), 2)) for k in range(3) for _ in range(18)} | {(1, 2), (2, 3), (3, 1), (5, 5), (7, 8), (8, 9)}
    got = strong_components(spark.createDataFrame(sorted(edges), "src long, dst long"))
    assert {r.node: r.component for r in got.collect()} == tarjan(edges)


def test_no_edges_and_no_cycles(spark):
    assert strong_components(spark.createDataFrame([], "src long, dst long")).collect() == []
    assert strong_components(spark.createDataFrame([(i, i + 1) for i in range(6)], "src long, dst long")).collect() == []


def test_a_pure_cycle_is_seen(spark):
    graph = made(spark, simple(8), {0: [0, 1, 2], 1: [2, 0], 2: [3, 4], 3: [5, 6]})
    got = {r.cluster_id: (r.n_nodes, r.n_cyclic, r.has_circle) for r in circles(graph).collect()}
    assert got == {0: (3, 3, True), 3: (2, 0, False), 5: (2, 0, False), 7: (1, 0, False)}


def walked(reads: dict, n: int, least: int, ignore: bool) -> set:
    of: dict = {}
    for r, p in reads.items():
        for a, b in zip(p, p[1:], strict=False):
            of.setdefault((a, b), set()).add(r)
    mid = {(r, x) for r, p in reads.items() for x in p[1:-1]}
    strong = {e for e, r in of.items() if len(r) >= least}
    part = list(range(n))
    for _ in range(n):
        for a, b in of:
            part[a] = part[b] = min(part[a], part[b])
    circular = {part[v] for v in tarjan(strong)}
    out = set()

    def go(way: list) -> None:
        last = way[-1]
        if not any(a == last for a, _ in of):
            out.add((part[way[0]], tuple(way)))
        for a, b in strong:
            if a != last or b in way:
                continue
            if len(way) > 1:
                m1, m2 = ({r for r in of[e] if (r, last) in mid} for e in ((way[-2], last), (a, b)))
                if m1 and m2 and not m1 & m2:
                    continue
            go([*way, b])

    for s in range(n):
        if not any(b == s for _, b in of) and (ignore or part[s] not in circular):
            go([s])
    return out


@pytest.mark.parametrize(("seed", "least", "ignore"), [(1, 1, True), (4, 2, False)])
def test_ways_are_those_of_a_plain_search(spark, seed, least, ignore):
    reads = paths(seed, 16, 24) if seed % 2 else {r: sorted(p) for r, p in paths(seed, 16, 24).items()}
    reads |= {100: [0, 5, 9], 101: [0, 5, 9], 102: [1, 5, 12], 103: [1, 5, 12]}  # 5 is in the middle of both, and no read goes 0, 5, 12
    graph = made(spark, simple(17), reads)
    mids = spark.createDataFrame([(r, x) for r, p in reads.items() for x in p[1:-1]], "read_id long, node_id long")
    got = {(r.cluster_id, tuple(r.way)) for r in guided_ways(graph, mids, least, ignore).collect()}
    assert got == walked(reads, 17, least, ignore)


def test_reads_guide_ways(spark):
    reads = {1: [0, 5, 9], 2: [1, 5, 8]}
    graph = made(spark, simple(10), reads)
    mids = spark.createDataFrame([(1, 5), (2, 5)], "read_id long, node_id long")
    ways = {tuple(r.way) for r in guided_ways(graph, mids).collect()}
    assert {w for w in ways if len(w) > 1} == {(0, 5, 9), (1, 5, 8)}
    free = guided_ways(graph, mids.where("read_id = 1")).collect()
    assert {tuple(r.way) for r in free if len(r.way) > 1} == {(0, 5, 9), (0, 5, 8), (1, 5, 9), (1, 5, 8)}


def test_refinement_goes_on_until_no_pair_is_near(spark):
    # 0 and 1 are near; their union comes near to 2, which neither was; 3 has other introns
    nodes = [(0, "c", "+", [(100, 200)]), (1, "c", "+", [(108, 209)]), (2, "c", "+", [(92, 219)]), (3, "c", "+", [(100, 150), (160, 200)]), (4, "c", "+", [(5000, 5100)]), (5, "c", "+", [(9000, 9100)])]
    reads = {1: [4, 0, 5], 2: [4, 1, 5], 3: [4, 1, 5], 4: [4, 2], 5: [3, 5], 6: [0, 1]}
    graph, names = refine(made(spark, nodes, reads))
    assert {r.node_id: r.merged for r in names.collect()} == {0: 1, 1: 1, 2: 1, 3: 3, 4: 4, 5: 5}
    assert {(r.src, r.dst): r.sr for r in graph.support().collect()} == {(4, 1): 4, (1, 5): 3, (3, 5): 1}
    assert {r.node_id: [tuple(e) for e in r.exons] for r in graph.nodes.collect()}[1] == [(92, 219)]
