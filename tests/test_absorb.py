"""Containment by votes and absorption in rounds against paths taken in one after the other."""

import random

import pytest

from segmentry.operators.absorb import Paths, absorb, contained_paths

STEPS = "path_id long, place int, n long, node_id long, chrom string, strand string, ident string, genuine boolean, exons array<struct<start:long,end:long>>, gap int, pos1 long, pos2 long"


def made(seed: int, clusters: int) -> list[dict]:
    """Paths of 2 to 5 nodes of one exon, + strand; those of a cluster are parts of one of its own with ends moved a little."""
    rnd = random.Random(seed)
    out = []
    for c in range(clusters):
        k = rnd.randint(3, 6)
        whole = [(f"c{c}", 1000 * i, 1000 * i + 300) for i in range(k)]
        hops = [rnd.choice((-3, 0, 0, 4)) for _ in range(k - 1)]
        for _ in range(rnd.randint(2, 6)):
            lo = rnd.randint(0, k - 2)
            hi = rnd.randint(lo + 1, k - 1)
            nodes = [list(x) for x in whole[lo : hi + 1]]
            nodes[0][1] += rnd.choice((0, 0, 5, 60))
            nodes[0][2] += rnd.choice((0, 0, 5, -9, 14))
            nodes[-1][1] += rnd.choice((0, 0, -5, 9, 14))
            nodes[-1][2] -= rnd.choice((0, 0, 5, 60))
            gaps = hops[lo:hi] if rnd.random() < 0.9 else [rnd.choice((0, 7)) for _ in range(hi - lo)]
            out.append({"id": len(out), "nodes": [tuple(x) for x in nodes], "gaps": gaps, "pos": [(a[2], b[1]) for a, b in zip(nodes, nodes[1:], strict=False)], "reads": [{100 * len(out) + r for r in range(rnd.randint(1, 3))}] * (hi - lo)})
    return out


def kind(path: dict, i: int) -> str:
    return "HEAD" if i == 0 else "TAIL" if i == len(path["nodes"]) - 1 else "MID"


def one(a: tuple, ka: str, b: tuple, kb: str, a_first: bool) -> bool:
    """Of two tails of one length the one with the smaller id counts as the longer."""
    (c, s, e), (d, t, f) = a, b
    if c != d:
        return False
    if (ka, kb) == ("HEAD", "HEAD"):
        return abs(e - f) <= 10
    if (ka, kb) == ("TAIL", "TAIL"):
        first = (s, e, t, f) if (e - s, a_first) > (f - t, not a_first) else (t, f, s, e)
        return abs(s - t) <= 10 and first[1] >= first[3]
    if (ka, kb) == ("HEAD", "MID"):
        return abs(e - f) <= 10 and t <= s
    if (ka, kb) == ("TAIL", "MID"):
        return abs(s - t) <= 10 and e <= f
    return (ka, kb) == ("MID", "MID") and a == b


def shift(p: dict, q: dict) -> int | None:
    n = len(p["nodes"])
    for k in range(len(q["nodes"]) - n + 1):
        if all(one(p["nodes"][i], kind(p, i), q["nodes"][i + k], kind(q, i + k), p["id"] < q["id"]) for i in range(n)) and p["gaps"] == q["gaps"][k : k + n - 1]:
            return k
    return None


def rank(p: dict) -> tuple:
    return len(p["nodes"]), "|".join(f"{c}:{s}-{e}:+" for c, s, e in p["nodes"]), p["id"]


def folded(paths: list[dict]) -> tuple[list[dict], dict]:
    """A cluster's paths, and who stands for each."""
    names = {p["id"]: p["id"] for p in paths}
    while True:
        if not any(p is not q and shift(p, q) is not None for p in paths for q in paths):
            return paths, names
        rest, kept, taken = sorted(paths, key=rank), [], []
        while rest:
            first = rest.pop()
            own = [p for p in rest if shift(p, first) is not None]
            taken += [(p, first, shift(p, first)) for p in own]
            rest = [p for p in rest if all(p is not o for o in own)]
            kept.append(first)
        grown = {q["id"]: {**q, "nodes": list(q["nodes"]), "pos": list(q["pos"]), "reads": [set(r) for r in q["reads"]]} for q in kept}
        for p, q, k in taken:
            x = grown[q["id"]]
            for i, (c, s, e) in enumerate(p["nodes"]):
                x["nodes"][i + k] = (c, min(s, x["nodes"][i + k][1]), max(e, x["nodes"][i + k][2]))
            for i, (a, b) in enumerate(p["pos"]):
                x["pos"][i + k] = (max(a, x["pos"][i + k][0]), min(b, x["pos"][i + k][1]))
                x["reads"][i + k] |= p["reads"][i]
            names = {a: q["id"] if b == p["id"] else b for a, b in names.items()}
        paths = list(grown.values())


def tables(spark, paths: list[dict]) -> Paths:
    steps, reads, node = [], [], 0
    for p in paths:
        for i, (c, s, e) in enumerate(p["nodes"]):
            last = i == len(p["nodes"]) - 1
            steps.append((p["id"], i, len(p["nodes"]), node, c, "+", kind(p, i), False, [(s, e)], *((None, None, None) if last else (p["gaps"][i], *p["pos"][i]))))
            node += 1
            reads += [] if last else [(p["id"], i, r) for r in p["reads"][i]]
    return Paths(spark.createDataFrame(steps, STEPS), spark.createDataFrame(reads, "path_id long, place int, read_id long"))


@pytest.fixture(scope="module")
def paths():
    return made(7, 1000)


def of_cluster(paths: list[dict]) -> list[list[dict]]:
    out: dict = {}
    for p in paths:
        out.setdefault(p["nodes"][0][0], []).append(p)
    return list(out.values())


def test_containment(spark, paths):
    got = {(r.path_id, r.container): r.shift for r in contained_paths(tables(spark, paths).steps).collect()}
    want = {(p["id"], q["id"]): k for own in of_cluster(paths) for p in own for q in own if p is not q and (k := shift(p, q)) is not None}
    assert got == want and len(want) > 500 and any(p["nodes"][0] != q["nodes"][k] for (a, b), k in want.items() for p, q in [(paths[a], paths[b])])


def test_fold_of_a_thousand_clusters(spark, paths):
    kept, names = absorb(tables(spark, paths))
    want, stands = {}, {}
    for own in of_cluster(paths):
        left, who = folded(own)
        stands |= who
        want |= {(p["id"], i): (s, e, p["gaps"][i] if i < len(p["gaps"]) else None, *(p["pos"][i] if i < len(p["pos"]) else (None, None))) for p in left for i, (_, s, e) in enumerate(p["nodes"])}
    assert {r.path_id: r.absorber for r in names.collect()} == stands and sum(a != b for a, b in stands.items()) > 300
    got = {(r.path_id, r.place): (r.exons[0].start, r.exons[-1].end, r.gap, r.pos1, r.pos2) for r in kept.steps.collect()}
    assert got == want
    reads: dict = {}
    for r in kept.hop_reads.collect():
        reads.setdefault((r.path_id, r.place), set()).add(r.read_id)
    assert reads == {(p["id"], i): set(x) for own in of_cluster(paths) for p in folded(own)[0] for i, x in enumerate(p["reads"])}


def test_no_path_and_alone(spark):
    alone = made(1, 1)[:1]
    kept, names = absorb(tables(spark, alone))
    assert kept.steps.count() == len(alone[0]["nodes"]) and [tuple(r) for r in names.collect()] == [(0, 0)]
    none = tables(spark, alone)
    assert absorb(Paths(none.steps.limit(0), none.hop_reads.limit(0)))[1].count() == 0
