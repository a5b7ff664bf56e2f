"""Chains of seeds and their alignments on made sequences."""

import random
import re
import time

import pyarrow as pa

from segmentry.operators import realign
from segmentry.operators.realign import chained, hit_alignments, seed_blocks, seed_hits

TURN = str.maketrans("ACGT", "TGCA")


def bases(rnd: random.Random, n: int) -> str:
    return "".join(rnd.choices("ACGT", k=n))


def frames(spark, queries: dict, contigs: dict):
    return spark.createDataFrame(list(queries.items()), "query long, bases string"), spark.createDataFrame(list(contigs.items()), "contig long, bases string")


def aligned(spark, queries: dict, contigs: dict, **options) -> dict:
    q, c = frames(spark, queries, contigs)
    return {(r.query, r.strand, r.contig): (r.pos, r.cigar, r.nm) for r in hit_alignments(chained(seed_blocks(q, c, **options)), q, c).collect()}


def cost(query: str, contig: str, pos: int, cigar: str) -> int:
    """Unequal, inserted and deleted bases of an alignment; checks its lengths."""
    i, p, n = 0, pos, 0
    for size, kind in re.findall(r"(\d+)([MIDNS])", cigar):
        k = int(size)
        if kind == "M":
            n += sum(a != b for a, b in zip(query[i : i + k], contig[p : p + k], strict=True))
        n += k if kind in "ID" else 0
        i += k if kind in "MIS" else 0
        p += k if kind in "MDN" else 0
    assert i == len(query)
    return n


def test_indels_stay_within_one_hit(spark):
    rnd = random.Random(1)
    contig = bases(rnd, 3000)
    cut = contig[500:600] + contig[630:730]  # 30 bases are missing
    more = contig[1000:1100] + bases(rnd, 30) + contig[1100:1200]  # and 30 are new
    spliced = contig[1500:1600] + contig[2200:2300]
    wrong = list(contig[2500:2700])
    for i in (40, 41, 90, 150):
        wrong[i] = "A" if wrong[i] != "A" else "C"
    queries = {1: cut, 2: more, 3: spliced, 4: "".join(wrong), 5: cut.translate(TURN)[::-1], 6: bases(rnd, 200), 7: "ACGT"}
    got = aligned(spark, queries, {9: contig})
    assert set(got) == {(1, "+", 9), (2, "+", 9), (3, "+", 9), (4, "+", 9), (5, "-", 9)}
    for (q, strand, _), (pos, cigar, nm) in got.items():
        text = queries[q] if strand == "+" else queries[q].translate(TURN)[::-1]
        assert nm == cost(text, contig, pos, cigar.replace("N", "N"))
    assert got[1, "+", 9][2] == got[5, "-", 9][2] == 30 and re.fullmatch(r"\d+M30D\d+M", got[1, "+", 9][1])
    assert got[2, "+", 9][2] == 30 and re.fullmatch(r"\d+M30I\d+M", got[2, "+", 9][1])
    assert got[3, "+", 9][2] == 0 and re.fullmatch(r"\d+M600N\d+M", got[3, "+", 9][1])
    assert got[4, "+", 9] == (2500, "200M", 4)


def test_far_and_crossed_parts_are_hits_of_their_own(spark):
    rnd = random.Random(2)
    contig = bases(rnd, 6000)
    queries = {1: contig[100:200] + contig[4000:4100], 2: contig[2000:2100] + contig[1800:1900]}
    q, c = frames(spark, queries, {0: contig})
    got = sorted((r.query, r.hit_start, r.hit_end, r.n_blocks) for r in seed_hits(q, c).collect())
    assert [(a, abs(b - x) < 4, abs(d - y) < 4) for (a, b, d, _), (x, y) in zip(got, [(100, 200), (4000, 4100), (1800, 1900), (2000, 2100)], strict=True)] == [(1, True, True), (1, True, True), (2, True, True), (2, True, True)]


def test_a_poly_a_query_makes_no_square(spark):
    rnd = random.Random(3)
    contigs = {i: bases(rnd, 100) + "A" * 2000 + bases(rnd, 100) for i in range(5)}
    queries = {i: "A" * 60 for i in range(20)} | {100: bases(rnd, 40) + "A" * 30, 101: contigs[0][70:100] + "A" * 40}
    q, c = frames(spark, queries, contigs)
    blocks = seed_blocks(q, c)
    assert blocks.count() <= 20 * 5 * 2 + 200
    got = {(r.query, r.strand, r.contig) for r in seed_hits(q, c).collect()}
    assert {x for x in got if x[0] < 100} == {(i, "+", k) for i in range(20) for k in range(5)}
    assert not any(x[0] == 100 for x in got)


def test_few_seeds_only_and_nothing(spark):
    q, c = frames(spark, {1: "ACGTACGTACGTAC"}, {1: "ACGTACGTACGTACGT" * 3})
    assert seed_hits(q, c).count() == 0
    empty = q.limit(0)
    assert seed_hits(empty, c).count() == 0 and seed_hits(q, c.limit(0)).count() == 0


def test_seeds_of_a_long_contig_are_cut_in_linear_time(spark):
    rnd = random.Random(4)
    for n in (13, 14, 255, 256, 257, 268, 269, 270, 525, 526, 1000):
        text = bases(rnd, n)
        rows = realign._seeds(spark.createDataFrame([(7, "+", text)], "query long, strand string, bases string"), "query", "bases", 14, "i").collect()
        assert sorted((r.query, r.strand, r.i, r.seed) for r in rows) == [(7, "+", i, text[i : i + 14]) for i in range(n - 13)]
    contig = bases(rnd, 500_000)
    began = time.time()
    got = aligned(spark, {1: contig[300_000:300_060]}, {5: contig})
    assert got == {(1, "+", 5): (300_000, "60M", 0)}
    assert time.time() - began < 60  # each seed was once found from the begin of the text on


def test_placed_clips_grow_over_shared_bases_without_a_list_of_lengths(spark):
    r, cigars = random.Random(8), ["20M", "2S20M3S", "5M3I5M", "4M0N4M", "7S9M", "9M7S", "0M8M", "6M0S"]
    chunk = bases(r, 5000)
    rows = []
    for i in range(300):
        left, plus, at = r.random() < 0.5, r.random() < 0.5, r.randint(100, 4000)
        near = chunk[at - 15 + 100 : at + 100] if left else chunk[at + 20 + 100 : at + 35 + 100]
        turn = near if plus else near.translate(TURN)[::-1]
        suffix, k = left == plus, r.randint(0, 15)
        own = bases(r, 15 - k) + turn[15 - k :] if suffix else turn[:k] + bases(r, 15 - k)
        read = "N" * r.choice([0, 0, 50]) + own + "N" * 30 if (strand := "+" if left == plus else "-") and left == plus else "N" * 30 + own + "N" * r.choice([0, 0, 50])
        mode = ("MS" if left else "SM") if (strand == "+") == plus else ("SM" if left else "MS")
        rows.append((i, strand, mode, len(read), read, 30, "chr1", at, at + 20, "+" if plus else "-", r.choice(cigars), 3))
    x = spark.createDataFrame(rows, "i long, strand string, mode string, q_len int, bases string, clip_len int, chrom string, hit_start long, hit_end long, hit_strand string, hit_cigar string, hit_nm int")
    genome = spark.createDataFrame([("chr1", 0, chunk)], "chrom string, chunk_no long, seq string")
    made = realign.clip_alignment(x, genome, most_shared=10)
    assert "array_max(" not in made._jdf.queryExecution().optimizedPlan().toString()
    got = {f.i: (f.sa_start, f.shared, f.sa_cigar) for f in made.collect()}
    want = {}
    for i, strand, mode, n, read, clip, _, start, end, hit_strand, cigar, _ in rows:
        outer, left = (strand == "+") == (mode == "MS"), (strand == hit_strand) == (mode == "MS")
        first = max(n - clip - 15, 0)
        own = read[first : n - clip] if outer else read[clip : clip + 15]
        ref = chunk[start - 15 + 100 : start + 100] if left else chunk[end + 100 : end + 115]
        ref = ref if hit_strand == "+" else ref.translate(TURN)[::-1]
        lengths = [k for k in range(1, min(len(ref), len(own)) + 1) if (ref[-k:] == own[-k:] if left == (hit_strand == "+") else ref[:k] == own[:k])]
        k = max(lengths, default=0) if left == (hit_strand == "+") or ref != own else 0
        k = k if re.search("^[0-9]+M" if left else "[0-9]+M$", cigar) else 0
        text = f"{n - clip - k}S{k}M{cigar}" if left else f"{cigar}{k}M{n - clip - k}S"
        ops = []
        for size, kind in re.findall(r"(\d+)([MIDNS])", text):
            if int(size) and ops and ops[-1][1] == kind:
                ops[-1] = (ops[-1][0] + int(size), kind)
            elif int(size):
                ops.append((int(size), kind))
        if k <= 10:
            want[i] = (start - k if left else start, k, "".join(f"{s}{o}" for s, o in ops))
    assert got == want and len({k for _, k, _ in want.values()}) > 5


def brute_blocks(queries: dict, contigs: dict, k: int, most: int) -> set:
    """Runs of shared seeds on diagonals, of queries, strands and contigs that have 20 and more."""
    places, found = {}, {}
    for c, text in contigs.items():
        for p in range(len(text) - k + 1):
            if set(text[p : p + k]) <= set("ACGT"):
                places.setdefault(text[p : p + k], []).append((c, p))
    for q, text in queries.items():
        for strand, t in (("+", text), ("-", text.translate(TURN)[::-1])):
            for i in range(len(t) - k + 1):
                at = places.get(t[i : i + k], [])
                for c, p in at if len(at) <= most else []:
                    found.setdefault((q, strand, c), []).append((p - i, i))
    out = set()
    for key, rows in found.items():
        runs = []
        for d, i in sorted(rows) if len(rows) >= 20 else []:
            if runs and runs[-1][0] == d and i - runs[-1][2] <= k:
                runs[-1][2:] = [i, runs[-1][3] + 1]
            else:
                runs.append([d, i, i, 1])
        out |= {(*key, a, b + k, a + d, b + k + d, n) for d, a, b, n in runs}
    return out


def test_seeds_of_texts_put_together_are_those_of_each():
    texts = ["ACGTTGCA", None, "", "ACG", "ACGTNACGTTT", "TTTTTTTT"]
    want = [(i, p, t[p : p + 4]) for i, t in enumerate(texts) for p in range(len(t or "") - 3) if "N" not in t[p : p + 4]]
    for step in (1, 3, 5, 100):
        for whole in (pa.array(texts), pa.array(["AC", *texts, "GT"]).slice(1, len(texts)), pa.array(texts, pa.large_string())):
            got = [(row[j], place[j], seed[j]) for _, seed, good, row, place in realign._windows(whole, 4, step) for j in good.nonzero()[0]]
            assert [(i, p, "".join("ACGT"[s >> 2 * b & 3] for b in (3, 2, 1, 0))) for i, p, s in got] == want


def test_blocks_are_all_shared_seeds_and_only_those_are_exchanged(spark, monkeypatch):
    rnd = random.Random(9)
    words = [bases(rnd, rnd.randint(3, 9)) for _ in range(60)]
    contigs = {i: "".join(rnd.choices(words, k=rnd.randint(1, 200))) for i in range(60)} | {60: "", 61: "ACGTNACGT" * 20, 62: None}
    queries = {i: (contigs[i % 60] * 5)[i % 7 : i % 7 + rnd.randint(10, 80)] for i in range(80)} | {90: None, 91: "", 92: "N" * 60}
    real = lambda x: {i: t for i, t in x.items() if t}
    for k, most, part in ((14, 64, 1 << 18), (11, 9, 50), (17, 5, 1000)):
        monkeypatch.setattr(realign, "PART", part)
        monkeypatch.setattr(realign, "BITS", 28 if k < 15 else 16)  # with few bits, others pass too
        want = brute_blocks(real(queries), real(contigs), k, most)
        kept, keep = {}, realign.stored
        with monkeypatch.context() as m:
            m.setattr(realign, "stored", lambda df, name="t", *a: kept.setdefault(name, keep(df, name, *a)))
            q, c = frames(spark, queries, contigs)
            got = [tuple(r) for r in realign.seed_blocks(q, c, k=k, most=most).select("query", "strand", "contig", "q0", "q1", "p0", "p1", "n").collect()]
        whole = {(r.query, r.strand) for r in kept["whole"].collect()}
        assert len(got) == len(set(got)) and {x for x in got if x[:2] not in whole} == {x for x in want if x[:2] not in whole} and len(want) > 30
        assert "there" not in kept and "asked" not in kept  # places of all seeds were once stored


def test_whole_queries_are_hits_without_an_exchange(spark):
    blocks = spark.createDataFrame([(1, "+", 3, 0, 60, p, p + 60, 47, True) for p in (5, 900, 40)], "query long, strand string, contig long, q0 int, q1 int, p0 int, p1 int, n int, alone boolean")
    made = chained(blocks)
    # The last branch of the union, after its last projection; each block was once put in order.
    assert "Window" not in made._jdf.queryExecution().optimizedPlan().toString().rsplit("Project", 1)[1]
    assert sorted(map(tuple, made.select("hit_start", "n_blocks", "score").collect())) == [(5, 1, 47), (40, 1, 47), (900, 1, 47)]
