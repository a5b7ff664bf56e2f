"""The trie of conversation prefixes against a dictionary of prefixes, DuckDB, and its own arrays."""

import hashlib
import random
from zlib import crc32

import duckdb
import numpy as np
import pandas as pd
import pytest

import segmentry.llm.prefix_trie as trie
from segmentry.llm.queries import ORACLES, QUERIES

SCHEMA = "conv_id long, turn long, role string, text string, depth string, path int"


def plain(rows: list[tuple]) -> list[tuple]:
    own: dict[int, list] = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    digest = lambda r, t: hashlib.sha256(f"{len(r.encode())}:{r}{t}".encode()).digest()
    for x in own.values():
        x.sort(key=lambda y: (y[0], y[1], y[2], digest(y[2], y[3])))
    seqs = {}
    for c, x in own.items():
        h = crc32(str(c).encode()) % 9
        seqs[c] = tuple((r, t) for *_, r, t in own.get(c - c % 5, [])[:h] + x[h:])
    members: dict[tuple, list[int]] = {}
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members.setdefault(s[:d], []).append(c)
    out = []
    for p, m in members.items():
        under = [q for q in members if q[: len(p)] == p]
        leaf = [q for q in under if not any(len(o) == len(q) + 1 and o[:-1] == q for o in under)]
        ends = ",".join(map(str, sorted(c for c in m if len(seqs[c]) == len(p))))
        saved = sum((len(members[q]) - 1) * len(q[-1][1].encode()) for q in under if q)
        kids = sum(len(q) == len(p) + 1 for q in under)
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids, len(leaf), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def made(seed: int, n: int = 60, words: int = 2) -> list[tuple]:
    rnd = random.Random(seed)
    rows = []
    for c in range(n):
        if rnd.random() < 0.15:
            continue
        for turn in range(rnd.choice((1, 2, 3, 9, 12))):
            rows.append((c, turn if rnd.random() > 0.05 else None, rnd.choice(("user", "assistant", None)), rnd.choice(("é" * 3, "", None, *(f"w{i}" for i in range(words)))), "x", 1))
    for c in (2_000, 2_005, 2_010, 2_015, 2_020, 2_001):  # copies, and one more turn
        rows += [(c, t, "user", f"copy {t}", "x", 1) for t in range(9 + (c == 2_020))]
    return [*rows, (None, 0, "user", "no conversation", "x", 1), rows[0], (-3, 0, "user", "negative", "x", 1), (-5, 0, None, None, "x", 1)]


@pytest.mark.parametrize("block", [1, 3, 20, 400_000])
@pytest.mark.parametrize("seed", [1, 2])
def test_whole_rows_equal_brute_force(spark, monkeypatch, block, seed):
    monkeypatch.setattr(trie, "BLOCK_TURNS", block)
    rows = made(seed)
    out = trie.prefix_trie(spark.createDataFrame(rows, SCHEMA).repartition(5))
    assert out.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted(map(tuple, out.collect()), key=str) == plain(rows)


def test_turnless_and_empty(spark):
    rows = [(6, 0, "user", "alone", "x", 1)]  # its family has no first conversation
    assert sorted(map(tuple, trie.prefix_trie(spark.createDataFrame(rows, SCHEMA)).collect()), key=str) == plain(rows)
    assert trie.prefix_trie(spark.createDataFrame([], SCHEMA)).collect() == []


def test_many_copies_of_one_conversation_and_a_long_one(spark):
    rows = [(5 * c, t, "user", f"turn {t}", "x", 1) for c in range(3_000) for t in range(2)] + [(50_000, t, "user", f"long {t % 7}", "x", 1) for t in range(1_500)]
    out = {(r.depth, r.conv_id): r for r in trie.prefix_trie(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert out[2, 0].n_convs == 3_000 and out[2, 0].ends_sha256 == hashlib.sha256(",".join(str(5 * c) for c in range(3_000)).encode()).hexdigest()
    assert out[0, 0].n_convs == 3_001 and out[0, 0].n_leaves == 2 and len(out) == 1 + 2 + 1_500
    assert out[1, 0].saved_tokens == 2 * 2_999 * len("turn 0")


@pytest.mark.parametrize("seed", range(20))
def test_double_array_holds_exactly_its_prefixes(seed):
    rng = np.random.default_rng(seed)
    seqs = sorted({tuple(rng.integers(0, rng.choice([2, 5, 300]), rng.integers(0, 8)).tolist()) for _ in range(300)})
    lengths = np.array([len(s) for s in seqs])
    keys = np.array([f"{x:016d}" for s in seqs for x in s], "S16").view("V16") if lengths.sum() else np.zeros(0, "V16")
    codes = trie.dense(keys, lengths)
    made_trie = trie.packed(codes, lengths)
    start, found = np.cumsum(lengths) - lengths, {}
    for i, s in enumerate(seqs):
        state = 0
        for d in range(len(s)):
            to = int(made_trie.base[state] + codes[start[i] + d])
            assert made_trie.check[to] == state
            state = to
            assert found.setdefault(state, s[: d + 1]) == s[: d + 1]
    assert len(found) == int((made_trie.check >= 0).sum()) == len({s[:d] for s in seqs for d in range(1, len(s) + 1)})
    assert made_trie.top < 4 * len(found) + 400


def test_query_equals_sql(spark):
    data = "/root/testdata/sf0.001"
    ours = QUERIES["op12_prefix_trie"](spark, data).toPandas()
    c = duckdb.connect()
    c.execute(f"create view conversations as select * from '{data}/conversations.parquet'")
    theirs = c.execute(ORACLES["op12_prefix_trie"]).df()
    order = ["depth", "conv_id"]
    pd.testing.assert_frame_equal(ours.sort_values(order).reset_index(drop=True), theirs[ours.columns].sort_values(order).reset_index(drop=True), check_dtype=False)
