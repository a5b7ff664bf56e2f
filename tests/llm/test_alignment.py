"""Two tokenizers aligned, against a token by token version and the tokenizers themselves."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import types as T
from tokenizers import Tokenizer

from segmentry.llm.alignment import byte_level, pieces, segments, shared_cuts, tokenizer_alignment
from segmentry.llm.queries import PIECES, RANKS

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("pair", T.StringType())])


def plain(rows: list[tuple]) -> list[tuple]:
    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    own.encode_special_tokens = True
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    byte_of = {}
    shift = 0
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            byte_of[chr(b)] = b
        else:
            byte_of[chr(256 + shift)] = b
            shift += 1

    def tokens(text: str):
        a = own.encode(" " + text, add_special_tokens=False).ids
        b = model.encode(text)
        a_bytes = [bytes(byte_of[c] for c in own.id_to_token(i)) for i in a]
        b_bytes = [bytes([int(model.IdToPiece(i)[3:5], 16)]) if model.IsByte(i) else model.IdToPiece(i).replace("▁", " ").encode() for i in b]
        goal = (" " + text).encode()
        return (a, a_bytes, b, b_bytes) if b"".join(a_bytes) == goal == b"".join(b_bytes) else ([], [], [], [])

    read, counts = [], Counter()
    for _, text, *_ in rows:
        a, a_bytes, b, b_bytes = tokens(text) if text else ([], [], [], [])
        ends_a, ends_b = np.cumsum([len(x) for x in a_bytes]).tolist(), np.cumsum([len(x) for x in b_bytes]).tolist()
        links = [(x, y) for x, e, n in zip(a, ends_a, map(len, a_bytes), strict=True) for y, f, m in zip(b, ends_b, map(len, b_bytes), strict=True) if e - n < f and f - m < e]
        groups = []
        for cut in sorted(set(ends_a) & set(ends_b)):
            before = max([c for c in set(ends_a) & set(ends_b) if c < cut], default=0)
            groups.append(",".join(str(x) for x, e in zip(a, ends_a, strict=True) if before < e <= cut) + "|" + ",".join(str(y) for y, e in zip(b, ends_b, strict=True) if before < e <= cut))
        counts.update(links)
        read.append((len(a), len(b), groups, links))
    best = Counter()
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    return [
        (doc, n_a, n_b, len(groups), len(links), sum(counts[p] == best[p[1]] for p in links), sum(counts[p] for p in links), hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "")
        for (doc, *_), (n_a, n_b, groups, links) in zip(rows, read, strict=True)
    ]


TEXTS = [
    "The cat sat on the mat.", "", None, "a", " ", "  two  spaces ", "tab\tand\nline\r\n\n end \n", "<|endoftext|> <s> </s> <unk> <0x41> is plain", "naïve café über straße", "日本語のテキスト",
    "emoji 👩‍👩‍👧 and 𝔘𝔫𝔦", "the ▁ mark", "x" * 300, "word " * 500, "the the the", " nbsp x y", "é combining ﬁ ligature", "1234567 8,900.5 %%% ###", "don't we'll I'm", "　full width　space", "a\u0000b null",
    " leading", "trailing ", "line\n next", "é è à", "the cat sat", "The cat sat on the mat.",
]


def test_whole_rows_equal_brute_force(spark):
    rows = [(i, t, "extra") for i, t in enumerate(TEXTS)] + [(3, "other text of id 3", None), (None, "no id here", None)]
    out = tokenizer_alignment(spark.createDataFrame(rows, SCHEMA).repartition(3), RANKS, PIECES)
    assert out.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, out.collect()), key=key) == sorted(plain(rows), key=key)


def test_blocks_and_counts_over_documents(spark, monkeypatch):
    import segmentry.llm.alignment as alignment

    monkeypatch.setattr(alignment, "BLOCK_LINKS", 50)
    rows = [(i, " ".join(["copy of the same line", f"and number {i % 7}", "naïve"][: 1 + i % 3]), None) for i in range(120)]
    out = tokenizer_alignment(spark.createDataFrame(rows, SCHEMA).repartition(5), RANKS, PIECES)
    assert sorted(map(tuple, out.collect())) == sorted(plain(rows))


def test_empty_table(spark):
    assert tokenizer_alignment(spark.createDataFrame([], SCHEMA), RANKS, PIECES).collect() == []


def test_very_long_text(spark):
    rng = np.random.default_rng(5)
    text = " ".join("".join(rng.choice(list("abcdeéß\n"), rng.integers(1, 9))) for _ in range(200_000))
    row = tokenizer_alignment(spark.createDataFrame([(1, text, None), (2, "short", None)], SCHEMA), RANKS, PIECES).where("doc_id = 1").first()
    a, b = byte_level(RANKS), pieces(PIECES)
    whole = [np.cumsum(t.lengths[np.array(t.encode(text))]) for t in (a, b)]
    assert (row.n_a, row.n_b, row.n_groups) == (whole[0].size, whole[1].size, np.intersect1d(*whole).size)


@pytest.mark.parametrize("seed", range(20))
def test_segments_have_the_tokens_of_their_text(seed):
    rng = np.random.default_rng(seed)
    signs = list("abAB  \n\t.,'1é▁ 日👩<|>")
    texts = ["".join(rng.choice(signs, rng.integers(1, 60))) for _ in range(200)]
    for t in (byte_level(RANKS), pieces(PIECES)):
        for text in texts:
            data = np.frombuffer((" " + text).encode(), np.uint8)
            starts, _ = segments(data, np.array([0, data.size]))
            parts = [data[i:j].tobytes().decode() for i, j in zip(starts, [*starts[1:], data.size], strict=True)]
            assert [i for p in parts for i in t.encode(p[1:])] == t.encode(text)


@pytest.mark.parametrize("seed", range(30))
def test_cuts_are_all_common_ends(seed):
    rng = np.random.default_rng(seed)
    a, b, sizes_a, sizes_b, base = [], [], [], [], 0
    for _ in range(40):
        n = int(rng.integers(0, 400))
        density = rng.random(2) ** 3
        ends = [np.append(np.flatnonzero(rng.random(max(n - 1, 0)) < d) + 1, n)[: n + 1] if n else np.zeros(0, np.int64) for d in density]
        for out, sizes, e in ((a, sizes_a, ends[0]), (b, sizes_b, ends[1])):
            out.append(e + base)
            sizes.append(e.size)
        base += n
    a, b = np.concatenate(a).astype(np.int64), np.concatenate(b).astype(np.int64)
    cut, cut_b = shared_cuts(a, b, np.array(sizes_a), np.array(sizes_b))
    assert np.array_equal(cut, np.isin(a, b)) and np.array_equal(cut_b, np.isin(b, a))
