"""Language models against a plain Witten-Bell, mixtures against known proportions and a grid, the query by held-out accuracy."""

import math
import re
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest

import segmentry.llm.language_id as lid
from segmentry.llm.queries import QUERIES
from segmentry.llm.wordhash import text_blocks

SCHEMA = "doc_id long, text string, lang string, score string, held_out int"
WORDS = re.compile(rb"[a-zA-Z\x80-\xff]+")


def triples(text: str) -> list[list[tuple]]:
    return [[tuple(w[i : i + 3]) for i in range(len(w) - 2)] for w in ([None, None, *m.lower(), None] for m in WORDS.findall(text.encode()))]


def read(texts: list) -> tuple:
    ((_, _, data, offs),) = text_blocks(pa.array(texts, pa.string()))
    return lid.trigrams(data, offs)


def decoded(code: int) -> tuple:
    back = [None, *range(97, 123), *range(128, 256)]
    return back[code // 155**2], back[code // 155 % 155], back[code % 155]


TEXTS = ["The cat's mat", None, "", " -- 12 ", "élan ÉTÉ x", "a", "ab ab", "日本"]


def test_trigrams_are_those_of_the_words():
    codes, sizes, words = read(TEXTS)
    want = [w for t in TEXTS for w in triples(t or "")]
    assert words.tolist() == [len(triples(t or "")) for t in TEXTS]
    at = np.split(codes, np.cumsum(sizes)[:-1])
    assert [[decoded(c) for c in x] for x in at] == want


def test_model_is_witten_bell():
    by_lang = {"x": ["the cat sat on the mat", "a cat"], "y": ["le chat été là", "la carte"]}
    counts = defaultdict(Counter)
    for lang, texts in by_lang.items():
        counts[lang].update(int(c) for c in read(texts)[0])
    codes = np.array(sorted(set().union(*counts.values())))
    n = np.array([[counts[k][c] for k in by_lang] for c in codes.tolist()], float)
    model = lid.Model.fit(list(by_lang), codes, n, np.array([2.0, 2.0]))
    place = np.full(155**3, -1)
    place[codes] = np.arange(codes.size)
    probe = "the carte zoo été cat"
    code, sizes, _ = read([probe])
    got = model.words(code, sizes, place)
    for j, lang in enumerate(by_lang):
        grams = Counter({decoded(c): k for c, k in counts[lang].items()})

        def p(gram: tuple, grams=grams) -> float:
            if not gram:
                return 1 / 155
            same = Counter()
            for g, k in grams.items():
                if g[3 - len(gram) : 2] == gram[:-1]:
                    same[g[2]] += k
            held, kinds = sum(same.values()), len(same)
            if not held:
                return p(gram[1:])
            return (same[gram[-1]] + kinds * p(gram[1:])) / (held + kinds)

        want = [sum(math.log(p(g)) for g in w) for w in triples(probe)]
        assert got[:, j] == pytest.approx(want, abs=1e-4)


def test_mixture_of_two_is_the_best_of_a_grid():
    rng = np.random.default_rng(1)
    words, kind = [400, 300, 5, 250], [0.7, 0.0, 1.0, 0.4]
    ll = np.concatenate([np.where((rng.random(n) < k)[:, None] == np.array([True, False, False]), -5.0, -9.0) + rng.normal(0, 0.7, (n, 3)) for n, k in zip(words, kind, strict=True)])
    ll[400:700] = rng.normal(-9, 0.7, (300, 3))
    ll[400:700, 1] += 4
    ll[705 : 705 + 100, 0] += 4
    share, posterior = lid.mixtures(ll, np.array(words), np.log(np.ones(3) / 3), per_word=0.03)
    assert (share[1] > 0).tolist() == [False, True, False] and posterior[1, 1] > 0.999
    assert share.sum(axis=1) == pytest.approx(1)
    p = np.exp(ll[:400])
    grid = [(np.log(p @ np.array([a / 50, b / 50, 1 - (a + b) / 50])).sum(), a / 50, b / 50) for a in range(51) for b in range(51 - a)]
    best = max(grid)
    assert share[0, 0] == pytest.approx(best[1], abs=0.04)


def test_a_text_is_judged_alike_whatever_stands_beside_it():
    rng = np.random.default_rng(8)
    words = rng.integers(1, 80, 60)
    ll = rng.normal(-9, 2, (int(words.sum()), 4))
    prior, start = np.log(np.ones(4) / 4), np.cumsum(words) - words
    share, posterior = lid.mixtures(ll, words, prior)
    for i, (a, n) in enumerate(zip(start, words, strict=True)):
        alone = lid.mixtures(ll[a : a + n], np.array([n]), prior)
        assert np.allclose(alone[0][0], share[i], atol=1e-9) and np.allclose(alone[1][0], posterior[i], atol=1e-9)


def test_cases_that_must_be_borne(spark):
    en, fr = "the house and the garden with of this that", "la maison et le jardin avec de cette une où été"
    rows = [(i, en if i % 2 else fr, "en" if i % 2 else "fr", "x", 1) for i in range(40)]
    rows += [(100, None, "en", "x", 1), (101, "", "fr", "x", 1), (102, " 12 %% 👩", "en", "x", 1), (None, en, "fr", "x", 1), (103, f"{en} " * 20_000, None, "x", 1), (104, f"{en} " * 30 + f"{fr} " * 10, None, "x", 1)]
    rows += [(5, fr, "xx", "x", 1) for _ in range(2) if crc32(b"5") % 5 == 0] + [(105, "Жук", None, "x", 1)]
    out = lid.languages(spark.createDataFrame(rows, SCHEMA).repartition(3))
    assert out.columns == ["doc_id", "held_out", "lang_pred", "score", "mixture"]
    got = out.collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r for r in got}
    for i in range(40):
        assert by[i].lang_pred == ("en" if i % 2 else "fr") and by[i].held_out == (crc32(str(i).encode()) % 5 == 0)
    assert [by[i].lang_pred for i in (100, 101, 102)] == ["und"] * 3 and by[None].lang_pred == "en" and not by[None].held_out
    assert by[103].lang_pred == "en" and by[105].lang_pred in ("en", "fr")
    assert [m.lang for m in by[104].mixture] == ["en", "fr"] and by[104].mixture[0].share == pytest.approx(270 / 380, abs=0.05)
    nothing = spark.createDataFrame(rows[:5], SCHEMA).selectExpr("doc_id", "text", "cast(null as string) as lang")
    assert {(r.lang_pred, r.score) for r in lid.languages(nothing).collect()} == {("und", 0.0)}
    assert lid.languages(spark.createDataFrame([], SCHEMA)).collect() == []
    with pytest.raises(ValueError, match="more than the driver may hold"):
        lid.languages(spark.createDataFrame(rows, SCHEMA), most_cells=10)


def test_query_by_held_out_rows(spark):
    data = "/root/testdata/sf0.01"
    told = {r.doc_id: r.lang for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "lang").collect()}
    rows = [r for r in QUERIES["op13_languages"](spark, data).collect() if r.held_out]
    right = sum(r.lang_pred == told[r.doc_id] for r in rows)
    assert len(rows) > 150 and right >= 0.99 * len(rows)
