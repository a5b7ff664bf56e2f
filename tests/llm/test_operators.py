"""Operators against brute force, and the cases that each must bear."""

import hashlib
import random
import re
import time
from collections import Counter
from zlib import crc32

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from segmentry.llm import toxicity
from segmentry.llm.ann import nearest
from segmentry.llm.html_extract import OPEN, PROTECTED, VETOED, main_text, marked_blocks
from segmentry.llm.mixing import mixed
from segmentry.llm.near_dup import near_duplicates
from segmentry.llm.packing import _encoder, fixed_by_dominance, least_sequences, pack_documents, packing_plan
from segmentry.llm.quality import discriminant, quality_scores, text_statistics
from segmentry.llm.queries import RANKS
from segmentry.llm.substring_dedup import remove_repeats
from segmentry.llm.topk import exact_top_k
from segmentry.llm.toxicity import LabelModel, toxicity_scores
from segmentry.llm.url_filter import url_verdicts

DOCS = "doc_id long, text string, source string, n_shingles int, id int, score int"
WORD = re.compile(rb"[^\x20\x09-\x0d]+")


def texts():
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choices("abcdeé", k=rnd.randint(2, 6)))
    base = [" ".join(word() for _ in range(rnd.randint(1, 90))) for _ in range(40)]
    out = []
    for i in range(160):
        w = rnd.choice(base).split()
        for _ in range(rnd.randint(0, max(1, len(w) // 8))):
            w[rnd.randrange(len(w))] = word()
        out.append(" ".join(w) + (" " + rnd.choice(base) if i % 3 == 0 else ""))
    return [*out, None, "", " \t\n", "one", "ONE", "two words", out[5], out[5], "x " * 30_000]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, f"s{i % 3}" if i % 7 else None, 0, 0, 0) for i, t in enumerate(texts())], DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_near_duplicates(docs, empty):
    sets = {}
    for i, t in enumerate(texts()):
        w = WORD.findall(re.sub(r"[A-Z]", lambda m: m[0].lower(), t or "").encode())
        sets[i] = set(zip(w, w[1:], strict=False)) if len(w) > 1 else {tuple(w)} - {()}
    part = {i: i for i in sets}
    changed = True
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            low = min(part[a], part[b])
            changed |= part[a] != low or part[b] != low
            part[a] = part[b] = low
    got = {r.doc_id: r for r in near_duplicates(docs, words=2).collect()}
    assert {i: (r.n_shingles, r.component_id, r.kept) for i, r in got.items()} == {i: (len(s), part[i], part[i] == i) for i, s in sets.items()}
    assert near_duplicates(empty).count() == 0


def test_remove_repeats(spark, docs, empty):
    words = [(t or "").encode().split() for t in texts()]
    first = {}
    for i, w in enumerate(words):
        for k in range(len(w) - 12):
            first.setdefault(tuple(w[k : k + 13]), i)
    got = {r.doc_id: r for r in remove_repeats(docs).collect()}
    for i, w in enumerate(words):
        gone = {j for k in range(len(w) - 12) if first[tuple(w[k : k + 13])] < i for j in range(k, k + 13)}
        assert (got[i].kept_text, got[i].n_words, got[i].n_removed) == (b" ".join(x for j, x in enumerate(w) if j not in gone).decode(), len(w), len(gone))
    assert remove_repeats(empty).count() == 0
    # A window that a document repeats, in turn and apart, before and after one that has it once.
    again = [(1, "a " * 40), (2, "b " + "a " * 200 + "c"), (3, " ".join(map(str, range(13))) + " x"), (4, (" ".join(map(str, range(13))) + " y ") * 5), (5, "a b " * 60), (6, "a b " * 40)]
    words, first = {i: t.split() for i, t in again}, {}
    for i, w in words.items():
        for k in range(len(w) - 12):
            first.setdefault(tuple(w[k : k + 13]), i)
    for r in remove_repeats(spark.createDataFrame(again, "doc_id long, text string")).collect():
        w = words[r.doc_id]
        gone = {j for k in range(len(w) - 12) if first[tuple(w[k : k + 13])] < r.doc_id for j in range(k, k + 13)}
        assert r.kept_text.split() == [x for j, x in enumerate(w) if j not in gone] and r.n_removed == len(gone)
    passage = " ".join(map(str, range(20)))
    lines = spark.createDataFrame([(1, passage), (2, f"a\n b\t{passage}\n\nc  d\n")], "doc_id long, text string")
    assert sorted(r.kept_text for r in remove_repeats(lines, spaced=True).collect()) == [passage, "a\n b\n\nc  d"][::1]
    long = " ".join(map(str, range(20)))
    same = spark.createDataFrame([(None, long), (None, long), (1, long), (1, long)], "doc_id long, text string")
    assert [r.n_removed for r in remove_repeats(same).collect()] == [0] * 4


def test_pack(spark, docs, empty):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    more = docs.unionByName(spark.createDataFrame([(900, "a<|endoftext|> b  c\n\n d", "s", 0, 0, 0)], DOCS))
    rows = more.collect()
    got = pack_documents(more, RANKS).toPandas().sort_values(["doc_id", "piece"])
    for r in rows:
        ids, at = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 0], 0
        for p in got[got.doc_id == r.doc_id].itertuples():
            assert p.start == at and p.length <= 2048 and (p.piece == 0 or p.length == 2048)
            assert p.ids_crc32 == crc32(np.array(ids[at : at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(ids)
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert list(s.offset) == [0, *np.cumsum(s.length)[:-1]] and s.length.sum() <= 2048
    assert pack_documents(empty, RANKS).count() == 0


@pytest.mark.parametrize("seed", range(30))
def test_plan_packs_everything(seed):
    rnd = random.Random(seed)
    counts = {rnd.randint(1, 50): rnd.randint(1, 9) for _ in range(rnd.randint(1, 12))}
    left = dict(counts)
    for kind, times in packing_plan(counts, 50):
        assert sum(kind) <= 50
        for n in kind:
            left[n] -= times
    assert not any(left.values())


def fewest(items, capacity):
    """Sequences of the best packing, by search."""
    items, best = sorted(items, reverse=True), [len(items)]

    def go(i, rooms):
        if len(rooms) < best[0]:
            if i == len(items):
                best[0] = len(rooms)
                return
            for room in {r for r in rooms if r >= items[i]}:
                at = rooms.index(room)
                go(i + 1, [*rooms[:at], room - items[i], *rooms[at + 1 :]])
            go(i + 1, [*rooms, capacity - items[i]])

    go(0, [])
    return best[0]


def test_plan_against_search():
    rnd = random.Random(2)
    worse = 0
    for _ in range(200):
        items = [rnd.randint(3, 60) for _ in range(9)]
        best, left = fewest(items, 100), dict(Counter(items))
        assert least_sequences(left, 100) <= best
        worse += sum(t for _, t in packing_plan(left, 100)) > best
        fixed = fixed_by_dominance(left, 100)
        assert sum(fixed.values()) + fewest([n for n, c in left.items() for _ in range(c)], 100) == best
    assert worse <= 2
    assert sum(t for _, t in packing_plan(Counter((24, 32, 37, 48, 27, 53, 38, 25, 5)), 100)) == 3


def test_long_white_space_is_encoded():
    from tokenizers import Tokenizer

    encode, tokenizer = _encoder(RANKS), Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for text in (" " * 9000 + "a", "b" + "\n" * 5000, "x" + "\n " * 4000 + "<|endoftext|>" + " " * 5000 + "<|endoftext|>\t" + "\u3000" * 5000 + "b", "\x1c" * 5000 + " " * 5000 + "\x1c"):
        assert np.array_equal(np.frombuffer(encode(text), "<u4"), tokenizer.encode(text, add_special_tokens=False).ids)
    assert len(encode(" " * 3_000_000)) == 12_000_000 and len(encode("\n" * 3_000_001)) > 0


def test_exact_top_k(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(300, 8)).round(2)
    v[7] = v[8]
    rows = [(i, [float(x) for x in v[i]]) for i in range(300)] + [(400, None), (450, [1.0] * 7 + [None]), (500, [float("nan")] * 8), (550, [])]
    got = exact_top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).toPandas()
    z = np.floor(256 * v).astype(int)
    assert set(got.query_id) == set(range(0, 300, 50))
    for q in range(0, 300, 50):
        s, ids = z @ z[q], np.arange(300)
        best = [i for i in ids[np.lexsort((ids, -s))] if i != q][:5]
        own = got[got.query_id == q].sort_values("rank")
        assert list(own.vec_id) == best and list(own.score) == list(s[best])
    assert exact_top_k(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


def test_exact_top_k_takes_every_finite_vector(spark):
    rng = random.Random(8)
    big = lambda: [rng.choice([5.0e6, -4.9e6, 4.2e6 + rng.random(), 0.0]) for _ in range(8)]
    rows = {i: big() for i in range(120)} | {150: [1e300, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.5]}
    rows |= {i: [0.0, *r[1:]] for i, r in rows.items() if i != 150}
    got = exact_top_k(spark.createDataFrame([(i, v, "x") for i, v in rows.items()], "vec_id long, embedding array<double>, cell string")).toPandas()
    whole = {i: [int(np.floor(256 * x)) for x in v] for i, v in rows.items()}
    whole[150][0] = int(1e300) * 256
    for q in (0, 50, 100, 150):
        best = sorted((-sum(a * b for a, b in zip(whole[q], whole[i], strict=True)), i) for i in whole if i != q)[:5]
        own = got[got.query_id == q].sort_values("rank")
        assert list(zip(own.score, own.vec_id, strict=True)) == [(-s, i) for s, i in best]
    wide = spark.createDataFrame([(50, [4e8] * 32), (51, [4e8] * 32), (52, [1.0] * 32)], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="fit a long"):
        exact_top_k(wide).collect()
    # The lowest score doesn't fit either, but isn't asked for.
    low = spark.createDataFrame([(50, [4e8] * 32), (51, [-4e8] * 32), *((60 + i, [1.0 + i] * 32) for i in range(5))], "vec_id long, embedding array<double>")
    assert [r.vec_id for r in exact_top_k(low).collect()] == [64, 63, 62, 61, 60]


def test_exact_top_k_skips_groups_but_no_result(spark):
    rng = np.random.default_rng(5)
    v = (rng.normal(size=(3000, 6)) + 20 * rng.normal(size=(9, 6))[rng.integers(0, 9, 3000)]).round(3)
    rows = [(i, [float(x) for x in v[i]]) for i in range(3000)] + [(50, [0.0] * 6)] * 2
    got = exact_top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).toPandas()
    z = np.floor(256 * v).astype(int)
    for q in range(0, 3000, 50):
        asks = min(v[q].tolist(), [0.0] * 6) if q == 50 else v[q].tolist()
        s = z @ np.floor(256 * np.array(asks)).astype(int)
        best = [i for i in np.lexsort((np.arange(3000), -s)) if i != q][:5]
        own = got[got.query_id == q].sort_values("rank")
        assert list(own.vec_id) == best and list(own.score) == list(s[best])


def test_nearest_returns_all_of_few(spark):
    rows = [(i, [float(i), 1.0], i) for i in range(8)]
    got = nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>, id int"), k=20).collect()
    assert [(r.query_id, r["rank"], r.vec_id) for r in sorted(got, key=lambda r: r["rank"])] == [(0, i, i) for i in range(1, 8)]


def test_nearest(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(1500, 8)) + 3 * rng.normal(size=(12, 8))[rng.integers(0, 12, 1500)]
    rows = [(i, [float(x) for x in v[i]]) for i in range(1500)] + [(2000, None), (2020, [0.0] * 8), (2040, [float("inf")] * 8), (2060, [1.0, 2.0])]
    got = nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).toPandas()
    hits = 0
    for q in range(0, 1500, 20):
        s = v @ v[q]
        s[q] = -np.inf
        own = got[got.query_id == q].sort_values("rank")
        assert len(own) == 20 and np.allclose(own.score, s[own.vec_id])
        hits += len(set(own.vec_id) & set(np.argsort(-s)[:20]))
    assert hits >= 0.9 * 20 * 75
    assert nearest(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


def test_mixed(docs, empty):
    got = mixed(docs).toPandas()
    assert set(got.doc_id) == set(range(docs.count()))
    assert not got.duplicated(["doc_id", "epoch"]).any()
    base = got[got.epoch == 0].groupby("source").n_tokens.sum()
    assert (got.groupby("source").n_tokens.sum() <= 2 * base + 60_000).all()
    assert mixed(empty).count() == 0
    assert mixed(docs, budget=1000).toPandas().n_tokens.sum() < got.n_tokens.sum()


def test_sources_without_words_are_spread_over_blocks(spark):
    rows = [(i, "a b c d" * 5, "s") for i in range(200)] + [(1000 + i, (None, "", " \n")[i % 3], "blank") for i in range(300)]
    got = mixed(spark.createDataFrame(rows, "doc_id long, text string, source string"), block_tokens=200).toPandas()
    blank = got[got.source == "blank"]
    assert sorted(blank.doc_id) == [1000 + i for i in range(300)] and set(blank.block) <= set(got[got.source == "s"].block)
    assert blank.groupby("block").size().max() < 60 and (got.groupby("block").position.max() == got.groupby("block").size()).all()


def test_main_text(spark):
    shared = "<p>Subscribe to our weekly letter now and get nine free gifts today</p>"
    pages = [(i, f"http://a.com/{i}", f"<div>{shared}<p>n{i} own words here</p></div>") for i in range(4)]
    pages += [(10, "http://b.com/", "<nav>menu</nav><article><h1>T &amp; x</h1><p>a\n b<div class='ad'>buy</div><p>c<br>d</article><footer>f</footer>"), (11, None, None), (12, "x", "")]
    got = {r.page_id: (r.text, r.n_chars) for r in main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == {i: (f"n{i} own words here", 17) for i in range(4)} | {10: ("T & x\na b\nc d", 13), 11: ("", 0), 12: ("", 0)}
    assert main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_marks():
    of = lambda page, mark=PROTECTED: [b for m, b in marked_blocks(page) if m == mark]
    assert of("<nav>never closed<article>x</article>") == ["x"]
    assert of('<article>a<article class="comment">c</article></article><div class="comments"><article>d</article></div><article>b') == ["a", "b"]
    assert of('<div class="no-sidebar"><article class="article-header">x <i>y</i></article></div>') == ["x y"]
    assert of('<div class="siteHeader">h</div><div id="cookie-notice">c</div><div class="page-header">t</div>', VETOED) == ["h", "c", "t"]
    assert of('<article>a</article><div class="related"><article>teaser</article></div>') == ["a"]
    assert of('<div class="menu"><article><div>a</div>b</article></div>c') == ["a", "b"] and of("<div class='menu'><p>x<div>y</div></div>z", OPEN) == ["z"]
    assert of("<p title='a > b' data-x=\"<\">x<!-- <p> --><script>'</p>'</script> y &lt;&nbsp;z", OPEN) == ["x y < z"]
    for piece in ("<a ", "<a<", "<!", "<script ", "<a x=\"", "<a '", "<div class='menu'>", "<article>", "</", "<p a=b=c\n"):
        began = time.time()
        marked_blocks(piece * (200_000 // len(piece)))
        assert time.time() - began < 2, piece


@pytest.mark.parametrize("depth", [1, 3, 63, 64, 1_000])
def test_depth_changes_no_mark(depth):
    of = lambda page: [b for m, b in marked_blocks(page) if m == PROTECTED]
    assert of("<main>" * depth + "<nav>Home About</nav><p>story one</p>") == ["story one"]
    assert of('<div class="ad">' * depth + "<article><p>the story</p></article>") == ["the story"]
    assert of("<article>" * depth + "a" + "</article>" * depth + "<div class='menu'>m</div>") == ["a"]
    assert of("<article><section class='comments'>" * depth + "c" + "</section></article>" * depth + "<article>b</article>") == ["b"]


def test_names_that_are_partly_unwanted_stay_in_an_article(spark):
    kept = '<p>a</p><p class="notice-board">The town board met.</p><div class="share-price">Shares rose.</div><section id="related-work"><p>We follow.</p></section><div class="ad-free">x</div><div class="header-image article">y</div>'
    page = f'<article>{kept}<div class="share-buttons">no</div><aside>no</aside><div role="search">no</div><div id="comments">no</div></article>'
    row = main_text(spark.createDataFrame([(1, "http://a.com", page)], "page_id long, url string, html string")).first()
    assert row.text == "a\nThe town board met.\nShares rose.\nWe follow.\nx\ny"
    assert [b for m, b in marked_blocks('<div class="ad-free">z</div><div class="header-image article">w</div>') if m == OPEN] == ["z", "w"]


def test_repeats_of_hosts(spark):
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choices("abcdefg", k=5))
    shared = [" ".join(word() for _ in range(rnd.randint(6, 14))) for _ in range(12)]
    block = lambda: rnd.choice(shared) if rnd.random() < 0.4 else " ".join(word() for _ in range(rnd.randint(1, 9)))
    pages = []
    for i in range(60):
        html = "".join(f"<{t}>{block()}</{t}>" for t in rnd.choices(("p", "div", "nav", "article", "li"), k=rnd.randint(0, 7)))
        pages.append((i // 2 if i < 8 else i, f"http://h{i % 4}.com/" if i % 9 else None, html))
    pages += [(None, "http://h0.com/", f"<p>{shared[0]}</p>"), (None, "http://h0.com/", None), (70, "http://h0.com/", f"<p>{shared[0]} tail</p>" + "<p>z</p>" * 20_000)]
    rows = spark.createDataFrame([(*p, i, "x") for i, p in enumerate(pages)], "page_id long, url string, html string, id int, host string")
    got = main_text(rows).collect()

    on: dict = {}
    streams = [[(m, b.split(" ")) for m, b in marked_blocks(h or "")] for _, _, h in pages]
    for (p, url, h), blocks in zip(pages, streams, strict=True):
        for articles in (False, True):
            words = [w for m, b in blocks if (m == PROTECTED) == articles for w in b]
            for k in range(len(words) - 7):
                on.setdefault((url, *words[k : k + 8]), set()).add((p, h) if p is None else p)
    wanted = []
    for (p, url, _), blocks in zip(pages, streams, strict=True):
        words = [w for m, b in blocks if m != PROTECTED for w in b]
        gone = {j for k in range(len(words) - 7) if len(on[(url, *words[k : k + 8])]) >= 3 for j in range(k, k + 8)}
        at, lines = 0, []
        for m, b in blocks:
            lines.append(" ".join(b) if m == PROTECTED else " ".join(w for j, w in enumerate(b, at) if j not in gone) if m == OPEN else "")
            at += len(b) * (m != PROTECTED)
        text = "\n".join(filter(None, lines))
        wanted.append((p, url, text, len(text), len(gone)))
    order = lambda x: sorted(x, key=str)
    assert order(tuple(r) for r in got) == order(wanted) and sum(w[4] for w in wanted) > 100


def test_marks_protect_or_veto_only(spark):
    shared = "subscribe to our weekly letter now and get nine free gifts today"
    story = "<article><p>this very story was posted on all pages of the host again</p></article>"
    pages = [(i, "http://a.com/", f"<div>{shared}</div>{story}<div>n{i} an open block of page {i}</div>") for i in range(3)]
    # Runs in unwanted containers and articles count for open blocks of other pages.
    pages += [(10, "http://b.com/", f"<div>{shared}</div><p>own</p>"), (11, "http://b.com/", f"<nav>{shared}</nav>"), (12, "http://b.com/", f"<article>{shared}</article>")]
    got = {r.page_id: r.text for r in main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    kept = "this very story was posted on all pages of the host again"
    assert got == {i: f"{kept}\nn{i} an open block of page {i}" for i in range(3)} | {10: "own", 11: "", 12: shared}


def test_url_verdicts(spark):
    urls = ["http://a.com/x", "https://WWW.example.com/en/1", "http://b.example.com/en/", "http://x.net/es/1?q", "http://x.net/de/", "net/es/", None, "", "http://net/fr/#t", "ftp://u.org"]
    pages = spark.createDataFrame([(i, u, 0) for i, u in enumerate(urls)], "page_id long, url string, id int")
    got = {r.page_id: (r.host, r.path, r.rule) for r in url_verdicts(pages).collect()}
    assert got[0] == ("a.com", "/x", "com/") and got[1] == ("www.example.com", "/en/1", "www.example.com/en/") and got[2][2] == "example.com/en/"
    assert got[3] == ("x.net", "/es/1", "net/es/") and got[4][2] is None and got[8][2] == "net/fr/"
    assert got[5] == got[6] == got[7] == ("", "", None) and got[9] == ("u.org", "", None)
    verdicts = {r.page_id: r.verdict for r in url_verdicts(pages).collect()}
    assert verdicts[0] == verdicts[1] == "allow" and verdicts[2] == verdicts[3] == "block" and set(verdicts.values()) == {"allow", "block"}
    assert url_verdicts(pages.where("false")).count() == 0


def test_url_scores_are_witten_bell(spark):
    rnd = random.Random(5)
    part = lambda: "".join(rnd.choices("abcde", k=6))
    urls = [f"http://{part()}.com/{part()}" for _ in range(25)] + [f"http://{part()}.net/es/{part()}" for _ in range(60)]
    urls += ["http://abc.org/new", "http://яяя", "http://zzqq.io/xyz/w", "", *(f"http://{part()}.org/" for _ in range(5))]
    got = {r.id: r.score for r in url_verdicts(spark.createDataFrame(list(enumerate(urls)), "id long, url string"), id_col="id").collect()}
    text = lambda u: u.split("://", 1)[-1]
    taught = [[text(u) for u in urls if mark in u and int(hashlib.md5(u.encode()).hexdigest()[:2], 16) % 5] for mark in (".com/", ".net/es/")]
    counts = []
    for own in taught:
        n = {}
        for u in own:
            s = "\2" * 4 + u + "\3"
            for i in range(4, len(s)):
                for k in range(5):
                    after = n.setdefault(s[i - k : i], {})
                    after[s[i]] = after.get(s[i], 0) + 1
        counts.append(n)
    v = len(set(counts[0][""]) | set(counts[1][""]))

    def prob(n, context, c):
        after = n.get(context, {})
        if not context:
            return (after.get(c, 0) + 1) / (sum(after.values()) + v)
        lower = prob(n, context[1:], c)
        return (after.get(c, 0) + len(after) * lower) / (sum(after.values()) + len(after)) if after else lower

    for i, u in enumerate(urls):
        if got[i] is not None:
            s = "\2" * 4 + text(u) + "\3"
            ratio = sum(np.log(prob(counts[0], s[j - 4 : j], s[j]) / prob(counts[1], s[j - 4 : j], s[j])) for j in range(4, len(s)))
            assert got[i] == pytest.approx(ratio / (len(text(u)) + 1), abs=1e-7), u


@pytest.mark.parametrize(("score", "label", "least"), [(quality_scores, "quality", 0.95), (toxicity_scores, "toxic", 0.8)])
def test_classifiers_hold_out(spark, score, label, least):
    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    got = score(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    assert len(got) and (got.predicted == got[label]).mean() >= least
    odd = spark.createDataFrame([(1, None), (2, ""), (2, " "), (None, "a")], "doc_id long, text string")
    assert score(odd, labels.where("false")).where("score between 0 and 1").count() == 4
    assert score(odd.where("false"), labels).count() == 0


def test_toxic_texts_are_found_and_clean_ones_left(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    got = toxicity_scores(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    assert got.predicted[got.toxic == 1].mean() >= 0.93 and got.toxic[got.predicted == 1].mean() >= 0.97


def test_label_model_doubts_labels_and_copies():
    rng = np.random.default_rng(3)
    truth = rng.random(6000) < 0.2
    speaks = lambda hit, false: rng.random(6000) < np.where(truth, hit, false)
    voters = [speaks(0.7, 0.02), speaks(0.6, 0.05), speaks(0.5, 0.03), speaks(0.6, 0.04)]
    copied = speaks(0.4, 0.1)
    labels = np.where(rng.random(6000) < 0.1, ~truth, truth).astype(float)
    model = LabelModel.fit(np.column_stack([*voters, *[copied] * 6]), labels)
    assert np.allclose(model.rates[:, -1], (0.1, 0.9), atol=0.04) and abs(model.share - 0.2) < 0.03
    assert np.allclose(model.weights, [1] * 4 + [1 / 6] * 6 + [1])
    assert np.allclose(model.rates[1][:4], (0.7, 0.6, 0.5, 0.6), atol=0.06)
    assert ((model.posterior(np.column_stack([*voters, *[copied] * 6]), labels) > 0.5) == truth).mean() > 0.97


def test_discriminant_against_numpy():
    rng = np.random.default_rng(4)
    x, y = rng.normal(size=(400, 5)) @ rng.normal(size=(5, 5)), rng.integers(0, 2, 400)
    x[y == 1] += 0.7
    own = [x[y == c] for c in (0, 1)]
    model = discriminant(np.array([len(o) for o in own]), np.array([o.sum(axis=0) for o in own]), np.array([o.T @ o for o in own]), shrink=0.2, ridge=0.02)
    pooled = np.cov(x.T, bias=True)
    logs = []
    for o in own:
        cov = 0.8 * np.cov(o.T, bias=True) + 0.1 * pooled + 0.12 * np.diag(np.diag(pooled))
        d = x - o.mean(axis=0)
        logs.append(np.log((len(o) + 1) / 402) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d))
    assert np.allclose(model.scores(x), 1 / (1 + np.exp(logs[0] - logs[1])))


def test_quality_of_whole_query_against_numpy(spark):
    folder = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    got = {r.doc_id: r for r in quality_scores(docs, labels).collect()}
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    x = {i: text_statistics(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0] for i, t in texts.items()}
    known = [(x[r.doc_id], r.quality) for r in labels.collect() if r.quality in (0, 1) and crc32(str(r.doc_id).encode()) % 4 != 2]
    own = [np.array([v for v, q in known if q == c]) for c in (0, 1)]
    model = discriminant(np.array([len(o) for o in own]), np.array([o.sum(axis=0) for o in own]), np.array([o.T @ o for o in own]))
    for i, r in got.items():
        assert r.score == pytest.approx(model.scores(x[i][None])[0], abs=1e-6) and r.predicted == int(r.score >= 0.7)


def test_toxicity_of_whole_query_against_plain_votes(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    split = re.compile(rb"[a-z\x80-\xff]+")
    words = {i: split.findall(re.sub(rb"[A-Z]", lambda m: m[0].lower(), t)) for i, t in texts.items()}
    told = {r.doc_id: r.toxic for r in labels.collect() if r.toxic in (0, 1) and crc32(str(r.doc_id).encode()) % 4 != 2}
    units = lambda w: [(0, w), *((k, w[:n]) for k, n in enumerate((4, 5, 6, 7, 8), 1) if len(w) >= n)]
    held, weight, total = Counter(), {0: Counter(), 1: Counter()}, Counter()
    for i, y in told.items():
        total[y] += len(words[i])
        for u, n in Counter(u for w in words[i] for u in units(w)).items():
            held[u] += y
            weight[y][u] += np.log2(1 + n)
    ratio = {u: ((weight[1][u] - weight[1][u] ** 0.5) / total[1]) / ((weight[0][u] + weight[0][u] ** 0.5 + 1) / total[0]) for u in held if held[u] >= 3}
    found = [(u, r) for u, r in ratio.items() if r >= toxicity.RATIOS[0]]
    band = lambda edges, x: sum(x >= e for e in edges) - 1
    seeds = {s.encode(): k for k, s in enumerate(sorted(toxicity.SEEDS, key=lambda s: int(toxicity.hash_words(np.frombuffer(s.encode(), np.uint8), np.array([0, len(s)]), toxicity._table())[0][0])))}
    voter = {(0, s): k for s, k in seeds.items()}
    odds = {(0, s): toxicity.SURE for s in seeds}
    for (kind, u), r in found:
        if u not in seeds or kind:
            voter[kind, u] = len(seeds) + (kind * len(toxicity.RATIOS) + band(toxicity.RATIOS, r)) * len(toxicity.HELD) + band(toxicity.HELD, held[kind, u])
            odds[kind, u] = r
    n = len(seeds) + 6 * len(toxicity.RATIOS) * len(toxicity.HELD)

    def votes(i: int) -> np.ndarray:
        hits = [[u for u in units(w) if u in voter] for w in words[i]]
        v = np.zeros(n)
        v[[voter[u] for h in hits for u in h]] = 1
        sure, likely = (sum(any(odds[u] >= least for u in h) for h in hits) for least in (toxicity.SURE, toxicity.LIKELY))
        return np.append(v, [(k := likely if wide else sure) >= least and k >= part * len(words[i]) for wide, least, part in toxicity.DENSITIES])

    known = np.array([votes(i) for i in told], np.float32)
    y = np.array(list(told.values()), float)
    weights, bias = toxicity.linear(known, LabelModel.fit(known, y).posterior(known, y))
    for r in toxicity_scores(docs, labels).collect():
        v = votes(r.doc_id)
        z = v @ weights[:-1] + bias + weights[-1] * v[:n].any()
        assert r.score == pytest.approx(1 / (1 + np.exp(-np.clip(z, -50, 50))), abs=1e-4), r.doc_id


def test_patterns_over_the_bound_raise_and_repeated_ids_stay_in_the_sample(spark):
    rows = [(i % 3, f"word{i % 5} same text idiot", i % 2) for i in range(400)]
    known = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    labels = spark.createDataFrame([(0, 1), (1, 0), (3, 1)], "doc_id long, toxic int")
    assert toxicity_scores(known, labels, sample=2).count() == 400
    many = spark.createDataFrame([(i, "bad worse worst" if i % 2 else "fine day") for i in range(60)], "doc_id long, text string")
    with pytest.raises(ValueError, match="more than driver and tasks may hold"):
        toxicity_scores(many, spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int"), most=1)


def test_toxic_words_are_counted_beyond_the_sample(spark):
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choices("bcdfgklmnprst", k=9))
    plain, bad = [word() for _ in range(200)], [word() for _ in range(40)]
    rows = [(i, " ".join([*rnd.choices(plain, k=30), *([bad[i // 3 % 40]] * 2 if i % 3 == 0 else [])]), int(i % 3 == 0)) for i in range(1200)]
    known = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    got = toxicity_scores(known.select("doc_id", "text"), known.select("doc_id", "toxic"), sample=60).join(known, "doc_id").toPandas()
    assert (got.predicted == got.toxic).mean() > 0.98


def test_held_out_rule(docs, spark):
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(50)], "doc_id long, quality int, toxic int")
    for r in quality_scores(docs, labels).collect():
        assert r.held_out == (crc32(str(r.doc_id).encode()) % 4 == 2)


def test_clashing_names_nulls_ties_and_long_texts(spark):
    long = "<p>never closed " + "long text idiot " * 60_000
    rows = [(None, None, None, None, 1), (20, None, "", [1.0, 2.0], 1), (20, "b idiot", "", [1.0, 2.0], 0), (40, long, "http://b.net/" + "z" * 90_000, [2.0, 1.0], 0), (60, "", "http://a.com/" + "x" * 50_000, [2.0, 1.0], None), (100, "y", "y", [-1.0, 0.5], 1)]
    wide = spark.createDataFrame([(*r, "x", "x", "x", 5, 5) for r in rows], "key long, body string, link string, v array<double>, mark int, id string, text string, url string, cell long, host long")
    labels = wide.selectExpr("key", "mark", "'x' as y", "'x' as text")
    for score in (quality_scores, toxicity_scores):
        got = score(wide, labels, id_col="key", text_col="body", label_col="mark").collect()
        assert sorted(str(r.key) for r in got) == sorted(str(r[0]) for r in rows) and all(0 <= r.score <= 1 for r in got)
    got = url_verdicts(wide, id_col="key", url_col="link").collect()
    assert sorted(str(r.key) for r in got) == sorted(str(r[0]) for r in rows) and all(r.verdict in ("allow", "block") for r in got)
    got = main_text(wide, id_col="key", url_col="link", html_col="body").collect()
    assert sorted(r.n_chars for r in got) == sorted([0, 0, 7, len("never closed " + "long text idiot " * 60_000) - 1, 0, 1])
    assert {(r.query_id, r.vec_id) for r in exact_top_k(wide, id_col="key", vector_col="v", every=20).collect()} == {(q, v) for q in (20, 40, 60, 100) for v in (20, 40, 60, 100) if q != v}
    assert {(r.query_id, r.vec_id) for r in nearest(wide, id_col="key", vector_col="v").collect()} == {(q, v) for q in (20, 40, 60, 100) for v in (20, 40, 60, 100) if q != v}
    assert mixed(wide, id_col="key", text_col="body", source_col="link").where("epoch = 0").count() == 6
    assert pack_documents(wide, RANKS, id_col="key", text_col="body").where("piece = 0").count() == 6
    assert near_duplicates(wide, id_col="key", text_col="body").count() == 6 and remove_repeats(wide, id_col="key", text_col="body").count() == 6


def test_texts_of_one_id_whose_short_fingerprints_agree(spark):
    # 16 bits of their hashes are equal, which used to mix up their places
    rows = [(1, " ".join(f"w{i}" for i in range(60))), (5, " ".join(f"w{i}" for i in range(60))), (5, "short 58789"), *((7, f"short {i}") for i in range(300))]
    got = remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed) for r in got) == sorted([(1, 60, 0), (5, 60, 60), (5, 2, 0), *((7, 2, 0) for _ in range(300))])


def test_digest(docs):
    row = remove_repeats(docs).where("doc_id = 3").select("kept_text", F.sha2(F.col("kept_text").cast("binary"), 256).alias("h")).first()
    assert row.h == hashlib.sha256(row.kept_text.encode()).hexdigest()
