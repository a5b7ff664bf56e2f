"""The pipeline's stages against brute force, on rows with null and repeated ids."""

import random
import re
from collections import Counter

import duckdb
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from segmentry.llm.quality import quality_scores
from segmentry.llm.queries import ORACLES


def test_null_and_repeated_ids(spark, tmp_path):
    given = "/root/testdata/sf0.001"
    labels = spark.read.parquet(f"{given}/labels.parquet")
    rows = [tuple(r) for r in spark.read.parquet(f"{given}/documents.parquet").select(*corpus_pipeline.COLUMNS).collect()]
    # Nameless copies, an id of three other texts, an id of exact copies.
    rows += [(None, *r[1:]) for r in rows[:40]] + [(7, *r[1:]) for r in rows[40:80]] + rows[80:120]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    # Nulls stand last.
    by = lambda r: (r.doc_id is None, r.doc_id or 0)

    got = corpus_pipeline.stored(corpus_pipeline.quality(spark, docs, tmp_path), "quality")
    accepted = quality_scores(docs, labels).where("predicted = 1").collect()
    assert any(r.doc_id is None for r in accepted)
    assert Counter(r.doc_id for r in got.collect()) == Counter(r.doc_id for r in accepted)

    texts = sorted(got.collect(), key=lambda r: (*by(r), r.row))
    grams = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}
    sets = [grams([w.lower() if w.isascii() else "".join(c.lower() if c.isascii() else c for c in w) for w in r.text.split()]) for r in texts]
    part = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                low, high = sorted((part[i], part[j]))
                part = [low if p == high else p for p in part]
    got = corpus_pipeline.stored(corpus_pipeline.near_dedup(spark, got, tmp_path), "near")
    assert sorted(r.row for r in got.collect()) == sorted(r.row for i, r in enumerate(texts) if part[i] == i)

    repeated = docs.where("text is not null and length(text) > 0").limit(60)
    repeated = corpus_pipeline.stored(corpus_pipeline.keyed(repeated.unionByName(repeated)), "twice")
    cut = corpus_pipeline.substring_dedup(spark, repeated, tmp_path).collect()
    assert len({r.row for r in cut}) == len(cut) <= repeated.count()

    uses = Counter(r.row for r in corpus_pipeline.mix(spark, repeated, tmp_path).collect())
    assert set(uses) == {r.row for r in repeated.collect()} and max(uses.values()) <= 3

    out = corpus_pipeline.run(spark, str(tmp_path)).where("piece = 0")
    assert set(r.doc_id for r in out.collect()) <= {r[0] for r in rows} and out.count() >= got.where("length(text) > 0").count() * 0.5


def some_rows(spark):
    """Rows with a key: repeated passages, nulls, blank and long texts, ids that repeat."""
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choices("abcdeé", k=rnd.randint(2, 6)))
    shared = [" ".join(word() for _ in range(rnd.randint(48, 90))) for _ in range(6)]
    part = lambda: rnd.choice(shared) if rnd.random() < 0.5 else "\n ".join(word() for _ in range(rnd.randint(1, 70)))
    rows = [(i if i % 9 else None, "  \t".join(part() for _ in range(rnd.randint(1, 4))), "en", f"s{i % 3 + (i % 3 == 0) * (i % 2)}", 0) for i in range(60)]
    rows += [(7, None, "en", "s1", 0), (8, "", None, None, 0), (9, " \n", "en", "s0", 0), (7, shared[0], "de", "s1", 0), (10, "x " * 9_000, "en", "s2", 0)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return corpus_pipeline.stored(corpus_pipeline.keyed(frame), "some")


def test_substring_dedup_stage(spark):
    docs = some_rows(spark)
    given = {r.row: r.text for r in docs.collect()}
    words = {row: re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode()) for row, text in given.items()}
    starts: dict = {}
    for row in sorted(words):
        for i in range(len(words[row]) - 49):
            starts.setdefault(tuple(words[row][i : i + 50]), row)
    want = {}
    for row, own in words.items():
        gone = set()
        for i in range(len(own) - 49):
            if starts[tuple(own[i : i + 50])] < row:
                gone |= set(range(i, i + 50))
        spaced = re.findall(rb"[\x20\x09-\x0d]*[^\x20\x09-\x0d]+", (given[row] or "").encode())
        left = b"".join(w for i, w in enumerate(spaced) if i not in gone).lstrip().decode()
        if not gone or left:
            want[row] = left if gone else given[row]
    got = corpus_pipeline.substring_dedup(spark, docs, None).collect()
    assert {r.row: r.text for r in got} == want and len(got) == len(want) < len(given)
    assert all(r.n_chars == (len(r.text) if r.text is not None else None) for r in got)


def test_mix_stage(spark):
    docs = some_rows(spark)
    c = duckdb.connect()
    c.register("documents", docs.selectExpr("row as doc_id", "text", "source").toPandas())
    want = Counter(row for row, *_ in c.execute(ORACLES["op4_mix_sources"]).fetchall())
    got = corpus_pipeline.mix(spark, docs, None).collect()
    assert Counter(r.row for r in got) == want and {r.row: r.text for r in got} == {r.row: r.text for r in docs.collect()}


def test_pack_stage(spark):
    docs = some_rows(spark)
    tokens = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    given = docs.collect()
    lengths = Counter((r.doc_id, len(tokens.encode(r.text or "", add_special_tokens=False).ids) + 1) for r in given)
    got = corpus_pipeline.pack(spark, docs, None).collect()
    # A document's pieces follow each other; documents of one id are told apart by where a first piece begins.
    assert sum(r.length for r in got) == sum(n * k for (_, n), k in lengths.items()) and sum(r.piece == 0 for r in got) == len(given)
    assert Counter(r.doc_id for r in got if r.piece == 0) == Counter(r.doc_id for r in given)
    assert sorted(r.length for r in got) == sorted(x for (_, n), k in lengths.items() for x in ([(n - 1) % 2048 + 1] + [2048] * ((n - 1) // 2048)) * k)
    by: dict = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in by.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(by) == -(-sum(r.length for r in got) // 2048)


def test_quality_stage(spark):
    docs = some_rows(spark)
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    folder = corpus_pipeline.stored(labels, "labels").inputFiles()[0].rsplit("/", 1)[0]
    linked = f"{folder}-dir"
    labels.write.parquet(f"{linked}/labels.parquet")
    scored = {r.row: r for r in quality_scores(docs, labels, row_col="row").collect()}
    got = corpus_pipeline.quality(spark, docs, linked).collect()
    assert {r.row for r in got} == {row for row, r in scored.items() if r.score >= 0.7} and len({r.row for r in got}) == len(got)
    assert corpus_pipeline.quality(spark, docs.limit(0), linked).collect() == []
