"""Near-duplicate documents: fast similarity sketches, banding, exact verification.

A document's set holds the hashes of its distinct word shingles. Its sketch has
``bands * rows`` coordinates, filled in rounds: in round i < t an element's hash puts
it into one bin, in round t + i all elements go into bin i, and the smallest hash
of the first round that reaches a bin is kept; so every coordinate fills. Equal
bands make buckets. Links are confirmed on the full sets.

No bucket is expanded into all pairs. Documents of equal sets are one class. In each
bucket the members are first compared with its smallest document; then those that
still lie outside its largest component are compared with all its members of other
components, in blocks, which finds what links the first round can't show.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segmentry.llm.wordhash import byte_values, gram_hashes, hash_words, mix, text_blocks, within_rows
from segmentry.operators.components import connected_components
from segmentry.shared import stored

_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_sets(column: pa.Array, words: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first row, sorted distinct shingle hashes of each row from there)."""
    table = byte_values(lower=True)
    for lo, hi, data, offs in text_blocks(column):
        h, counts = hash_words(data, offs, table)[:2]
        at, grams = within_rows(counts, words), gram_hashes(h, words)
        grams = grams[at] if grams.size else grams
        edge = np.concatenate(([0], np.cumsum(np.maximum(counts - words + 1, 0))))
        begin = np.concatenate(([0], np.cumsum(counts)))
        sets = []
        for i in range(hi - lo):
            if 0 < counts[i] < words:
                sets.append(gram_hashes(h[begin[i] : begin[i + 1]], int(counts[i])))
            else:
                sets.append(np.unique(grams[edge[i] : edge[i + 1]]))
        yield lo, sets


def sketches(sets: list[np.ndarray], t: int) -> np.ndarray:
    """One row of t coordinates for each set, none empty."""
    out = np.zeros((len(sets), t), np.uint64)
    filled = np.zeros((len(sets), t), bool)
    sizes = np.array([s.size for s in sets])
    elements, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    for i in range(2 * t):
        h = mix(elements + np.uint64(0x9E3779B97F4A7C15 * (i + 1) & 0xFFFFFFFFFFFFFFFF))
        bins = ((h >> np.uint64(32)) * np.uint64(t) >> np.uint64(32)).astype(np.int64) if i < t else np.full(h.size, i - t)
        low = np.full(out.size, _FULL)
        np.minimum.at(low, row * t + bins, mix(h))
        new = (low.reshape(out.shape) != _FULL) & ~filled
        out[new] = mix(low.reshape(out.shape)[new] + np.uint64(i))
        filled |= new
        open_rows = ~filled.all(axis=1)
        if not open_rows.any():
            break
        if not open_rows[row].all():
            keep = open_rows[row]
            elements, row = elements[keep], row[keep]
    return out


def signatures(docs: DataFrame, words: int, bands: int, rows: int, id_col: str, text_col: str) -> DataFrame:
    """One row per document: a hash of the text, set size, 128-bit digest of the set, band hashes (null for an empty set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, sets in shingle_sets(batch.column(1), words):
                full = [i for i, s in enumerate(sets) if s.size]
                band: list = [None] * len(sets)
                if full:
                    sk = sketches([sets[i] for i in full], bands * rows).reshape(len(full), bands, rows)
                    salt = mix(np.arange(1, bands + 1, dtype=np.uint64))
                    power = np.array([pow(0xD6E8FEB86659FD93, j + 1, 1 << 64) for j in range(rows)], np.uint64)
                    keys = mix((sk * power).sum(axis=2, dtype=np.uint64) + salt).view(np.int64)
                    for i, k in zip(full, keys, strict=True):
                        band[i] = k
                digest = [(int(mix(s).sum(dtype=np.uint64)), int(mix(mix(s + np.uint64(1))).sum(dtype=np.uint64))) for s in sets]
                d = np.array(digest, np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i).slice(lo, len(sets)) for i in (0, 2)), pa.array([s.size for s in sets], pa.int64()), pa.array(d[:, 0]), pa.array(d[:, 1]), pa.array(band, pa.list_(pa.int64()))],
                    ["id", "of", "n", "s1", "s2", "bands"],
                )

    read = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("of"))
    return read.mapInArrow(run, "id long, of long, n long, s1 long, s2 long, bands array<long>")


def _with_least(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Add the smallest ``id`` of a row's group as ``least``, the group's ``size`` and a ``salt``.

    A group is dealt by the salt of its ids, summed up in each part, and told to each part again, so that no task sees a large group whole.
    """
    salts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.withColumn("salt", F.pmod(F.xxhash64("id", F.lit(3)), F.lit(salts)).cast("int"))
    local = dealt.groupBy(*keys, "salt").agg(F.min("id").alias("least"), F.count("*").alias("size"))
    whole = local.groupBy(*keys).agg(F.min("least").alias("least"), F.sum("size").alias("size"))
    return dealt.join(local.select(*keys, "salt").join(whole, keys), [*keys, "salt"])


def _verified(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union of the full sets. ``size`` says how many pairs may have the same b; its text is told to parts of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                left = [s for _, sets in shingle_sets(part.column(2), words) for s in sets]
                right = [s for _, sets in shingle_sets(part.column(3), words) for s in sets]
                both = [np.intersect1d(x, y, assume_unique=True).size for x, y in zip(left, right, strict=True)]
                ok = pa.array([100 * m >= percent * (x.size + y.size - m) for m, x, y in zip(both, left, right, strict=True)], pa.bool_())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], ["a", "b"]).filter(ok)

    pairs = pairs.withColumn("parts", F.ceil(F.col("size") / BLOCK)).withColumn("part", F.pmod(F.xxhash64("a"), "parts"))
    of_b = pairs.groupBy("b").agg(F.max("parts").alias("parts")).join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")
    of_b = of_b.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("parts")
    with_a = pairs.drop("parts").join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a")
    with_b = with_a.join(of_b, ["b", "part"])
    return with_b.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def _block_links(words: int, percent: int):
    """Links of the queries and rows of one block of a bucket, from an index of the rows' shingles."""

    def run(queries: pa.Table, rows: pa.Table) -> pa.Table:
        out: tuple[list, list] = ([], [])
        if queries.num_rows and rows.num_rows:
            sets = [s for _, found in shingle_sets(rows["text"], words) for s in found]
            size, ids, parts = np.array([s.size for s in sets]), rows["id"].to_numpy(), rows["part"].to_numpy()
            key, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
            order = np.argsort(key, kind="stable")
            key, owner = key[order], owner[order]
            asked = [s for _, found in shingle_sets(queries["text"], words) for s in found]
            for s, a, part in zip(asked, queries["id"].to_pylist(), queries["part"].to_pylist(), strict=True):
                lo, hi = np.searchsorted(key, s, "left"), np.searchsorted(key, s, "right")
                n = hi - lo
                at = np.arange(n.sum()) + np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n)
                both = np.bincount(owner[at], minlength=len(sets))
                for b in ids[(100 * both >= percent * (s.size + size - both)) & (parts != part)]:
                    out[0].append(max(a, b))
                    out[1].append(min(a, b))
        return pa.table({"a": pa.array(out[0], pa.int64()), "b": pa.array(out[1], pa.int64())})

    return run


#: Buckets up to this size give their open pairs as rows; larger ones are compared in blocks of so many.
SMALL, BLOCK = 16, 512


def _links_left(live: DataFrame, parts: DataFrame, done: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Links between members of a bucket that lie in different components.

    The members outside a bucket's largest component are held against all its members of other
    components: as pairs in small buckets, where there are few, else in blocks of
    bounded size that emit links only.
    """
    named = live.join(parts, live.id == parts.node, "left").select("bucket", "id", "n", F.coalesce("component", "id").alias("part"))
    shares = named.groupBy("bucket", "part").agg(F.count("*").alias("k"))
    mixed = shares.groupBy("bucket").agg(F.sum("k").alias("size"), F.max_by("part", F.struct("k", "part")).alias("main"), F.max("k").alias("k"))
    mixed = mixed.where("k < size").select("bucket", "size", "main", (F.col("size") - F.col("k")).alias("asked"))
    open_rows = stored(named.join(mixed, "bucket"), "open")

    few = open_rows.where(F.col("size") <= SMALL)
    x = few.where("part <> main").select("bucket", F.col("id").alias("x"), F.col("n").alias("nx"), F.col("part").alias("px"))
    y = few.select("bucket", F.col("id").alias("y"), F.col("n").alias("ny"), F.col("part").alias("py"))
    near = (F.col("nx") * 100 >= F.col("ny") * percent) & (F.col("ny") * 100 >= F.col("nx") * percent)
    pairs = x.join(y, "bucket").where((F.col("px") != F.col("py")) & near).select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b"))
    pairs = pairs.distinct().join(done, ["a", "b"], "left_anti").withColumn("size", F.lit(1))

    many = open_rows.where(F.col("size") > SMALL).join(texts, "id").select("bucket", "id", "part", "text", "size", "asked", F.col("part") != F.col("main"))
    many = many.toDF("bucket", "id", "part", "text", "size", "asked", "asks")
    blocks = lambda of: F.ceil(F.col(of) / BLOCK)
    every = lambda of: F.explode(F.sequence(F.lit(0).cast("long"), blocks(of) - 1))
    held = many.withColumn("row_block", F.pmod(F.xxhash64("id"), blocks("size"))).withColumn("ask_block", every("asked"))
    ask = many.where("asks").withColumn("ask_block", F.pmod(F.xxhash64("id", F.lit(1)), blocks("asked"))).withColumn("row_block", every("size"))
    keys = ["bucket", "ask_block", "row_block"]
    kept = [*keys, "id", "part", "text"]
    ask = ask.select(kept).toDF("of", "ask", "row", "id", "part", "text")
    found = ask.groupBy("of", "ask", "row").cogroup(held.select(kept).groupBy(keys)).applyInArrow(_block_links(words, percent), "a long, b long")
    return stored(_verified(pairs, texts, words, percent).unionByName(found).distinct(), "links")


def near_duplicates(
    docs: DataFrame, words: int = 5, percent: int = 80, bands: int = 50, rows: int = 6, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: id, ``n_shingles``, ``component_id``, ``kept``.

    Words are ``[^\\x20\\x09-\\x0D]+`` after A-Z are lower-cased. A document with fewer
    than ``words`` words has its whole sequence as its one shingle. Null, empty and
    blank texts have no shingles and are linked with nothing. Rows that repeat an id
    or a text are copies and share a component; of texts that differ under one id, the one with the smallest
    hash is compared for it. A null id gives a null component
    and is not kept. An empty table gives no rows. Texts are hashed in blocks of a few megabytes or one longer text. Other columns, of whatever names, are not looked at. A pair of exactly 0.8 shares
    no band with a chance of (1 - 0.8**rows) ** bands, 2.5e-7 by default.
    """
    sig = stored(signatures(docs, words, bands, rows, id_col, text_col), "signatures")
    some = sig.where("n > 0 and id is not null")
    members = stored(_with_least(some.select("id", "n", "s1", "s2"), ["s1", "s2", "n"]).withColumnRenamed("least", "rep").drop("size"), "members")

    own = some.join(members.where("id = rep").select("id", "s1", "s2", "n").distinct(), ["id", "s1", "s2", "n"], "left_semi")
    reps = own.groupBy("id").agg(F.min(F.struct("of", "n", "bands")).alias("r")).select("id", "r.n", "r.bands")
    buckets = reps.select("id", "n", F.explode("bands").alias("bucket"))
    # A hub is one row of its bucket, so adaptive execution can split the other side of a large one.
    hubs = buckets.groupBy("bucket").agg(F.min("id").alias("hub"), F.count("*").alias("size")).where("size > 1")
    live = stored(buckets.join(hubs, "bucket"), "buckets")
    chosen = own.groupBy("id").agg(F.min("of").alias("of")).join(live.select("id").distinct(), "id", "left_semi")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("of"))
    texts = stored(texts.join(chosen, ["id", "of"], "left_semi").dropDuplicates(["id"]).drop("of"), "texts")

    first = live.where("id <> hub").groupBy(F.col("id").alias("a"), F.col("hub").alias("b")).agg(F.max("size").alias("size"))
    first = stored(first, "pairs")
    links = stored(_verified(first, texts, words, percent), "links")
    parts = connected_components(links)

    more = _links_left(live, parts, first, texts, words, percent)
    parts = connected_components(links.unionByName(more))

    told = members.select("rep", "salt").distinct().join(parts, F.col("rep") == F.col("node"), "left").select("rep", "salt", F.coalesce("component", "rep").alias("component"))
    out = members.join(told, ["rep", "salt"]).select("id", "n", "component")
    out = out.unionByName(sig.where("n = 0 or id is null").select("id", "n", F.col("id").alias("component")))
    component = F.col("component")
    return out.select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept")
    )
