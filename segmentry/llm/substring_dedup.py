"""Removal of repeated passages: seed on winnowed anchors, extend, keep maximal repeats.

Every window of ``window`` words picks one anchor, the smallest hash of ``seed``
words in turn (the last of equal ones), so equal windows pick equal anchors
and no repeat of that length goes unseen. Anchors that occur once only are dropped.
Around the others all windows that pick the anchor, to both sides of it, are compared by 96-bit hashes; overlapping matches
merge into maximal repeats. That is the result of extending every match word by word, without a pair of
documents for each match: a passage that many documents share would make the square of their number.

Both exchanges are pre-aggregated in the tasks: of a key seen in several documents
of a task one witness travels, and a document sends a key once with all its places; so a key has a few rows per task at most however many
documents share it and however often one repeats it.
"""

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from segmentry.llm.wordhash import byte_values, gram_hashes, hash_words, mix, text_blocks
from segmentry.shared import stored

#: A word with the white space before it.
_SPACED = re.compile(rb"[\x20\x09-\x0d]*[^\x20\x09-\x0d]+")
#: Keys that a task gathers before it pre-aggregates them; bounds its memory, not the result.
FLUSH = 2_000_000


def picked(h: np.ndarray, counts: np.ndarray, window: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts of all windows, the anchor's place for each, hashes of ``seed`` words)."""
    g = gram_hashes(h, seed, salt=3)
    ends = np.repeat(np.cumsum(counts), counts)
    at = np.arange(ends.size)
    at = at[at + window <= ends]
    n = h.size - window + 1
    if n <= 0 or not at.size:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), g
    low, place = g[:n].copy(), np.zeros(n, np.int64)
    for j in range(1, window - seed + 1):
        better = g[j : j + n] <= low
        low[better] = g[j : j + n][better]
        place[better] = j
    return at, at + place[at], g


def _grouped(*keys: np.ndarray) -> np.ndarray:
    """Places in sorted columns where a new combination begins."""
    new = np.zeros(keys[0].size, bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def _further(values: np.ndarray, first: np.ndarray) -> pa.Array:
    """For groups that begin at ``first``, their values but the first; null where there is one only."""
    sizes = np.diff(np.append(first, values.size)) - 1
    rest = np.ones(values.size, bool)
    rest[first] = False
    edge = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(edge), pa.array(values[rest].astype(np.int32)), mask=pa.array(sizes == 0))


def _anchors(window: int, seed: int):
    """Rows (key, id, fp, pos, more): anchors of one document of the task, once with all their places; a witness (id null) and the places for those of several."""

    def flush(parts: list) -> pa.RecordBatch:
        key, doc, fp, pos = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((pos, fp, doc, key))
        key, doc, fp, pos = key[order], doc[order], fp[order], pos[order]
        own = _grouped(key, doc, fp)
        more = _further(pos, own)
        # Back in the order of the texts, in which ids and places compress well.
        back = np.argsort(order[own])
        more, place = more.take(pa.array(back)), pos[own]
        key, doc, fp = key[own], doc[own], fp[own]
        first = _grouped(key)
        last = np.append(first[1:], key.size) - 1
        many = doc[first] != doc[last]
        shared = np.repeat(many, last - first + 1)
        n, witnesses = int(many.sum()), key[first[many]]
        key, doc, fp, place, shared = key[back], doc[back], fp[back], place[back], shared[back]
        # Places that are known to count travel by document.
        keys = np.where(shared, mix(doc.view(np.uint64)), key)
        pad, mask = np.zeros(n, np.int64), np.arange(key.size + n) >= key.size
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate((keys, witnesses)).view(np.int64)),
                pa.array(np.concatenate((doc, pad)), mask=mask),
                pa.array(np.concatenate((fp, pad))),
                pa.array(np.concatenate((place, pad)).astype(np.int32)),
                pa.concat_arrays([more, pa.nulls(n, more.type)]),
                pa.array(np.concatenate((shared, np.zeros(n, bool)))),
            ],
            ["key", "id", "fp", "pos", "more", "known"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, parts, held = byte_values(), [], 0
        for batch in batches:
            ids, fps = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for lo, hi, data, offs in text_blocks(batch.column(2)):
                h, counts = hash_words(data, offs, table)[:2]
                _, place, g = picked(h, counts, window, seed)
                place = np.unique(place)
                row = np.repeat(np.arange(hi - lo), counts)[place]
                begin = np.concatenate(([0], np.cumsum(counts)))[row]
                parts.append((g[place], ids[lo:hi][row], fps[lo:hi][row], place - begin))
                held += place.size
                if held >= FLUSH:
                    yield flush(parts)
                    parts, held = [], 0
        if held:
            yield flush(parts)

    return run


def _windows(window: int, seed: int):
    """Rows (h1, h2, id, fp, start, length, more, known): windows at shared anchors, once for a document with all their starts; runs of those known to be repeats."""

    def flush(parts: list) -> pa.RecordBatch:
        h1, h2, doc, fp, start = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((start, fp, doc, h2, h1))
        h1, h2, doc, fp, start = h1[order], h2[order], doc[order], fp[order], start[order]
        first = _grouped(h1, h2)
        low = np.repeat(doc[first], np.diff(np.append(first, doc.size)))
        known = doc != low
        kd, kf, ks = doc[known], fp[known], start[known]
        by = np.lexsort((ks, kf, kd))
        kd, kf, ks = kd[by], kf[by], ks[by]
        head = np.concatenate(([True], (kd[1:] != kd[:-1]) | (kf[1:] != kf[:-1]) | (ks[1:] != ks[:-1] + 1))) if kd.size else np.zeros(0, bool)
        run_at = np.flatnonzero(head)
        length = np.diff(np.append(run_at, kd.size))
        h1, h2, doc, fp, start, order = (x[~known] for x in (h1, h2, doc, fp, start, order))
        own = _grouped(h1, h2, doc, fp)
        # The others in the order of the texts, in which ids and places compress well.
        back = np.argsort(order[own])
        more = _further(start, own).take(pa.array(back))
        one = own[back]
        cat = lambda x, y, kind: pa.array(np.concatenate((x[one], y)).astype(kind))
        return pa.RecordBatch.from_arrays(
            [
                cat(h1.view(np.int64), mix(kd[run_at].view(np.uint64)).view(np.int64), np.int64),
                cat(h2.view(np.int64) >> 32, ks[run_at], np.int32),
                cat(doc, kd[run_at], np.int64),
                cat(fp, kf[run_at], np.int64),
                cat(start, ks[run_at], np.int32),
                pa.array(np.concatenate((np.ones(one.size, np.int32), length.astype(np.int32)))),
                pa.concat_arrays([more, pa.nulls(run_at.size, more.type)]),
                pa.array(np.arange(one.size + run_at.size) >= one.size),
            ],
            ["h1", "h2", "id", "fp", "start", "length", "more", "known"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, other, parts, held = byte_values(), byte_values(seed=8), [], 0
        for batch in batches:
            ids, fps, places = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(3)
            for lo, hi, data, offs in text_blocks(batch.column(2)):
                h, counts = hash_words(data, offs, table)[:2]
                at, place, _ = picked(h, counts, window, seed)
                if not at.size:
                    continue
                begin = np.concatenate(([0], np.cumsum(counts)))
                own = places.slice(lo, hi - lo)
                sizes = np.diff(own.offsets.to_numpy())
                mark = np.zeros(h.size + 1, bool)
                spots = np.repeat(begin[:-1], sizes) + own.flatten().to_numpy()
                mark[spots[spots < h.size]] = True
                at = at[mark[place]]
                row = np.repeat(np.arange(hi - lo), counts)[at]
                parts.append((gram_hashes(h, window, 1)[at], gram_hashes(hash_words(data, offs, other)[0], window, 2)[at], ids[lo:hi][row], fps[lo:hi][row], at - begin[row]))
                held += at.size
                if held >= FLUSH:
                    yield flush(parts)
                    parts, held = [], 0
        if held:
            yield flush(parts)

    return run


def _kept(window: int, spaced: bool):
    """The words that stay, joined by one space, or (``spaced``) each with the white space before it, where words were removed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, lows, lengths, more = batch.column(1), batch.column(2), batch.column(3), batch.column(4)
            out, n, gone = [], [], []
            for i in range(batch.num_rows):
                text = texts[i].as_py() or b""
                words = text.split()
                if lows[i].is_valid:
                    edge = np.zeros(len(words) + 1, np.int32)
                    s, k = lows[i].values.to_numpy(), lengths[i].values.to_numpy()
                    np.add.at(edge, s, 1)
                    np.add.at(edge, np.minimum(s + k - 1 + window, len(words)), -1)
                    s = more[i].values.to_numpy()
                    np.add.at(edge, s, 1)
                    np.add.at(edge, np.minimum(s + window, len(words)), -1)
                    keep = np.cumsum(edge[:-1]) == 0
                    kept = [w for w, k in zip(words, keep.tolist(), strict=True) if k]
                    if spaced:
                        out.append(b"".join(w for w, k in zip(_SPACED.findall(text), keep.tolist(), strict=True) if k).lstrip())
                    else:
                        out.append(b" ".join(kept))
                else:
                    kept = words
                    out.append(text if spaced else b" ".join(kept))
                n.append(len(words))
                gone.append(len(words) - len(kept))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary()), pa.array(n, pa.int64()), pa.array(gone, pa.int64())], ["id", "kept_text", "n_words", "n_removed"])

    return run


def remove_repeats(docs: DataFrame, window: int = 13, seed: int = 5, spaced: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, ``kept_text``, ``n_words``, ``n_removed``.

    A word goes if a window of ``window`` words that covers it also starts, word for word,
    in a document with a smaller id; windows are those of the input. The kept words
    are joined by one space; with ``spaced`` each keeps the white space before it, and texts that lose nothing stay as they are. Null, empty and blank texts give an empty text and 0
    words; texts shorter than a window stay whole. Rows that repeat an id are never
    held against each other; they are told apart by a 64-bit hash of the text. A row with a null id stays whole and is no
    one's earlier document. An empty table gives no rows. Texts are hashed in blocks of a few megabytes or one longer text. Other
    columns, of whatever names, are not looked at.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    base = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("fp"), F.col(text_col).cast("binary").alias("text"))
    named = base.where("id is not null")

    seeds = named.mapInArrow(_anchors(window, seed), "key long, id long, fp long, pos int, more array<int>, known boolean")
    counted = seeds.withColumn("seen", F.sum(F.when(F.col("known") | F.col("id").isNull(), 2).otherwise(1)).over(Window.partitionBy("key")))
    places = stored(counted.where("seen > 1 and id is not null").groupBy("id", "fp").agg(F.concat(F.collect_list("pos"), F.flatten(F.collect_list("more"))).alias("places")), "places")

    # Both joins below read this one exchange; the filter is the one that an inner join adds.
    dealt = named.where("fp is not null").repartition(n, "id", "fp")
    runs = dealt.join(places, ["id", "fp"]).select("id", "fp", "text", "places").mapInArrow(
        _windows(window, seed), "h1 long, h2 int, id long, fp long, start int, length int, more array<int>, known boolean"
    )
    first = F.min("id").over(Window.partitionBy("h1", "h2"))
    gone = runs.withColumn("first", first).where("known or id > first")
    covered = gone.groupBy("id", "fp").agg(F.collect_list(F.struct("start", "length")).alias("runs"), F.flatten(F.collect_list("more")).alias("more"))
    out = dealt.join(covered, ["id", "fp"], "left").select("id", "text", "runs.start", "runs.length", "more")
    nameless = base.where("id is null").select("id", "text", *(F.lit(None).cast("array<int>").alias(c) for c in ("start", "length", "more")))
    out = out.unionByName(nameless)
    out = out.mapInArrow(_kept(window, spaced), "id long, kept_text binary, n_words long, n_removed long")
    return out.select(F.col("id").alias(id_col), F.col("kept_text").cast("string").alias("kept_text"), "n_words", "n_removed")
