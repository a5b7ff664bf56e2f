"""Alignment of two tokenizers over the same bytes, by divide and conquer at shared cuts.

Both token sequences of a text cover the bytes of a space and the text. An interval of tokens is cut at a
byte where a token of either ends: ends are tried from the middle outwards and looked
up among the other's by bisection, and both halves are cut in turn. An interval without a common end within is a
leaf, a group. All intervals of a block of texts are cut side by side.

How often two ids are linked is counted in blocks of texts first, so a frequent pair has one row a
block; the counts come back to the blocks in the same way.
"""

from collections.abc import Callable, Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segmentry.llm.packing import text_encoder
from segmentry.llm.wordhash import text_blocks
from segmentry.shared import stored

#: Links whose pairs a task gathers before they leave as a block, and bytes of the texts that it reads at a time; they bound memory, not results.
BLOCK_LINKS, BLOCK_BYTES = 2_000_000, 1 << 22
#: Fixed values of the second vocabulary: its mark of a space.
MARK = "▁"


class Tokenizer:
    """Ids of texts and the bytes of each id. ``encode`` gives the ids of a text that a space stands before."""

    def __init__(self, encode: Callable[[str], list[int]], tokens: list[bytes]) -> None:
        self.encode = encode
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.data = np.frombuffer(b"".join(tokens), np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of ``ids`` in turn."""
        return self.data[_ragged(self.starts[ids], self.lengths[ids])]

    def tokens(self, data: np.ndarray, edge: np.ndarray, apart: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids in turn, ids of each, whether they make up the bytes) of the segments between ``edge``, each of which begins with a space.

        Those not ``apart`` end so that they can be read as one text with the next.
        """
        ids = [np.zeros(0, np.int64)]
        counts, right = np.zeros(edge.size - 1, np.int64), np.zeros(edge.size - 1, bool)
        stop = np.flatnonzero(apart) + 1
        stop = np.unique(np.concatenate((stop, stop - 1, [edge.size - 1])))
        at = 0
        for end in stop[stop > 0].tolist():
            while at < end:  # few at a time, as the encoders slow down on long texts
                to = min(end, max(at + 1, int(np.searchsorted(edge, edge[at] + 4096, "right")) - 1))
                part = data[edge[at] : edge[to]]
                own = np.asarray(self.encode(part[1:].tobytes().decode()), np.int64)
                last = np.cumsum(self.lengths[own])
                if last.size and last[-1] == part.size and np.array_equal(self.joined(own), part):
                    ids.append(own)
                    upto = np.searchsorted(last, edge[at + 1 : to + 1] - edge[at]) + 1
                    counts[at:to], right[at:to] = np.diff(np.append(0, upto)), True
                    at = to
                elif to == at + 1:
                    at = to
                else:  # one of them is altered: each on its own
                    for i in range(at, to):
                        own, n, ok = self.tokens(data, edge[i : i + 2], np.ones(1, bool))
                        ids.append(own)
                        counts[i], right[i] = n[0], ok[0]
                    at = to
        return np.concatenate(ids), counts, right


def byte_level(ranks_path: str) -> Tokenizer:
    """Byte-level merges by a file of ranks. Strings of special tokens are plain text."""
    part, ranks = text_encoder(ranks_path)
    tokens = sorted(ranks, key=ranks.__getitem__)
    return Tokenizer(lambda text: part(f" {text}"), tokens)


def pieces(model_path: str) -> Tokenizer:
    """Pieces of a model that adds a space itself and falls back to bytes."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=model_path)
    names = [model.IdToPiece(i) for i in range(model.GetPieceSize())]
    if any(MARK in name.lstrip(MARK) for name in names):
        raise ValueError("a piece goes on after the start of a word, so texts can't be cut there")
    tokens = [bytes([int(name[3:5], 16)]) if model.IsByte(i) else name.replace(MARK, " ").encode() for i, name in enumerate(names)]
    return Tokenizer(model.encode, tokens)


def segments(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the segments of the texts between ``offs``, and segments of each: one begins at each text and at each space after a printable ASCII character, unless the text ends with it.

    No token of either vocabulary goes on over such a place, so each segment has the tokens that it has in its text.
    """
    before, mark = data[:-1], np.zeros(data.size, bool)
    mark[1:] = (data[1:] == 32) & (before > 32) & (before < 127)
    mark[offs[1:] - 1] = False
    mark[offs[:-1]] = True
    starts = np.flatnonzero(mark)
    return starts, np.diff(np.append(np.searchsorted(starts, offs[:-1]), starts.size))


def _ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its size, in turn."""
    first = np.cumsum(sizes) - sizes
    return np.repeat(starts - first, sizes) + np.arange(int(sizes.sum()))


def shared_cuts(a: np.ndarray, b: np.ndarray, sizes_a: np.ndarray, sizes_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marks of ``a`` and of ``b`` where a token of both ends.

    ``a`` and ``b``: rising ends of the tokens of texts that follow each other; ``sizes``: tokens of each text, whose last ends are the same.
    """
    cut, cut_b = np.zeros(a.size, bool), np.zeros(b.size, bool)
    last_a, last_b = np.cumsum(sizes_a) - 1, np.cumsum(sizes_b) - 1
    cut[last_a[sizes_a > 0]], cut_b[last_b[sizes_b > 0]] = True, True
    # Intervals of ends that may be cuts: [lo, hi) of a and [blo, bhi) of b; those within ``width`` of the middle are tried.
    work = np.stack([last_a + 1 - sizes_a, last_a, last_b + 1 - sizes_b, last_b, np.zeros_like(last_a)])
    while True:
        work = work[:, (work[0] < work[1]) & (work[2] < work[3])]
        if not work.shape[1]:
            return cut, cut_b
        lo, hi, blo, bhi, width = work
        middle = (lo + hi) // 2
        left, right = np.maximum(lo, middle - width), np.minimum(hi, middle + width + 1)
        if width.any():
            n = right - left
            tried = _ragged(left, n)
            away = 2 * np.abs(tried - np.repeat(middle, n)) + (tried < np.repeat(middle, n))
            at = np.searchsorted(b, a[tried])
            away[b[at] != a[tried]] = np.iinfo(np.int64).max
            best = np.minimum.reduceat(away, np.cumsum(n) - n)
            hit = best < np.iinfo(np.int64).max
            found = np.where(hit, middle + np.where(best % 2, -(best // 2), best // 2), middle)
        else:
            found = middle
            hit = None
        there = np.searchsorted(b, a[found])
        hit = b[there] == a[found] if hit is None else hit
        cut[found[hit]], cut_b[there[hit]] = True, True
        zero = np.zeros(int(hit.sum()), np.int64)
        halves = np.stack([np.stack([lo[hit], found[hit], blo[hit], there[hit], zero], 1), np.stack([found[hit] + 1, hi[hit], there[hit] + 1, bhi[hit], zero], 1)], 1).reshape(-1, 5).T
        open_ = ~hit & ((left > lo) | (right < hi))
        wider = np.stack([lo[open_], hi[open_], blo[open_], bhi[open_], 4 * width[open_] + 1])
        work = np.concatenate([halves, wider], 1)


def _digits(most: int) -> tuple[np.ndarray, np.ndarray]:
    """Decimal digits of 0 to ``most`` - 1, right-aligned with a place for what follows, and which of the places count."""
    width = len(str(most - 1))
    n = np.arange(most)[:, None] // 10 ** np.arange(width - 1, -1, -1)
    used = n > 0
    used[:, -1] = True
    return np.column_stack([n % 10 + 48, np.zeros(most, np.int64)]).astype(np.uint8), np.column_stack([used, np.ones(most, bool)])


def _groups_text(a: np.ndarray, b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, digits: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of ``a1,a2|b1;a3|b2,b3;`` over all groups, and the place where each group ends."""
    n = int(group_a[-1]) + 1
    per_a, per_b = np.bincount(group_a, minlength=n), np.bincount(group_b, minlength=n)
    ids, follows = np.empty(a.size + b.size, np.int64), np.full(a.size + b.size, ord(","), np.uint8)
    ids[np.arange(a.size) + (np.cumsum(per_b) - per_b)[group_a]] = a
    ids[np.arange(b.size) + np.cumsum(per_a)[group_b]] = b
    ends = np.cumsum(per_a + per_b)
    follows[ends - per_b - 1] = ord("|")
    follows[ends - 1] = ord(";")
    text, used = digits[0][ids], digits[1][ids]
    text[:, -1] = follows
    return text[used], np.cumsum(used.sum(axis=1))[ends - 1]


_DOCS = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"


def aligned(a_ids: np.ndarray, b_ids: np.ndarray, sizes_a: np.ndarray, sizes_b: np.ndarray, a: Tokenizer, b: Tokenizer, digits: tuple) -> tuple[list, np.ndarray, np.ndarray]:
    """(columns of ``_DOCS`` for each text, row and code of each link); the code is a's id times b's number of ids plus b's id."""
    rows = np.arange(sizes_a.size)
    if not a_ids.size:
        zero = pa.array(np.zeros(rows.size, np.int64))
        return [zero, zero, zero, zero, pa.array([""] * rows.size)], np.zeros(0, np.int64), np.zeros(0, np.int64)
    ends_a, ends_b = np.cumsum(a.lengths[a_ids]), np.cumsum(b.lengths[b_ids])
    cut, cut_b = shared_cuts(ends_a, ends_b, sizes_a, sizes_b)
    group_a, group_b = np.cumsum(cut) - cut, np.cumsum(cut_b) - cut_b
    # Where a token ends, it is linked with the other's that holds the byte before.
    of_a = np.empty(ends_a.size, np.int64)
    of_a[cut] = np.flatnonzero(cut_b)
    of_a[~cut] = np.searchsorted(ends_b, ends_a[~cut])
    alone = np.flatnonzero(~cut_b)
    by_b = np.searchsorted(ends_a, ends_b[alone])
    codes = np.concatenate([a_ids * b.lengths.size + b_ids[of_a], a_ids[by_b] * b.lengths.size + b_ids[alone]])
    row_a, row_b = np.repeat(rows, sizes_a), np.repeat(rows, sizes_b)
    link_row = np.concatenate([row_a, row_b[alone]])
    n_groups, n_links = np.bincount(row_a[cut], minlength=rows.size), np.bincount(link_row, minlength=rows.size)
    text, at = _groups_text(a_ids, b_ids, group_a, group_b, digits)
    text = text.tobytes()
    edge = np.concatenate(([0], at))[np.concatenate(([0], np.cumsum(n_groups)))]
    digests = [sha256(text[edge[i] : edge[i + 1] - 1]).hexdigest() if n_groups[i] else "" for i in rows]
    return [*(pa.array(x.astype(np.int64)) for x in (sizes_a, sizes_b, n_groups, n_links)), pa.array(digests, pa.string())], link_row, codes


def _blocks(ranks_path: str, model_path: str):
    """Rows of texts (block, id, ``_DOCS``, pairs and times: places in the block's list and uses of each of the text's different pairs), and of the list (block, pair, place, n)."""

    def flush(held: list, number: int) -> Iterator[pa.RecordBatch]:
        block = (TaskContext.get().partitionId() << 32) + number
        codes = np.concatenate([codes for _, _, _, codes, _ in held])
        pairs, place = np.unique(codes, return_inverse=True)
        n = np.bincount(place, weights=np.concatenate([times for *_, times in held]), minlength=pairs.size).astype(np.int64)
        at = 0
        for docs, sizes, _, codes, times in held:
            edge = pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32))
            own = pa.ListArray.from_arrays(edge, pa.array(place[at : at + codes.size].astype(np.int32)))
            uses = pa.ListArray.from_arrays(edge, pa.array(times.astype(np.int32)))
            at += codes.size
            size = len(docs[0])
            none = pa.nulls(size, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(size, block)), *docs, own, uses, none, none.cast(pa.int32()), none], names)
        size = pairs.size
        docs = [pa.nulls(size, kind) for kind in (*[pa.int64()] * 5, pa.string(), *[pa.list_(pa.int32())] * 2)]
        yield pa.RecordBatch.from_arrays([pa.array(np.full(size, block)), *docs, pa.array(pairs), pa.array(np.arange(size, dtype=np.int32)), pa.array(n)], names)

    names = ["block", "id", *(c.split()[0] for c in _DOCS.split(", ")), "pairs", "times", "pair", "place", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = byte_level(ranks_path), pieces(model_path)
        digits = _digits(max(a.lengths.size, b.lengths.size))
        held, size, number = [], 0, 0
        for batch in batches:
            for lo, hi, data, offs in text_blocks(batch.column(1), BLOCK_BYTES):
                full = np.diff(offs) > 0
                # A space before each text that isn't empty.
                spaced = np.insert(data, offs[:-1][full], 32)
                starts, counts = segments(spaced, np.concatenate(([0], np.cumsum(np.diff(offs)[full] + 1)))) if full.any() else (np.zeros(0, np.int64), np.zeros(0, np.int64))
                edge = pa.py_buffer(np.append(starts, spaced.size).astype(np.int64))
                coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), starts.size, [None, edge, pa.py_buffer(spaced)]).dictionary_encode()
                at, found = coded.indices.to_numpy(), coded.dictionary
                edge = np.frombuffer(found.buffers()[1], np.int64)[found.offset : found.offset + len(found) + 1]
                known = np.frombuffer(found.buffers()[2], np.uint8) if spaced.size else spaced
                last = known[edge[1:] - 1]
                tokens = [t.tokens(known, edge, (last <= 32) | (last >= 127)) for t in (a, b)]
                # A text one of whose segments a tokenizer alters has no tokens.
                missed = ~(tokens[0][2] & tokens[1][2])[at]
                per_text = np.zeros(hi - lo, np.int64)
                per_text[full] = counts
                row = np.repeat(np.arange(hi - lo), per_text)
                bad = np.bincount(row[missed], minlength=hi - lo) > 0
                at, row = at[~bad[row]], row[~bad[row]]
                ids = [flat[_ragged((np.cumsum(n) - n)[at], n[at])] for flat, n, _ in tokens]
                sizes = [np.bincount(row, weights=n[at], minlength=hi - lo).astype(np.int64) for _, n, _ in tokens]
                docs, link_row, codes = aligned(*ids, *sizes, a, b, digits)
                keys = np.sort(link_row << 32 | codes)
                first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: keys.size])
                keys, times = keys[first], np.diff(np.append(first, keys.size))
                per_text = np.bincount(keys >> 32, minlength=hi - lo)
                held.append(([batch.column(0).slice(lo, hi - lo), *docs], per_text, None, keys & 0xFFFFFFFF, times))
                size += codes.size
                if size >= BLOCK_LINKS:
                    yield from flush(held, number)
                    held, size, number = [], 0, number + 1
        if held:
            yield from flush(held, number)

    return run


def _summed(texts: pa.Table, pairs: pa.Table) -> pa.Table:
    """The texts of a block with ``n_best`` and ``count_sum``; ``pairs``: place, count and whether it is the best of its second id."""
    place = pairs["place"].to_numpy()
    count, best = np.zeros(place.size, np.int64), np.zeros(place.size, np.int64)
    count[place], best[place] = pairs["count"].to_numpy(), pairs["best"].to_numpy()
    out: list[list[int]] = [[], []]
    for chunk in texts.select(["pairs", "times"]).to_batches():
        own, uses = chunk.column(0), chunk.column(1).flatten().to_numpy().astype(np.int64)
        edge = np.concatenate(([0], np.cumsum(np.diff(own.offsets.to_numpy()))))
        at = own.flatten().to_numpy()
        for kept, worth in zip(out, (best, count), strict=True):
            total = np.concatenate(([0], np.cumsum(uses * worth[at])))
            kept.extend((total[edge[1:]] - total[edge[:-1]]).tolist())
    texts = texts.select(["id", *(c.split()[0] for c in _DOCS.split(", "))])
    return texts.append_column("n_best", pa.array(out[0], pa.int64())).append_column("count_sum", pa.array(out[1], pa.int64()))


def tokenizer_alignment(docs: DataFrame, ranks_path: str, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, ``n_a``, ``n_b`` (tokens), ``n_groups``, ``n_links``, ``n_best``, ``count_sum``, ``groups_sha256``.

    Links are pairs of tokens, one of each tokenizer, that share bytes. A pair of ids counts as often as it is linked in all documents;
    ``count_sum`` adds the counts of a document's links, and ``n_best`` are its links whose
    count no other id of the first tokenizer has with that id of the second. ``groups_sha256`` is the digest of ``a1,a2|b1;a3|b2,b3``, ids by group.
    Null and empty texts, and those that a tokenizer alters, have zeros and an empty digest. Rows
    that repeat an id, or have none, are rows of their own. An empty table gives no rows. Texts are read whole, a few megabytes at a
    time or one longer text. Other columns, of whatever names, are not looked at.
    """
    width = pieces(model_path).lengths.size
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    schema = f"block long, id long, {_DOCS}, pairs array<int>, times array<int>, pair long, place int, n long"
    found = stored(texts.mapInArrow(_blocks(ranks_path, model_path), schema), "alignment")
    listed = found.where("pair is not null").select("block", "pair", "place", "n")
    counts = listed.groupBy("pair").agg(F.sum("n").alias("count")).withColumn("b", F.col("pair") % width)
    counts = stored(counts, "pair_counts")
    # A row for each id of the second vocabulary at most.
    highest = counts.groupBy("b").agg(F.max("count").alias("highest"))
    counts = counts.join(F.broadcast(highest), "b").select("pair", "count", (F.col("count") == F.col("highest")).cast("long").alias("best"))
    back = listed.select("block", "pair", "place").join(counts, "pair").select(F.col("block").alias("of"), "place", "count", "best")
    rows = found.where("pair is null").drop("pair", "place", "n")
    out = rows.groupBy("block").cogroup(back.groupBy("of")).applyInArrow(_summed, f"id long, {_DOCS}, n_best long, count_sum long")
    return out.select(F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
