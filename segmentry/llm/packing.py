"""Packing of tokenised documents into sequences.

A document is its token ids and an end id. Only documents longer than a sequence are
cut, from the back, so that all pieces but the first are full. Pieces have at most
``capacity`` lengths, so the instance is a histogram of bounded size.
On it Martello-Toth dominance first fixes sets of up to three pieces that some best packing has;
the rest is packed best-fit, longest pieces first, by whole groups of
equal sequences; where that stays above the least thinkable number, filling one sequence after the other
as full as can be is tried too. The plan says which ranks of each length go into which sequences; Spark
numbers the pieces of a length and joins them to it.
"""

import bisect
import re
import sys
from array import array
from base64 import b64decode
from collections import defaultdict
from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from segmentry.llm.wordhash import text_blocks
from segmentry.shared import stored

#: Groups that number the pieces of one length; a length may hold a third of all pieces.
NUMBERING = 512
#: Fixed values of the vocabulary.
END_OF_TEXT = "<|endoftext|>"
#: The split of texts before byte-level merges that this vocabulary was made with.
PRE_TOKENS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Unicode's white space, as that split has it; longer runs than its backtracking bears are cut out of a text first.
LONG_WHITE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{4096,}")


def text_encoder(ranks_path: str) -> tuple[Callable[[str], list[int]], dict[bytes, int]]:
    """A function from a text to the ids of its tokens, and the vocabulary. ``ranks_path`` names it as base64 tokens and ranks; strings of special tokens are plain text."""
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    coder = tiktoken.Encoding("given", pat_str=PRE_TOKENS, mergeable_ranks=ranks, special_tokens={})
    piece = tiktoken.Encoding("piece", pat_str="(?s:.+)", mergeable_ranks=ranks, special_tokens={})

    def part(text: str) -> list[int]:
        ids, at = [], 0
        for m in LONG_WHITE.finditer(text):
            # A run is one pre-token, but for its last character if something follows.
            end = m.end() - (m.end() < len(text))
            ids += coder.encode_ordinary(text[at : m.start()]) + piece.encode_ordinary(text[m.start() : end])
            at = end
        return ids + coder.encode_ordinary(text[at:]) if at else coder.encode_ordinary(text)

    return part, ranks


def _encoder(ranks_path: str):
    """A function from a text to the ids of its tokens, as little-endian unsigned 32-bit bytes.

    The end-of-text token in a text
    is one token, the next rank after them, as the vocabulary's own tokenizer has it.
    """
    part, ranks = text_encoder(ranks_path)

    def encode(text: str) -> bytes:
        parts = [part(x) for x in text.split(END_OF_TEXT)]
        ids = array("I", parts[0])
        for x in parts[1:]:
            ids.append(len(ranks))
            ids.extend(x)
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()

    return encode


def token_pieces(docs: DataFrame, ranks_path: str, capacity: int, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32. Texts are tokenised whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(ranks_path)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for lo, hi, _, _ in text_blocks(batch.column(1)):
                rows = []
                for doc, text in zip(batch.column(0).slice(lo, hi - lo).to_pylist(), batch.column(1).slice(lo, hi - lo).to_pylist(), strict=True):
                    data = encode(text or "") + end
                    n = len(data) // 4
                    first = (n - 1) % capacity + 1
                    at = 0
                    for k in range((n - first) // capacity + 1):
                        size = capacity if k else first
                        rows.append((doc, k, at, size, crc32(data[4 * at : 4 * (at + size)])))
                        at += size
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[2:])], ["id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, piece int, start long, length long, ids_crc32 long")


def fixed_by_dominance(left: dict[int, int], capacity: int) -> dict[tuple[int, ...], int]:
    """Sets that dominate all others that hold their first piece, taken out of the histogram ``left``: (lengths, times).

    A set dominates another one if its pieces can stand in for the other's, each for one or for two that are together no longer.
    """
    sizes, plan = sorted(left), defaultdict(int)

    def take(*kind: int) -> None:
        times = min(left[n] // kind.count(n) for n in kind)
        plan[kind] += times
        for n in set(kind):
            left[n] -= times * kind.count(n)
            if not left[n]:
                del left[n]
                sizes.pop(bisect.bisect_left(sizes, n))

    def largest(most: int, *used: int) -> int:
        """The largest length up to ``most`` of which more are left than ``used``; 0 if there is none."""
        at = bisect.bisect_right(sizes, most) - 1
        while at >= 0 and left[sizes[at]] <= used.count(sizes[at]):
            at -= 1
        return sizes[at] if at >= 0 else 0

    def smallest(count: int, over: int, *used: int) -> int:
        """Sum of the ``count`` smallest pieces longer than ``over``; too much if there are fewer."""
        at, total = bisect.bisect_right(sizes, over), 0
        while count and at < len(sizes):
            have = min(count, left[sizes[at]] - used.count(sizes[at]))
            total, count, at = total + have * sizes[at], count - have, at + 1
        return capacity + 1 if count else total

    def dominating(n: int) -> tuple[int, ...] | None:
        room = capacity - n
        a = largest(room, n)
        if not a or a == room or smallest(2, 0, n) > room:
            return (n, a) if a else (n,)
        if smallest(3, 0, n) <= room:
            return None
        # Two more fit at most: the largest one and the largest beside it, unless two others are both longer than the second.
        b = largest(room - a, n, a)
        if not b:
            pairs = max((x + y for x in sizes if x <= room and (y := largest(room - x, n, x))), default=0)
            return (n, a) if pairs <= a else None
        return (n, a, b) if smallest(2, b, n) > room else None

    changed = True
    while changed:
        changed = False
        for n in sorted(left, reverse=True):
            while n in left and (kind := dominating(n)):
                take(*kind)
                changed = True
    return plan


def best_fit(left: dict[int, int], capacity: int) -> dict[tuple[int, ...], int]:
    """Longest pieces first, each into the open sequence with the least room for it, by groups of equal sequences."""
    rooms: list[int] = []
    open_at: dict[int, dict[tuple[int, ...], int]] = {}

    def open_(kind: tuple[int, ...], room: int, times: int) -> None:
        if room not in open_at:
            open_at[room] = {}
            bisect.insort(rooms, room)
        open_at[room][kind] = open_at[room].get(kind, 0) + times

    for n in sorted(left, reverse=True):
        rest = left[n]
        while rest:
            at = bisect.bisect_left(rooms, n)
            if at == len(rooms):
                each = capacity // n
                if rest >= each:
                    open_((n,) * each, capacity - each * n, rest // each)
                if rest % each:
                    open_((n,) * (rest % each), capacity - rest % each * n, 1)
                break
            room = rooms[at]
            kind, have = next(iter(open_at[room].items()))
            each = min(room // n, rest)
            times = min(have, rest // each)
            if times == have:
                del open_at[room][kind]
                if not open_at[room]:
                    del open_at[room], rooms[at]
            else:
                open_at[room][kind] = have - times
            open_((*kind, *(n,) * each), room - each * n, times)
            rest -= each * times
    plan: dict[tuple[int, ...], int] = defaultdict(int)
    for kinds in open_at.values():
        for kind, times in kinds.items():
            plan[kind] += times
    return plan


def fullest_first(left: dict[int, int], capacity: int) -> dict[tuple[int, ...], int]:
    """The longest piece and those of the others that fill its sequence most, again and again; sums that can be reached are bits of an integer."""
    left, plan = dict(left), defaultdict(int)
    while left:
        first = max(left)
        room, reach = capacity - first, [1]
        sizes = sorted(n for n in left if n <= room)
        have = {n: min(left[n] - (n == first), room // n) for n in sizes}
        for n in sizes:
            bits, rest, step = reach[-1], have[n], 1
            while rest:
                step = min(step, rest)
                bits |= bits << step * n
                rest, step = rest - step, step * 2
            reach.append(bits & (2 << room) - 1)
        total, kind = reach[-1].bit_length() - 1, [first]
        for at in range(len(sizes), 0, -1):
            n = sizes[at - 1]
            times = next(m for m in range(min(have[n], total // n), -1, -1) if reach[at - 1] >> total - m * n & 1)
            kind += [n] * times
            total -= times * n
        times = min(left[n] // kind.count(n) for n in set(kind))
        plan[tuple(kind)] += times
        for n in set(kind):
            left[n] -= times * kind.count(n)
            if not left[n]:
                del left[n]
    return plan


def least_sequences(left: dict[int, int], capacity: int) -> int:
    """A lower bound: pieces of which no two go together, and what the others need beyond the room beside them."""
    best = 0
    for limit in {0, *(n for n in left if 2 * n <= capacity)}:
        large = sum(c for n, c in left.items() if n > capacity - limit)
        half = [(n, c) for n, c in left.items() if capacity - limit >= n and 2 * n > capacity]
        small = sum(n * c for n, c in left.items() if limit <= n and 2 * n <= capacity)
        over = small - sum(c * (capacity - n) for n, c in half)
        best = max(best, large + sum(c for _, c in half) + max(0, -(-over // capacity)))
    return best


def packing_plan(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, sequences of that kind) for a histogram of lengths from 1 to ``capacity``."""
    left = {n: c for n, c in counts.items() if c}
    plan = fixed_by_dominance(left, capacity)
    rest = best_fit(left, capacity)
    if sum(rest.values()) > least_sequences(left, capacity):
        rest = min(rest, fullest_first(left, capacity), key=lambda p: sum(p.values()))
    for kind, times in rest.items():
        plan[kind] += times
    return sorted(plan.items(), reverse=True)


def _slots(plan: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, end rank, first sequence, offset) for each place of each kind of sequence."""
    out, used, sequence = [], defaultdict(int), 0
    for kind, times in plan:
        offset = 0
        for n in kind:
            out.append((n, used[n], used[n] + times, sequence, offset))
            used[n] += times
            offset += n
        sequence += times
    return out


def pack_pieces(pieces: DataFrame, capacity: int) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to rows with a ``length`` of 1 to ``capacity``; ``id`` and ``piece`` order them.

    The driver gets one count per length, ``capacity`` at most. The slots are
    few (a group of equal sequences is one entry), but each part of the join is keyed by length and
    rank group, so that no size need be assumed.
    """
    spark = pieces.sparkSession
    salted = pieces.withColumn("g", F.pmod(F.xxhash64("id", "piece"), F.lit(NUMBERING)))
    sizes = stored(salted.groupBy("length", "g").count(), "lengths")
    counts = {r.length: r.n for r in sizes.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    before = Window.partitionBy("length").orderBy("g").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("length", "g", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"), "count")
    schema = "length long, lo long, hi long, first long, offset long"
    slots = spark.createDataFrame(_slots(packing_plan(counts, capacity)), schema)
    # Which slots a numbering group's ranks fall into; then each piece meets only its own group's.
    meet = bases.join(slots, "length").where((F.col("lo") < F.col("base") + F.col("count")) & (F.col("hi") > F.col("base")))
    meet = meet.groupBy("length", "g").agg(F.first("base").alias("base"), F.array_sort(F.collect_list(F.struct("lo", "hi", "first", "offset"))).alias("slots"))
    rank = F.row_number().over(Window.partitionBy("length", "g").orderBy("id", "piece", "start", "ids_crc32")) - 1
    placed = salted.withColumn("r", rank).join(meet, ["length", "g"]).withColumn("r", F.col("r") + F.col("base"))
    slot = F.filter("slots", lambda s: (s["lo"] <= F.col("r")) & (s["hi"] > F.col("r")))[0]
    placed = placed.withColumn("slot", slot)
    return placed.select(*pieces.columns, (F.col("slot.first") + F.col("r") - F.col("slot.lo")).alias("sequence_id"), F.col("slot.offset").alias("offset"))


def pack_documents(docs: DataFrame, ranks_path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset.

    A null text is empty: its one piece is the end id. Rows that repeat an id are packed each
    on its own; null ids are packed too. Of equal pieces of one id it is open which goes where. An empty table gives no
    rows. Long texts are tokenised alone, so memory follows the longest one. Extra columns, of whatever names, are not looked at.
    """
    pieces = stored(token_pieces(docs, ranks_path, capacity, end_id, id_col, text_col), "pieces")
    return pack_pieces(pieces, capacity).withColumnRenamed("id", id_col)
