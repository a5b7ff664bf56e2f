"""Parts of reads that are placed on the reference again, and what becomes of their alignments."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from segmentry.functions import cigar as C
from segmentry.operators.genome import genome_slice, stranded
from segmentry.operators.junctions import base_affix_length, insertion_flanks
from segmentry.shared import stored


#: Bases of a piece that seeds are cut from.
PIECE = 256


def _seeds(df: DataFrame, key: str, bases: str, k: int, at: str) -> DataFrame:
    """A row for each run of ``k`` bases: key, ``seed`` and its place from 0.

    Finding the n-th base of a text takes n steps, so texts are first cut into pieces, in one pass, and the work grows with their length and not with its square.
    """
    pieces = F.regexp_extract_all(F.col(bases), F.lit(f"(?s)(?=(.{{1,{PIECE + k - 1}}})).{{1,{PIECE}}}"), F.lit(1))
    x = df.where(F.length(bases) >= k).select(key, *(c for c in df.columns if c not in (key, bases)), F.posexplode(pieces).alias("_n", "_piece")).where(F.length("_piece") >= k)
    x = x.withColumn("_i", F.explode(F.sequence(F.lit(0), F.length("_piece") - k)))
    return x.withColumn("seed", F.substring(F.col("_piece"), F.col("_i") + 1, F.lit(k))).withColumn(at, F.col("_n") * PIECE + F.col("_i")).drop("_n", "_piece", "_i")


def turned(queries: DataFrame) -> DataFrame:
    """query, strand and bases: each query as it is and reverse-complemented."""
    both = F.array(F.struct(F.lit("+").alias("strand"), "bases"), F.struct(F.lit("-").alias("strand"), C.reverse_complement(F.col("bases")).alias("bases")))
    return queries.select("query", F.explode(both).alias("q")).select("query", "q.*")


#: Letters as numbers of two bits; 4 for what is no base.
_NUMBER = np.full(256, 4, np.uint8)
_NUMBER[list(b"ACGT")] = range(4)
#: Sets of seeds are sets of bits by their last 28 bits, 32 MB however many seeds there are. For seeds of up to 14 bases they are exact; of longer ones they let some more pass, which meet nothing in the joins.
BITS = 28
#: Bases that are looked at together, and seeds that a part of the join has about.
STEP, PART = 1 << 21, 1 << 18
#: Seeds that one row has at most, and bases: two bits each in a long.
ROW, LONGEST = 8, 31


def _windows(texts: pa.Array, k: int, step: int = STEP) -> Iterator[tuple[np.ndarray, ...]]:
    """(numbers of the letters, seeds of ``k`` letters as numbers, which of them are bases of one text, row and place in it) for each stretch of the texts put together."""
    texts = texts.fill_null("").cast(pa.large_string())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if not len(texts) or ends[-1] - ends[0] < k:
        return
    letters = np.frombuffer(texts.buffers()[2], np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    for begin in range(0, len(letters) - k + 1, step):
        x = _NUMBER[letters[begin : begin + step + k - 1]]
        n = len(x) - k + 1
        seed, good = np.zeros(n, np.int64), np.ones(n, bool)
        for i in range(k):
            seed = (seed << 2) | (x[i : i + n] & 3)
        bad = np.flatnonzero(x == 4)
        for i in range(k) if len(bad) else ():
            at = bad - i
            good[at[(at >= 0) & (at < n)]] = False
        place = np.arange(begin, begin + n)
        row = np.searchsorted(ends, place, "right") - 1
        yield x, seed, good & (place + k <= ends[row + 1]), row, place - ends[row]


def _among(seed: np.ndarray, bits: np.ndarray) -> np.ndarray:
    low = seed & (8 * len(bits) - 1)
    return (bits[low >> 3] >> (low & 7).astype(np.uint8)) & 1 == 1


def _bits(*sets: DataFrame) -> list[Broadcast]:
    """The ``seed`` of each of the tables as a set of bits, at every task."""
    out = []
    for seeds in sets:
        low = F.col("seed") % (1 << BITS)
        rows = seeds.groupBy((low / 32768).cast("int").alias("b")).agg(F.bitmap_construct_agg(low % 32768).alias("v")).collect()
        bits = np.zeros(1 << (BITS - 3), np.uint8)
        for r in rows:
            bits[r.b * 4096 : r.b * 4096 + 4096] = np.frombuffer(r.v, np.uint8)
        out.append(seeds.sparkSession.sparkContext.broadcast(bits))
    return out


def _numbered(df: DataFrame, bases: str, k: int, bits: Broadcast | None = None) -> DataFrame:
    """seed and n: how often the seeds of ``k`` bases stand in the texts, those of ``bits`` only. A task has several rows of a seed if it has many seeds."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def rows() -> pa.RecordBatch:
            seed, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(seed), pa.array(n, pa.int64())], ["seed", "n"])

        for batch in batches:
            for _, seed, good, _, _ in _windows(batch.column(0), k):
                held.append(seed[good if bits is None else good & _among(seed, bits.value)])
                size += len(held[-1])
                if size >= 4 * STEP:
                    yield rows()
                    size = 0
        if held:
            yield rows()

    return df.select(bases).mapInArrow(count, "seed long, n long")


def _parts(df: DataFrame, keys: list[str], bases: str, k: int, at: str, bits: Broadcast, parts: int) -> DataFrame:
    """A row for each run of neighbouring seeds of ``bits``: part, keys, the place of the first, their bases as a number and how many seeds they are.

    The part comes from the least of the shorter words in a seed, so equal seeds have the same part, and neighbours often.
    """
    m, most = max(1, k - 4), min(ROW, LONGEST + 1 - k)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, seed, good, row, place in _windows(batch.column(len(keys)), k):
                here = np.flatnonzero(good & _among(seed, bits.value))
                if not len(here):
                    continue
                word = np.zeros(len(x) - m + 1, np.uint64)
                for i in range(m):
                    word = (word << np.uint64(2)) | (x[i : i + len(word)] & 3)
                word = (word * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)
                least = word[: len(seed)]
                for i in range(1, k - m + 1):
                    least = np.minimum(least, word[i : i + len(seed)])
                part = (((least[here] * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(33)) % np.uint64(parts)).astype(np.int32)
                # A row begins where the part, the text or the place doesn't go on, and after so many seeds.
                new = np.ones(len(here), bool)
                new[1:] = (np.diff(here) != 1) | (np.diff(part) != 0) | (np.diff(row[here]) != 0)
                first = np.flatnonzero(new)
                new |= (np.arange(len(here)) - np.repeat(first, np.diff(np.append(first, len(here))))) % most == 0
                first = np.flatnonzero(new)
                n = np.diff(np.append(first, len(here)))
                code = seed[here[first]]
                for i in range(1, most):
                    more = n > i
                    code[more] = (code[more] << 2) | (seed[here[first[more] + i]] & 3)
                own = [batch.column(c).take(pa.array(row[here[first]])) for c in range(len(keys))]
                columns = [pa.array(part[first]), *own, pa.array(place[here[first]], pa.int32()), pa.array(code), pa.array(n, pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, ["part", *keys, at, "code", "n"])

    schema = T.StructType([T.StructField("part", T.IntegerType()), *(df.schema[c] for c in keys), T.StructField(at, T.IntegerType()), T.StructField("code", T.LongType()), T.StructField("n", T.IntegerType())])
    return df.select(*keys, bases).mapInArrow(cut, schema)


def _unrolled(rows: pa.Table, at: str, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of the row, place, seed) of each seed of ``_parts``."""
    n, place, code = (rows.column(c).to_numpy() for c in ("n", at, "code"))
    row = np.repeat(np.arange(len(n)), n)
    i = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    return row, place[row].astype(np.int64) + i, (code[row] >> (2 * (n[row] - 1 - i))) & ((1 << (2 * k)) - 1)


def _shared(asked: DataFrame, there: DataFrame, k: int, most: int) -> DataFrame:
    """Runs of seeds that both have on one diagonal, as far as they are in one part: query, strand, contig, d, first and last place in the query, n. All places of a seed are in one part, so those of more than ``most`` are left out here."""
    schema = T.StructType([asked.schema["query"], asked.schema["strand"], there.schema["contig"], *(T.StructField(c, T.IntegerType()) for c in ("d", "i0", "i1", "n"))])

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        q_row, q_at, q_seed = _unrolled(left, "i", k)
        c_row, c_at, c_seed = _unrolled(right, "pos", k)
        order = np.argsort(c_seed, kind="stable")
        c_row, c_at, c_seed = c_row[order], c_at[order], c_seed[order]
        lo, hi = np.searchsorted(c_seed, q_seed, "left"), np.searchsorted(c_seed, q_seed, "right")
        hi = np.where(hi - lo > most, lo, hi)
        kinds = [left.column(c).combine_chunks().dictionary_encode() for c in ("query", "strand")] + [right.column("contig").combine_chunks().dictionary_encode()]
        q_kind = kinds[0].indices.to_numpy().astype(np.int64) * max(1, len(kinds[1].dictionary)) + kinds[1].indices.to_numpy()
        c_kind = kinds[2].indices.to_numpy().astype(np.int64)
        # A query's seeds lie together; slices end where a query does, as runs are made within them.
        order = np.lexsort((q_at, q_kind[q_row]))
        lo, hi, q_at, q_row = lo[order], hi[order], q_at[order], q_row[order]
        made = np.cumsum(hi - lo)
        out, begin = [], 0
        while begin < len(lo):
            done = made[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(made, done + STEP, "right")))
            size = hi[begin:end] - lo[begin:end]
            q = np.repeat(np.arange(begin, end), size)
            c = np.arange(len(q)) - np.repeat(np.cumsum(size) - size, size) + lo[q]
            a, b, i = q_kind[q_row[q]], c_kind[c_row[c]], q_at[q]
            d = c_at[c] - i
            order = np.lexsort((i, d, b, a))
            a, b, d, i = a[order], b[order], d[order], i[order]
            if len(a):
                new = np.append(True, (np.diff(a) != 0) | (np.diff(b) != 0) | (np.diff(d) != 0) | (np.diff(i) > k))
                first = np.flatnonzero(new)
                last = np.append(first[1:], len(a)) - 1
                out.append((a[first], b[first], d[first], i[first], i[last], last - first + 1))
            begin = end
        a, b, *rest = (np.concatenate(c) for c in zip(*out, strict=True)) if out else [np.zeros(0, np.int64)] * 6
        strands = max(1, len(kinds[1].dictionary))
        columns = [kinds[0].dictionary.take(pa.array(a // strands)), kinds[1].dictionary.take(pa.array(a % strands)), kinds[2].dictionary.take(pa.array(b))]
        return pa.Table.from_arrays([*columns, *(pa.array(c, pa.int32()) for c in rest)], ["query", "strand", "contig", "d", "i0", "i1", "n"])

    return asked.groupBy("part").cogroup(there.groupBy("part")).applyInArrow(meet, schema)


def seed_blocks(queries: DataFrame, reference: DataFrame, k: int = 14, most: int = 64, least: int = 20) -> DataFrame:
    """Where bases of queries (query, bases) and of contigs (contig, bases) agree: query, strand, contig, q0, q1, p0, p1, n, the query's seeds in the block, and ``alone``: is it a whole query, and so a hit of its own?

    Blocks are runs of shared seeds of ``k`` bases (A, C, G and T) on one diagonal, each seed next to the one before or overlapping it; those of a query, strand and contig that have fewer than ``least`` seeds in all are left out, as no
    chain of them counts. Only the queries are turned, so the reference is cut into seeds once for their numbers and once for their places. A seed
    that stands at more than ``most`` places of the reference doesn't make blocks, so rows are at most ``most`` times the queries' seeds. A query
    the rest of whose seeds are fewer than ``least`` is looked up whole instead, by its rarest seed, at the first and the last place of each run of it: a stretch of one
    base is one row, however long it is.

    Seeds of the reference that no query has, and those of too many places, are dropped where they are cut, by sets of bits, and neighbouring ones are one row, so what is exchanged and stored follows the places that are looked at.
    """
    if k > LONGEST:
        raise ValueError(f"seeds of more than {LONGEST} bases")
    both = stored(turned(queries), "turned")
    (asked,) = _bits(_numbered(both, "bases", k))
    counts = stored(_numbered(reference, "bases", k, asked).groupBy("seed").agg(F.sum("n").alias("n")), "counts")
    few, many = _bits(counts.where(F.col("n") <= most), counts.where(F.col("n") > most))
    parts = int((counts.where(F.col("n") <= most).agg(F.sum("n")).first()[0] or 0) // PART) + 1
    shared = _shared(_parts(both, ["query", "strand"], "bases", k, "i", few, parts), _parts(reference, ["contig"], "bases", k, "pos", few, parts), k, most)
    # All that follows is by query, strand and contig, so it is exchanged once.
    shared = shared.repartition("query", "strand", "contig").withColumn("_all", F.sum("n").over(Window.partitionBy("query", "strand", "contig"))).where(F.col("_all") >= least)
    line = Window.partitionBy("query", "strand", "contig", "d").orderBy("i0")
    before = F.max("i1").over(line.rowsBetween(Window.unboundedPreceding, -1))
    shared = shared.withColumn("new", F.when(F.col("i0") - before <= k, 0).otherwise(1)).withColumn("run", F.sum("new").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    runs = shared.groupBy("query", "strand", "contig", "d", "run").agg(F.min("i0").alias("q0"), (F.max("i1") + k).alias("q1"), F.sum("n").alias("n"))
    blocks = runs.select("query", "strand", "contig", "q0", "q1", (F.col("q0") + F.col("d")).alias("p0"), (F.col("q1") + F.col("d")).alias("p1"), "n", F.lit(False).alias("alone"))

    whole = stored(_whole(both, counts, few, many, k, most, least), "whole")
    if whole.isEmpty():
        return blocks
    reach = whole.agg(F.max("i").alias("before"), F.max(F.length("bases") - F.col("i")).alias("after")).first()
    places = _around(reference, "bases", k, _bits(whole.select("seed").distinct())[0], reach["before"], reach["after"])
    tried = whole.join(places, "seed").withColumn("p0", F.col("pos") - F.col("i")).where(F.substring("around", F.col("lead") - F.col("i") + 1, F.length("bases")) == F.col("bases"))
    exact = tried.where("p0 >= 0").select("query", "strand", "contig", F.lit(0).alias("q0"), F.length("bases").alias("q1"), "p0", (F.col("p0") + F.length("bases")).alias("p1"), F.col("seeds").alias("n"), F.lit(True).alias("alone"))
    # What few places gave such a query is part of these.
    return blocks.join(whole.select("query", "strand"), ["query", "strand"], "left_anti").unionByName(exact)


def _around(df: DataFrame, bases: str, k: int, bits: Broadcast, before: int, after: int) -> DataFrame:
    """contig, pos and seed of the first and the last place of each run of a seed of ``bits``, with the bases ``around`` it: ``lead`` of them, ``before`` at most, stand before the place."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, seed, good, row, place in _windows(batch.column(1), k):
                texts = batch.column(1)
                here = np.flatnonzero(good & _among(seed, bits.value))
                for begin in range(0, len(here), 1 << 16):
                    at = here[begin : begin + (1 << 16)]
                    rows = []
                    for j, r, p in zip(at.tolist(), row[at].tolist(), place[at].tolist(), strict=True):
                        text = texts[r].as_py() if not rows or rows[-1][0] != r else text
                        word = text[p : p + k]
                        # Two neighbouring places have the same seed if it is of one base, which goes on there.
                        if text[max(0, p - 1) : p] + word != word[0] * (k + 1) or word + text[p + k : p + k + 1] != word[0] * (k + 1):
                            rows.append((r, p, int(seed[j]), text[max(0, p - before) : p + after], min(p, before)))
                    if rows:
                        r, *rest = zip(*rows, strict=True)
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(r)), *map(pa.array, rest)], schema=pa.schema([batch.schema.field(0).with_name("contig"), ("pos", pa.int64()), ("seed", pa.int64()), ("around", pa.string()), ("lead", pa.int64())]))

    schema = T.StructType([df.schema["contig"], *(T.StructField(c, t) for c, t in (("pos", T.LongType()), ("seed", T.LongType()), ("around", T.StringType()), ("lead", T.LongType())))])
    return df.select("contig", bases).mapInArrow(cut, schema).withColumns({"pos": F.col("pos").cast("int"), "lead": F.col("lead").cast("int")})


def _whole(both: DataFrame, counts: DataFrame, few: Broadcast, many: Broadcast, k: int, most: int, least: int) -> DataFrame:
    """query, strand, bases, seeds, i and seed: queries that are looked up whole, with the number of their seeds, and their rarest one and its place."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = len(batch)
            n = np.maximum(pc.fill_null(pc.binary_length(batch.column(2)), 0).to_numpy() - k + 1, 0)
            frequent, known = np.zeros(size, np.int64), np.zeros(size, np.int64)
            for _, seed, good, row, _ in _windows(batch.column(2), k):
                often = good & _among(seed, many.value)
                frequent += np.bincount(row[often], minlength=size)
                known += np.bincount(row[often | (good & _among(seed, few.value))], minlength=size)
            yield batch.filter(pa.array((frequent > 0) & (n - frequent < least) & (known == n)))

    # For longer seeds than the sets of bits tell apart, this is all of them and some more.
    maybe = both.select("query", "strand", "bases").mapInArrow(keep, both.select("query", "strand", "bases").schema)
    seeds = _seeds(maybe, "query", "bases", k, "i").withColumn("seed", F.conv(F.translate("seed", "ACGT", "0123"), 4, 10).cast("long"))
    often = F.col("n") > most
    seen = seeds.join(counts, "seed", "left").groupBy("query", "strand").agg(F.count("*").alias("seeds"), F.count_if(often).alias("many"), F.min(F.when(often, F.struct("n", "i", "seed"))).alias("rarest"), F.count_if(F.col("n").isNull()).alias("absent"))
    seen = seen.where((F.col("many") > 0) & (F.col("seeds") - F.col("many") < least) & (F.col("absent") == 0))
    return seen.join(maybe, ["query", "strand"]).select("query", "strand", "bases", "seeds", "rarest.i", "rarest.seed").distinct()


def chained(blocks: DataFrame, reach: int = 1000, shift: int = 100, least: int = 20) -> DataFrame:
    """``blocks`` with ``hit``, a number that the chain that they are in has alone among those of the query, strand and contig, ``score`` (its seeds), ``n_blocks``, ``hit_start`` and ``hit_end``; chains of ``least`` seeds and more.

    Along the contig, a block goes on from the one before if it ends later in both, lies within ``reach`` of its end and has at most ``shift`` more of the query than of the contig between them; so a deletion
    or an intron up to ``reach`` and an insertion up to ``shift`` stay within a hit.
    """
    w = Window.partitionBy("query", "strand", "contig").orderBy("p0", "q0", "p1")
    last = lambda c: F.lag(c).over(w)
    on = (F.col("q0") > last("q0")) & (F.col("q1") > last("q1")) & (F.col("p0") > last("p0")) & (F.col("p1") > last("p1")) & (F.col("p0") - last("p1") <= reach)
    on = on & (F.col("p0") - F.col("q0") - last("p0") + last("q0") >= -shift)
    # Whole queries all begin at 0, so none goes on from another: they need no order, and however many they are, they aren't exchanged.
    alone = blocks.where("alone").withColumns({"hit": F.col("p0").cast("long"), "score": F.col("n"), "hit_start": F.col("p0"), "hit_end": F.col("p1"), "n_blocks": F.lit(1).cast("long")})
    x = blocks.where("not alone").withColumn("new", F.when(F.coalesce(on, F.lit(False)), 0).otherwise(1)).withColumn("hit", F.sum("new").over(w)).drop("new")
    h = Window.partitionBy("query", "strand", "contig", "hit")
    x = x.withColumns({"score": F.sum("n").over(h), "hit_start": F.min("p0").over(h), "hit_end": F.max("p1").over(h), "n_blocks": F.count("*").over(h)})
    return x.unionByName(alone).where(F.col("score") >= least)


def seed_hits(queries: DataFrame, reference: DataFrame, k: int = 14, most: int = 64, reach: int = 1000, shift: int = 100, least: int = 20) -> DataFrame:
    """Where queries lie on contigs, on either strand: query, strand, contig, hit_start, hit_end, score and n_blocks of each chain of ``seed_blocks``."""
    x = chained(seed_blocks(queries, reference, k, most, least), reach, shift, least)
    # One block of a chain begins where it begins.
    return x.where(F.col("p0") == F.col("hit_start")).select("query", "strand", "contig", "hit_start", "hit_end", "score", "n_blocks")


def hit_alignments(hits: DataFrame, queries: DataFrame, reference: DataFrame, intron: int = 70) -> DataFrame:
    """``chained`` blocks as alignments: query, strand, contig, pos, cigar and nm of each hit.

    Where blocks overlap the later one begins later. Between blocks the bases that both have are aligned one by one, and the rest is an insertion, a deletion, or from ``intron`` bases on an
    intron; what stands outside of the first and the last block is clipped. ``nm`` counts inserted, deleted and unequal bases.
    """
    w = Window.partitionBy("query", "strand", "contig", "hit").orderBy("p0")
    end_q, end_p = F.lag("q1").over(w), F.lag("p1").over(w)
    alone = hits.where("alone").select("query", "strand", "contig", F.col("p0").alias("pos"), F.concat("q1", F.lit("M")).alias("cigar"), F.lit(0).alias("nm"))
    x = hits.where("not alone").withColumn("cut", F.greatest(F.coalesce(end_q - F.col("q0"), F.lit(0)), F.coalesce(end_p - F.col("p0"), F.lit(0)), F.lit(0)))
    x = x.withColumns({"q0": F.col("q0") + F.col("cut"), "p0": F.col("p0") + F.col("cut"), "end_q": end_q, "end_p": end_p})
    x = x.withColumns({"both": F.least(F.col("q0") - F.col("end_q"), F.col("p0") - F.col("end_p")), "more": F.col("p0") - F.col("end_p") - F.col("q0") + F.col("end_q")})
    # Few blocks have bases between them and the one before; these are stored, so that they go to the contigs, and not all contigs to them.
    x = stored(x.join(queries.select("query", F.length("bases").alias("q_len")), "query"), "hits")
    between = stored(x.where("both > 0").select("query", "strand", "contig", "p0", "hit", "end_q", "end_p", "both"), "between")
    y = between.join(turned(queries), ["query", "strand"]).join(reference.select("contig", F.col("bases").alias("own")), "contig")
    part = lambda c, at: F.substring(c, F.col(at) + 1, F.col("both"))
    y = y.select("query", "strand", "contig", "hit", "p0", "both", part("bases", "end_q").alias("a"), part("own", "end_p").alias("b"))
    y = y.select("query", "strand", "contig", "hit", "p0", F.expr("size(filter(sequence(1, both), i -> substring(a, i, 1) <> substring(b, i, 1)))").alias("unequal"))
    x = x.join(y, ["query", "strand", "contig", "hit", "p0"], "left")
    x = x.withColumn("off", F.coalesce("unequal", F.lit(0)) + F.when(F.col("more") >= intron, 0).otherwise(F.coalesce(F.abs("more"), F.lit(0))))
    gap = F.when(F.col("more") >= intron, F.concat("more", F.lit("N"))).when(F.col("more") > 0, F.concat("more", F.lit("D"))).when(F.col("more") < 0, F.concat(-F.col("more"), F.lit("I"))).otherwise("")
    text = F.concat(F.when(F.col("both") > 0, F.concat("both", F.lit("M"))).otherwise(""), F.coalesce(gap, F.lit("")), F.concat(F.col("q1") - F.col("q0"), F.lit("M")))
    rows = x.groupBy("query", "strand", "contig", "hit").agg(
        F.min("p0").alias("pos"), F.min("q0").alias("lead"), (F.max("q_len") - F.max("q1")).alias("tail"), F.sum("off").cast("int").alias("nm"), F.array_sort(F.collect_list(F.struct("p0", text.alias("t")))).alias("ts")
    )
    clip = lambda c: F.when(F.col(c) > 0, F.concat(c, F.lit("S"))).otherwise("")
    cigar = C.normalized(F.concat(clip("lead"), F.array_join(F.transform("ts", lambda t: t["t"]), ""), clip("tail")))
    return rows.select("query", "strand", "contig", "pos", cigar.alias("cigar"), "nm").unionByName(alone)


def clip_alignment(clips: DataFrame, genome: DataFrame, most_shared: int = 10, max_nm: int = 100) -> DataFrame:
    """Alignments of placed soft clips, as entries of the read's list: ``sa_start``, ``sa_cigar``, ``sa_mapq``.

    Rows are the read (strand, mode, q_len, bases as sequenced, clip_len) and the hit (chrom, hit_start, hit_end, hit_strand, hit_cigar, hit_nm).
    Where the hit begins or ends with matches toward the read's own part, it grows over the bases that both share there; more than ``most_shared`` point
    to template switching, and the clip isn't used, nor one of ``max_nm`` mismatches or more.
    """
    reach = most_shared + 5
    outer = (F.col("strand") == "+") == (F.col("mode") == "MS")  # the clip is the read's end
    n, clip = F.length("bases"), F.col("clip_len")
    first = F.greatest(n - clip - reach, F.lit(0))
    own = F.when(outer, F.substring(F.col("bases"), first + 1, n - clip - first)).otherwise(F.substring(F.col("bases"), clip + 1, F.lit(reach)))
    same = F.col("strand") == F.col("hit_strand")
    x = clips.withColumn("_own", own).withColumn("_left", F.when(same, F.col("mode") == "MS").otherwise(F.col("mode") == "SM"))  # is the hit's clip on the left?
    x = x.withColumn("_grows", F.when(F.col("_left"), F.rlike("hit_cigar", F.lit("^[0-9]+M"))).otherwise(F.rlike("hit_cigar", F.lit("[0-9]+M$"))))
    x = x.withColumn("_a", F.when(F.col("_left"), F.col("hit_start") - reach).otherwise(F.col("hit_end"))).withColumn("_b", F.col("_a") + reach)
    x = genome_slice(x, genome, "chrom", "_a", "_b", "_ref").withColumn("_ref", stranded(F.col("_ref"), F.col("hit_strand")))
    suffix = F.col("_left") == (F.col("hit_strand") == "+")
    shared = F.when(suffix, base_affix_length(F.col("_ref"), F.col("_own"), True)).otherwise(base_affix_length(F.col("_ref"), F.col("_own"), False))
    x = x.withColumn("shared", F.when(F.col("_grows"), F.coalesce(shared, F.lit(0))).otherwise(0))
    # What is put before or behind the hit: the shared matches, or the rest of the read as a clip. It is united with the hit's own operation there, so little is left to normalize.
    rest, hit = F.col("q_len") - clip - F.col("shared"), F.col("hit_cigar")
    x = x.withColumn("_edge", F.when(F.col("_left"), F.regexp_extract(hit, "^[0-9]+[A-Z=]", 0)).otherwise(F.regexp_extract(hit, "[0-9]+[A-Z=]$", 0)))
    x = x.withColumn("_kind", F.when(F.col("shared") > 0, "M").otherwise("S")).withColumn("_size", F.when(F.col("shared") > 0, F.col("shared")).otherwise(rest))
    own = F.left("_edge", F.length("_edge") - 1).try_cast("int")
    x = x.withColumn("_united", (F.right("_edge", F.lit(1)) == F.col("_kind")) & own.isNotNull() & (F.col("_size") >= 0))
    x = x.withColumn("_op", F.concat((F.col("_size") + F.when(F.col("_united"), own).otherwise(0)).cast("string"), "_kind")).withColumn("_gone", F.when(F.col("_united"), F.length("_edge")).otherwise(0))
    outer_clip = F.when((F.col("shared") > 0) & (rest != 0), F.concat(rest.cast("string"), F.lit("S"))).otherwise("")
    text = F.when(F.col("_left"), F.concat(outer_clip, "_op", F.substring(hit, F.col("_gone") + 1, F.length(hit)))).otherwise(F.concat(F.left(hit, F.length(hit) - F.col("_gone")), "_op", outer_clip))
    x = x.withColumn("_text", text)
    x = x.withColumn("sa_start", F.when(F.col("_left"), F.col("hit_start") - F.col("shared")).otherwise(F.col("hit_start"))).withColumn("sa_cigar", C.normalized(F.col("_text"))).withColumn("sa_mapq", F.lit(60))
    return x.where((F.col("shared") <= most_shared) & (F.col("hit_nm") < max_nm)).drop("_own", "_left", "_grows", "_a", "_b", "_ref", "_edge", "_kind", "_size", "_united", "_op", "_gone", "_text")


def insertion_alignment(reads: DataFrame, near: int = 10, max_nm: int = 100) -> DataFrame:
    """A long insertion that was placed beside its own locus parts the read in two: ``primary_cigar``, ``sa_cigar`` and ``sa_nm``.

    Rows are the read (chrom, strand, ref_start, ref_end, cigar, nm, ins_pos, ins_len) and the hit (hit_chrom, hit_strand, hit_start, hit_end, hit_cigar, hit_nm).
    """
    flank = insertion_flanks(F.col("cigar"), F.col("ins_len"))
    x = reads.select("*", *(c.alias(f"_{n}") for n, c in flank.items()), C.total(C.operations(F.col("cigar")), "MIS").alias("_n"))
    after = (F.abs(F.col("hit_start") - F.col("ins_pos")) <= near) & (F.col("hit_end") <= F.col("ref_end"))
    before = (F.abs(F.col("hit_end") - F.col("ins_pos")) <= near) & (F.col("hit_start") >= F.col("ref_start"))
    x = x.where((F.col("hit_chrom") == F.col("chrom")) & (F.col("hit_strand") == F.col("strand")) & (after | before))
    clip = lambda n: F.concat(n.cast("string"), F.lit("S"))
    x = x.withColumn("primary_cigar", C.normalized(F.concat(clip(F.col("_n") - F.col("_after_len")), "_after")))
    x = x.withColumn("sa_cigar", C.normalized(F.concat("_before", "hit_cigar", clip(F.col("_n") - F.col("_before_len") - F.col("ins_len")))))
    x = x.withColumn("sa_nm", F.col("nm") - F.col("ins_len") + F.col("hit_nm")).where(F.col("sa_nm") < max_nm)
    return x.drop("_before", "_after", "_before_len", "_after_len", "_n")


def extended_chains(chains: DataFrame, ends: DataFrame, hits: DataFrame, least: int = 20, long: int = 200, mapq: int = 20) -> DataFrame:
    """Chains with a segment more where their unaligned first or last part was placed.

    ``chains``: read_id, place, chrom, ref_start, strand, mapq. ``ends``: read_id, side ('start' or 'end') and part_len. ``hits``: read_id, side, chrom,
    ref_start, strand, mapq. Parts under ``least`` aren't looked at. A read is rejected if a part of ``long`` or more has no hit or a poor one; hits on
    the mitochondrion add nothing. Any hit with a quality counts as sure.
    """
    found = hits.select("read_id", "side", F.struct("chrom", "ref_start", "strand", F.when(F.col("mapq") > 0, 60).otherwise(0).alias("mapq")).alias("hit"))
    x = ends.where(F.col("part_len") >= least).join(found, ["read_id", "side"], "left")
    poor = (F.col("part_len") >= long) & (F.coalesce("hit.mapq", F.lit(0)) < mapq)
    rejected = x.where(poor).select("read_id").distinct()
    bounds = chains.groupBy("read_id").agg(F.min("place").alias("lo"), F.max("place").alias("hi"))
    new = x.where(F.col("hit").isNotNull() & ~F.col("hit.chrom").isin("chrM", "MT")).join(bounds, "read_id")
    new = new.select("read_id", F.when(F.col("side") == "start", F.col("lo") - 1).otherwise(F.col("hi") + 1).alias("place"), "hit.*")
    own = chains.select("read_id", "place", "chrom", "ref_start", "strand", "mapq").withColumn("added", F.lit(False))
    return own.unionByName(new.withColumn("added", F.lit(True))).join(rejected, "read_id", "left_anti")


def rescued(candidates: DataFrame, references: DataFrame, keys: list[str], mismatches: int = 3, share: float = 0.8) -> DataFrame:
    """Candidates (keys, read_id, clip) whose clip is like one of the ``references`` (keys, clip) of the same side.

    Clips are equal but for ``mismatches`` edits, and the shorter one has ``share`` of the longer. Different clips of a side meet once, however many reads have them.
    """
    q, t = candidates.select(*keys, F.col("clip").alias("q")).distinct(), references.select(*keys, F.col("clip").alias("t")).distinct()
    alike = (F.levenshtein("q", "t", mismatches) >= 0) & (F.least(F.length("q"), F.length("t")) >= F.lit(share) * F.greatest(F.length("q"), F.length("t")))
    good = q.join(t, keys).where(alike).select(*keys, F.col("q").alias("clip")).distinct()
    return candidates.join(good, [*keys, "clip"], "left_semi")


def rescued_support(links: DataFrame, up: DataFrame, down: DataFrame, cap: int | None) -> DataFrame:
    """``links`` (link, node1, node2, sr) with the reads rescued at both nodes (node, read_id); a read that counts upstream doesn't downstream again, each count is ``cap`` at most."""
    one = up.select(F.col("node").alias("node1"), "read_id").distinct()
    n1 = one.groupBy("node1").agg(F.count("*").alias("n1"))
    # By the nodes of a link and not by its name, which may be long.
    two = links.select("node1", "node2").distinct().join(down.select(F.col("node").alias("node2"), "read_id").distinct(), "node2").join(one, ["node1", "read_id"], "left_anti")
    n2 = two.groupBy("node1", "node2").agg(F.count("*").alias("n2"))
    number = lambda c: F.coalesce(c, F.lit(0))
    most = lambda c: number(c) if cap is None else F.least(number(c), F.lit(cap))
    x = links.join(n1, "node1", "left").join(n2, ["node1", "node2"], "left")
    return x.select("link", F.col("sr").alias("original_sr"), (F.col("sr") + most("n1") + most("n2")).alias("sr"))

