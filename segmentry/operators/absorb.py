"""Paths within longer paths and what takes them in, consensus of reads."""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from segmentry.functions.cigar import gaps
from segmentry.operators.compat import compatible
from segmentry.shared import stored


#: Identities of a path's node and of the container's node that it may be.
WITHIN = (("HEAD", "HEAD"), ("HEAD", "MID"), ("MID", "MID"), ("TAIL", "MID"), ("TAIL", "TAIL"))


@dataclass
class Paths:
    """Tables of paths.

    ``steps``: path_id, place (from 0), n (steps of the path), node_id (each in one step), chrom, strand, ident, genuine and exons; gap, pos1 and pos2 of the hop to the next step, null for the
    last. ``hop_reads``: path_id, place and read_id, a row for each read of a hop.
    """

    steps: DataFrame
    hop_reads: DataFrame


def contained_paths(steps: DataFrame, tolerance: int = 10) -> DataFrame:
    """path_id, container and shift: the steps of a path are, one by one, steps of another one of its length or more, from place ``shift`` on.

    Nodes must have the same introns and count as one by the rule of their identities, hops the same payload. Each pair of such nodes votes for the paths and the shift that it
    stands for, and a shift with as many votes as the path has steps is a containment; so rows grow with the pairs of nodes. Of several shifts the first counts.
    """
    pairs = compatible(steps.select("node_id", "chrom", "strand", "ident", "genuine", "exons"), tolerance, list(WITHIN))
    both = pairs.select(F.col("node1").alias("inner"), F.col("node2").alias("outer")).unionByName(pairs.where("kind1 = kind2").select(F.col("node2").alias("inner"), F.col("node1").alias("outer")))
    x = steps.select("path_id", "place", "n", "node_id", "gap", gaps(F.col("exons")).alias("introns"))
    as_ = lambda side, prefix: x.select(*(F.col(c).alias(f"{prefix}_{c}") for c in x.columns)).withColumnRenamed(f"{prefix}_node_id", side)
    met = both.join(as_("inner", "p"), "inner").join(as_("outer", "q"), "outer")
    met = met.where("p_path_id <> q_path_id and q_n >= p_n and p_introns = q_introns and (p_gap is null or p_gap = q_gap)")
    votes = met.groupBy("p_path_id", "q_path_id", (F.col("q_place") - F.col("p_place")).alias("shift"), "p_n").agg(F.count("*").alias("votes"))
    return votes.where("votes = p_n").groupBy(F.col("p_path_id").alias("path_id"), F.col("q_path_id").alias("container")).agg(F.min("shift").alias("shift"))


def _ranks(steps: DataFrame) -> DataFrame:
    """path_id and rank: longer paths rank higher, then those with the larger texts of their nodes, then larger ids."""
    node = F.concat_ws(":", "chrom", F.array_join(F.transform("exons", lambda e: F.concat_ws("-", e["start"].cast("string"), e["end"].cast("string"))), ";"), "strand")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", node.alias("node")))), lambda s: s["node"]), "|")
    return steps.groupBy("path_id").agg(F.first("n").alias("n"), text.alias("text")).select("path_id", F.struct("n", "text", "path_id").alias("rank"))


def absorbers(found: DataFrame, ranks: DataFrame) -> DataFrame:
    """path_id, absorber and shift of each path that goes, as if paths took in what they contain one after the other, the highest rank first.

    A path goes if a container of higher rank stays, and stays if all of them go. What is decided in a round decides those below in the next; rounds are
    as many as the longest chain of containers.
    """
    above = found.join(ranks, "path_id").withColumnRenamed("rank", "own").join(ranks.select(F.col("path_id").alias("container"), "rank"), "container").where("rank > own")
    above = stored(above.select("path_id", "container", "shift", "rank"), "above")
    status = stored(above.select(F.col("container").alias("path_id")).join(above.select("path_id"), "path_id", "left_anti").distinct().withColumn("stays", F.lit(True)), "status")
    while True:
        left = above.join(status.select("path_id"), "path_id", "left_anti").join(status.withColumnRenamed("path_id", "container"), "container", "left")
        seen = left.groupBy("path_id").agg(F.max(F.coalesce("stays", F.lit(False))).alias("taken"), F.count_if(F.col("stays").isNull()).alias("open"))
        new = stored(seen.where("taken or open = 0").select("path_id", (~F.col("taken")).alias("stays")), "decided")
        if new.isEmpty():
            break
        status = stored(status.unionByName(new), "status")
    gone, staying = status.where("not stays").select("path_id"), status.where("stays").select(F.col("path_id").alias("container"))
    best = above.join(gone, "path_id", "left_semi").join(staying, "container", "left_semi").groupBy("path_id").agg(F.max_by(F.struct("container", "shift"), "rank").alias("b"))
    return best.select("path_id", F.col("b.container").alias("absorber"), F.col("b.shift").alias("shift"))


def absorb(paths: Paths, tolerance: int = 10) -> tuple[Paths, DataFrame]:
    """The paths that stay, with all that they took in, and path_id and absorber of every path (of those that stay, themselves).

    A node that took in others spans them all; a hop has the reads of all, and the outermost breakpoints. As nodes grow, a path may come to contain another
    that it didn't before, so the fold is repeated until no path contains another.
    """
    steps, reads = stored(paths.steps, "steps"), stored(paths.hop_reads, "hop_reads")
    names = stored(steps.select("path_id", F.col("path_id").alias("absorber")).distinct(), "names")
    while True:
        found = stored(contained_paths(steps, tolerance), "contained")
        if found.isEmpty():
            return Paths(steps, reads), names
        gone = stored(absorbers(found, _ranks(steps)), "absorbers")
        moved = lambda x: x.join(gone, "path_id", "left").withColumn("place", F.col("place") + F.coalesce("shift", F.lit(0)).cast("int")).withColumn("path_id", F.coalesce("absorber", "path_id"))
        lo, hi = F.min(F.element_at("exons", 1)["start"]).alias("lo"), F.max(F.element_at("exons", -1)["end"]).alias("hi")
        grown = moved(steps).groupBy("path_id", "place").agg(lo, hi, *(getattr(F, f)(c).alias(f"{f}_{c}") for f in ("min", "max") for c in ("pos1", "pos2")))
        last = F.size("exons") - 1
        exons = F.transform("exons", lambda e, i: F.struct(F.when(i == 0, F.col("lo")).otherwise(e["start"]).alias("start"), F.when(i == last, F.col("hi")).otherwise(e["end"]).alias("end")))
        kept = steps.join(gone.select("path_id"), "path_id", "left_anti").join(grown, ["path_id", "place"])
        following = F.lead("strand").over(Window.partitionBy("path_id").orderBy("place"))
        one, two = F.when(F.col("strand") == "+", F.col("max_pos1")).otherwise(F.col("min_pos1")), F.when(following == "+", F.col("min_pos2")).otherwise(F.col("max_pos2"))
        kept = kept.withColumns({"exons": exons, "_one": one, "_two": two}).withColumns({"pos1": F.when(F.col("gap").isNotNull(), F.col("_one")), "pos2": F.when(F.col("gap").isNotNull(), F.col("_two"))})
        steps, reads = stored(kept.select(*steps.columns), "steps"), stored(moved(reads).select("path_id", "place", "read_id").distinct(), "hop_reads")
        to = gone.select(F.col("path_id").alias("absorber"), F.col("absorber").alias("_to"))
        names = stored(names.join(to, "absorber", "left").select("path_id", F.coalesce("_to", "absorber").alias("absorber")), "names")


def sorted_paths(paths: Paths, names: DataFrame, clusters: DataFrame) -> DataFrame:
    """path_id, cluster_id and place of each path that stays: in its cluster longer ones come first, then those that stand for more paths, with the higher score of payloads (2 for a blunt hop, 1 for shared bases),
    the larger text of spans, the smaller id. ``names`` are path_id and absorber, ``clusters`` node_id and cluster_id; the first node's cluster is the path's.
    """
    factor = names.groupBy(F.col("absorber").alias("path_id")).agg(F.count("*").alias("factor"))
    score = F.when(F.col("gap") == 0, 2).when(F.col("gap") < 0, 1).otherwise(0)
    span = F.concat("chrom", F.lit(":"), F.element_at("exons", 1)["start"].cast("string"), F.lit("-"), F.element_at("exons", -1)["end"].cast("string"), F.lit(":"), "strand")
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", span.alias("t")))), lambda s: s["t"]), "|")
    x = paths.steps.groupBy("path_id").agg(F.first("n").alias("n"), F.sum(score).alias("score"), whole.alias("text"), F.min_by("node_id", "place").alias("node_id"))
    w = Window.partitionBy("cluster_id").orderBy(F.desc("n"), F.desc("factor"), F.desc("score"), F.desc("text"), "path_id")
    return x.join(factor, "path_id").join(clusters, "node_id").select("path_id", "cluster_id", F.row_number().over(w).alias("place"))


#: Places in a piece of a read, and counts that are held at a time while pieces are counted.
PIECE, COUNTS = 256, 2**24


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The most frequent letter of each place for pieces (key, piece, part) that come in order of key and piece; what the last key and piece have so far is kept for the next rows."""
    names, held = None, None  # held: key, piece, letters and counts (place, letter)

    def rows(keys, pieces, letters: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        sizes = (counts.sum(axis=2) > 0).sum(axis=1)
        text = letters[counts.argmax(axis=2)].astype("<u4").tobytes().decode("utf-32-le") if len(letters) else ""
        return pa.RecordBatch.from_arrays([keys, pieces, pa.array([text[i * PIECE : i * PIECE + n] for i, n in enumerate(sizes)], pa.string())], names=names)

    for whole in batches:
        names, at = whole.schema.names, 0
        while at < whole.num_rows:
            # The letters of a batch are few; rows that are counted at a time follow from them.
            codes = np.frombuffer("".join(whole.column(2).slice(at).to_pylist()).encode("utf-32-le"), "<u4")
            step = max(1, COUNTS // (PIECE * max(1, len(np.unique(codes[:10_000])))))
            batch, at = whole.slice(at, step), at + step
            key, piece, part = batch.columns
            lengths = pc.utf8_length(part).to_numpy(zero_copy_only=False).astype(np.int64)
            codes = codes[: lengths.sum()]
            letters = np.flatnonzero(np.bincount(codes)).astype(np.uint32)
            n = batch.num_rows
            changes = pc.or_(pc.not_equal(key.slice(1), key.slice(0, n - 1)), pc.not_equal(piece.slice(1), piece.slice(0, n - 1))).to_numpy(zero_copy_only=False)
            starts = np.concatenate([[0], np.flatnonzero(changes) + 1])
            goes_on = held is not None and held[0][0] == key[0] and held[1][0] == piece[0]
            if held is not None and not goes_on:
                yield rows(*held[:3], held[3][None])
            if goes_on:
                letters = np.union1d(letters, held[2])
            group = np.repeat(np.searchsorted(starts, np.arange(n), side="right") - 1, lengths)
            place = np.arange(len(codes)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            index = (group * PIECE + place) * len(letters) + np.searchsorted(letters, codes)
            counts = np.bincount(index, minlength=len(starts) * PIECE * len(letters)).reshape(len(starts), PIECE, len(letters))
            if goes_on:
                counts[0][:, np.searchsorted(letters, held[2])] += held[3]
            keys, pieces = key.take(pa.array(starts)), piece.take(pa.array(starts))
            if len(starts) > 1:
                yield rows(keys.slice(0, len(starts) - 1), pieces.slice(0, len(starts) - 1), letters, counts[:-1])
            held = keys.slice(len(starts) - 1), pieces.slice(len(starts) - 1), letters, counts[-1].copy()
    if held is not None:
        yield rows(*held[:3], held[3][None])


def consensus(reads: DataFrame, key: str, bases: str) -> DataFrame:
    """The most frequent base of each place over the reads of a key; of equal ones the first letter. Reads are aligned at their start.

    Reads travel once, cut into pieces of ``PIECE`` places; the pieces of a key and a piece number come in turn and are counted as they come, so neither a row for each base is made nor all reads of a key held.
    """
    last = F.floor((F.greatest(F.length(bases), F.lit(1)) - 1) / PIECE).cast("int")
    pieces = reads.select(key, bases, F.explode(F.sequence(F.lit(0), last)).alias("piece")).select(key, "piece", F.substring(F.col(bases), F.col("piece") * PIECE + 1, F.lit(PIECE)).alias("part"))
    schema = T.StructType([T.StructField(key, reads.schema[key].dataType), T.StructField("piece", T.IntegerType()), T.StructField("part", T.StringType())])
    best = pieces.repartition(F.col(key), F.col("piece")).sortWithinPartitions(key, "piece").mapInArrow(_votes, schema)
    rows = best.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("piece", "part"))).alias("bs"))
    return rows.select(key, F.array_join(F.transform("bs", lambda b: b["part"]), "").alias("consensus"))


def best_annotated(exons: DataFrame, annotated: DataFrame, margin: int = 10) -> DataFrame:
    """Add to each exon (node_id, i, start, end) whether the annotated exon that it fills most fits within ``margin`` at both ends.

    ``annotated`` are pairs already joined by range, with tx, e_start and e_end.
    """
    w = Window.partitionBy("node_id", "i").orderBy(F.desc((F.col("end") - F.col("start")) / (F.col("e_end") - F.col("e_start"))), "e_start", "e_end")
    best = annotated.withColumn("_r", F.row_number().over(w)).where("_r = 1")
    fits = (F.abs(F.col("start") - F.col("e_start")) <= margin) & (F.abs(F.col("end") - F.col("e_end")) <= margin)
    return exons.join(best.select("node_id", "i", fits.alias("fits")), ["node_id", "i"], "left").withColumn("fits", F.coalesce("fits", F.lit(False)))
