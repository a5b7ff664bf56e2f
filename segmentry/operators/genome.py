"""Slices of the genome: chunks are joined by number, never the whole sequence held."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segmentry.functions import cigar as C

CHUNK, SHIFT = 5000, 100
#: Donor and acceptor bases of an intron on its own strand.
CANONICAL = ("GT-AG", "GC-AG", "AT-AC")


def genome_slice(spans: DataFrame, genome: DataFrame, chrom: str, start: str, end: str, name: str, pad: bool = False) -> DataFrame:
    """Add the bases of [start, end) of ``chrom``; where a chunk is missing null, or with ``pad`` as many N.

    Distinct spans are looked up once. A span goes to the chunks it touches, one or two for motifs,
    and its pieces are put together in their order.
    """
    spots = spans.select(F.col(chrom).alias("_c"), F.col(start).alias("_s"), F.col(end).alias("_e")).distinct()
    number = lambda c: F.floor((c + SHIFT) / CHUNK)
    lo, hi = number(F.col("_s")), number(F.greatest(F.col("_e") - 1, F.col("_s")))
    touched = spots.withColumn("_n", (hi - lo + 1).cast("long")).withColumn("chunk_no", F.explode(F.sequence(lo, hi)))
    chunks = genome.select(F.col("chrom").alias("_c"), "chunk_no", "seq")
    begin = F.col("chunk_no") * CHUNK - SHIFT
    left = F.greatest(F.col("_s") - begin, F.lit(0))
    length = (F.least(F.col("_e") - begin, F.lit(CHUNK)) - left).cast("int")
    piece = F.substring(F.col("seq"), (left + 1).cast("int"), length)
    piece = F.coalesce(piece, F.repeat(F.lit("N"), length)) if pad else piece
    pieces = touched.join(chunks, ["_c", "chunk_no"], "left" if pad else "inner").groupBy("_c", "_s", "_e", "_n").agg(F.array_sort(F.collect_list(F.struct("chunk_no", piece.alias("p")))).alias("ps"))
    whole = pieces.where(F.size("ps") == F.col("_n")).select("_c", "_s", "_e", F.array_join(F.transform("ps", lambda p: p["p"]), "").alias(name))
    on = (F.col(chrom) == F.col("_c")) & (F.col(start) == F.col("_s")) & (F.col(end) == F.col("_e"))
    return spans.join(whole, on, "left").drop("_c", "_s", "_e")


def stranded(bases: Column, strand: Column) -> Column:
    return F.when(strand == "-", C.reverse_complement(bases)).otherwise(bases)


def intron_motifs(introns: DataFrame, genome: DataFrame) -> DataFrame:
    """Add ``motif`` (donor-acceptor on the strand) to rows chrom, strand, i_start, i_end."""
    # Both ends are looked up as rows of one table, so the genome is read once.
    ends = F.explode(F.array(F.struct(F.col("i_start").alias("_from"), (F.col("i_start") + 2).alias("_to")), F.struct((F.col("i_end") - 2).alias("_from"), F.col("i_end").alias("_to")))).alias("e")
    found = genome_slice(introns.select("chrom", "i_start", "i_end").distinct().select("*", ends).select("chrom", "i_start", "i_end", "e.*"), genome, "chrom", "_from", "_to", "_two")
    both = found.groupBy("chrom", "i_start", "i_end").agg(F.max(F.when(F.col("_from") == F.col("i_start"), F.col("_two"))).alias("_left"), F.max(F.when(F.col("_to") == F.col("i_end"), F.col("_two"))).alias("_right"))
    x = introns.join(both, ["chrom", "i_start", "i_end"], "left").select(*introns.columns, "_left", "_right")
    plus, strand = F.col("strand") == "+", F.col("strand")
    donor, acceptor = F.when(plus, F.col("_left")).otherwise(F.col("_right")), F.when(plus, F.col("_right")).otherwise(F.col("_left"))
    # concat is null if a side is.
    return x.withColumn("motif", F.concat(stranded(donor, strand), F.lit("-"), stranded(acceptor, strand))).drop("_left", "_right")


def canonical_share(segments: DataFrame, genome: DataFrame) -> DataFrame:
    """Introns and canonical introns of each segment; those without introns have 0 of 0."""
    i = segments.select("read_id", "seg_ord", "chrom", "strand", F.explode_outer(C.gaps(F.col("exons"))).alias("i"))
    i = i.select("read_id", "seg_ord", "chrom", "strand", F.col("i.start").alias("i_start"), F.col("i.end").alias("i_end"))
    found = intron_motifs(i.where("i_start is not null").select("chrom", "strand", "i_start", "i_end").distinct(), genome)
    good = F.coalesce(F.col("motif").isin(*CANONICAL), F.lit(False)).cast("int")
    return i.join(found, ["chrom", "strand", "i_start", "i_end"], "left").groupBy("read_id", "seg_ord").agg(F.count("i_start").alias("introns"), F.sum(good).alias("canonical"))


def downstream(segments: DataFrame, genome: DataFrame, length: int = 20) -> DataFrame:
    """Add ``tail``, the bases that follow a segment on its strand."""
    plus = F.col("strand") == "+"
    x = segments.withColumn("_ts", F.when(plus, F.col("ref_end")).otherwise(F.col("ref_start") - length)).withColumn("_te", F.col("_ts") + length)
    x = genome_slice(x, genome, "chrom", "_ts", "_te", "_tail")
    return x.withColumn("tail", stranded(F.col("_tail"), F.col("strand"))).drop("_ts", "_te", "_tail")


def genuine_ends(segments: DataFrame, genome: DataFrame, share: float = 0.7, length: int = 20) -> DataFrame:
    """Add ``genuine``: are at most ``share`` of the ``length`` bases after a segment A? More point to priming inside the transcript."""
    x = downstream(segments, genome, length)
    return x.withColumn("genuine", F.length("tail") - F.length(F.replace("tail", F.lit("A"), F.lit(""))) <= share * length).drop("tail")
