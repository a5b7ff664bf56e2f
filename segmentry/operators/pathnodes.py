"""Nodes of a read's path from its hops, with placed insertions as nodes of their own."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segmentry.operators.events import SV_TYPES, classify
from segmentry.operators.paths import order_transcription

SIDE = ("chrom", "strand", "ref_start", "ref_end", "mode")


def _sub_hop(x: DataFrame, one: str, two: str, name: str) -> DataFrame:
    """Add ``name``, the type of the hop between the sides ``one`` and ``two`` (prefixes of columns), by the same rules as for any hop."""
    kept = x.columns
    y = x.withColumns({f"{c}{i}": F.col(f"{p}_{c}") for i, p in ((1, one), (2, two)) for c in SIDE})
    return classify(y).select(*kept, F.col("kind").alias(name))


def path_nodes(hops: DataFrame, placed: DataFrame, kinds: tuple[str, ...] = SV_TYPES) -> DataFrame:
    """read_id, place, chrom, strand, n_start, n_end, ident, source, and kind, payload and payload_len of the hop to the next node.

    ``hops`` are classified ones with their payload; ``placed`` are read_id, seg_ord1 and chrom, strand, ref_start and ref_end of hits of inserted bases, one a hop. Hops
    are put in the direction of transcription. A hop whose insertion is placed becomes two, from the upstream segment to the hit and from there to the downstream one, which
    are classified again; if either is of none of ``kinds``, the hop stays one, and the insertion its payload. The first node of a
    read is HEAD, the last TAIL, others are MID.
    """
    up_first = F.col("up") == F.col("seg_ord1")
    x = order_transcription(hops)
    own = [c for c in SIDE if c != "mode"]
    x = x.select("read_id", "seg_ord1", "hop_ord", F.col("kind").alias("whole"), "payload", "payload_len", *(F.when(up_first, F.col(f"{c}1")).otherwise(F.col(f"{c}2")).alias(f"u_{c}") for c in SIDE), *(F.when(up_first, F.col(f"{c}2")).otherwise(F.col(f"{c}1")).alias(f"d_{c}") for c in SIDE))
    x = x.join(placed.select("read_id", "seg_ord1", *(F.col(c).alias(f"i_{c}") for c in own)), ["read_id", "seg_ord1"], "left")
    other = lambda side: F.when(F.col(f"{side}_strand") != F.col("i_strand"), F.col(f"{side}_mode")).when(F.col(f"{side}_mode") == "MS", "SM").otherwise("MS")
    x = _sub_hop(x.withColumn("i_mode", other("u")), "u", "i", "to_hit")
    x = _sub_hop(x.withColumn("i_mode", other("d")), "i", "d", "from_hit")
    x = x.withColumn("split", F.col("i_chrom").isNotNull() & F.col("to_hit").isin(*kinds) & F.col("from_hit").isin(*kinds))
    x = x.withColumn("last", F.col("hop_ord") == F.max("hop_ord").over(Window.partitionBy("read_id")))

    def node(side: str, at: int, source: str, kind: Column, payload: Column, size: Column) -> Column:
        spans = (F.col(f"{side}_{c}").alias(name) for c, name in zip(own, ("chrom", "strand", "n_start", "n_end"), strict=True))
        return F.struct((2 * F.col("hop_ord") + at).alias("key"), *spans, F.lit(source).alias("source"), kind.cast("string").alias("kind"), payload.cast("string").alias("payload"), size.cast("int").alias("payload_len"))

    none = F.lit(None)
    first = node("u", 0, "segment", F.when(F.col("split"), F.col("to_hit")).otherwise(F.col("whole")), F.when(F.col("split"), "Insertion").otherwise(F.col("payload")), F.col("payload_len"))
    between = F.when(F.col("split"), node("i", 1, "insertion", F.col("from_hit"), F.lit("none"), F.lit(0)))
    made = F.filter(F.array(first, between, F.when(F.col("last"), node("d", 2, "segment", none, none, none))), lambda n: n.isNotNull())
    x = x.select("read_id", F.explode(made).alias("n")).select("read_id", "n.*")
    read = Window.partitionBy("read_id")
    x = x.withColumns({"place": (F.row_number().over(read.orderBy("key")) - 1), "_n": F.count("*").over(read)})
    ident = F.when(F.col("place") == 0, "HEAD").when(F.col("place") == F.col("_n") - 1, "TAIL").otherwise("MID")
    return x.withColumn("ident", ident).drop("key", "_n")
