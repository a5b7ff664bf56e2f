"""Column expressions over CIGAR strings, bases and tags."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INT = "int"


def operations(cigar: Column) -> Column:
    """Array of (op, len); lengths of 0 stay."""
    parts = F.regexp_extract_all(cigar, F.lit(r"(\d+[MIDNSHPX=])"), F.lit(1))
    return F.transform(parts, lambda x: F.struct(F.right(x, F.lit(1)).alias("op"), F.regexp_extract(x, r"^\d+", 0).cast(INT).alias("len")))


def total(ops: Column, kinds: str) -> Column:
    """Sum of the lengths of the operations whose letter is in ``kinds``."""
    chosen = F.filter(ops, lambda o: o["op"].isin(*kinds))
    return F.aggregate(chosen, F.lit(0), lambda acc, o: acc + o["len"])


def clip(cigar: Column, right: bool) -> Column:
    """Length of the soft clip that is the last or first operation, else 0."""
    found = F.regexp_extract(cigar, r"(\d+)S$" if right else r"^(\d+)S", 1)
    return F.when(found == "", 0).otherwise(found.cast(INT))


def normalized(cigar: Column) -> Column:
    """Without operations of length 0, neighbours of one kind merged."""
    ops = F.filter(operations(cigar), lambda o: o["len"] > 0)
    start = F.array().cast("array<struct<op:string,len:int>>")

    def step(acc, o):
        last = F.element_at(acc, -1)
        grown = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(last["op"].alias("op"), (last["len"] + o["len"]).alias("len"))))
        same = (F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["op"] == o["op"])
        return F.when(same, grown).otherwise(F.concat(acc, F.array(F.struct(o["op"].alias("op"), o["len"].alias("len")))))

    folded = F.array_join(F.transform(F.aggregate(ops, start, step), lambda o: F.concat(o["len"].cast("string"), o["op"])), "")
    # A text that has nothing to merge or to leave out stays as it is, without a fold.
    done = F.rlike(cigar, F.lit(r"\A(?:[1-9][0-9]*[MIDNSHPX=])*\z")) & ~F.rlike(cigar, F.lit(r"([MIDNSHPX=])[0-9]+\1"))
    return F.when(done, cigar).otherwise(folded)


def exons(start: Column, cigar: Column) -> Column:
    """Array of (start, end): matches and deletions advance, N closes an exon, the last exon is always there."""
    kind = "struct<at:bigint,begin:bigint,done:array<struct<start:bigint,end:bigint>>>"
    zero = F.struct(start.cast("bigint").alias("at"), start.cast("bigint").alias("begin"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("done")).cast(kind)

    def step(acc, o):
        to = acc["at"] + F.when(o["op"].isin("M", "D", "N"), o["len"]).otherwise(0)
        closes = o["op"] == "N"
        done = F.when(closes, F.concat(acc["done"], F.array(F.struct(acc["begin"].alias("start"), acc["at"].alias("end"))))).otherwise(acc["done"])
        return F.struct(to.alias("at"), F.when(closes, to).otherwise(acc["begin"]).alias("begin"), done.alias("done")).cast(kind)

    folded = F.aggregate(operations(cigar), zero, step, lambda a: F.concat(a["done"], F.array(F.struct(a["begin"].alias("start"), a["at"].alias("end")))))
    # The usual forms, one match or two around an intron between clips, are read without a fold or a pattern, which cost ten times and twice as much.
    form = F.btrim(F.translate(cigar, "0123456789", ""), F.lit("SH"))
    size = lambda text: text.try_cast("bigint")
    exon = lambda a, b: F.struct(a.cast("bigint").alias("start"), b.cast("bigint").alias("end"))
    match = size(F.substring_index(F.translate(F.substring_index(cigar, "M", 1), "H", "S"), "S", -1))
    intron, rest = size(F.substring_index(F.substring_index(cigar, "N", 1), "M", -1)), size(F.substring_index(F.substring_index(cigar, "N", -1), "M", 1))
    again = start + match + intron
    spliced = F.array(exon(start, start + match), exon(again, again + rest))
    return F.when((form == "M") & match.isNotNull(), F.array(exon(start, start + match))).when((form == "MNM") & (match + intron + rest).isNotNull(), spliced).otherwise(folded)


def gaps(intervals: Column) -> Column:
    """Introns: what lies between intervals in turn."""
    n = F.size(intervals)
    ahead, behind = F.slice(intervals, F.lit(2), F.greatest(n - 1, F.lit(0))), F.slice(intervals, F.lit(1), F.greatest(n - 1, F.lit(0)))
    return F.zip_with(behind, ahead, lambda x, y: F.struct(x["end"].alias("start"), y["start"].alias("end")))


def merged(intervals: Column, touch: int = 0) -> Column:
    """Union of sorted intervals; the next joins if it starts at the last end plus ``touch`` at most."""
    kind = "array<struct<start:bigint,end:bigint>>"

    def step(acc, x):
        last = F.try_element_at(acc, F.lit(-1))
        grown = F.concat(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))))
        return F.when((F.size(acc) > 0) & (x["start"] <= last["end"] + touch), grown.cast(kind)).otherwise(F.concat(acc, F.array(x)).cast(kind))

    return F.aggregate(F.array_sort(intervals), F.array().cast(kind), step)


def text_of(intervals: Column) -> Column:
    """``start-end;start-end``"""
    return F.array_join(F.transform(intervals, lambda x: F.concat_ws("-", x["start"].cast("string"), x["end"].cast("string"))), ";")


def reverse_complement(bases: Column) -> Column:
    """Only A, C, G and T are exchanged."""
    return F.reverse(F.translate(bases, "ACGT", "TGCA"))


def mode(lt: Column, rt: Column) -> Column:
    """SM if the left clip is longer, else MS."""
    return F.when(lt > rt, "SM").otherwise("MS")


def link_type(kind: Column, mode1: Column, mode2: Column) -> Column:
    return F.when(kind == "TDUP", "ICRL").when(kind == "INV", "ICTL").when((kind == "TRA") & (mode1 == mode2), "ITTL").when(kind == "TRA", "ITPL").otherwise("NA")


def longest_insertion(start: Column, cigar: Column) -> Column:
    """(len, at) of the longest insertion, the first of equal ones; before an intron it stands at the intron's end. Length 0 if there is none."""
    kind = "struct<at:bigint,last:string,best:struct<len:int,at:bigint>>"
    zero = F.struct(start.cast("bigint").alias("at"), F.lit("").alias("last"), F.struct(F.lit(0).alias("len"), start.cast("bigint").alias("at")).alias("best")).cast(kind)

    def step(acc, o):
        to = acc["at"] + F.when(o["op"].isin("M", "D", "N"), o["len"]).otherwise(0)
        best = acc["best"]
        longer = F.when((o["op"] == "I") & (o["len"] > best["len"]), F.struct(o["len"].alias("len"), acc["at"].alias("at")))
        moved = F.when((o["op"] == "N") & (acc["last"] == "I") & (best["at"] == acc["at"]), F.struct(best["len"].alias("len"), to.alias("at")))
        return F.struct(to.alias("at"), o["op"].alias("last"), F.coalesce(longer, moved, best).alias("best")).cast(kind)

    return F.aggregate(operations(cigar), zero, step, lambda a: a["best"])


def cs_stats(df: DataFrame, cs: str, long: int) -> DataFrame:
    """Add ``ref_len``, and per reference base the substitutions ``subs`` and the insertions and deletions of ``long`` or more."""
    items = lambda pattern: F.regexp_extract_all(F.col(cs), F.lit(pattern), F.lit(1))
    size = lambda xs: F.aggregate(xs, F.lit(0), lambda a, x: a + F.length(x))
    x = df.withColumn("_m", F.aggregate(items(r":(\d+)"), F.lit(0), lambda a, n: a + n.cast(INT))).withColumn("_s", F.size(items(r"\*([a-z]{2})")))
    x = x.withColumn("_i", items(r"\+([a-z]+)")).withColumn("_d", items(r"-([a-z]+)")).withColumn("ref_len", F.col("_m") + F.col("_s") + size(F.col("_d")))
    many = lambda c: F.size(F.filter(F.col(c), lambda t: F.length(t) >= long)) / F.col("ref_len")
    return x.withColumn("subs", F.col("_s") / F.col("ref_len")).withColumn("long_ins", many("_i")).withColumn("long_del", many("_d")).drop("_m", "_s", "_i", "_d")
