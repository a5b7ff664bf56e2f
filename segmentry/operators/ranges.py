"""Range joins by bins of several widths: every pair once, as an equi-join."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Each level's bins are so many times as wide as those of the level below.
FACTOR = 16


def _bins(df: DataFrame, start: str, end: str, width: int, levels: int, name: str) -> DataFrame:
    """A row for each bin that an interval touches on its own level, which has bins of about its length, and on the levels above."""
    wide = [width * FACTOR**i for i in range(levels)]
    length = F.greatest(F.col(end) - F.col(start), F.lit(0))
    own = F.lit(levels - 1)
    for i in range(levels - 2, -1, -1):
        own = F.when(length <= wide[i], i).otherwise(own)
    x = df.withColumn(f"{name}_own", own).withColumn(f"{name}_level", F.explode(F.sequence(F.col(f"{name}_own"), F.lit(levels - 1))))
    step = F.element_at(F.array(*map(F.lit, wide)), F.col(f"{name}_level") + 1)
    lo, hi = F.floor(F.col(start) / step), F.floor(F.greatest(F.col(start), F.col(end)) / step)
    return x.withColumn(f"{name}_lo", lo).withColumn(name, F.explode(F.sequence(lo, hi)))


def range_join(left: DataFrame, right: DataFrame, on: Column, key: tuple[str, str], left_span: tuple[str, str], right_span: tuple[str, str], width: int = 10_000, levels: int = 3) -> DataFrame:
    """Rows of both sides with equal keys, a common bin and ``on``.

    A pair meets on the level of its longer interval, which touches two bins there (more only on
    the highest level), and is kept in the first common bin only. So the rows that are made follow the
    number of intervals, not their lengths; a hot bin is split by adaptive execution.
    """
    x = _bins(left, *left_span, width, levels, "_lb")
    y = _bins(right, *right_span, width, levels, "_rb")
    first = F.col("_lb") == F.greatest("_lb_lo", "_rb_lo")
    level = (F.col("_lb_level") == F.col("_rb_level")) & (F.col("_lb_level") == F.greatest("_lb_own", "_rb_own"))
    out = x.join(y, (F.col(key[0]) == F.col(key[1])) & (F.col("_lb") == F.col("_rb")) & level & first & on)
    return out.drop(*(f"{side}{c}" for side in ("_lb", "_rb") for c in ("", "_lo", "_own", "_level")))


def union(df: DataFrame, key: str, start: str, end: str, touch: int = 0, width: int = 1_000_000) -> DataFrame:
    """Unions of the intervals of each key: the next joins if it starts at the largest end so far plus ``touch`` at most.

    Equal intervals are counted first. Islands are numbered in bins of ``width`` starts; what an earlier
    bin hands on to a later one are its largest end and its number of islands, a row per bin.
    """
    x = df.groupBy(key, F.col(start).alias("_s"), F.col(end).alias("_e")).agg(F.count("*").alias("_n")).withColumn("_bin", F.floor(F.col("_s") / width))
    before = Window.partitionBy(key).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    carried = x.groupBy(key, "_bin").agg(F.max("_e").alias("_top")).select(key, "_bin", F.max("_top").over(before).alias("_carried"))
    w = Window.partitionBy(key, "_bin").orderBy("_s", "_e")
    top = F.greatest(F.max("_e").over(w.rowsBetween(Window.unboundedPreceding, -1)), "_carried")
    x = x.join(carried, [key, "_bin"]).withColumn("_new", F.when(F.col("_s") <= top + touch, 0).otherwise(1))
    x = x.withColumn("_own", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    parts = x.groupBy(key, "_bin", "_own").agg(F.min("_s").alias("_s"), F.max("_e").alias("_e"), F.sum("_n").alias("_n"), F.max("_new").alias("_new"))
    ahead = parts.groupBy(key, "_bin").agg(F.sum("_new").alias("_islands")).select(key, "_bin", F.coalesce(F.sum("_islands").over(before), F.lit(0)).alias("_ahead"))
    parts = parts.join(ahead, [key, "_bin"]).withColumn("_island", F.col("_ahead") + F.col("_own"))
    return parts.groupBy(key, "_island").agg(F.min("_s").alias("u_start"), F.max("_e").alias("u_end"), F.sum("_n").alias("n")).drop("_island")


def near_pairs(df: DataFrame, keys: list[str], item: str, start: str, end: str, tolerance: int) -> DataFrame:
    """Pairs (item1 < item2) of equal keys whose starts and ends differ by ``tolerance`` at most.

    One side is repeated for the nine neighbouring bins of start and end, the other is
    in one, so every pair is found once by an equi-join.
    """
    width = tolerance + 1
    at = lambda c, d=0: F.floor(F.col(c) / width) + d
    x = df.select(*keys, F.col(item).alias(f"{item}1"), F.col(start).alias("_s1"), F.col(end).alias("_e1"), at(start).alias("_bs"), at(end).alias("_be"))
    y = df.select(*keys, F.col(item).alias(f"{item}2"), F.col(start).alias("_s2"), F.col(end).alias("_e2"))
    y = y.withColumn("_bs", F.explode(F.array(*(at("_s2", d) for d in (-1, 0, 1))))).withColumn("_be", F.explode(F.array(*(at("_e2", d) for d in (-1, 0, 1)))))
    close = (F.abs(F.col("_s1") - F.col("_s2")) <= tolerance) & (F.abs(F.col("_e1") - F.col("_e2")) <= tolerance)
    return x.join(y, [*keys, "_bs", "_be"]).where(close & (F.col(f"{item}1") < F.col(f"{item}2"))).select(*keys, f"{item}1", f"{item}2")
