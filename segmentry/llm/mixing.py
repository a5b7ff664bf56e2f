"""Mixing of sources by temperature.

The weights of the sources are their token shares to an exponent between 0 (even) and
1 (as they are), found by bisection to meet a target entropy or a limit of repetition. A source's
quota of tokens is filled by whole permutations of its documents and the head of one more; the
sources' streams are then dealt into blocks of a token budget, each with the sources in
their weights, and each block is a permutation. All of it is DataFrame operations.
"""

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segmentry.shared import stored

#: Words are runs without ASCII white space.
_WHITE = "[ \\t-\\r]+"
#: A source's permutation is summed in this many ranges of the hash, then in each.
RANGES = 4096


def token_count(text: Column) -> Column:
    return F.coalesce(F.size(F.filter(F.split(text, _WHITE), lambda w: w != "")), F.lit(0)).cast("long")


def exponent(shares: DataFrame, repeat_limit: float | None = 2.0, entropy: float | None = None, rounds: int = 5, ways: int = 32) -> float:
    """The exponent, by bisection into ``ways`` parts; ``shares`` has a column p over 0 and is only summed by Spark.

    With ``repeat_limit``, the smallest exponent for which no source is used more than that often
    when every source is used once; with ``entropy``, the one whose weights have that
    share of the largest entropy. Rounded up to 6 digits.
    """
    lo, hi = 0.0, 1.0
    for _ in range(rounds):
        grid = [lo + (hi - lo) * i / ways for i in range(ways + 1)]
        at = shares.select("p", F.explode(F.array(*(F.lit(t) for t in grid))).alias("t"))
        sums = at.groupBy("t").agg(
            F.sum(F.pow("p", "t")).alias("z"), F.sum(F.pow("p", "t") * F.log("p")).alias("s"), F.count("*").alias("n"), F.max(F.pow("p", F.col("t") - 1)).alias("most"), F.min(F.pow("p", F.col("t") - 1)).alias("least")
        )
        rows = sorted(sums.collect())
        if not rows:
            return 1.0
        if entropy is not None:
            ok = [r.n < 2 or math.log(r.z) - r.t * r.s / r.z <= entropy * math.log(r.n) for r in rows]
        else:
            ok = [r.most / r.least <= repeat_limit * (1 + 1e-12) for r in rows]
        first = ok.index(True) if True in ok else ways
        if first == 0:
            return math.ceil(round(lo * 1e6, 3)) / 1e6
        lo, hi = grid[first - 1], grid[first]
    return min(1.0, math.ceil(round(hi * 1e6, 3)) / 1e6)


def mixed(
    docs: DataFrame, repeat_limit: float | None = 2.0, entropy: float | None = None, budget: int | None = None, block_tokens: int = 100_000, seed: int = 1, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"
) -> DataFrame:
    """One row per use of a document: id, source, n_tokens, ``epoch`` (from 0), ``block``, ``position`` (in the block, from 1).

    Without ``budget`` the total is the least with which each document is used at least once, so nothing is
    lost and smaller sources are repeated; with a budget of tokens each source gets its weight's
    part of it, and large sources may be cut. A null source is the source ''. Documents without
    words are used as often as whole epochs, at least once, and cost nothing. Rows that
    repeat an id are documents of their own. A source without words has no quota but epoch 0, and its documents are spread over the blocks by
    their hash. An empty table gives no rows. A text is counted as a whole by Spark's own functions, so the longest one bounds what a task holds. Other columns, of whatever names, are not looked at.
    """
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(source_col, F.lit("")).alias("source"), token_count(F.col(text_col)).alias("n_tokens"))
    base = stored(base, "tokens")
    sizes = stored(base.groupBy("source").agg(F.sum("n_tokens").alias("t")), "sources")
    total = sizes.agg(F.sum("t")).first()[0] or 0
    power = exponent(sizes.where("t > 0").select((F.col("t") / F.lit(float(max(total, 1)))).alias("p")), repeat_limit, entropy)
    weighed = sizes.withColumn("u", F.when(F.col("t") > 0, F.pow(F.col("t") / F.lit(float(max(total, 1))), F.lit(power))).otherwise(0.0))
    sums = weighed.agg(F.sum("u").alias("z"), F.max(F.when(F.col("t") > 0, F.col("t") / F.col("u"))).alias("top")).first()
    whole = float(budget) / (sums.z or 1.0) if budget is not None else float(sums.top or 0.0)
    quotas = weighed.withColumn("times", F.when(F.col("t") > 0, F.round(whole * F.col("u") / F.col("t"), 9)).otherwise(1.0))
    quotas = quotas.withColumn("full", F.floor("times")).withColumn("quota", F.floor(F.col("times") * F.col("t") + 0.5))
    quotas = stored(quotas.select("source", "t", "full", "quota"), "quotas")

    uses = base.join(quotas, "source").withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("full"))))
    uses = uses.withColumn("key", F.md5(F.concat_ws(":", F.coalesce(F.col("id").cast("string"), F.lit("")), "epoch", F.lit(seed))))
    uses = uses.withColumn("range", F.conv(F.substring("key", 1, 3), 16, 10).cast("int"))
    ranges = uses.groupBy("source", "epoch", "range").agg(F.sum("n_tokens").alias("n"))
    above = Window.partitionBy("source", "epoch").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    bases = ranges.select("source", "epoch", "range", F.coalesce(F.sum("n").over(above), F.lit(0)).alias("base"))
    ahead = Window.partitionBy("source", "epoch", "range").orderBy("key", "id", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    run = uses.withColumn("own", F.coalesce(F.sum("n_tokens").over(ahead), F.lit(0))).join(bases, ["source", "epoch", "range"])
    run = run.withColumn("start", F.col("epoch") * F.col("t") + F.col("base") + F.col("own"))
    taken = run.where((F.col("epoch") < F.col("full")) | (F.col("start") < F.col("quota")))

    blocks = max(1, -(-int(quotas.agg(F.sum("quota")).first()[0] or 0) // block_tokens))
    # A source without a word has no quota to be dealt along; its documents go by the range of their hash.
    along = F.least(F.expr(f"(start * {blocks}) div greatest(quota, 1)"), F.lit(blocks - 1))
    taken = taken.withColumn("block", F.when(F.col("t") == 0, F.expr(f"(cast(range as bigint) * {blocks}) div {RANGES}")).otherwise(along))
    position = F.row_number().over(Window.partitionBy("block").orderBy(F.reverse("key"), "id", "n_tokens"))
    return taken.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "n_tokens", "epoch", "block", position.alias("position"))
