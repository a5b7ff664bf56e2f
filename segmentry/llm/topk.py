"""Exact search by elimination with a pivot table.

Distances of all rows to a set of pivots are computed once. By the triangle
inequality they bound the distance of a query and a row from below, and with the norms
their inner product from above. Rows are grouped by the nearest of a set of centres, and
each group keeps the ranges of its rows' distances. A query first searches a block of its own group, then
only those groups whose ranges leave room for a better score; there candidates are evaluated in
the order of their bounds until no bound left can reach the k-th best score.
"""

from collections.abc import Iterator
from math import floor

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segmentry.llm.blocks import ROW_BLOCK, counted, good_vector, matrix, ranked, searched
from segmentry.shared import stored

#: Groups of one dimension at most; a table of so many ranges goes to the tasks.
MOST_CELLS = 1024
_FOUND = "query_id long, vec_id long, over int, score long"


def choose_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Farthest-first rows of the sample."""
    if not len(sample):
        return sample
    with np.errstate(over="ignore", invalid="ignore"):
        at = [0]
        near = ((sample - sample[0]) ** 2).sum(axis=1)
        while len(at) < min(n, len(sample)):
            at.append(int(near.argmax()))
            near = np.minimum(near, ((sample - sample[at[-1]]) ** 2).sum(axis=1))
    return sample[at]


def _whole(v: np.ndarray, factor: float) -> np.ndarray:
    """floor(factor * x) as Python's integers, also beyond what a double holds."""
    one = lambda x: floor(factor * x) if abs(factor * x) < float("inf") else int(x) * int(factor)
    return np.array([[one(x) for x in row] for row in v.tolist()], object)


def _best(k: int, factor: float):
    """The k best of a block for each query, none below the query's ``tau``; ``over`` is -1 or 1 where a score exceeds a long."""

    def top(queries: pa.Table, rows: pa.Table) -> pa.Table:
        out: list[tuple[int, int, int, int]] = []
        if queries.num_rows and rows.num_rows:
            q_id, r_id = queries["id"].to_numpy(), rows["id"].to_numpy()
            x, y, qd, rd, tau = matrix(queries["v"]), matrix(rows["v"]), matrix(queries["d"]), matrix(rows["d"]), queries["tau"].to_numpy()
            with np.errstate(over="ignore", invalid="ignore"):
                qv, rv = np.floor(factor * x), np.floor(factor * y)
                qn, rn = (qv**2).sum(axis=1), (rv**2).sum(axis=1)
                most = float(np.abs(qv).max()) * float(np.abs(rv).max()) * qv.shape[1]
            if not most < 2.0**52:  # else sums of doubles are exact
                qv, rv = (qv.astype(np.int64), rv.astype(np.int64)) if most < 2.0**62 else (_whole(x, factor), _whole(y, factor))
            for i in range(len(q_id)):
                with np.errstate(over="ignore", invalid="ignore"):
                    far = np.abs(rd - qd[i]).max(axis=1)
                    bound = 0.5 * (qn[i] + rn - far * far) + 1e-9 * (qn[i] + rn) + 1e-6
                bound[np.isnan(bound)] = np.inf
                bound[(r_id == q_id[i]) | (bound < tau[i])] = -np.inf
                order = np.argsort(-bound)
                order = order[bound[order] > -np.inf]
                best: list[tuple] = []
                for at in range(0, order.size, 128):
                    if len(best) == k and bound[order[at]] < -best[-1][0]:
                        break
                    part = order[at : at + 128]
                    scores = rv[part] @ qv[i]
                    if len(part) > k and scores.dtype != object:
                        good = np.flatnonzero(scores >= np.partition(scores, -k)[-k])
                        part, scores = part[good], scores[good]
                    best = sorted(best + [(-int(s), int(r)) for s, r in zip(scores, r_id[part], strict=True)])[:k]
                for s, r in best:
                    over = (-s > 2**63 - 1) - (-s < -(2**63))
                    out.append((int(q_id[i]), r, over, max(-(2**63), min(2**63 - 1, -s))))
        cols = list(zip(*out, strict=True)) or [()] * 4
        return pa.table({n: pa.array(c, t) for n, c, t in zip(("query_id", "vec_id", "over", "score"), cols, (pa.int64(), pa.int64(), pa.int32(), pa.int64()), strict=True)})

    return top


def exact_top_k(rows: DataFrame, k: int = 5, every: int = 50, factor: float = 256.0, pivots: int = 16, sample: int = 2048, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k rows of the highest integer inner product for each query: query_id, rank, vec_id, score.

    A component x counts as floor(factor * x). Queries are the rows whose id is divisible by ``every``. Pivots and centres are
    chosen among ``sample`` rows; they decide the speed, never the result. Vectors that are null, empty or hold
    null or non-finite components take no part, nor do null ids; finite ones do, however large: sums are exact, and
    a result whose score doesn't fit a long raises an error. Vectors meet only those of the same dimension. Rows that repeat a query's id count as its
    own, and its smallest vector asks; other repeated rows are candidates each. With fewer rows than k all are returned, and none
    for an empty table. Other columns, of whatever names, are not looked at.
    """
    spark = rows.sparkSession
    v = F.col(vector_col)
    base = rows.where(good_vector(v) & F.col(id_col).isNotNull())
    good = stored(base.select(F.col(id_col).cast("long").alias("id"), v.cast("array<double>").alias("v"), F.size(v).alias("dim")), "vectors")
    centres = {}
    for dim, n in counted(good, "dim").items():
        few = good.where(F.col("dim") == dim).orderBy(F.xxhash64("id"), "id", "v").limit(sample).select("v").collect()
        centres[dim] = choose_pivots(np.floor(factor * np.array([r.v for r in few], np.float64)), max(pivots, min(MOST_CELLS, n // (2 * ROW_BLOCK))))

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, vectors = batch.column(2).to_numpy(), batch.column(1)
            for dim in np.unique(dims):
                at, own = np.flatnonzero(dims == dim), centres[int(dim)]
                with np.errstate(over="ignore", invalid="ignore"):
                    x = np.floor(factor * matrix(vectors.take(pa.array(at))))
                    d = np.sqrt(((x[:, None, :] - own[None, :pivots]) ** 2).sum(axis=2))
                    near = ((own**2).sum(axis=1) - 2 * x @ own.T).argmin(axis=1)
                    n2 = (x * x).sum(axis=1)
                cols = [batch.column(0).take(pa.array(at)), vectors.take(pa.array(at)), pa.array(list(d), pa.list_(pa.float64())), pa.array(n2), pa.array(dims[at] * 2 * MOST_CELLS + 2 * near)]
                yield pa.RecordBatch.from_arrays(cols, ["id", "v", "d", "n2", "cell"])

    table = stored(good.mapInArrow(measured, "id long, v array<double>, d array<double>, n2 double, cell long"), "pivot_table")
    # A block of each group, which those nearest to it search first, is a group of its own.
    shares = F.broadcast(spark.createDataFrame([(c, -(-n // ROW_BLOCK)) for c, n in counted(table).items()], "cell long, blocks long"))
    front = F.pmod(F.xxhash64("id", F.lit(9)), "blocks") == 0
    table = table.join(shares, "cell").withColumn("cell", F.col("cell") + F.when(front, 1).otherwise(0)).drop("blocks")
    ranges = [f(F.get("d", F.lit(i))).alias(f"{f.__name__}{i}") for i in range(pivots) for f in (F.min, F.max)]
    stats = table.groupBy("cell").agg(F.count("*").alias("n"), F.max("n2").alias("n2"), *ranges).collect()
    sizes = {r.cell: r.n for r in stats}
    by_dim = {d: [r for r in stats if r.cell // (2 * MOST_CELLS) == d] for d in centres}

    queries = table.where(F.col("id") % every == 0).groupBy("id").agg(F.min(F.struct("v", "d", "n2", "cell")).alias("q"))
    queries = stored(queries.select("id", "q.v", "q.d", "q.n2", F.col("q.cell").alias("home"), F.lit(float("-inf")).alias("tau")), "queries")
    home = (F.col("home") / 2).cast("long") * 2 + 1
    first = stored(searched(table, queries.select("id", "v", "d", "tau", F.array(home).alias("cells")), sizes, _best(k, factor), _FOUND), "first")
    reached = first.groupBy(F.col("query_id").alias("id")).agg(F.count("*").alias("c"), F.min("score").cast("double").alias("t")).where(F.col("c") >= k)
    queries = queries.drop("tau").join(reached, "id", "left").select("id", "v", "d", "n2", "home", F.coalesce("t", F.lit(float("-inf"))).alias("tau"))

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d, n2, homes, tau = batch.column(2), batch.column(3).to_numpy(), batch.column(4).to_numpy(), batch.column(5).to_numpy()
            cells: list = [[]] * batch.num_rows
            for dim in np.unique(homes // (2 * MOST_CELLS)):
                at, own = np.flatnonzero(homes // (2 * MOST_CELLS) == dim), by_dim[int(dim)]
                q, ids, top_n = matrix(d.take(pa.array(at))), np.array([r.cell for r in own]), np.array([r.n2 for r in own])
                lo, hi = (np.array([[r[f"{f}{i}"] for i in range(q.shape[1])] for r in own]) for f in ("min", "max"))
                for i, row in zip(at, q, strict=True):
                    with np.errstate(over="ignore", invalid="ignore"):
                        gap = np.maximum(np.maximum(lo - row, row - hi), 0).max(axis=1)
                        bound = 0.5 * (n2[i] + top_n - gap * gap) + 1e-9 * (n2[i] + top_n) + 1e-6
                    open_ = ~(bound < tau[i]) & (ids != homes[i] // 2 * 2 + 1)
                    cells[i] = ids[open_].tolist()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), d, batch.column(5), pa.array(cells, pa.list_(pa.int64()))], ["id", "v", "d", "tau", "cells"])

    asked = stored(queries.mapInArrow(routed, "id long, v array<double>, d array<double>, tau double, cells array<long>"), "asked")
    found = first.unionByName(searched(table, asked, sizes, _best(k, factor), _FOUND))
    best = ranked(found, k, F.desc("over"), F.desc("score"))
    fits = F.when(F.col("over") != 0, F.raise_error(F.concat(F.lit("the score of query "), "query_id", F.lit(" and "), "vec_id", F.lit(" doesn't fit a long"))).cast("long")).otherwise(F.col("score"))
    return best.select("query_id", "rank", "vec_id", fits.alias("score"))
