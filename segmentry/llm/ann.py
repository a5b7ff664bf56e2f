"""Approximate nearest neighbours by learned partitions.

On a bounded sample a neighbour graph is split into balanced parts by recursive
spectral bisection. A softmax classifier learns which parts hold a vector's neighbours. Every row
is indexed in its likeliest part; a query searches its most probable parts, whose
rows are ranked by the exact inner product. How many parts it searches is set on rows held out of
the fit, so that the recall measured there reaches the target.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segmentry.llm.blocks import ROW_BLOCK, counted, good_vector, matrix, ranked, searched
from segmentry.shared import stored


def bisected(graph: np.ndarray, levels: int) -> np.ndarray:
    """Balanced parts 0 .. 2**levels - 1 of a symmetric weighted graph."""
    part = np.zeros(len(graph), np.int64)
    for _ in range(levels):
        nxt = part * 2
        for p in np.unique(part):
            at = np.flatnonzero(part == p)
            w = graph[np.ix_(at, at)]
            root = np.sqrt(w.sum(axis=1) + 1e-9)
            step = w / root[:, None] / root[None, :]
            x = np.random.default_rng(int(p) + 1).normal(size=at.size)
            for _ in range(60):
                x -= root * (x @ root) / (root @ root)
                x = step @ x + x
                x /= np.linalg.norm(x) + 1e-12
            nxt[at[np.argsort(x / root, kind="stable")[at.size // 2 :]]] += 1
        part = nxt
    return part


class Router:
    """Softmax regression of the part from a normalised vector."""

    def __init__(self, sample: np.ndarray, tried: np.ndarray, levels: int, neighbours: int, k: int, target: float):
        unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
        near = sample @ sample.T
        np.fill_diagonal(near, -np.inf)
        n, parts = len(sample), 2**levels
        nn = np.argsort(-near, axis=1)[:, : min(neighbours, n - 1)]
        graph = np.zeros((n, n), np.float32)
        graph[np.repeat(np.arange(n), nn.shape[1]), nn.ravel()] = 1
        own = bisected(np.maximum(graph, graph.T), levels)
        goal = np.zeros((n, parts))
        np.add.at(goal, (np.repeat(np.arange(n), nn.shape[1]), own[nn].ravel()), 1)
        goal[np.arange(n), own] += max(1, nn.shape[1] // 2)
        goal /= goal.sum(axis=1, keepdims=True)
        x = np.column_stack([unit * 8, np.ones(n)])
        self.w = np.zeros((x.shape[1], parts))
        speed = np.zeros_like(self.w)
        for _ in range(400):
            z = x @ self.w
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            speed = 0.9 * speed - 0.05 * (x.T @ (p - goal) / n + 1e-4 * self.w)
            self.w += speed
        # Where the nearest sample rows of the rows held out lie in these rows' rankings of the parts.
        own = self.ranked(sample)[:, 0]
        best = np.argsort(-(tried @ sample.T), axis=1)[:, : min(k, n)]
        place = np.argsort(self.ranked(tried), axis=1)[np.arange(len(tried))[:, None], own[best]]
        self.probes = next((m for m in range(1, parts + 1) if (place < m).mean() >= target), parts)

    def ranked(self, v: np.ndarray) -> np.ndarray:
        """All parts for each row, likeliest first."""
        unit = v / np.linalg.norm(v, axis=1, keepdims=True)
        return np.argsort(-(np.column_stack([unit * 8, np.ones(len(v))]) @ self.w), axis=1, kind="stable")


def _best(k: int):
    def top(queries: pa.Table, rows: pa.Table) -> pa.Table:
        out: tuple[list, list, list] = ([], [], [])
        if queries.num_rows and rows.num_rows:
            q_id, r_id, qv, rv = queries["id"].to_numpy(), rows["id"].to_numpy(), matrix(queries["v"]), matrix(rows["v"])
            for lo in range(0, len(q_id), 256):
                scores = qv[lo : lo + 256] @ rv.T
                for i, s in enumerate(scores, lo):
                    s[r_id == q_id[i]] = -np.inf
                    at = np.flatnonzero(s >= np.partition(s, -k)[-k]) if s.size > k else np.arange(s.size)
                    at = at[s[at] > -np.inf]
                    at = at[np.lexsort((r_id[at], -s[at]))[:k]]
                    out[0].append(np.full(at.size, q_id[i]))
                    out[1].append(r_id[at])
                    out[2].append(s[at])
        cat = [np.concatenate(x) if x else np.zeros(0) for x in out]
        return pa.table({"query_id": pa.array(cat[0].astype(np.int64)), "vec_id": pa.array(cat[1].astype(np.int64)), "score": pa.array(cat[2].astype(np.float64))})

    return top


def nearest(rows: DataFrame, k: int = 20, every: int = 20, levels: int | None = None, sample: int = 2048, trial: int = 512, neighbours: int = 12, target: float = 0.96, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k nearest rows found for each query, by inner product: query_id, rank, vec_id, score.

    Queries are the rows whose id is divisible by ``every``. The parts and the classifier are fitted
    on ``sample`` rows, the number of parts to search is set on ``trial`` others (a fifth of the rows where there are fewer); every row is indexed. Without ``levels`` there are 2**4 parts, and more, to 2**7,
    as the rows grow past ``ROW_BLOCK`` a part. Vectors that are null, zero, empty or hold
    null or non-finite components take no part, nor do null ids. Vectors of another dimension
    than most of the sample are searched in full among their own. Rows that repeat a query's id
    count as its own, and its smallest vector asks. A query searches on until its parts hold 4 k rows, so with fewer than k candidates all are
    returned; an empty table gives no rows. Other columns, of whatever names, are not looked at.
    """
    v = F.col(vector_col)
    base = rows.where(good_vector(v) & F.exists(v, lambda e: e != 0) & F.col(id_col).isNotNull())
    base = stored(base.select(F.col(id_col).cast("long").alias("id"), v.cast("array<double>").alias("v"), F.size(v).alias("dim")), "vectors")
    n = base.count()
    few = base.orderBy(F.xxhash64("id"), "id", "v").limit(sample + trial).collect()
    dims = [r.dim for r in few]
    dim = max(sorted(set(dims)), key=dims.count, default=0)
    fit_on = np.array([r.v for r in few if r.dim == dim], np.float64)
    trial = min(trial, len(fit_on) // 5)
    levels = levels or max(4, min(7, (n // ROW_BLOCK).bit_length()))
    router = Router(fit_on[trial:], fit_on[:trial], levels, neighbours, k, target) if len(fit_on) > 20 * k else None

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = -batch.column(2).to_numpy().astype(np.int64)  # a negative cell is a dimension's own
            at = np.flatnonzero(cells == -dim)
            if router is not None and at.size:
                cells[at] = router.ranked(matrix(batch.column(1).take(pa.array(at))))[:, 0]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cells)], ["id", "v", "cell"])

    index = stored(base.mapInArrow(indexed, "id long, v array<double>, cell long"), "index")
    sizes = counted(index)

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.array([sizes.get(p, 0) for p in range(2**levels)])
        for batch in batches:
            own = batch.column(2).to_numpy()
            cells: list = [[c] for c in own.tolist()]
            at = np.flatnonzero(own >= 0)
            if at.size:
                order = router.ranked(matrix(batch.column(1).take(pa.array(at))))
                enough = (np.cumsum(held[order], axis=1) < 4 * k).sum(axis=1) + 1
                for i, parts, m in zip(at, order, np.maximum(enough, router.probes), strict=True):
                    cells[i] = parts[:m].tolist()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cells, pa.list_(pa.int64()))], ["id", "v", "cells"])

    asked = index.where(F.col("id") % every == 0).groupBy("id").agg(F.min(F.struct("v", "cell")).alias("q")).select("id", "q.v", "q.cell")
    asked = stored(asked.mapInArrow(routed, "id long, v array<double>, cells array<long>"), "asked")
    found = searched(index, asked, sizes, _best(k), "query_id long, vec_id long, score double")
    return ranked(found, k, F.desc("score")).select("query_id", "rank", "vec_id", "score")
