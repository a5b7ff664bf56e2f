"""A stated query set against all rows, in blocks of bounded size.

Rows lie in cells, whose number callers bound. A query names the cells that it searches. A cell's rows and its
queries are dealt into blocks by their counts, and each block of rows meets each block of queries of its cell.
"""

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows and queries that meet in one task, on average.
ROW_BLOCK, QUERY_BLOCK = 4096, 2048


def matrix(column) -> np.ndarray:
    """A column of lists of one length as rows of doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)


def good_vector(v: Column) -> Column:
    """Whether a vector is there, has components and all of them are finite."""
    return v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e.cast("double")) < float("inf")))


def counted(df: DataFrame, cell: str = "cell") -> dict[int, int]:
    """Rows of each cell."""
    return {r.cell: r.n for r in df.groupBy(F.col(cell).alias("cell")).agg(F.count("*").alias("n")).collect()}


def searched(rows: DataFrame, asked: DataFrame, sizes: dict[int, int], top: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """What ``top(queries, rows)`` gives for all blocks that meet.

    ``rows`` have ``id`` and ``cell``, ``asked`` ``id`` and ``cells``, an array; ``sizes`` are the rows of each cell.
    """
    asks = counted(asked.select(F.explode("cells").alias("cell")))
    table = [(c, -(-sizes[c] // ROW_BLOCK), -(-n // QUERY_BLOCK)) for c, n in asks.items() if c in sizes]
    cells = F.broadcast(rows.sparkSession.createDataFrame(table, "cell long, row_blocks long, query_blocks long"))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    held = rows.join(cells, "cell").withColumn("block", F.pmod(F.xxhash64("id"), "row_blocks")).withColumn("q_block", every("query_blocks"))
    asked = asked.withColumn("cell", F.explode("cells")).drop("cells").join(cells, "cell")
    asked = asked.withColumn("q_block", F.pmod(F.xxhash64("id", F.lit(5)), "query_blocks")).withColumn("block", every("row_blocks"))
    keys, rest = ["cell", "block", "q_block"], ("row_blocks", "query_blocks")
    return asked.drop(*rest).groupBy(*keys).cogroup(held.drop(*rest).groupBy(*keys)).applyInArrow(top, schema)


def ranked(found: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first k rows of each ``query_id`` with their ``rank``, from 1."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(*order, "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)
