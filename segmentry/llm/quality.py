"""Quality of documents by a regularised quadratic discriminant.

Statistics of a text (shares of byte classes, repeats of words, lines and word
runs, lengths) are transformed to be nearer to normal. For each class the mean and
covariance come from sums that Spark gathers over all labelled training
rows; covariances are shrunk toward their pooled form and its diagonal. A score is the
logistic of the difference of the log-densities, from Mahalanobis distances
with Cholesky factors made once.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segmentry.llm.wordhash import byte_values, gram_hashes, hash_words, text_blocks, within_rows
from segmentry.shared import stored

#: Byte classes whose shares are statistics: lower case, upper case, digits, sentence marks, symbols, bars, other marks, over ASCII, line ends.
CLASSES = ("lower", "upper", "digit", "stop", "symbol", "bar", "mark", "high", "line")
NAMES = (*CLASSES, "log_words", "word_bytes", "distinct", "same_next", "repeat_3", "repeat_line", "upper_words")


def _class_of() -> np.ndarray:
    c = np.full(256, -1, np.int64)
    for k, chars in enumerate((range(97, 123), range(65, 91), range(48, 58), b".,;:?", b"#$%&*@^~=+<>\\_", b"|", b"!\"'()[]{}-/`", range(128, 256), b"\n")):
        c[list(chars)] = k
    return c


def _distinct_share(h: np.ndarray, row: np.ndarray, n_rows: int) -> np.ndarray:
    """Distinct keys over keys, for each row; 1 for rows without."""
    total = np.bincount(row, minlength=n_rows)
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.concatenate(([True], (h[1:] != h[:-1]) | (row[1:] != row[:-1]))) if h.size else np.zeros(0, bool)
    return np.where(total > 0, np.bincount(row[new], minlength=n_rows) / np.maximum(total, 1), 1.0)


def text_statistics(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """One row of transformed statistics for each text of a block; all finite, empty texts too."""
    n = offs.size - 1
    row = np.repeat(np.arange(n), np.diff(offs))
    shares = []
    size = np.maximum(np.diff(offs), 1)
    kinds = _class_of()[data]
    known = kinds >= 0
    counts = np.bincount(row[known] * len(CLASSES) + kinds[known], minlength=n * len(CLASSES)).reshape(n, -1)
    for k in range(len(CLASSES)):
        shares.append(np.log1p(100 * counts[:, k] / size))
    h, words = hash_words(data, offs, byte_values())[:2]
    w_row = np.repeat(np.arange(n), words)
    black = size - np.bincount(row[np.isin(data, [9, 10, 11, 12, 13, 32])], minlength=n)
    same = (h[1:] == h[:-1]) & (w_row[1:] == w_row[:-1])
    at = within_rows(words, 3)
    g = gram_hashes(h, 3)
    lines, line_counts = hash_words(data, offs, _line_table())[:2]
    l_row = np.repeat(np.arange(n), line_counts)
    return np.column_stack(
        [
            *shares,
            np.log1p(words),
            np.log1p(black / np.maximum(words, 1)),
            np.log1p(100 * (1 - _distinct_share(h, w_row, n))),
            np.log1p(100 * np.bincount(w_row[1:][same], minlength=n) / np.maximum(words, 1)),
            np.log1p(100 * (1 - _distinct_share(g[at], w_row[at], n))),
            np.log1p(100 * (1 - _distinct_share(lines, l_row, n))),
            np.log1p(100 * counts[:, 1] / np.maximum(words, 1)),
        ]
    )


def _line_table() -> np.ndarray:
    t = byte_values(seed=11)
    fresh = np.random.default_rng(12).integers(1, 1 << 63, 6, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    t[[9, 11, 12, 13, 32]] = fresh[:5]
    t[10] = 0
    return t


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """Columns ``id``, ``row`` (null without ``row_col``) and ``x``, the statistics of each whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offs in text_blocks(batch.column(2)):
                x = text_statistics(data, offs)
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(lo, hi - lo) for i in (0, 1)), pa.array(list(x), pa.list_(pa.float64()))], ["id", "row", "x"])

    row = F.col(row_col) if row_col else F.lit(None).cast("long")
    return docs.select(F.col(id_col).alias("id"), row.alias("row"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, "id long, row long, x array<double>")


@dataclass
class Discriminant:
    """Means, inverse Cholesky factors, log-determinants and log-priors of classes 0 and 1."""

    means: np.ndarray
    inverse: np.ndarray
    log_det: np.ndarray
    prior: np.ndarray
    scale: float = 1.0

    def scores(self, x: np.ndarray) -> np.ndarray:
        d = []
        for c in (0, 1):
            z = (x - self.means[c]) @ self.inverse[c].T
            d.append(self.prior[c] - self.log_det[c] - 0.5 * (z * z).sum(axis=1))
        return 1 / (1 + np.exp(-np.clip(self.scale * (d[1] - d[0]), -700, 700)))


def discriminant(counts: np.ndarray, sums: np.ndarray, outer: np.ndarray, shrink: float = 0.2, ridge: float = 0.02) -> Discriminant:
    """From each class's count, sums and sums of products. Classes without rows get the pooled form."""
    total = max(counts.sum(), 1)
    k = sums.shape[1]
    pooled_mean = sums.sum(axis=0) / total
    pooled = outer.sum(axis=0) / total - np.outer(pooled_mean, pooled_mean)
    diag = np.diag(np.maximum(np.diag(pooled), 1e-4))
    means, inverse, log_det = [], [], []
    for c in (0, 1):
        m = sums[c] / counts[c] if counts[c] else pooled_mean
        s = outer[c] / counts[c] - np.outer(m, m) if counts[c] else pooled
        a = max(shrink, k / (k + counts[c]))
        low = np.linalg.cholesky((1 - a) * s + a * pooled * 0.5 + (a * 0.5 + ridge) * diag)
        means.append(m)
        inverse.append(np.linalg.inv(low))
        log_det.append(np.log(np.diag(low)).sum())
    return Discriminant(np.array(means), np.array(inverse), np.array(log_det), np.log((counts + 1) / (total + 2)))


def fit(labelled: DataFrame, shrink: float = 0.2) -> Discriminant:
    """``labelled``: columns x and y (0 or 1). Only sums of each class come to the driver."""
    width = len(NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 + width + width * width))
        for batch in batches:
            x = batch.column(0).flatten().to_numpy().reshape(-1, width)
            y = batch.column(1).to_numpy()
            for c in (0, 1):
                part = x[y == c]
                total[c] += np.concatenate(([len(part)], part.sum(axis=0), (part.T @ part).ravel()))
        yield pa.RecordBatch.from_arrays([pa.array([0, 1]), pa.array(list(total), pa.list_(pa.float64()))], ["y", "sums"])

    parts = labelled.select("x", F.col("y").cast("long").alias("y")).mapInArrow(run, "y long, sums array<double>")
    rows = parts.select("y", F.posexplode("sums").alias("i", "v")).groupBy("y", "i").agg(F.sum("v").alias("v")).collect()
    total = np.zeros((2, 1 + width + width * width))
    for r in rows:
        total[r.y, r.i] = r.v
    return discriminant(total[:, 0], total[:, 1 : 1 + width], total[:, 1 + width :].reshape(2, width, width), shrink)


def training_part(column: str = "id"):
    """Rows whose crc32 of the id as text leaves another remainder than 2 by 4."""
    return F.crc32(F.col(column).cast("string")) % 4 != 2


def quality_scores(docs: DataFrame, labels: DataFrame, keep_at: float = 0.7, shrink: float = 0.2, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", row_col: str | None = None) -> DataFrame:
    """One row per document: id, ``held_out``, ``score`` (0 to 1), ``predicted``; with ``row_col`` that column too.

    Learns from labelled rows of the training part only, from the text only. Null and
    empty texts are scored as texts without words. Null labels teach nothing; ids
    that repeat are scored row by row; a null id is scored, never held out and
    teaches nothing. Without any labels all rows get the same score, one half; an empty table gives no rows. Texts are
    read in blocks of a few megabytes or one longer text. Other columns, of whatever names, are not looked at.
    """
    stats = stored(statistics(docs, id_col, text_col, row_col), "statistics")
    marks = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("y")).where("y in (0, 1)").where(training_part())
    model = fit(stats.join(marks, "id"), shrink)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(2).flatten().to_numpy().reshape(-1, len(NAMES))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(model.scores(x))], ["id", "row", "score"])

    scored = stats.mapInArrow(run, "id long, row long, score double")
    return scored.select(
        *([F.col("row").alias(row_col)] if row_col else []),
        F.col("id").alias(id_col), F.coalesce(~training_part(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= keep_at).cast("int").alias("predicted")
    )
