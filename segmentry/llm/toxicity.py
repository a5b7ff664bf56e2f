"""Toxicity of documents by weak supervision.

Voters are the words of a seed lexicon, families of mined patterns (whole words and word beginnings that are far more
frequent in labelled toxic texts than in others; a family are those of one kind, one band of the frequencies' ratio and one band of the texts that hold them) and thresholds on how many words of a
text, and how large a part of it, the patterns match. So every pattern votes, and the number of voters doesn't grow with them. A generative label model estimates by EM how often
each voter speaks in toxic and in other texts, how far the given labels can be believed, and how voters are correlated within the classes,
so that the same evidence isn't counted twice. Its posteriors are
the labels of a linear classifier over the voters, which scores every text.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segmentry.llm.quality import training_part
from segmentry.llm.wordhash import byte_values, hash_words, mix, text_blocks, word_starts
from segmentry.shared import stored

#: A fixed list of common insults, each a voter from the start.
SEEDS = ("idiot", "idiots", "stupid", "moron", "morons", "loser", "losers", "scum", "trash", "pathetic", "worthless", "disgusting", "clown", "garbage", "filth", "dumb", "retard", "imbecile", "vermin", "jerk")
#: Lengths in bytes of the word beginnings that are tried as patterns.
PREFIXES = (4, 5, 6, 7, 8)
#: Labelled rows that label model and classifier are fitted on at most.
SAMPLE = 40_000
#: Patterns that driver and tasks hold at most (some 17 bytes each); more raise an error.
MOST_PATTERNS = 5_000_000
#: Bits of the filter that keeps most texts without a label out of the join; bounds its memory, not the result.
FILTER_BITS = 1 << 23
#: A pattern is sure or likely from these ratios of its frequencies in toxic and other texts.
SURE, LIKELY = 30.0, 5.0
#: Lower ends of the bands of ratios, and of those of toxic texts that hold the pattern, by which patterns make families.
RATIOS, HELD = (3.0, LIKELY, 10.0, SURE, 100.0), (0, 8, 24, 72)
#: Voters on matched words: (likely ones count, words at least, part of the text at least).
DENSITIES = tuple((wide, least, part) for wide in (False, True) for least in (1, 2, 3) for part in (0.0, 0.004, 0.007, 0.01, 0.014, 0.03))


def _units(data: np.ndarray, offs: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of each word, words of each row, units: the word and its beginnings by line, 0 where it is shorter)."""
    h, counts, *parts = hash_words(data, offs, table, PREFIXES)
    return np.repeat(np.arange(offs.size - 1), counts), counts, np.stack([h, *parts])


def _table() -> np.ndarray:
    return byte_values(lower=True, letters=True, seed=21)


def seed_units() -> np.ndarray:
    words = pa.array(["\n".join(SEEDS).encode()], pa.binary())
    _, _, data, offs = next(text_blocks(words))
    return hash_words(data, offs, _table())[0]


def _packed(texts: pa.Array) -> pa.Array:
    """Each text compressed; null as empty."""
    packer = zstandard.ZstdCompressor(level=1)
    return pa.array((packer.compress(t.as_py() or b"") for t in texts), pa.binary())


def _read(texts: pa.Array, packed: bool) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """As ``text_blocks`` gives them, of texts that may be compressed."""
    if not packed:
        yield from text_blocks(texts)
        return
    reader = zstandard.ZstdDecompressor()
    for first, end, _, _ in text_blocks(texts):
        plain = pa.array((reader.decompress(t.as_py()) for t in texts.slice(first, end - first)), pa.large_binary())
        for lo, hi, data, offs in text_blocks(plain):
            yield first + lo, first + hi, data, offs


def _counted(labelled: DataFrame) -> DataFrame:
    """unit, kind (0 for words, then the beginnings by length), toxic texts that hold it, weight in toxic and in other texts (the logarithm of uses and one, by text). Counted in each task before the shuffle."""

    def flush(held: list) -> pa.RecordBatch:
        units, kinds, y, uses = (np.concatenate(x) for x in zip(*held, strict=True))
        keys, first, at = np.unique(units, return_index=True, return_inverse=True)
        sums = [np.bincount(at, weights=x, minlength=keys.size) for x in (y, y * uses, (1 - y) * uses)]
        sums[0] = sums[0].astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(kinds[first].astype(np.int32)), *map(pa.array, sums)], ["unit", "kind", "texts", "toxic", "other"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, held, size = _table(), [], 0
        for batch in batches:
            y = batch.column(1).to_numpy()
            for lo, hi, data, offs in _read(batch.column(0), True):
                row, _, units = _units(data, offs, table)
                kinds, rows = np.repeat(np.arange(len(units)), row.size), np.tile(row, len(units))
                units = units.ravel()
                own = units != 0
                rows, units, kinds = rows[own], units[own], kinds[own]
                order = np.lexsort((kinds, units, rows))
                rows, units, kinds = rows[order], units[order], kinds[order]
                new = np.flatnonzero(np.concatenate(([True], (rows[1:] != rows[:-1]) | (units[1:] != units[:-1])))) if rows.size else np.zeros(0, int)
                held.append((units[new], kinds[new], y[lo:hi][rows[new]], np.log2(1 + np.diff(np.append(new, rows.size)))))
                size += new.size
                if size > 2_000_000:
                    yield flush(held)
                    held, size = [], 0
        if held:
            yield flush(held)

    parts = labelled.select("text", "y").mapInArrow(run, "unit long, kind int, texts long, toxic double, other double")
    return parts.groupBy("unit").agg(F.min("kind").alias("kind"), *(F.sum(c).alias(c) for c in ("texts", "toxic", "other")))


def _maybe_labelled(texts: DataFrame, marks: DataFrame) -> DataFrame:
    """``texts``, compressed, and their words, without most of those whose id isn't among ``marks``."""
    place = lambda ids: (mix(ids.to_numpy().view(np.uint64)) % np.uint64(FILTER_BITS)).astype(np.int64)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(FILTER_BITS, bool)
        for batch in batches:
            held[place(batch.column(0))] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(held).tobytes()], pa.binary())], ["bits"])

    packed = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in marks.select("id").repartition(4).mapInArrow(mark, "bits binary").collect():
        packed |= np.frombuffer(r.bits, np.uint8)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _table()
        held = np.unpackbits(packed).astype(bool)
        for batch in batches:
            found = batch.filter(pa.array(held[place(batch.column(0))]))
            for lo, hi, data, offs in text_blocks(found.column(1)):
                part = found.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([part.column(0), _packed(part.column(1)), pa.array(word_starts(data, offs, table)[2])], ["id", "text", "words"])

    return texts.where("id is not null").mapInArrow(keep, "id long, text binary, words long")


def _votes(texts: DataFrame, patterns: "Patterns", kept: str, kind: str, packed: bool = False) -> DataFrame:
    """Columns ``kept``, ``hits`` (voters that speak in a text), its words that match a sure pattern, a likely one, and all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, n = _table(), patterns.n
        for batch in batches:
            for lo, hi, data, offs in _read(batch.column(1), packed):
                row, counts, found = _units(data, offs, table)
                at = np.minimum(np.searchsorted(patterns.units, found), patterns.units.size - 1)
                ok = patterns.units[at] == found
                pairs = np.unique(np.broadcast_to(row, found.shape)[ok] * n + patterns.voter[at[ok]])
                edge = np.searchsorted(pairs, np.arange(hi - lo + 1) * n)
                hits = pa.ListArray.from_arrays(pa.array(edge.astype(np.int32)), pa.array((pairs % n).astype(np.int32)))
                matched = [np.bincount(row[m.any(axis=0)], minlength=hi - lo) for m in (ok & patterns.sure[at], ok & patterns.likely[at])]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), hits, *(pa.array(x.astype(np.int32)) for x in (*matched, counts))], [kept, "hits", "sure", "any", "words"]
                )

    return texts.select(kept, "text").mapInArrow(run, f"{kept} {kind}, hits array<int>, sure int, any int, words int")


def density_votes(sure: np.ndarray, likely: np.ndarray, words: np.ndarray) -> np.ndarray:
    """One column for each of ``DENSITIES``."""
    return np.column_stack([((k := likely if wide else sure) >= least) & (k >= part * words) for wide, least, part in DENSITIES])


@dataclass
class LabelModel:
    """A text is toxic with probability ``share``; given that or not, each voter speaks at its rate. The label, where it is given, is one more voter, the last.

    Voters aren't independent: the same evidence makes several speak. Their correlations within the classes are estimated too,
    and a voter's word counts by one over the sum of its correlations, itself included, so n copies of a voter count as one.
    """

    rates: np.ndarray
    share: float
    weights: np.ndarray

    @staticmethod
    def fit(votes: np.ndarray, labels: np.ndarray, rounds: int = 60) -> "LabelModel":
        """EM over all rows from first guesses near the labels; afterwards labels are believed as far as the voters bear them out."""
        votes = np.column_stack([votes, labels]).astype(np.float64)
        p = np.where(labels > 0, 0.9, 0.1)
        weights = LabelModel._weights(votes, p, 0.5)
        for i in range(rounds):
            share = float(np.clip(p.mean(), 1e-4, 1 - 1e-4))
            rates = np.stack([(w @ votes + 0.05 * (1 + c)) / (w.sum() + 1) for c, w in enumerate((1 - p, p))])
            model = LabelModel(np.clip(rates, 1e-5, 1 - 1e-5), share, weights)
            new = model._posterior(votes)
            done, p = np.abs(new - p).max() < 1e-4, new
            if i in (5, 10, 15):  # before the classes are parted well, only near copies can be told from voters that are both right
                weights = LabelModel._weights(votes, p, 0.1)
            elif done and i > 15:
                break
        return model

    @staticmethod
    def _weights(votes: np.ndarray, p: np.ndarray, least: float) -> np.ndarray:
        """From the correlations within the classes over ``least`` and over what chance makes of uncorrelated voters."""
        within = np.zeros((votes.shape[1], votes.shape[1]))
        for w in (p, 1 - p):
            total = w.sum() + 1e-9
            mean = w @ votes / total
            within += (votes * w[:, None]).T @ votes - total * np.outer(mean, mean)
        size = np.sqrt(np.maximum(np.diag(within), 1e-9))
        rho = within / size[:, None] / size[None, :]
        np.fill_diagonal(rho, 1)
        return 1 / np.where(rho > max(least, 4 / np.sqrt(p.sum() + 1)), rho, 0).sum(axis=1)

    def posterior(self, votes: np.ndarray, labels: np.ndarray | None = None) -> np.ndarray:
        """Probability of toxic, from the votes alone or with the labels."""
        return self._posterior(votes if labels is None else np.column_stack([votes, labels]))

    def _posterior(self, votes: np.ndarray) -> np.ndarray:
        n = votes.shape[1]
        spoken, silent = np.log(self.rates[1, :n] / self.rates[0, :n]), np.log((1 - self.rates[1, :n]) / (1 - self.rates[0, :n]))
        d = votes @ (self.weights[:n] * (spoken - silent)) + self.weights[:n] @ silent + np.log(self.share / (1 - self.share))
        return 1 / (1 + np.exp(-np.clip(d, -50, 50)))


def linear(votes: np.ndarray, goal: np.ndarray, rounds: int = 600) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression on the votes and on whether there is any."""
    x = np.column_stack([votes, votes.any(axis=1)]).astype(np.float64)
    w, b = np.zeros(x.shape[1]), float(np.log((goal.mean() + 1e-3) / (1 - goal.mean() + 1e-3)))
    gw, gb = np.full(x.shape[1], 1e-8), 1e-8
    for _ in range(rounds):
        d = 1 / (1 + np.exp(-np.clip(x @ w + b, -50, 50))) - goal
        g, h = x.T @ d / len(x) + 1e-5 * w, float(d.mean())
        gw, gb = gw + g * g, gb + h * h
        w, b = w - 0.5 * g / np.sqrt(gw), b - 0.5 * h / np.sqrt(gb)
    return w, b


@dataclass
class Patterns:
    """Sorted units, the voter of each, and whether each is sure, and likely; ``n`` voters: a word of the lexicon each, then the families."""

    units: np.ndarray
    voter: np.ndarray
    sure: np.ndarray
    likely: np.ndarray
    n: int

    @staticmethod
    def of(mined: np.ndarray, kind: np.ndarray, ratio: np.ndarray, texts: np.ndarray) -> "Patterns":
        """A mined pattern that the lexicon has is the lexicon's."""
        seeds = np.unique(seed_units())
        family = (kind * len(RATIOS) + np.searchsorted(RATIOS, ratio, "right") - 1) * len(HELD) + np.searchsorted(HELD, texts, "right") - 1
        new = ~np.isin(mined, seeds)
        units = np.concatenate([seeds, mined[new]])
        voter, odds = np.concatenate([np.arange(seeds.size), seeds.size + family[new]]), np.concatenate([np.full(seeds.size, SURE), ratio[new]])
        order = np.argsort(units)
        return Patterns(units[order], voter[order].astype(np.int64), odds[order] >= SURE, odds[order] >= LIKELY, seeds.size + (1 + len(PREFIXES)) * len(RATIOS) * len(HELD))


def mine(labelled: DataFrame, least: int = 3, most: int = MOST_PATTERNS) -> Patterns:
    """All units with an excess among toxic texts, and the lexicon.

    A unit's frequency is its weight for each word of the class; among toxic texts it is taken lower, and among the others higher, by a deviation.
    """
    words = {r.y: r.n for r in labelled.groupBy("y").agg(F.sum("words").alias("n")).collect()}
    toxic, other = max(words.get(1, 0), 1), max(words.get(0, 0), 1)
    ratio = ((F.col("toxic") - F.sqrt("toxic")) / toxic) / ((F.col("other") + F.sqrt("other") + 1) / other)
    odds = stored(_counted(labelled).where(F.col("texts") >= least).withColumn("ratio", ratio).where(F.col("ratio") >= RATIOS[0]), "patterns")
    if (n := odds.count()) > most:
        raise ValueError(f"{n} patterns are more than driver and tasks may hold ({most})")
    found = odds.toArrow()
    unit, kind, texts, ratio = (found[c].to_numpy() for c in ("unit", "kind", "texts", "ratio"))
    return Patterns.of(unit.view(np.uint64), kind.astype(np.int64), ratio, texts)


def toxicity_scores(docs: DataFrame, labels: DataFrame, flag_at: float = 0.3, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE, most: int = MOST_PATTERNS) -> DataFrame:
    """One row per document: id, ``held_out``, ``score`` (0 to 1), ``predicted``.

    Patterns are counted in all labelled rows of the training part; label model and classifier are
    fitted on at most ``sample`` of these rows, chosen by a hash; every text is scored whole, in blocks of a few megabytes or one longer text. A unit
    counts if three toxic texts hold it. Every pattern is held and votes in its family; more than ``most`` raise an error. Null and empty texts have no votes. Null
    labels teach nothing; ids that repeat are scored row by row; a null id is scored and
    not held out. Without labelled rows only the seed lexicon speaks; an empty table gives no rows. Other columns, of whatever names, are not looked at.
    """
    marks = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("y in (0, 1)").where(training_part())
    marks = stored(marks, "marks")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    # The join is the same at every size: what is exchanged follows the labelled texts.
    known = stored(_maybe_labelled(texts, marks).hint("merge").join(marks, "id").select("id", "text", "words", "y"), "labelled")
    patterns = mine(known, most=most)
    n = patterns.n

    # At most ``sample`` ids, so their broadcast is bounded; of ids that repeat, no more rows than that either.
    chosen = marks.select("id").distinct().orderBy(F.xxhash64("id"), "id").limit(sample)
    rows = _votes(known.join(F.broadcast(chosen), "id", "left_semi"), patterns, "y", "int", True).orderBy("y", "words", "any", "sure", "hits").limit(sample).collect()
    y = np.array([r.y for r in rows], np.float64)
    votes = np.zeros((len(rows), n + len(DENSITIES)), np.float32)
    for i, r in enumerate(rows):
        votes[i, r.hits] = 1
    if 0 < y.sum() < y.size:
        sums = np.array([(r.sure, r["any"], r.words) for r in rows])
        votes[:, n:] = density_votes(*sums.T)
        goal = LabelModel.fit(votes, y).posterior(votes, y)
        weights, bias = linear(votes, goal)
    else:
        weights, bias = np.append(np.ones(votes.shape[1]), 2.0), -2.0

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = batch.column(1)
            sizes = np.diff(hits.offsets.to_numpy())
            row = np.repeat(np.arange(batch.num_rows), sizes)
            z = np.bincount(row, weights=weights[hits.flatten().to_numpy()], minlength=batch.num_rows) + bias + weights[-1] * (sizes > 0)
            z = z + density_votes(*(batch.column(i).to_numpy() for i in (2, 3, 4))) @ weights[n:-1]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(z, -50, 50))))], ["id", "score"])

    scored = _votes(texts, patterns, "id", "long").mapInArrow(score, "id long, score double")
    return scored.select(
        F.col("id").alias(id_col), F.coalesce(~training_part(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= flag_at).cast("int").alias("predicted")
    )
