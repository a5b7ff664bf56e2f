"""Languages of documents as mixtures.

Each language has a model of the byte trigrams within words (Witten-Bell, down to bigrams and single bytes), from counts over all labelled
documents. A document's words are drawn from a mixture of languages whose proportions expectation-maximisation
estimates. The set of languages grows from the likeliest one by the one that raises the likelihood most, as long as the likelihood less a
penalty for each language rises.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segmentry.llm.wordhash import byte_values, text_blocks, word_starts
from segmentry.shared import stored

#: Symbols: the edge of a word, 26 letters without case, and the bytes over 127.
SYMBOLS = 1 + 26 + 128
#: A new language must raise the log-likelihood by this for each word of the text, as models of related languages explain some words better by chance.
PER_WORD = 0.03
#: Trigrams times languages that the driver holds at most (trigrams are at most 155 cubed); more raise an error.
MOST_CELLS = 100_000_000
#: Trigrams that a task gathers before it pre-aggregates them; bounds its memory, not the result.
FLUSH = 4_000_000


def _symbols() -> np.ndarray:
    t = np.zeros(256, np.int32)
    t[65:91] = t[97:123] = np.arange(1, 27)
    t[128:] = np.arange(27, SYMBOLS)
    return t


def trigrams(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes of the trigrams, trigrams of each word, words of each text). A word of n bytes has n + 1: each byte and its end, after the two symbols before."""
    _, start, words = word_starts(data, offs, byte_values(letters=True))
    symbol = _symbols()[data]
    letter = np.flatnonzero(symbol)
    if not letter.size:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), words
    first = np.searchsorted(letter, start)
    sizes = np.diff(np.append(first, letter.size))
    # Two edges stand before each word; the first of them ends the word before.
    line = np.zeros(letter.size + 2 * start.size + 2, np.int64)
    line[np.arange(letter.size) + 2 * np.repeat(np.arange(1, start.size + 1), sizes)] = symbol[letter]
    codes = (line[:-2] * SYMBOLS + line[1:-1]) * SYMBOLS + line[2:]
    keep = np.ones(codes.size, bool)
    keep[(first + 2 * np.arange(1, start.size + 1) - 3)[1:]] = False  # those of a second edge
    return codes[keep][: letter.size + start.size], sizes + 1, words


def counted(labelled: DataFrame) -> DataFrame:
    """``labelled``: lang and text (bytes). lang, code and n, counted in each task before the shuffle."""

    def flush(held: list, names: list) -> pa.RecordBatch:
        keys, n = (np.concatenate(x) for x in zip(*held, strict=True))
        keys, at = np.unique(keys, return_inverse=True)
        langs = pa.array(names, pa.string()).take(pa.array(keys // SYMBOLS**3))
        return pa.RecordBatch.from_arrays([langs, pa.array((keys % SYMBOLS**3).astype(np.int32)), pa.array(np.bincount(at, weights=n).astype(np.int64))], ["lang", "code", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: dict[str, int] = {}
        held, size = [], 0
        for batch in batches:
            lang = np.array([names.setdefault(x, len(names)) for x in batch.column(0).to_pylist()], np.int64)
            for lo, hi, data, offs in text_blocks(batch.column(1)):
                codes, sizes, words = trigrams(data, offs)
                keys = np.sort(np.repeat(np.repeat(lang[lo:hi], words), sizes) * SYMBOLS**3 + codes)
                new = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: keys.size])
                held.append((keys[new], np.diff(np.append(new, keys.size))))
                size += new.size
                if size > FLUSH:
                    yield flush(held, list(names))
                    held, size = [], 0
        if held:
            yield flush(held, list(names))

    return labelled.mapInArrow(run, "lang string, code int, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    """Log-probabilities of the trigrams that are known of some language, and what all others have by their last two symbols and their context; log shares of the languages."""

    langs: list[str]
    codes: np.ndarray
    known: np.ndarray
    last: np.ndarray
    escape: np.ndarray
    prior: np.ndarray

    @staticmethod
    def fit(langs: list[str], codes: np.ndarray, n: np.ndarray, docs: np.ndarray) -> "Model":
        """``n``: counts by code and language; ``docs``: documents of each language."""
        a = SYMBOLS

        def folded(key: np.ndarray, size: int, x: np.ndarray) -> np.ndarray:
            return np.stack([np.bincount(key, weights=x[:, j], minlength=size) for j in range(x.shape[1])], 1)

        one = folded(codes % a, a, n)
        total, kinds = one.sum(axis=0), (one > 0).sum(axis=0)
        p1 = (one + kinds / a + 1e-9) / (total + kinds + a * 1e-9)
        two = folded(codes % (a * a), a * a, n)
        held, kinds = (x.reshape(a, a, -1).sum(axis=1) for x in (two, (two > 0).astype(np.float64)))
        weight = np.where(held > 0, kinds / np.maximum(held + kinds, 1), 1)
        p2 = two.reshape(a, a, -1) / np.maximum(held + kinds, 1)[:, None] + weight[:, None] * p1[None]
        p2 = p2.reshape(a * a, -1)
        held, kinds = (folded(codes // a, a * a, x) for x in (n, (n > 0).astype(np.float64)))
        weight = np.where(held > 0, kinds / np.maximum(held + kinds, 1), 1)
        context = codes // a
        p3 = n / np.maximum(held + kinds, 1)[context] + weight[context] * p2[codes % (a * a)]
        return Model(langs, codes, np.log(p3).astype(np.float32), np.log(p2).astype(np.float32), np.log(weight).astype(np.float32), np.log(docs / docs.sum()))

    def words(self, codes: np.ndarray, sizes: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Log-likelihood of each word (row) in each language; ``place``: of each code among the known ones, or -1."""
        out = np.empty((sizes.size, len(self.langs)))
        if not sizes.size:
            return out
        at = place[codes]
        new = np.flatnonzero(at < 0)
        tail, context = codes[new] % SYMBOLS**2, codes[new] // SYMBOLS
        start = np.cumsum(sizes) - sizes
        for j in range(len(self.langs)):
            p = self.known[at, j]
            p[new] = self.last[tail, j] + self.escape[context, j]
            out[:, j] = np.add.reduceat(p, start, dtype=np.float64)
        return out


def mixtures(ll: np.ndarray, words: np.ndarray, prior: np.ndarray, per_word: float = PER_WORD, rounds: int = 25) -> tuple[np.ndarray, np.ndarray]:
    """(shares of the languages, posterior of each language as the only one) of texts of ``words`` rows of ``ll`` each; texts have a word at least."""
    start, n_langs = np.cumsum(words) - words, ll.shape[1]
    alone = np.add.reduceat(ll, start, axis=0) + prior
    best = alone.argmax(axis=1)
    posterior = np.exp(alone - alone.max(axis=1, keepdims=True))
    posterior /= posterior.sum(axis=1, keepdims=True)
    share = np.zeros((words.size, n_langs))
    share[np.arange(words.size), best] = 1
    # From here on with each word's likeliest language at 1, so that nothing underflows.
    p = np.exp(ll - ll.max(axis=1, keepdims=True))
    open_ = np.arange(words.size)
    while open_.size and n_langs > 1:
        n = words[open_]
        row = np.repeat(start[open_] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        q, doc, edge = p[row], np.repeat(np.arange(open_.size), n), np.cumsum(n) - n
        now = np.log(np.maximum((q * share[open_][doc]).sum(axis=1), 1e-300))
        cost = np.log(n + 1) + per_word * n
        # No mixture with a further language is better than the best of both for each word.
        gain, most = np.empty((open_.size, n_langs)), np.empty((open_.size, n_langs))
        for j in range(n_langs):
            other = np.log(np.maximum(q[:, j], 1e-300))
            most[:, j] = np.add.reduceat(np.maximum(other - now, 0), edge)
            gain[:, j] = np.add.reduceat(np.log(0.9 * np.exp(now) + 0.1 * q[:, j]) - now, edge)
        gain[(share[open_] > 0) | (most <= cost[:, None])] = -np.inf
        add = gain.argmax(axis=1)
        go = np.flatnonzero(gain[np.arange(open_.size), add] > -np.inf)
        on = np.isin(doc, go)
        q, now, add, n, open_ = q[on], now[on], add[go], n[go], open_[go]
        if not open_.size:
            break
        doc, edge = np.repeat(np.arange(open_.size), n), np.cumsum(n) - n
        new = share[open_] * 0.9
        new[np.arange(open_.size), add] = 0.1
        # Each text stops by itself, so its result doesn't depend on those beside it.
        moving = np.ones(open_.size, bool)
        for _ in range(rounds):
            r = q * new[doc]
            r /= np.maximum(r.sum(axis=1, keepdims=True), 1e-300)
            step = np.add.reduceat(r, edge, axis=0) / n[:, None]
            settled = np.abs(step - new).max(axis=1) < 1e-3
            new[moving] = step[moving]
            moving &= ~settled
            if not moving.any():
                break
        rise = np.add.reduceat(np.log(np.maximum((q * new[doc]).sum(axis=1), 1e-300)) - now, edge)
        taken = rise > cost[go]
        share[open_[taken]] = new[taken]
        open_ = open_[taken]
    return share, posterior


def languages(docs: DataFrame, per_word: float = PER_WORD, most_cells: int = MOST_CELLS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per document: id, ``held_out``, ``lang_pred``, ``score``, ``mixture`` (language and share of the words, largest first).

    ``lang_pred`` is the language of the largest share; ``score`` is this share times the language's posterior against the languages that are not in
    the mixture. The models learn from rows with a language whose crc32 of the id as text isn't divisible by 5, from all of them. A
    text without a letter, null or empty, is ``und`` with score 0 and no mixture, as is every text if there is nothing to learn from. A null id
    is scored, not held out, and teaches nothing; rows that repeat an id are scored row by row. Equal shares go to the language that
    is first by name. An empty table gives no rows. Texts are read whole, a few megabytes at a time or one longer text. The driver holds
    ``most_cells`` counts at most; more raise an error. Other columns, of whatever names, are not looked at.
    """
    teaches = F.crc32(F.col("id").cast("string")) % 5 != 0
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"), F.col(lang_col).alias("lang"), F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)).alias("lettered"))
    held_out = F.coalesce(~teaches, F.lit(False)).alias("held_out")
    known = texts.where(teaches & F.col("lang").isNotNull() & F.col("lettered"))
    of_lang = {r.lang: r.n for r in known.groupBy("lang").agg(F.count("*").alias("n")).orderBy("lang").limit(most_cells // SYMBOLS + 1).collect()}
    counts = stored(counted(known.select("lang", "text")), "trigrams")
    cells = counts.select("code").distinct().count() * max(1, len(of_lang))
    if cells > most_cells:
        raise ValueError(f"{cells} trigrams of languages are more than the driver may hold ({most_cells})")
    table, langs = counts.toArrow(), list(of_lang)
    found = table["code"].to_numpy()
    codes, at = np.unique(found, return_inverse=True)
    n = np.zeros((codes.size, len(langs)))
    where = {lang: j for j, lang in enumerate(langs)}
    n[at, np.array([where[x] for x in table["lang"].to_pylist()], np.int64)] = table["n"].to_numpy()
    model = Model.fit(langs, codes.astype(np.int64), n, np.array(list(of_lang.values()), np.float64)) if langs else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = np.full(SYMBOLS**3, -1, np.int32)
        if model:
            place[model.codes] = np.arange(model.codes.size)
        for batch in batches:
            for lo, hi, data, offs in text_blocks(batch.column(1)):
                part = batch.slice(lo, hi - lo)
                lettered = part.column(2).to_numpy(zero_copy_only=False).astype(bool)
                pred, score, mixture = ["und"] * (hi - lo), np.zeros(hi - lo), [[] for _ in range(hi - lo)]
                if model:
                    codes, sizes, words = trigrams(data, offs)
                    full = np.flatnonzero((words > 0) & lettered)
                    on = np.repeat(np.isin(np.arange(hi - lo), full), words)
                    ll = model.words(codes[np.repeat(on, sizes)], sizes[on], place)
                    share, posterior = mixtures(ll, words[full], model.prior, per_word) if full.size else (np.zeros((0, len(model.langs))),) * 2
                    best = share.argmax(axis=1)
                    for i, b, s, p in zip(full.tolist(), best.tolist(), share, posterior, strict=True):
                        outside = s <= 0
                        pred[i], score[i] = model.langs[b], min(1.0, s[b] * p[b] / (p[b] + p[outside].sum() + 1e-300))
                        mixture[i] = [{"lang": model.langs[j], "share": float(s[j])} for j in np.argsort(-s, kind="stable") if s[j] > 0]
                kind = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(pred), pa.array(score), pa.array(mixture, kind)], ["id", "lang_pred", "score", "mixture"])

    out = texts.select("id", "text", "lettered").mapInArrow(run, "id long, lang_pred string, score double, mixture array<struct<lang:string,share:double>>")
    return out.select(F.col("id").alias(id_col), held_out, "lang_pred", "score", "mixture")
