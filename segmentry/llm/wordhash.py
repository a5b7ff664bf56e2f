"""Words of many texts as 64-bit hashes, in numpy, from Arrow's buffers.

Texts are handled in blocks of bounded bytes, so memory follows the block and the
longest single text, not the batch.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_R = np.uint64(0x9E3779B97F4A7C15)
_Q = 0xD6E8FEB86659FD93
_M64 = (1 << 64) - 1
BLOCK_BYTES = 1 << 21


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def byte_values(lower: bool = False, letters: bool = False, seed: int = 7) -> np.ndarray:
    """A random value for each byte; 0 for those that part words.

    Words are runs without ASCII white space, or of letters (all bytes over 127
    count as letters). ``lower`` gives A-Z the values of a-z.
    """
    t = np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    t[[9, 10, 11, 12, 13, 32]] = 0
    if letters:
        keep = np.zeros(256, bool)
        keep[65:91] = keep[97:123] = keep[128:] = True
        t[~keep] = 0
    if lower:
        t[65:91] = t[97:123]
    return t


def text_blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets of the rows in them); a null text is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    n = len(column)
    if not n:
        return
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
        yield lo, min(hi, n), data[offs[lo] : offs[min(hi, n)]], offs[lo : min(hi, n) + 1] - offs[lo]
        lo = min(hi, n)


def word_starts(data: np.ndarray, offs: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values of the bytes, starts of the words, and words of each row."""
    v = table[data]
    word = v != 0
    start = word.copy()
    start[1:] &= ~word[:-1]
    first = offs[:-1][offs[:-1] < offs[1:]]
    start[first] = word[first]
    s = np.flatnonzero(start)
    edge = np.searchsorted(s, offs)
    return v, s, np.diff(edge)


def hash_words(data: np.ndarray, offs: np.ndarray, table: np.ndarray, prefixes: tuple[int, ...] = ()) -> tuple:
    """(hashes of all words, words of each row), then for each n the hashes of the first n bytes (0 for shorter words)."""
    v, s, counts = word_starts(data, offs, table)
    if not s.size:
        return (np.zeros(0, np.uint64), counts, *(np.zeros(0, np.uint64) for _ in prefixes))
    v = v[s[0] :]
    s = s - s[0]
    pos = np.arange(v.size) - np.repeat(s, np.diff(np.append(s, v.size)))
    power = np.cumprod(np.full(int(pos.max()) + 1, _R, np.uint64), dtype=np.uint64)
    v = v * power[pos]
    out = [mix(np.add.reduceat(v, s)), counts]
    for n in prefixes:
        long = np.add.reduceat(((pos == n - 1) & (v != 0)).astype(np.uint8), s, dtype=np.uint8) > 0
        out.append(np.where(long, mix(np.add.reduceat(np.where(pos < n, v, np.uint64(0)), s) + np.uint64(n)), np.uint64(0)))
    return tuple(out)


def gram_hashes(h: np.ndarray, k: int, salt: int = 1) -> np.ndarray:
    """Hashes of k words in turn, for each start; those over the end of a row are not left out."""
    if h.size < k:
        return np.zeros(0, np.uint64)
    g = np.zeros(h.size - k + 1, np.uint64)
    for j in range(k):
        g += h[j : h.size - k + 1 + j] * np.uint64(pow(_Q + 2 * salt, j + 1, 1 << 64))
    return mix(g)


def within_rows(counts: np.ndarray, k: int) -> np.ndarray:
    """Starts of k words in turn that are all in one row."""
    ends = np.repeat(np.cumsum(counts), counts)
    at = np.arange(ends.size)
    return at[at + k <= ends]
