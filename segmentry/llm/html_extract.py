"""Main text of web pages.

A page is read as blocks of text with the containers that they stand in. The suffixes of a host's token streams, what stands in
marked articles apart, are grouped by a hash of their first ``run`` tokens: groups are the stretches of a suffix array whose neighbours share so
long a prefix, but suffixes aren't sorted, and no longer prefix is measured. A group of suffixes of several distinct pages is a long repeated substring. Tokens
that repeats cover are boilerplate, unique runs stay. Marks correct what repetition can't tell: an article protects its blocks,
as articles are reposted, and containers whose element, role or class names them as menus, headers, footers, sidebars, notices, adverts,
forms or comments veto theirs, as adverts differ on every page.
"""

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segmentry.llm.url_filter import host_of
from segmentry.llm.wordhash import byte_values, gram_hashes, hash_words, mix, text_blocks, within_rows
from segmentry.shared import stored

# Elements and names by which pages mark what is not the article.
DROPPED = frozenset("head script style noscript template nav header footer aside form button select option textarea svg iframe canvas object audio video menu dialog title".split())
RAW = "script|style|textarea|title|iframe|noscript|template|svg"
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
NAMES = frozenset(
    "ad ads advert adverts advertisement sponsor sponsored promo banner cookie cookies consent gdpr notice notices newsletter subscribe subscription popup modal sidebar menu nav navbar navigation "
    "breadcrumb breadcrumbs comment comments disqus respond reply header footer masthead share sharing social related recommended widget pagination pager login signup search skip".split()
)
COMMENTS = frozenset("comment comments disqus respond reply replies".split())
#: Words beside an unwanted one that name its form only, so that the whole name is unwanted.
FORMS = frozenset("area bar block bottom box button buttons container content element group inline inner item items left link links list main outer page panel post posts primary right section site slot top unit wrap wrapper".split())
#: Words that say of a name after them, or before them, that it isn't meant, and those that a header of an article has before it.
NOT_MEANT, FREE = frozenset("no not without has with hide hides".split()), frozenset("free less".split())
OF_ARTICLE = frozenset("article content entry post section story title".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
MAIN = frozenset(("article", "main"))
#: Marks of blocks: in an article, in no container that says anything, in an unwanted one, in an article in an unwanted one.
PROTECTED, OPEN, VETOED, INNER = 1, 0, -1, -2

_ATTRIBUTES = r"(?:[^<>=]|=\s*(?:\"[^\"]*\"|'[^']*')?)*+"
_TAG = re.compile(rf"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<({RAW})\b{_ATTRIBUTES}>.*?(?:</\1\s*>|\Z)|<(/?)([a-z][^\s/<>]*+)({_ATTRIBUTES})>", re.S | re.I)
_NAMED = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORD = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


def _says(name: str, whole: bool) -> str:
    """The unwanted kind that a class or id names: '', 'veto' or 'comment'. ``site-header`` names one; ``no-sidebar``, ``ad-free`` and ``article-header`` don't, and with ``whole`` neither does ``notice-board``."""
    words = ["", *_WORD.findall(_CAMEL.sub("-", name).lower()), ""]
    if whole and not all(w in NAMES or w in FORMS or len(w) < 2 for w in words):
        return ""
    for before, word, after in zip(words, words[1:], words[2:], strict=False):
        if word in NAMES and before not in NOT_MEANT and after not in FREE and not (word == "header" and before in OF_ARTICLE):
            return "comment" if word in COMMENTS else "veto"
    return ""


def _unwanted(tag: str, attributes: str, in_article: bool) -> str:
    """'', 'veto' or 'comment' for a container. In an article, or beside a class that names one, only whole names count."""
    if tag in ("html", "body", "main"):
        return ""
    if tag in DROPPED and not (tag == "header" and in_article):
        return "veto"
    said = set()
    named = [(name.lower(), next(filter(None, values), "").split()) for name, *values in _NAMED.findall(attributes)] if attributes else []
    whole = in_article or any(x.lower() in OF_ARTICLE for name, values in named if name != "role" for x in values)
    for name, values in named:
        said |= {"veto" if x.lower() in ROLES else "" for x in values} if name == "role" else {_says(x, whole) for x in values}
    return "comment" if "comment" in said else "veto" if "veto" in said else ""


class _Open:
    """Containers that are open and say something of what stands in them, the innermost last. Each knows its mark from the one below, and each tag its containers."""

    def __init__(self) -> None:
        self.frames: list[list] = []  # [tag, containers of the tag that say nothing, mark, a comment or a veto at or below]
        self.of_tag: dict[str, list[int]] = {}

    @property
    def mark(self) -> int:
        return self.frames[-1][2] if self.frames else OPEN

    def holds(self, tag: str) -> bool:
        return bool(self.of_tag.get(tag))

    def push(self, tag: str, kind: str) -> None:
        below = self.frames[-1][3] if self.frames else ""
        worst = "comment" if "comment" in (kind, below) else "veto" if "veto" in (kind, below) else ""
        mark = VETOED if kind != "main" or worst == "comment" else INNER if worst else PROTECTED
        self.of_tag.setdefault(tag, []).append(len(self.frames))
        self.frames.append([tag, 1, mark, worst])

    def nest(self, tag: str) -> None:
        self.frames[self.of_tag[tag][-1]][1] += 1

    def close(self, tag: str) -> None:
        own = self.of_tag[tag][-1]
        self.frames[own][1] -= 1
        if not self.frames[own][1]:
            for gone, *_ in self.frames[own:]:
                self.of_tag[gone].pop()
            del self.frames[own:]


def marked_blocks(page: str) -> list[tuple[int, str]]:
    """(mark, block) in page order, white space made single. Time is in proportion to the page, however deep its containers stand in each other and also where nothing is closed."""
    out: list[tuple[int, str]] = []
    text: list[str] = []
    open_ = _Open()
    at, mark = 0, OPEN

    def close() -> None:
        block = " ".join(entities.unescape("".join(text)).split())
        text.clear()
        if block:
            out.append((mark, block))

    for m in _TAG.finditer(page):
        if m.start() > at:
            text.append(page[at : m.start()])
        at = m.end()
        tag = (m[3] or "").lower()
        if not tag:
            continue
        if tag == "br":
            text.append(" ")
        unwanted = "" if m[2] or tag in VOID else _unwanted(tag, m[4], mark == PROTECTED)
        if tag not in INLINE or unwanted or open_.holds(tag):
            close()
        if m[2]:
            if open_.holds(tag):
                open_.close(tag)
        elif tag in VOID or m[4].endswith("/"):
            continue
        elif unwanted or tag in MAIN:
            open_.push(tag, unwanted or "main")
        elif open_.holds(tag):
            open_.nest(tag)
        mark = open_.mark
    text.append(page[at:])
    close()
    # An article in an unwanted container is the article after all if there is no other: the container was never closed, or its name misleads.
    inner = VETOED if any(mark == PROTECTED for mark, _ in out) else PROTECTED
    return [(inner if mark == INNER else mark, block) for mark, block in out]


def _streams(pages: list[list[tuple[int, str]]], articles: bool) -> pa.Array:
    """The token streams of what stands in articles, or outside of them."""
    return pa.array(["\n".join(block for mark, block in blocks if (mark == PROTECTED) == articles) for blocks in pages], pa.string())


def _suffixes(streams: pa.Array, hosts: np.ndarray, run: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of blocks of streams: (first, end, words of each, starts of the suffixes, the stream of each, two hashes of their first ``run`` tokens)."""
    table = byte_values()
    for lo, hi, data, offs in text_blocks(streams):
        h, counts = hash_words(data, offs, table)[:2]
        at = within_rows(counts, run)
        row = np.repeat(np.arange(hi - lo), counts)[at]
        yield lo, hi, counts, at, row, mix(gram_hashes(h, run)[at] + hosts[lo:hi][row]), gram_hashes(h, run, 2)[at]


def repeats(pages: DataFrame, run: int, least_pages: int) -> DataFrame:
    """``pages``: id, page, host (a hash) and html. id and ``known``: hashes of the page's suffixes outside of articles that stand on ``least_pages`` pages of its host or more.

    Articles of a host are looked through too if it has open blocks, as only these are decided by repeats.
    """
    schema = "id long, page long, h long, h2 int"

    def suffixes(articles: bool):
        def run_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for lo, hi, _, _ in text_blocks(batch.column(3)):
                    part = batch.slice(lo, hi - lo)
                    blocks = [marked_blocks(x or "") for x in part.column(3).to_pylist()]
                    hosts = part.column(2).to_numpy()
                    for first, end, _, _, row, h, h2 in _suffixes(_streams(blocks, articles), hosts.view(np.uint64), run):
                        keep = np.unique(np.column_stack((row.astype(np.uint64), h, h2)), axis=0)
                        owner, own = pa.array(keep[:, 0].astype(np.int64)), part.slice(first, end - first)
                        hashes = pa.array(np.ascontiguousarray(keep[:, 1]).view(np.int64)), pa.array((keep[:, 2] >> np.uint64(33)).astype(np.int32))
                        yield pa.RecordBatch.from_arrays([own.column(0).take(owner), own.column(1).take(owner), *hashes], ["id", "page", "h", "h2"])
                    asks = np.unique([host for host, page in zip(hosts, blocks, strict=True) if any(mark == OPEN for mark, _ in page)]).astype(np.int64)
                    if not articles and asks.size:  # rows that name hosts
                        none = pa.nulls(asks.size, pa.int64())
                        yield pa.RecordBatch.from_arrays([none, pa.array(asks), none, none.cast(pa.int32())], ["id", "page", "h", "h2"])

        return run_

    read = pages.select("id", "page", "host", "html")
    found = stored(read.mapInArrow(suffixes(False), schema), "suffixes")
    hosts = stored(found.where("h is null").select(F.col("page").alias("host")).distinct(), "hosts")  # stored, so that few are broadcast and the pages stay where they are
    inside = read.join(hosts, "host", "left_semi").select("id", "page", "host", "html").mapInArrow(suffixes(True), schema)
    found = found.where("h is not null")
    shared = found.unionByName(inside).select("h", "h2", "page").distinct().groupBy("h", "h2").agg(F.count("*").alias("n")).where(F.col("n") >= least_pages)
    return stored(found.join(shared, ["h", "h2"]).groupBy("id").agg(F.collect_set("h").alias("known")), "repeats")


def main_text(pages: DataFrame, run: int = 8, least_pages: int = 3, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: id, url, ``text``, ``n_chars``, ``n_repeated`` (words outside of articles that the host's repeats cover).

    Blocks stand in page order, joined by one line end: those of articles, and of those in no unwanted container what
    no repeat covers. Repeats are looked for in all pages of the host. A null or empty page has an empty text and 0
    characters; a null url is the host ''. Rows that repeat an id count as one page
    when repeats are looked for, a null id counts for itself, and each row gets its text. An empty table gives no rows. Pages are read whole, a few megabytes at a time or
    one longer page. Other columns, of whatever names, are not looked at.
    """
    read = pages.select(F.col(id_col).alias("of"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    read = read.withColumn("id", F.xxhash64("of", "url", "html")).withColumn("page", F.coalesce("of", "id")).withColumn("host", F.xxhash64(host_of(F.col("url"))))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor()
        for batch in batches:
            for lo, hi, _, _ in text_blocks(batch.column(4)):
                part = batch.slice(lo, hi - lo)
                found = [packer.compress("\n".join(f"{mark}\t{block}" for mark, block in marked_blocks(x or "")).encode()) for x in part.column(4).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:4], pa.array(found, pa.binary())], ["of", "url", "id", "host", "blocks"])

    def unpacked(packed: bytes) -> list[tuple[int, str]]:
        lines = zstandard.ZstdDecompressor().decompress(packed).decode().split("\n")
        return [(int(mark), block) for mark, _, block in (line.partition("\t") for line in lines if line)]

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, texts, repeated = batch.column(2).to_numpy().view(np.uint64), [], []
            for lo in range(0, batch.num_rows, 64):  # pages are compressed until they are read
                part = batch.slice(lo, 64)
                rows = [unpacked(x) for x in part.column(3).to_pylist()]
                for first, end, counts, at, row, h, _ in _suffixes(_streams(rows, False), hosts[lo : lo + 64], run):
                    edge = np.zeros(int(counts.sum()) + 1, np.int64)
                    begin = np.searchsorted(row, np.arange(end - first + 1))
                    for i in range(end - first):
                        if part.column(4)[first + i].is_valid:
                            own = slice(begin[i], begin[i + 1])
                            hit = at[own][np.isin(h[own], part.column(4)[first + i].values.to_numpy().view(np.uint64))]
                            edge[hit] += 1
                            np.add.at(edge, hit + run, -1)
                    covered = np.cumsum(edge[:-1]) > 0
                    start = np.concatenate(([0], np.cumsum(counts)))
                    for i in range(end - first):
                        gone, lines, place = covered[start[i] : start[i + 1]], [], 0
                        for mark, block in rows[first + i]:
                            if mark == PROTECTED:
                                lines.append(block)
                                continue
                            words = block.split(" ")
                            if mark == OPEN:
                                lines.append(" ".join(w for w, g in zip(words, gone[place:], strict=False) if not g))
                            place += len(words)
                        texts.append("\n".join(filter(None, lines)))
                        repeated.append(int(gone.sum()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(repeated, pa.int64())], ["of", "url", "text", "n_repeated"])

    told = read.select("of", "url", "id", "host", "html").mapInArrow(blocks, "of long, url string, id long, host long, blocks binary")
    told = told.join(repeats(read, run, least_pages), "id", "left").select("of", "url", "host", "blocks", "known")
    done = told.mapInArrow(finish, "of long, url string, text string, n_repeated long")
    return done.select(F.col("of").alias(id_col), F.col("url").alias(url_col), "text", F.length("text").cast("long").alias("n_chars"), "n_repeated")
