"""Trie of conversation prefixes, packed as double arrays.

Equal conversations are counted first. The different ones, in the order of their turns, are dealt by ranges into shards, so a
first turn that many share is split as finely as any other. A shard packs its conversations over dense turn ids
into BASE and CHECK arrays (the child of node s by turn c is ``t = BASE[s] + c`` where ``CHECK[t] = s``) and walks them for its nodes. Only
nodes on a shard's first and last path can stand in other shards as well: their aggregates are merged in Spark, and what two shards count both
is taken off the later one. All others are final where they were made.
"""

from collections.abc import Iterator
from dataclasses import dataclass, field
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segmentry.shared import stored

#: Turns that a shard packs at a time, and free places that are tried for siblings before they go behind all others; they bound memory and time, not results.
BLOCK_TURNS, TRIES = 400_000, 256
EMPTY = sha256(b"").hexdigest()


def rebuilt(turns: DataFrame, family: int = 5, most: int = 9) -> DataFrame:
    """conv, path (keys and text bytes of its turns): the first h turns of the family's first conversation, then those after the first h of its own."""
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    key = F.unhex(F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32))
    conv = F.col("conv_id").cast("long")
    rows = turns.where("conv_id is not null").select((conv - F.pmod(conv, F.lit(family))).alias("of"), F.struct(conv.alias("conv"), "turn", role.alias("role"), key.alias("key"), F.octet_length(text).alias("size")).alias("r"))
    families = rows.groupBy("of").agg(F.sort_array(F.collect_list("r")).alias("rows"))
    each = families.select("of", "rows", F.explode(F.array_distinct("rows.conv")).alias("conv"))
    h = F.expr(f"cast(crc32(cast(conv as string)) % {most} as int)")
    own = F.expr("filter(rows, r -> r.conv = conv)")
    first = F.slice(F.expr("filter(rows, r -> r.conv = of)"), F.lit(1), h)
    path = F.transform(F.concat(first, F.slice(own, h + 1, F.size(own))), lambda r: F.struct(r["key"].alias("key"), r["size"].alias("size")))
    return each.select("conv", path.alias("path"))


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (seq, conv) in order as (seq, first conv, ids in turn as text), one for each sequence and batch."""
    for batch in batches:
        seqs, convs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        at = [i for i in range(len(seqs)) if not i or seqs[i] != seqs[i - 1]]
        texts = [",".join(map(str, convs[i:j])) for i, j in zip(at, [*at[1:], len(seqs)], strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([seqs[i] for i in at], pa.binary()), pa.array([convs[i] for i in at], pa.int64()), pa.array(texts, pa.string())], ["seq", "conv", "ids"])


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of ``_joined`` in order as (seq, digest of all ids); one chunk is held at a time."""
    seq, digest = None, sha256()
    for batch in batches:
        out = []
        for now, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if now == seq:
                digest.update(f",{ids}".encode())
                continue
            if seq is not None:
                out.append((seq, digest.hexdigest()))
            seq, digest = now, sha256(ids.encode())
        yield pa.RecordBatch.from_pylist([{"seq": s, "ends": d} for s, d in out], pa.schema([("seq", pa.binary()), ("ends", pa.string())]))
    if seq is not None:
        yield pa.RecordBatch.from_arrays([pa.array([seq], pa.binary()), pa.array([digest.hexdigest()])], ["seq", "ends"])


def sequences(convs: DataFrame) -> DataFrame:
    """seq, n, conv (the smallest), path, ends (digest of the ids in order): one row for conversations that are equal turn by turn."""
    named = convs.withColumn("seq", F.unhex(F.sha2(F.array_join(F.transform("path.key", F.hex), ""), 256)))
    named = stored(named, "conversations")
    one = named.groupBy("seq").agg(F.count("*").alias("n"), F.min("conv").alias("conv"), F.first("path").alias("path"))
    ids = named.select("seq", "conv").repartitionByRange("seq", "conv").sortWithinPartitions("seq", "conv").mapInArrow(_joined, "seq binary, conv long, ids string")
    ends = ids.repartition("seq").sortWithinPartitions("seq", "conv").select("seq", "ids").mapInArrow(_digested, "seq binary, ends string")
    return stored(one.join(ends, "seq"), "sequences")


@dataclass
class DoubleArray:
    """``base`` and ``check`` of a trie whose root is place 0; ``levels`` are the places of each depth."""

    base: np.ndarray = field(default_factory=lambda: np.zeros(1024, np.int64))
    check: np.ndarray = field(default_factory=lambda: np.full(1024, -1, np.int64))
    top: int = 1
    low: int = 1

    def _room(self, size: int) -> None:
        if size > self.check.size:
            more = max(size, 2 * self.check.size) - self.check.size
            self.base = np.append(self.base, np.zeros(more, np.int64))
            self.check = np.append(self.check, np.full(more, -1, np.int64))

    def _free(self, n: int) -> np.ndarray:
        """The first ``n`` free places."""
        while self.check[self.low] >= 0:
            self.low += 1
            self._room(self.low + 1)
        found = self.low + np.flatnonzero(self.check[self.low : self.top] < 0)[:n]
        return np.append(found, np.arange(max(self.top, self.low), max(self.top, self.low) + n - found.size))

    def add(self, states: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Places of new children; those of one state stand together."""
        first = np.flatnonzero(np.append(True, states[1:] != states[:-1]))
        size = np.diff(np.append(first, states.size))
        places = np.zeros(states.size, np.int64)
        for i in np.flatnonzero(size > 1).tolist():  # siblings need places that fit all of them
            own = codes[first[i] : first[i] + size[i]]
            at = own - own.min()
            span = int(at.max()) + 1
            self._room(self.top + TRIES + span + 1)
            tried = np.append(self._free(max(1, min(TRIES, 1_000_000 // own.size))), max(self.top, self.low))
            self._room(int(tried[-2:].max()) + span + 1)
            put = int(tried[np.argmax((self.check[tried[:, None] + at] < 0).all(axis=1))])
            self.base[states[first[i]]] = put - int(own.min())
            places[first[i] : first[i] + size[i]] = put + at
            self.check[put + at] = states[first[i]]
            self.top = max(self.top, put + span)
        lone = first[size == 1]
        if lone.size:
            self._room(self.top + lone.size + 2)
            put = self._free(lone.size)
            self._room(int(put[-1]) + 2)
            self.base[states[lone]] = put - codes[lone]
            places[lone], self.check[put] = put, states[lone]
            self.top = max(self.top, int(put[-1]) + 1)
        return places


def dense(keys: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Turn ids from 0, numbered as they first appear depth by depth, so that siblings have near ones."""
    depth = np.arange(keys.size) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    order = np.argsort(depth, kind="stable")
    _, seen, code = np.unique(keys[order], return_index=True, return_inverse=True)
    rank = np.empty(seen.size, np.int64)
    rank[np.argsort(seen)] = np.arange(seen.size)
    out = np.empty(keys.size, np.int64)
    out[order] = rank[code]
    return out


def packed(codes: np.ndarray, lengths: np.ndarray) -> DoubleArray:
    """The trie of sequences in an order in which equal prefixes stand together."""
    trie, start = DoubleArray(), np.cumsum(lengths) - lengths
    alive = np.flatnonzero(lengths > 0)
    state = np.zeros(alive.size, np.int64)
    depth = 0
    while alive.size:
        code = codes[start[alive] + depth]
        new = np.append(True, (state[1:] != state[:-1]) | (code[1:] != code[:-1]))
        state = trie.add(state[new], code[new])[np.cumsum(new) - 1]
        depth += 1
        on = lengths[alive] > depth
        alive, state = alive[on], state[on]
    return trie


_NODE = "conv long, depth long, parent_conv long, n_convs long, n_children long, n_leaves long, saved long, ends string"
_EDGE = "key binary, parent binary, shard long, own long, on_first boolean, before long, through long, on_last boolean, tail boolean"


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def shard_nodes(shard: int, paths: pa.Array, n: np.ndarray, conv: np.ndarray, ends: list[str]) -> pa.RecordBatch:
    """Nodes of sorted sequences: final ones without key, and those that other shards may have, where ``saved`` still counts all members and ``own`` is what is to be taken off."""
    lengths = np.diff(paths.offsets.to_numpy())
    flat = paths.flatten()
    keys = np.frombuffer(b"".join(flat.field(0).to_pylist()), "V16")
    sizes = flat.field(1).to_numpy(zero_copy_only=False).astype(np.int64)
    codes = dense(keys, lengths)
    trie, start = packed(codes, lengths), np.cumsum(lengths) - lengths
    count, least = np.zeros(trie.top, np.int64), np.full(trie.top, np.iinfo(np.int64).max)
    depth, text, child, leaves, worth, own = (np.zeros(trie.top, np.int64) for _ in range(6))
    ending, turn = np.full(trie.top, -1), np.zeros(trie.top, np.int64)
    # The sequences walk down side by side.
    alive, state, d, levels, walked = np.arange(lengths.size), np.zeros(lengths.size, np.int64), 0, [], {0: [0], lengths.size - 1: [0]}
    while True:
        np.add.at(count, state, n[alive])
        np.minimum.at(least, state, conv[alive])
        levels.append(np.unique(state))
        depth[levels[-1]] = d
        done = lengths[alive] == d
        ending[state[done]] = alive[done]
        alive, state = alive[~done], state[~done]
        if not alive.size:
            break
        at = start[alive] + d
        nxt = trie.base[state] + codes[at]
        if not np.array_equal(trie.check[nxt], state):
            raise AssertionError("the packed trie doesn't hold a sequence")
        state = nxt
        text[state], turn[state] = sizes[at], at
        for end in {alive[0], alive[-1]} & walked.keys():
            walked[end].append(int(state[0] if end == alive[0] else state[-1]))
        d += 1
    for level in levels[:0:-1]:
        np.add.at(child, trie.check[level], 1)
    for level in levels[::-1]:
        leaves[level] += child[level] == 0
        worth[level] += count[level] * text[level]
        own[level] += text[level]
        if level[0]:
            up = trie.check[level]
            for x in (leaves, worth, own):
                np.add.at(x, up, x[level])
    nodes = np.concatenate(levels)
    first, last = walked[0], walked[lengths.size - 1]
    edge = np.zeros(trie.top, bool)
    edge[first + last] = True
    digest, above = {0: b"root"}, {0: None}
    for path in (first, last):
        for up, down in zip(path, path[1:], strict=False):
            digest[down], above[down] = sha256(digest[up] + keys[turn[down]].tobytes()).digest()[:16], digest[up]
    through = np.cumsum(text[first])
    before = {s: (int(x - text[s]), int(x)) for s, x in zip(first, through, strict=True)}
    is_edge, up = edge[nodes], trie.check[nodes]
    under = edge[up] & (nodes > 0) & ~is_edge  # final but for the parent's smallest conversation
    listed, on_last = nodes.tolist(), set(last)
    none = [None] * len(listed)
    of_edges = lambda f: [f(s) if e else None for s, e in zip(listed, is_edge, strict=True)]
    columns = [
        pa.array(least[nodes]), pa.array(depth[nodes]), pa.array(least[np.maximum(up, 0)], mask=is_edge | under), pa.array(count[nodes]), pa.array(child[nodes]), pa.array(leaves[nodes]),
        pa.array(np.where(is_edge, worth[nodes], worth[nodes] - own[nodes])), pa.array([ends[i] if i >= 0 else None for i in ending[nodes].tolist()], pa.string()),
        pa.array(of_edges(digest.get), pa.binary()), pa.array([above[s] if e else digest[p] if u else None for s, e, u, p in zip(listed, is_edge, under, up.tolist(), strict=True)], pa.binary()),
        pa.array([shard] * len(listed), pa.int64()), pa.array(own[nodes]), pa.array(of_edges(lambda s: s in before), pa.bool_()),
        *(pa.array(of_edges(lambda s, k=k: before.get(s, none)[k]), pa.int64()) for k in (0, 1)),
        pa.array(of_edges(lambda s: s in on_last), pa.bool_()), pa.array(of_edges(lambda s: s == last[-1]), pa.bool_()),
    ]
    return pa.RecordBatch.from_arrays(columns, _names(f"{_NODE}, {_EDGE}"))


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (path, n, conv, ends) in order; every ``BLOCK_TURNS`` turns make a shard."""
    held, turns, number = [], 0, 0

    def made() -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        return shard_nodes((TaskContext.get().partitionId() << 32) + number, t["path"].chunk(0), t["n"].to_numpy(), t["conv"].to_numpy(), t["ends"].to_pylist())

    for batch in batches:
        at = 0
        while at < batch.num_rows:
            size = np.cumsum(np.diff(batch.column(0).offsets.to_numpy())[at:])
            n = max(1, int(np.searchsorted(size, BLOCK_TURNS - turns, "right")))
            held.append(batch.slice(at, n))
            turns, at = turns + int(size[min(n, size.size) - 1]), at + n
            if turns >= BLOCK_TURNS or at < batch.num_rows:
                yield made()
                held, turns, number = [], 0, number + 1
    if held:
        yield made()


def prefix_trie(turns: DataFrame, family: int = 5, most: int = 9) -> DataFrame:
    """One row per node: ``conv_id`` (its smallest member), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens``, ``ends_sha256``.

    ``turns`` has conv_id, turn, role and text. Turns stand in the order of ``turn``, null first; equal ones by role, then by
    a digest of role and text. Null roles and texts are empty. Rows without a conv_id belong to no conversation; families of negative ids begin at the multiple of
    ``family`` below. Turns are the same if role and text have the same 128-bit digest. Repeated rows are
    turns of their own. A conversation that is rebuilt without turns is a member of the root. An empty table has no
    conversation and no root, so no rows. One family's turns are held by a task, some hundred bytes each whatever the
    texts' lengths, and one shard's by another. Other columns, of whatever names, are not looked at.
    """
    found = sequences(rebuilt(turns, family, most))
    ordered = found.withColumn("keys", F.col("path.key")).repartitionByRange("keys").sortWithinPartitions("keys").select("path", "n", "conv", "ends")
    nodes = stored(ordered.mapInArrow(_shards, f"{_NODE}, {_EDGE}"), "nodes")

    part = nodes.where("key is not null").drop("parent_conv")
    span = part.groupBy("key").agg(F.min("shard").alias("lo"), F.max("shard").alias("hi"))
    part = part.join(span, "key")
    # What a shard's first path has in common with shards before it, and whether its last conversation goes on in a later one.
    shared = F.col("on_first") & (F.col("lo") < F.col("shard"))
    common = part.groupBy("shard").agg(F.max(F.when(shared, F.col("depth"))).alias("common"), F.max(F.when(shared, F.col("through"))).alias("common_bytes"), F.max(F.col("tail") & (F.col("hi") > F.col("shard"))).alias("goes_on"))
    part = part.join(common, "shard")
    twice = F.coalesce(F.col("on_first") & (F.col("depth") <= F.col("common")), F.lit(False))
    own = F.col("own") - F.when(twice, F.col("common_bytes") - F.col("before")).otherwise(0)
    child = F.col("n_children") - F.coalesce((F.col("on_first") & (F.col("depth") < F.col("common"))).cast("long"), F.lit(0))
    leaf = F.col("n_leaves") - (F.col("on_last") & F.col("goes_on")).cast("long")
    merged = part.groupBy("key").agg(
        F.first("parent").alias("parent"), F.min("conv").alias("conv"), F.first("depth").alias("depth"), F.sum("n_convs").alias("n_convs"), F.sum(child).alias("n_children"), F.sum(leaf).alias("n_leaves"),
        (F.sum("saved") - F.sum(own)).alias("saved"), F.max("ends").alias("ends"),
    )
    merged = stored(merged, "merged")
    columns = ("conv", "depth", "parent_conv", "n_convs", "n_children", "n_leaves", "saved", "ends")
    above = merged.select(F.col("key").alias("parent"), F.col("conv").alias("parent_conv"))
    under = nodes.where("key is null and parent is not null").drop("parent_conv").join(above, "parent")
    out = nodes.where("key is null and parent is null").select(*columns).unionByName(under.select(*columns)).unionByName(merged.join(above, "parent", "left").select(*columns))
    return out.select(
        F.col("conv").alias("conv_id"), "depth", F.col("parent_conv").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), F.coalesce("ends", F.lit(EMPTY)).alias("ends_sha256")
    )
