"""Conversation prefix trie in double arrays, by prefix shards.

Texts are left behind at once: a turn goes on as 128 bits of (role, text) and its number of code points. Turns are
sorted by range and numbered in their conversations across range boundaries, so that a conversation may be of any
length. Each conversation is rebuilt on the first turns of its group's leader and cut into runs of ``RUN`` turns. Equal
runs after equal turns collapse to one segment with a count before anything else sees them.

Segments are sorted by range of (run, what precedes it, turns): each range is a *prefix shard*, a stretch of the trie
in its order, so a prefix that a large share of conversations has is cut like any other. In a shard, turns get dense
numbers, BASE and CHECK arrays are packed level by level, and walking them gives each node's counts; CHECK gives its
parent. Nodes off the two edges of a block are whole there ("closed"), with their subtrees. Nodes on an edge, or above
a run that goes on, are shared ("open"): their counts are added up globally, and sums over their subtrees are gathered
by pointer jumping in log2(depth) rounds. A shard holds ``BLOCK_TURNS`` turns at a time.

Defined cases: rows without conv_id belong to no conversation and are left out; null role and text are empty; null
turns come first; rows that share a turn are ordered by role, then by a hash of the row; repeated rows are turns of
their own; long texts count whole; other columns are not read; an empty table has no nodes. The member list of one node
is hashed in order, in blocks of conversations, by one task, as its digest demands; it is streamed, not held.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kelpie.llm._common import column, discard, staged

#: Turns of a conversation that are one row.
RUN = 64
#: Turns of a shard that are in memory together.
BLOCK_TURNS = 200_000
#: Free places that are tried for the children of a node before they go to the end of the arrays.
TRIES = 512
ROOT, FREE = -1, -2
NO_TURNS = bytes(16)
SEGMENT = "run int, top binary, path binary, lengths array<int>, exit binary, n long, first long, more long, ends string"
NODE = "key binary, parent binary, open boolean, depth long, n long, first long, length long, kids long, leaves long, saved long, parent_first long, ends string"


class DoubleArray:
    """A trie in BASE and CHECK arrays: the child of node s by number c is BASE[s] + c, if its CHECK is s."""

    def __init__(self, roots: int, size: int):
        self.base = np.zeros(size + roots, np.int64)
        self.check = np.full(size + roots, FREE, np.int64)
        self.check[:roots] = ROOT
        self.low, self.end = roots, roots  # nothing below ``low`` is free, all from ``end`` on is

    def _room(self, size: int) -> None:
        if size > len(self.check):
            more = max(size, 2 * len(self.check)) - len(self.check)
            self.base = np.concatenate([self.base, np.zeros(more, np.int64)])
            self.check = np.concatenate([self.check, np.full(more, FREE, np.int64)])

    def _free(self, most: int) -> np.ndarray:
        """The first free places, at least one of them past the end."""
        inner = self.low + np.flatnonzero(self.check[self.low : self.end] == FREE)[:most]
        return np.append(inner, np.arange(self.end, self.end + max(1, most - len(inner))))

    def add_level(self, parents: np.ndarray, numbers: np.ndarray) -> None:
        """Children of nodes without any; rows of one parent are neighbours, numbers differ within a parent."""
        start = np.concatenate([[0], 1 + np.flatnonzero(parents[1:] != parents[:-1])])
        sizes = np.diff(np.append(start, len(parents)))
        for i in np.flatnonzero(sizes > 1)[np.argsort(-sizes[sizes > 1], kind="stable")]:
            c = np.sort(numbers[start[i] : start[i] + sizes[i]])
            gaps = c - c[0]
            at = self._free(TRIES)
            self._room(int(at[-1] + gaps[-1] + 1))
            fits = np.ones(len(at), bool)
            for g in range(0, len(gaps), 64):  # most places fail early
                left = np.flatnonzero(fits)
                if len(left) == 1:
                    break
                fits[left] = (self.check[at[left][:, None] + gaps[None, g : g + 64]] == FREE).all(axis=1)
            self._put(parents[start[i]], int(at[np.argmax(fits)] if fits.any() else self.end), gaps, int(c[0]))
        single = start[sizes == 1]
        if len(single):
            at = self._free(len(single))[: len(single)]
            self._room(int(at[-1]) + 1)
            self.base[parents[single]] = at - numbers[single]
            self.check[at] = parents[single]
            self.end = max(self.end, int(at[-1]) + 1)
        free = np.flatnonzero(self.check[self.low : self.end] == FREE)
        self.low = self.low + int(free[0]) if len(free) else self.end

    def _put(self, parent: int, at: int, gaps: np.ndarray, least: int) -> None:
        if at < self.end and (self.check[at + gaps] != FREE).any():  # the one place left was not tried to its end
            at = self.end
        self._room(int(at + gaps[-1] + 1))
        self.base[parent] = at - least
        self.check[at + gaps] = parent
        self.end = max(self.end, int(at + gaps[-1]) + 1)

    def step(self, nodes: np.ndarray, numbers: np.ndarray) -> np.ndarray:
        """The child of each node by the number, ROOT where there is none."""
        at = self.base[nodes] + numbers
        inside = (at >= 0) & (at < len(self.check))
        return np.where(inside & (self.check[np.where(inside, at, 0)] == nodes), at, ROOT)


class _Block:
    """Segments of one block, in order."""

    def __init__(self, t: pa.Table):
        col = lambda c: pa.concat_arrays(t[c].chunks)
        self.rows = t.num_rows
        path, lengths = col("path"), col("lengths")
        self.turns = np.frombuffer(b"".join(path.to_pylist()), np.dtype("V16"))
        self.sizes = pc.binary_length(path).to_numpy(zero_copy_only=False).astype(np.int64) // 16
        self.offsets = np.concatenate([[0], np.cumsum(self.sizes)])
        self.lengths = lengths.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        self.n, self.first, self.more = (col(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("n", "first", "more"))
        self.exits, self.ends = col("exit").to_pylist(), col("ends").to_pylist()
        tops, runs = col("top").to_pylist(), col("run").to_pylist()
        new = [i == 0 or tops[i] != tops[i - 1] or runs[i] != runs[i - 1] for i in range(self.rows)]
        self.group = np.cumsum(new) - 1
        self.tops = [x for x, y in zip(tops, new, strict=True) if y]
        self.runs = np.array([x for x, y in zip(runs, new, strict=True) if y], np.int64)

    def numbers(self) -> tuple[np.ndarray, np.ndarray]:
        """Dense numbers of the turns, by first place in the order of levels, and the different turns."""
        level = np.arange(len(self.turns)) - np.repeat(self.offsets[:-1], self.sizes)
        order = np.argsort(level, kind="stable")
        if not len(order):
            return np.zeros(0, np.int64), self.turns
        found, at, which = np.unique(self.turns[order], return_index=True, return_inverse=True)
        rank = np.empty(len(found), np.int64)
        rank[np.argsort(at)] = np.arange(len(found))
        out = np.empty(len(order), np.int64)
        out[order] = rank[which]
        return out, found[np.argsort(at)]


def block_nodes(t: pa.Table, run: int = RUN) -> pa.RecordBatch:
    """Node rows of one block of segments."""
    b = _Block(t)
    codes, turns = b.numbers()
    roots = len(b.tops)
    trie = DoubleArray(roots, len(b.turns))
    state = b.group.copy()
    deepest = int(b.sizes.max())
    for d in range(deepest):
        live = np.flatnonzero(b.sizes > d)
        c = codes[b.offsets[live] + d]
        new = np.ones(len(live), bool)  # in order, segments of one prefix are neighbours
        new[1:] = (state[live][1:] != state[live][:-1]) | (c[1:] != c[:-1])
        trie.add_level(state[live][new], c[new])
        state[live] = trie.step(state[live], c)
    size = len(trie.check)
    n, kids, leaves, saved, length, depth = (np.zeros(size, np.int64) for _ in range(6))
    first, turn_of = np.full(size, np.iinfo(np.int64).max), np.zeros(size, np.int64)
    is_open, levels = np.zeros(size, bool), [np.arange(roots)]
    state = b.group.copy()
    depth[:roots] = b.runs * run
    is_open[:roots] = b.runs > 0
    counted = b.runs[b.group] == 0  # the top of a later run is counted where the run before ends
    np.add.at(n, state[counted], b.n[counted])
    np.minimum.at(first, state[counted], b.first[counted])
    for d in range(deepest):
        live = np.flatnonzero(b.sizes > d)
        c = codes[b.offsets[live] + d]
        at = trie.step(state[live], c)
        np.add.at(n, at, b.n[live])
        np.minimum.at(first, at, b.first[live])
        length[at], turn_of[at], depth[at] = b.lengths[b.offsets[live] + d], c, depth[state[live]] + 1
        levels.append(np.unique(at))
        state[live] = at
    is_open[state[[0, -1]]] = True  # the block's edges
    is_open[state[b.more > 0]] = True
    parent = trie.check
    for at in levels[:0:-1]:
        is_open[parent[at[is_open[at]]]] = True
    for at in levels[::-1]:
        shut = at[~is_open[at]]
        leaves[shut] += kids[shut] == 0
        saved[shut] += (n[shut] - 1) * length[shut]
        shut = shut[parent[shut] >= 0]
        for into, what in ((kids, 1), (leaves, leaves[shut]), (saved, saved[shut])):
            np.add.at(into, parent[shut], what)
    keys: list[bytes | None] = [None] * size
    exits = {int(s): e for s, e, k in zip(state, b.exits, b.sizes, strict=True) if k == run}
    ends = {int(s): e for s, e in zip(state, b.ends, strict=True) if e is not None}
    for i, top in enumerate(b.tops):
        keys[i] = top
    for at in levels[1:]:
        for s, p, c in zip(at.tolist(), parent[at].tolist(), turn_of[at].tolist(), strict=True):
            keys[s] = exits.get(s) or xxhash.xxh3_128_digest(keys[p] + turns[c].tobytes())
    at = np.concatenate(levels)
    up = parent[at]
    known = (up >= 0) & ~is_open[at] & ~is_open[np.maximum(up, 0)]
    none = n[at] == 0
    return pa.RecordBatch.from_arrays([
        pa.array([keys[s] for s in at], pa.binary()), pa.array([keys[p] if p >= 0 else None for p in up], pa.binary()), pa.array(is_open[at]), pa.array(depth[at]), pa.array(n[at]),
        pa.array(first[at], mask=none), pa.array(length[at]), pa.array(kids[at]), pa.array(leaves[at]), pa.array(saved[at]), pa.array(first[np.maximum(up, 0)], mask=~known),
        pa.array([ends.get(s) for s in at.tolist()], pa.string())], NODE.replace(" binary", "").replace(" boolean", "").replace(" long", "").replace(" string", "").split(", "))


def _shards(run: int, block_turns: int):
    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, turns = [], 0
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                held.append(part)
                turns += part.num_rows + len(column(part, "lengths").flatten())
                if turns >= block_turns:
                    yield block_nodes(pa.Table.from_batches(held), run)
                    held, turns = [], 0
        if held:
            yield block_nodes(pa.Table.from_batches(held), run)

    return nodes


def turn_id(role: Column, text: Column) -> Column:
    """128 bits that stand for a turn's role and text."""
    return F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")))


def numbered(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), id and n (code points) of each turn."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    order = ["conv_id", "turn", "role", "id"]
    turns = conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long"), "turn", role.alias("role"), turn_id(role, text).alias("id"), F.length(text).cast("int").alias("n"))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, done = TaskContext.get().partitionId(), None, 0
        for b in batches:
            conv = column(b, "conv_id").to_numpy()
            if not len(conv):
                continue
            start = np.concatenate([[0], 1 + np.flatnonzero(conv[1:] != conv[:-1])])
            at = 1 + np.arange(len(conv)) - np.repeat(start, np.diff(np.append(start, len(conv))))
            if last == conv[0]:
                at[: start[1] if len(start) > 1 else None] += done
            last, done = int(conv[-1]), int(at[-1])
            yield pa.RecordBatch.from_arrays([column(b, "conv_id"), pa.array(np.full(len(conv), part, np.int32)), pa.array(at), column(b, "id"), column(b, "n")], ["conv_id", "part", "at", "id", "n"])

    placed = staged(turns.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(number, "conv_id long, part int, at long, id binary, n int"), "turns")
    before = F.sum("count").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    # of one range only the first conversation can have begun before, so these are at most one row a range
    begun = placed.groupBy("conv_id", "part").count().withColumn("before", before).where("before > 0").select("conv_id", "part", "before")
    return placed.join(F.broadcast(begun), ["conv_id", "part"], "left").select("conv_id", (F.col("at") + F.coalesce("before", F.lit(0))).alias("pos"), "id", "n")


def shared_heads(c: Column) -> Column:
    """How many turns a conversation takes over from its leader."""
    return (F.crc32(c.cast("string").cast("binary")) % 6).cast("int")


def rebuilt_runs(turns: DataFrame, group: int = 100, run: int = RUN) -> DataFrame:
    """conv_id, run and turns (array of id and n in order) of the rebuilt conversations; all have a run 0."""
    item = F.struct("pos", "id", "n")
    heads = turns.where((F.col("conv_id") % group == 0) & (F.col("pos") <= 5)).groupBy(F.col("conv_id").alias("leader")).agg(F.array_sort(F.collect_list(item)).alias("head"))
    convs = turns.select("conv_id").distinct().withColumn("leader", F.col("conv_id") - F.col("conv_id") % group).withColumn("h", shared_heads(F.col("conv_id"))).join(heads, "leader", "left")
    convs = convs.select("conv_id", "h", F.when(F.col("head").isNull(), F.array().cast("array<struct<pos:bigint,id:binary,n:int>>")).otherwise(F.slice("head", F.lit(1), F.col("h"))).alias("head"))
    own = turns.groupBy("conv_id", F.floor((F.col("pos") - 1) / run).alias("old")).agg(F.collect_list(item).alias("own"))
    joined = own.join(convs, "conv_id").withColumn("shift", F.col("h") - F.size("head"))
    kept = F.transform(F.filter("own", lambda x: x["pos"] > F.col("h")), lambda x: F.struct((x["pos"] - F.col("shift")).alias("pos"), x["id"].alias("id"), x["n"].alias("n")))
    whole = joined.select("conv_id", "old", F.concat(F.when(F.col("old") == 0, F.col("head")).otherwise(F.array().cast("array<struct<pos:bigint,id:binary,n:int>>")), kept).alias("turns"))
    run_of = lambda x: F.floor((x["pos"] - 1) / run)
    # turns that move up, by five at most, may cross into a run before; a head may be longer than a short run
    pieces = whole.select("conv_id", F.explode(F.array(*[F.col("old") - i for i in range(-(4 // run), 2 + 5 // run)])).alias("run"), "turns", "old").select("conv_id", "run", "old", F.filter("turns", lambda x: run_of(x) == F.col("run")).alias("turns"))
    pieces = pieces.where((F.size("turns") > 0) | ((F.col("run") == 0) & (F.col("old") == 0)))
    return pieces.groupBy("conv_id", "run").agg(F.array_sort(F.flatten(F.collect_list("turns"))).alias("turns"))


def segments(runs: DataFrame) -> DataFrame:
    """Different segments with the number of their conversations, the least of these, how many go on, and the digest of
    those that end there."""
    path = F.array_join(F.transform("turns", lambda x: F.hex(x["id"])), "")
    own = F.md5(F.concat(F.col("run").cast("string"), F.lit(":"), path).cast("binary"))
    half = lambda at: F.conv(F.substring(own, at, 15), 16, 10).cast("decimal(38,0)")
    w = Window.partitionBy("conv_id").orderBy("run")
    before = lambda c: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("decimal(38,0)"))
    top = lambda run, a, b: F.unhex(F.md5(F.concat_ws(":", run.cast("string"), a.cast("string"), b.cast("string")).cast("binary")))
    runs = runs.select("conv_id", "run", path.alias("path"), F.transform("turns", lambda x: x["n"]).alias("lengths"), half(1).alias("a"), half(16).alias("b"))
    runs = runs.withColumns({"sum_a": before("a"), "sum_b": before("b"), "more": F.lead("run").over(w).isNotNull()})
    runs = runs.select(
        "conv_id", "run", "path", "lengths", "more", F.when(F.col("run") == 0, F.lit(NO_TURNS)).otherwise(top(F.col("run"), F.col("sum_a"), F.col("sum_b"))).alias("top"),
        top(F.col("run") + 1, (F.col("sum_a") + F.col("a")).cast("decimal(38,0)"), (F.col("sum_b") + F.col("b")).cast("decimal(38,0)")).alias("exit"))
    runs = staged(runs.withColumn("seg", F.unhex(F.md5(F.concat(F.hex("top"), F.col("path")).cast("binary")))), "runs")
    found = runs.groupBy("seg").agg(
        *[F.first(c).alias(c) for c in ("run", "top", "path", "lengths", "exit")], F.count("*").alias("n"), F.min("conv_id").alias("first"), F.sum(F.col("more").cast("long")).alias("more"))
    ends = runs.where(~F.col("more")).groupBy("seg", F.shiftright("conv_id", 9).alias("block")).agg(F.array_sort(F.collect_list("conv_id")).alias("ids"))
    ends = ends.select("seg", "block", F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("ids"))
    digests = ends.repartition("seg").sortWithinPartitions("seg", "block").mapInArrow(_digests, "seg binary, ends string")
    return found.join(digests, "seg", "left").select(F.col("run").cast("int").alias("run"), "top", F.unhex("path").alias("path"), "lengths", "exit", "n", "first", "more", "ends")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the comma-joined texts of each segment, whose rows follow each other."""
    seg, sha = None, None
    for b in batches:
        done = []
        for s, ids in zip(column(b, "seg").to_pylist(), column(b, "ids").to_pylist(), strict=True):
            if s != seg:
                if seg is not None:
                    done.append((seg, sha.hexdigest()))
                seg, sha = s, hashlib.sha256(ids.encode())
            else:
                sha.update(b"," + ids.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in done], pa.binary()), pa.array([x for _, x in done], pa.string())], ["seg", "ends"])
    if seg is not None:
        yield pa.RecordBatch.from_arrays([pa.array([seg], pa.binary()), pa.array([sha.hexdigest()], pa.string())], ["seg", "ends"])


def subtree_sums(nodes: DataFrame) -> DataFrame:
    """key, leaves and saved of nodes(key, parent, depth, leaves, saved), summed over subtrees by pointer jumping: round k
    adds to each node what its descendants 2^k below it have."""
    deepest = nodes.agg(F.coalesce(F.max("depth"), F.lit(0)).alias("d")).first()["d"]
    at = nodes.select("key", F.col("parent").alias("jump"), "leaves", "saved")
    for _ in range(math.ceil(math.log2(deepest + 1))):
        below = at.where(F.col("jump").isNotNull()).groupBy(F.col("jump").alias("key")).agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
        on = at.where(F.col("jump").isNotNull()).select(F.col("key").alias("from"), "jump").join(at.select(F.col("key").alias("jump"), F.col("jump").alias("next")), "jump").select(F.col("from").alias("key"), "next")
        after = staged(at.join(below, "key", "left").join(on, "key", "left").select(
            "key", F.col("next").alias("jump"), (F.col("leaves") + F.coalesce("l", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("s", F.lit(0))).alias("saved")), "jumps")
        discard(at)
        at = after
    return at.drop("jump")


def prefix_nodes(conversations: DataFrame, group: int = 100, run: int = RUN, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """One row per node of the trie of rebuilt conversations(conv_id, turn, role, text): conv_id, depth, parent_conv_id,
    n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    order = ["run", "top", "path"]
    found = staged(segments(rebuilt_runs(numbered(conversations), group, run)), "segments")
    nodes = staged(found.select(*[x.split()[0] for x in SEGMENT.split(", ")]).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_shards(run, block_turns), NODE), "nodes")
    shared = nodes.where("open").groupBy("key").agg(
        F.max("parent").alias("parent"), F.max("depth").alias("depth"), F.min("first").alias("first"), F.max("ends").alias("ends"), F.max("length").alias("length"),
        *[F.sum(c).alias(c) for c in ("n", "kids", "leaves", "saved")])
    shared = staged(shared, "shared")
    below = shared.where(F.col("parent").isNotNull()).groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("below"))
    own = staged(shared.join(below, "key", "left").withColumn("kids", F.col("kids") + F.coalesce("below", F.lit(0))).select(
        "key", "parent", "depth", "first", "ends", "n", "kids", (F.col("leaves") + (F.col("kids") == 0).cast("long")).alias("leaves"),
        (F.col("saved") + (F.col("n") - 1) * F.col("length")).alias("saved")), "own")
    above = own.select(F.col("key").alias("parent"), F.col("first").alias("parent_first"))
    is_shared = own.drop("leaves", "saved").join(subtree_sums(own), "key").join(above, "parent", "left")
    shut = nodes.where("not open")
    columns = ["first", "depth", "parent_first", "n", "kids", "leaves", "saved", "ends"]
    out = is_shared.select(columns).unionByName(shut.where(F.col("parent_first").isNotNull()).select(columns))
    out = out.unionByName(shut.where(F.col("parent_first").isNull()).drop("parent_first").join(above, "parent").select(columns))
    return out.select(
        F.col("first").alias("conv_id"), "depth", F.col("parent_first").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("kids").alias("n_children"), F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"), F.coalesce("ends", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))
