"""Exact n-gram Jaccard self-join, size-aware: subsets for light sets, inverted lists for heavy ones.

A text's set holds its distinct word n-grams, as 64-bit hashes. Equal sets collapse to one node, so copies cost
one. Two sets link if threshold * union <= intersection (in hundredths, exact in integers).

Light sets (size up to a boundary) emit a key for each subset of the sizes that two linked light sets must share.
Heavy sets, and light ones near the boundary, emit the keys of a prefix in a global order, rare n-grams first:
linked sets share one. N-grams are counted over all rows; those with the largest counts, ``FREQUENT`` at most, have a
place of their own in the order. The boundary is the size that saves most over all different sets that may be light:
for each, the entries of the lists that its prefix would meet against its subsets. A size of which a set has over
``MOST_SUBSETS`` subsets is always on the list side. Boundary and order affect cost only.

Each set also has a signature: how many of its elements fall in each of some ranges of the hash. The sum of the
lesser counts bounds an intersection from above, so most nodes that share a key by chance are dropped from its
list, exactly, before any set is read again.

A list of nodes that share a key isn't expanded into pairs: it becomes a star around its least node. The few keys
with a large share of all entries are dealt by node as well, so that their lists are cut over all tasks, and the
stars of the cuts meet at last. Stars make clusters. A cluster of up to ``BLOCK`` sets is compared in memory, all
with all, by matrix products over the elements that at least two of them share. In a larger one all sets are first
compared with a few pivots; sets that links already join needn't be compared again, so only blocks of different
components are, pair by pair. A comparison hands on one link per node, and no link between different sets is lost.

Defined cases: words are split at ``[\\x20\\x09-\\x0D]``, A-Z lower-cased; a text of fewer words than n is one n-gram;
null, empty and blank texts have the empty set, which links with nothing; rows of equal sets are linked, whatever
their ids; a null id never names a component unless all its ids are null; repeated ids are kept row by row; a long
text is one set of any size; n-grams of equal frequency go by their hashes, alike in all sets; an empty table gives an
empty result.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kelpie.llm._common import Words, column, discard, mix, partitions, small_batches, staged, text_id, text_runs, unused

#: Shards of the counts of n-grams, and frequent n-grams that get a place of their own.
SHARDS, FREQUENT = 256, 1_000_000
#: N-grams of a batch that are held until they are dealt to their shards.
DEALT = 500_000
#: Lists up to this length are pruned by signature; longer ones go on whole.
PRUNED = 1_000
#: Sets of a cluster in a block, and pivots of a larger cluster.
BLOCK, PIVOTS = 1_024, 48
#: Keys of subsets that one set may emit; sizes that would emit more are on the list side.
MOST_SUBSETS = 2_000
#: Largest size whose subsets are thought of.
LIGHT = 60
#: Rows of a table that is sent to all tasks, at most.
SENT = 300_000
_MUL = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
_ENTRY = np.dtype([("key", "<u8"), ("node", "<i8"), ("n", "<i4")])


def ngram_sets(texts: pa.Array, n: int = 3, most: int = 1_000_000) -> Iterator[np.ndarray]:
    """The sorted distinct n-gram hashes of each text; texts are taken by runs of at most ``most`` bytes."""
    for run in text_runs(texts, most):
        yield from _run_sets(run, n)


def _run_sets(texts: pa.Array, n: int) -> Iterator[np.ndarray]:
    w = Words(texts)
    words = w.hashes()[w.codes] if len(w.codes) else np.zeros(0, np.uint64)
    grams = np.zeros(len(words), np.uint64)
    for k in range(n):
        part = words[k:]
        grams[: len(part)] = mix(grams[: len(part)] * _MUL[1] + part * _MUL[0] + np.uint64(k + 1))
    for a, b in zip(w.offsets[:-1].tolist(), w.offsets[1:].tolist()):
        if b - a >= n:
            x = np.sort(grams[a : b - n + 1])
            yield x[np.concatenate([[True], x[1:] != x[:-1]])]
        elif b > a:
            yield np.array([xxhash.xxh3_64_intdigest(words[a:b].tobytes(), b - a)], np.uint64)
        else:
            yield np.zeros(0, np.uint64)


def signature(x: np.ndarray) -> bytes:
    """The number of ranges as a power of two, then the elements in each range, 255 for more."""
    k = min(10, max(3, (len(x) // 12).bit_length()))
    return bytes([k]) + np.minimum(np.bincount((x >> np.uint64(64 - k)).astype(np.int64), minlength=1 << k), 255).astype(np.uint8).tobytes()


def _prune(percent: int):
    """(node, b) for the nodes that may link with another node of their list; b: the least node of those of the
    list that it may reach."""

    def run(table: pa.Table) -> pa.Table:
        key, node, n = (table[c].to_numpy() for c in ("key", "node", "n"))
        order = np.lexsort((node, key))
        key, node, n = key[order], node[order], n[order]
        sigs = table["sig"].combine_chunks().take(pa.array(order)).to_pylist()
        level = np.array([x[0] for x in sigs], np.int64)
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        length = np.diff(np.append(first, len(key)))
        label = np.where(np.repeat(length > PRUNED, length), np.repeat(first, length), -1)
        left, right, linked = [], [], []
        for size in np.unique(length[(length > 1) & (length <= PRUNED)]).tolist():
            i, j = np.triu_indices(size, 1)
            starts = first[length == size]
            for lo in range(0, len(starts), max(1, 1_000_000 // len(i))):
                s = starts[lo : lo + max(1, 1_000_000 // len(i)), None]
                a, b = (s + i).ravel(), (s + j).ravel()
                fit = 100 * np.minimum(n[a], n[b]) >= percent * np.maximum(n[a], n[b])
                left.append(a[fit])
                right.append(b[fit])
        if left:
            a, b = np.concatenate(left), np.concatenate(right)
            coarse = np.minimum(level[a], level[b])
            for k in np.unique(coarse).tolist():
                x, y = a[coarse == k], b[coarse == k]
                used = np.unique(np.concatenate([x, y]))
                counts = np.stack([np.frombuffer(sigs[u], np.uint8, offset=1).astype(np.int32).reshape(1 << k, -1).sum(axis=1) for u in used.tolist()])
                full = np.array([255 in sigs[u][1:] for u in used.tolist()])
                x_at, y_at = np.searchsorted(used, x), np.searchsorted(used, y)
                for lo in range(0, len(x), 50_000):
                    p, q = x_at[lo : lo + 50_000], y_at[lo : lo + 50_000]
                    most = np.minimum(counts[p], counts[q]).sum(axis=1)
                    total = n[x[lo : lo + 50_000]] + n[y[lo : lo + 50_000]]
                    may = full[p] | full[q] | (100 * most >= percent * (total - most))
                    linked.append(np.stack([x[lo : lo + 50_000][may], y[lo : lo + 50_000][may]]))
        if linked:  # a list falls apart into parts that may link
            x, y = np.concatenate(linked, axis=1)
            ends = np.unique(np.concatenate([x, y]))
            label[ends] = ends
            while True:
                least = label.copy()
                np.minimum.at(least, x, label[y])
                np.minimum.at(least, y, label[x])
                least[ends] = least[least[ends]]
                if (least == label).all():
                    break
                label = least
        kept = label >= 0
        return pa.table({"node": pa.array(node[kept]), "b": pa.array(node[label[kept]])})

    return run


def need(n: int, m: int, percent: int) -> int:
    """Common elements that sets of sizes n and m must have to link."""
    return -(-percent * (n + m) // (100 + percent))


def fits(n: int, m: int, percent: int) -> bool:
    return 100 * min(n, m) >= percent * max(n, m)


def subset_sizes(n: int, percent: int) -> list[int]:
    """Sizes of the subsets that a light set of size n emits: one for each size of linked partner."""
    lo, hi = -(-percent * n // 100), 100 * n // percent
    return sorted({need(n, m, percent) for m in range(max(1, lo), hi + 1)})


def n_subsets(n: int, percent: int) -> int:
    return sum(math.comb(n, c) for c in subset_sizes(n, percent))


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def choose_boundary(sizes: dict[int, int], list_length: float | dict[int, float], percent: int) -> int:
    """The size up to which subsets cost less than scanning lists, for the given numbers of sets by size and the
    mean length of the lists that a set's prefix meets (by size, or one for all). 0: nowhere."""
    best, boundary, saved = 0.0, 0, 0.0
    for n in range(1, max(sizes, default=0) + 1):
        subsets = n_subsets(n, percent)
        if subsets > MOST_SUBSETS:
            break
        met = list_length.get(n, 1.0) if isinstance(list_length, dict) else list_length
        saved += sizes.get(n, 0) * (prefix_length(n, percent) * met - subsets)
        if saved > best:
            best, boundary = saved, n
    return boundary


def weights_of(x: np.ndarray, frequent: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """How many sets hold each n-gram, 0 where it is not frequent; an n-gram is known by its leading 40 bits."""
    if not len(frequent):
        return np.zeros(len(x), np.int64)
    short = x >> np.uint64(24)
    at = np.searchsorted(frequent, short)
    at[at == len(frequent)] = 0
    return np.where(frequent[at] == short, weight[at], 0)


def rare_first(x: np.ndarray, k: int, frequent: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The first k elements of a set in the global order: by weight (0 if not frequent), then by hash."""
    weights = weights_of(x, frequent, weight)
    return x[np.lexsort((x, weights))[:k]] if weights.any() else x[:k]


def keys_of(x: np.ndarray, percent: int, boundary: int, frequent: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Keys of a set: subsets if light, a rare-first prefix if heavy or near the boundary."""
    n = len(x)
    out = []
    if n <= boundary:
        for c in subset_sizes(n, percent):
            out += [xxhash.xxh3_64_intdigest(np.array(s, np.uint64).tobytes(), c) for s in itertools.combinations(x.tolist(), c)]
    keys = np.array(out, np.uint64)
    if n > boundary or 100 * n >= percent * (boundary + 1):
        keys = np.concatenate([keys, mix(rare_first(x, prefix_length(n, percent), frequent, weight))])
    return keys


def _counts(docs: DataFrame, text: str, n: int, percent: int) -> DataFrame:
    """Of all rows' sets: (gram, times) for n-grams that more than one row has, (null, times) with how many others there are,
    and (elements) of the different sets that may be light. ``DEALT`` n-grams at a time, 32 bits of an n-gram go to the
    shard that its first 8 bits name."""
    lights = max((k for k in range(1, LIGHT + 1) if all(n_subsets(j, percent) <= MOST_SUBSETS for j in range(1, k + 1))), default=0)

    def send(found: list[np.ndarray], rows: dict[int, list[bytes]]) -> pa.RecordBatch:
        grams = np.concatenate(found) if found else np.zeros(0, np.uint64)
        shard = (grams >> np.uint64(56)).astype(np.uint8)
        grams = ((grams >> np.uint64(24)) & np.uint64(0xFFFFFFFF)).astype("<u4")[np.argsort(shard, kind="stable")]
        ends = np.cumsum(np.bincount(shard, minlength=SHARDS))
        held = [(p, grams[lo:hi].tobytes()) for p, (lo, hi) in enumerate(zip([0, *ends.tolist()], ends.tolist())) if lo < hi]
        held += [(p, b"".join(parts)) for p, parts in rows.items()]
        return pa.RecordBatch.from_arrays([pa.array([p for p, _ in held], pa.int64()), pa.array([d for _, d in held], pa.binary())], ["shard", "data"])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found, rows, size = [], {}, 0
            for x in ngram_sets(column(b, text), n):
                found.append(x)
                size += len(x)
                if 0 < len(x) <= lights:
                    rows.setdefault(SHARDS + int(x[0] & np.uint64(SHARDS - 1)), []).append(np.uint64(len(x)).tobytes() + x.tobytes())
                if size >= DEALT:
                    yield send(found, rows)
                    found, rows, size = [], {}, 0
            yield send(found, rows)

    def count(table: pa.Table) -> pa.Table:
        shard, data = table["shard"][0].as_py(), b"".join(table["data"].to_pylist())
        if shard >= SHARDS:
            words, at, sets = np.frombuffer(data, np.uint64), 0, set()
            while at < len(words):
                size = int(words[at])
                sets.add(words[at + 1 : at + 1 + size].tobytes())
                at += 1 + size
            none = pa.nulls(len(sets), pa.int64())
            return pa.table({"gram": none, "times": none, "elements": pa.array(list(sets), pa.binary())})
        values, times = np.unique(np.frombuffer(data, "<u4"), return_counts=True)
        again = times > 1
        grams = (np.int64(shard) << np.int64(32)) | values[again].astype(np.int64)
        return pa.table({"gram": pa.array(np.append(0, grams), pa.int64(), mask=np.arange(1 + len(grams)) == 0), "times": pa.array(np.concatenate([[(~again).sum()], times[again]]).astype(np.int64)), "elements": pa.nulls(1 + len(grams), pa.binary())})

    return docs.select(text).mapInArrow(deal, "shard long, data binary").groupBy("shard").applyInArrow(count, "gram long, times long, elements binary")


def _plan(docs: DataFrame, text: str, n: int, percent: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Boundary, frequent n-grams (sorted) and their weights, from all rows; copies count as often as they occur."""
    counts = staged(_counts(docs, text, n, percent), "counts")
    again = counts.where("gram is not null")
    by_times = {r["t"]: (r["grams"], r["entries"], r["squares"]) for r in again.groupBy(F.least("times", F.lit(1_000)).alias("t")).agg(F.count("*").alias("grams"), F.sum("times").alias("entries"), F.sum(F.col("times") * F.col("times")).alias("squares")).collect()}
    least, held = 1_001, 0
    while least > 2 and held + by_times.get(least - 1, (0, 0, 0))[0] <= FREQUENT:
        least -= 1
        held += by_times.get(least, (0, 0, 0))[0]
    often = again.where(F.col("times") >= min(least, 1_000)).orderBy(F.desc("times"), "gram").limit(FREQUENT).select("gram", "times").toArrow()  # bounded
    grams, times = (often[c].to_numpy().astype(np.int64) for c in ("gram", "times"))
    order = np.argsort(grams)
    frequent, weight = grams[order].view(np.uint64), times[order]
    once = counts.where("gram is null and times is not null").agg(F.sum("times")).first()[0] or 0
    entries = once + sum(e for t, (_, e, _) in by_times.items() if t < least)
    squares = once + sum(q for t, (_, _, q) in by_times.items() if t < least)
    rare = squares / entries - 1 if entries else 0.0  # other sets that hold an n-gram which is not frequent

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [np.frombuffer(e, np.uint64) for e in column(b, "elements").to_pylist()]
            met = [weights_of(rare_first(x, prefix_length(len(x), percent), frequent, weight), frequent, weight) for x in sets]
            yield pa.RecordBatch.from_arrays([pa.array([len(x) for x in sets], pa.int64()), pa.array([1 + float(np.where(w > 0, w - 1, rare).mean()) for w in met], pa.float64())], ["size", "met"])

    lists = counts.where("elements is not null").select("elements").mapInArrow(meet, "size long, met double").groupBy("size").agg(F.count("*").alias("sets"), F.avg("met").alias("met")).collect()  # a row a size
    discard(counts)
    return choose_boundary({r["size"]: r["sets"] for r in lists}, {r["size"]: r["met"] for r in lists}, percent), frequent, weight


_ROWS = "`{key}` {kind}, owner binary, hi long, lo long, n long, keys binary, sig binary"


def _describe(docs: DataFrame, key: str, text: str, n: int, percent: int, plan: tuple) -> DataFrame:
    """(key, owner, hi, lo, n, keys, sig) per row; hi and lo identify the set, null if it is empty."""
    kind = docs.schema[key].dataType.simpleString()
    boundary, frequent, weight = plan

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, sizes, keys, sigs = [], [], [], []
            for x in ngram_sets(column(b, text), n):
                full = len(x) > 0
                names.append(xxhash.xxh3_128_digest(x.tobytes()) if full else bytes(16))
                sizes.append(len(x))
                keys.append(keys_of(x, percent, boundary, frequent, weight).tobytes() if full else None)
                sigs.append(signature(x) if full else None)
            half = np.frombuffer(b"".join(names), "<i8").reshape(-1, 2)
            none = np.array(sizes, np.int64) == 0
            yield pa.RecordBatch.from_arrays(
                [column(b, key), column(b, "owner"), pa.array(half[:, 0], mask=none), pa.array(half[:, 1], mask=none), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(sigs, pa.binary())],
                [key, "owner", "hi", "lo", "n", "keys", "sig"])

    return docs.select(F.col(key), F.col(text), text_id(text).alias("owner")).mapInArrow(run, _ROWS.format(key=key, kind=kind))


def _hot_keys(nodes: DataFrame, parts: int) -> np.ndarray:
    """Keys with a large share of all entries, sorted; there are fewer of them than shares, so few. A key with two
    shares of the whole has one of them in batches where it has a share of the batch, so none is missed."""
    share = 1 / (16 * parts)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = np.frombuffer(b"".join(column(b, "keys").to_pylist()), np.uint64)
            values, times = np.unique(keys, return_counts=True)
            often = times >= max(2, share * len(keys))
            yield pa.RecordBatch.from_arrays([pa.array([None, *values[often].view(np.int64).tolist()], pa.int64()), pa.array([len(keys), *times[often].tolist()], pa.int64())], ["key", "times"])

    counts = nodes.select("keys").mapInArrow(count, "key long, times long").groupBy("key").agg(F.sum("times").alias("times"))
    hot = counts.where(f"key is null or times > {PRUNED}").orderBy(F.col("key").isNull().desc(), F.desc("times")).limit(1 + int(1 / share)).collect()
    total = sum(r["times"] for r in hot if r["key"] is None)
    return np.sort(np.array([r["key"] % (1 << 64) for r in hot if r["key"] is not None and r["times"] > total * share], np.uint64))


def _deal_keys(nodes: DataFrame, parts: int, hot: np.ndarray) -> DataFrame:
    """Entries (key, node, n) by partition of the key; those of hot keys by partition of key and node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = [np.frombuffer(k, np.uint64) for k in column(b, "keys").to_pylist()]
            count = np.array([len(k) for k in keys], np.int64)
            entries = np.zeros(int(count.sum()), _ENTRY)
            if not len(entries):
                continue
            entries["key"] = np.concatenate(keys)
            entries["node"] = np.repeat(column(b, "node").to_numpy(zero_copy_only=False), count)
            entries["n"] = np.repeat(column(b, "n").to_numpy(zero_copy_only=False), count)
            place = entries["key"] >> np.uint64(20)
            often = np.isin(entries["key"], hot)
            place[often] += mix(entries["node"][often].astype(np.uint64)) >> np.uint64(20)
            part = place % np.uint64(parts)
            order = np.argsort(part, kind="stable")
            entries, part = entries[order], part[order]
            bounds = np.searchsorted(part, np.arange(parts + 1, dtype=np.uint64))
            held = [(p, entries[bounds[p] : bounds[p + 1]].tobytes()) for p in range(parts) if bounds[p] < bounds[p + 1]]
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in held], pa.int64()), pa.array([d for _, d in held], pa.binary())], ["part", "data"])

    return nodes.select("node", "n", "keys").mapInArrow(run, "part long, data binary")


_LISTED = "key long, node long, n long, b long"


def _lists(percent: int, hot: np.ndarray):
    """What keys tell of nodes of fitting sizes: of short lists, (key, node, n) to be pruned; of longer ones and of
    cuts of hot ones, a star (node, b); and for the cut of a hot key also (key, b)."""

    def run(table: pa.Table) -> pa.Table:
        e = np.frombuffer(b"".join(table["data"].to_pylist()), _ENTRY)
        e = e[np.lexsort((e["node"], e["n"], e["key"]))]
        often = np.isin(e["key"], hot)
        new = np.ones(len(e), bool)
        new[1:] = (e["key"][1:] != e["key"][:-1]) | (~often[1:] & (100 * e["n"][:-1].astype(np.int64) < percent * e["n"][1:].astype(np.int64)))
        first = np.flatnonzero(new)
        length = np.diff(np.append(first, len(e)))
        least = np.minimum.reduceat(e["node"], first) if len(first) else first
        # a list whose sizes leave a gap is several lists
        name = mix(e["key"][first] + mix(e["n"][first].astype(np.uint64))).view(np.int64) if len(first) else first
        short = np.repeat((length > 1) & (length <= PRUNED), length) & ~often
        long = np.repeat(length > PRUNED, length) | often
        of = np.repeat(np.arange(len(first)), length)
        cuts = first[often[first]] if len(first) else first
        none = lambda k: pa.nulls(k, pa.int64())
        columns = [
            [pa.array(name[of[short]], pa.int64()), none(int(long.sum())), pa.array(e["key"][cuts].view(np.int64) if len(cuts) else [], pa.int64())],
            [pa.array(e["node"][short], pa.int64()), pa.array(e["node"][long], pa.int64()), none(len(cuts))],
            [pa.array(e["n"][short].astype(np.int64), pa.int64()), none(int(long.sum())), none(len(cuts))],
            [none(int(short.sum())), pa.array(least[of[long]], pa.int64()), pa.array(least[of[cuts]], pa.int64())]]
        return pa.table([pa.chunked_array(c, pa.int64()) for c in columns], names=["key", "node", "n", "b"])

    return run


def _stars(nodes: DataFrame, percent: int) -> DataFrame:
    """(a, b): links to be checked, which join all nodes that may link."""
    parts = partitions(nodes.sparkSession)
    hot = _hot_keys(nodes, parts)
    listed = staged(_deal_keys(nodes, parts, hot).groupBy("part").applyInArrow(_lists(percent, hot), _LISTED), "lists")
    signed = listed.where("n is not null").select("key", "node", "n").join(nodes.select("node", "sig"), "node").withColumn("part", F.pmod("key", F.lit(4 * parts)))
    pruned = signed.groupBy("part").applyInArrow(_prune(percent), "node long, b long")
    cuts = listed.where("node is null").select("key", F.col("b").alias("node"))
    met = cuts.join(cuts.groupBy("key").agg(F.min("node").alias("b")), "key").select("node", "b")
    stars = pruned.unionByName(listed.where("node is not null and b is not null").select("node", "b")).unionByName(met)
    out = staged(stars.where("node <> b").select(F.col("node").alias("a"), "b").distinct(), "stars")
    discard(listed)
    return out


def _sets(docs: DataFrame, key: str, text: str, wanted: DataFrame, n: int) -> DataFrame:
    """(node, elements) of the wanted(node, owner, least): each read from a row of that text and key, so that copies
    of a text don't meet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([column(b, "node"), pa.array([x.tobytes() for x in ngram_sets(column(b, "t"), n)], pa.binary())], ["node", "elements"])

    own = docs.select(F.col(key).alias("k"), F.col(text).alias("t"), text_id(text).alias("o"))
    wanted = F.broadcast(wanted) if wanted.count() <= SENT else wanted  # else all texts are shuffled
    rows = own.join(wanted, (F.col("o") == F.col("owner")) & F.col("k").eqNullSafe(F.col("least")))
    return rows.select("node", "t").mapInArrow(run, "node long, elements binary").dropDuplicates(["node"])


def linked_roots(x: list[np.ndarray], y: list[np.ndarray], percent: int) -> np.ndarray:
    """Of sets x followed by sets y, those of x compared with those of y (or with each other, if y is empty): for
    each the least number that it reaches by links found here."""
    sets = x + y
    size = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(len(sets)), size)
    _, element, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    order = np.argsort(element, kind="stable")
    element, owner = element[order], owner[order]
    shared = times[element] > 1
    element, owner = element[shared], owner[shared]
    _, element = np.unique(element, return_inverse=True)
    n = len(x)
    width = n if not y else len(y)
    common = np.zeros((n, width), np.float32)
    top = int(element.max(initial=-1)) + 1
    for lo in range(0, top, 1024):
        a, b = np.searchsorted(element, (lo, lo + 1024))
        m = np.zeros((len(sets), min(1024, top - lo)), np.float32)
        m[owner[a:b], element[a:b] - lo] = 1
        common += m[:n] @ (m[n:] if y else m).T
    common = common.astype(np.int64)
    other = size[n:] if y else size
    links = 100 * common >= percent * (size[:n, None] + other[None, :] - common)
    label = np.arange(len(sets))
    i, j = np.nonzero(links)
    j = j + n if y else j
    while True:
        least = label.copy()
        np.minimum.at(least, i, label[j])
        np.minimum.at(least, j, label[i])
        least = least[least]
        if (least == label).all():
            return label
        label = least


def _check(percent: int):
    """Links (a, b) that join what the blocks of a partition link: one for each node but the first."""

    def run(table: pa.Table) -> pa.Table:
        blocks: dict[tuple[int, int, int], tuple[list, list]] = {}
        for cluster, lo, hi, mine, node, elements in zip(*(table[c].to_pylist() for c in ("cluster", "lo", "hi", "mine", "node", "elements"))):
            blocks.setdefault((cluster, lo, hi), ([], []))[mine != lo].append((node, np.frombuffer(elements, np.uint64)))
        a, b = [], []
        for left, right in blocks.values():
            if not left or not (right or len(left) > 1):
                continue
            names = [v for v, _ in left + right]
            for k, root in enumerate(linked_roots([s for _, s in left], [s for _, s in right], percent).tolist()):
                if root != k:
                    a.append(names[k])
                    b.append(names[root])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def components(labels: DataFrame, links: DataFrame, files: int | None = None) -> DataFrame:
    """labels(node, comp) after merging along links(a, b): least labels spread and jump until they rest."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    la, lb = labels.select(F.col("node").alias("a"), F.col("comp").alias("ca")), labels.select(F.col("node").alias("b"), F.col("comp").alias("cb"))
    edges = staged(both.join(la, "a").join(lb, "b").where("ca != cb").select("ca", "cb").distinct(), "edges", files)
    roots = staged(edges.groupBy(F.col("ca").alias("comp")).agg(F.min("cb").alias("m")).select("comp", F.least("comp", "m").alias("root")), "roots", files)
    while True:
        near = roots.select(F.col("comp").alias("cb"), F.col("root").alias("r"))
        least = edges.join(near, "cb").groupBy(F.col("ca").alias("comp")).agg(F.min("r").alias("r"))
        spread = roots.join(least, "comp").select("comp", F.least("root", "r").alias("to"), F.col("root").alias("was"))
        jump = roots.select(F.col("comp").alias("to"), F.col("root").alias("further"))
        after = staged(spread.join(jump, "to", "left").select("comp", F.least("to", F.coalesce("further", "to")).alias("root"), "was"), "roots", files)
        discard(roots)
        moved = after.where("root != was").limit(1).count()
        roots = after
        if not moved:
            break
    discard(edges)
    return labels.join(roots.select("comp", "root"), "comp", "left").select("node", F.coalesce("root", "comp").alias("comp"))


def _compare(dealt: DataFrame, sets: DataFrame, percent: int, files: int) -> DataFrame:
    """Links within and between the blocks of dealt(cluster, lo, hi, mine, node)."""
    parts = 4 * partitions(sets.sparkSession)
    dealt = dealt.select("cluster", "lo", "hi", "mine", "node").join(sets, "node").withColumn("part", F.pmod(F.xxhash64("cluster", "lo", "hi"), F.lit(parts)))
    return staged(dealt.groupBy("part").applyInArrow(_check(percent), "a long, b long"), "links", files)


def _large(clusters: DataFrame, sets: DataFrame, percent: int, files: int) -> list[DataFrame]:
    """Links of clusters(cluster, node, size) of more than a block."""
    chunk = F.pmod(F.xxhash64("node"), F.ceil(F.col("size") / BLOCK))
    members = clusters.withColumn("lo", chunk).withColumn("hi", F.lit(-1).cast("long")).withColumn("mine", F.col("lo"))
    ranked = clusters.withColumn("rank", F.row_number().over(Window.partitionBy("cluster").orderBy(F.xxhash64("node", "cluster"), "node"))).where(F.col("rank") <= PIVOTS)
    pivots = ranked.withColumn("lo", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("size") / BLOCK) - 1))).withColumn("hi", F.lit(-1).cast("long")).withColumn("mine", F.col("hi"))
    names = ["cluster", "lo", "hi", "mine", "node"]
    found = _compare(members.select(names).unionByName(pivots.select(names)), sets, percent, files)
    joined = staged(components(clusters.select("node", F.col("node").alias("comp")), found, files), "joined", files)
    # sets of one large component make blocks of their own; what is left of the cluster makes blocks of any
    whole = joined.groupBy("comp").agg(F.count("*").alias("held")).where(F.col("held") > BLOCK // 2)
    marked = staged(clusters.join(joined, "node").join(whole, "comp", "left").withColumn("own", F.when(F.col("held").isNotNull(), F.col("comp"))), "marked", files)
    counts = marked.groupBy("cluster", "own").agg(F.count("*").alias("all"))
    many = F.ceil(F.col("all") / BLOCK)
    counts = staged(counts.select("cluster", "own", many.alias("many")), "counts", files)
    blocks = staged(counts.select("cluster", "own", F.explode(F.sequence(F.lit(0).cast("long"), F.col("many") - 1)).alias("k")).withColumn("block", F.xxhash64("cluster", "own", "k")), "blocks", files)
    other = blocks.select("cluster", F.col("own").alias("own2"), F.col("block").alias("block2"))
    pairs = blocks.join(other, "cluster").where("block <= block2 and (own is null or own2 is null or own <> own2)")
    sides = pairs.select("cluster", F.col("block").alias("lo"), F.col("block2").alias("hi"), F.explode(F.array_distinct(F.array("block", "block2"))).alias("mine"))
    placed = marked.join(counts, marked["cluster"].eqNullSafe(counts["cluster"]) & marked["own"].eqNullSafe(counts["own"])).select(marked["cluster"], marked["own"], "node", F.pmod(F.xxhash64("node"), "many").alias("k"))
    placed = placed.select("node", F.xxhash64("cluster", "own", "k").alias("mine"))
    rest = _compare(placed.join(sides, "mine"), sets, percent, files)
    return [found, rest]


def _resolve(stars: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """labels(node, comp) of the nodes of the stars."""
    files = max(6, stars.count() // 50_000)
    ends = stars.select(F.col("a").alias("node")).unionByName(stars.select(F.col("b").alias("node"))).distinct()
    alone = staged(ends.withColumn("comp", F.col("node")), "alone", files)
    clusters = staged(components(alone, stars, files), "clusters", files).withColumnRenamed("comp", "cluster")
    sizes = staged(clusters.groupBy("cluster").agg(F.count("*").alias("size")), "sizes", files)
    large = sizes.where(F.col("size") > BLOCK)
    small = clusters.join(large, "cluster", "left_anti")
    nought = F.lit(0).cast("long")
    links = _compare(small.select("cluster", "node", nought.alias("lo"), nought.alias("hi"), nought.alias("mine")), sets, percent, files)
    if large.limit(1).count():
        for more in _large(staged(clusters.join(large, "cluster"), "large", files), sets, percent, files):
            links = links.unionByName(more)
    out = staged(components(alone, links, files), "labels", files)
    discard(alone, sizes)
    return out


def join_components(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 3, percent: int = 90) -> DataFrame:
    """Per row: key, n_shingles (size of its set), component_id (the least key reachable by links, own included),
    owner (128 bits of the text) and group, a label of the component; null for the empty set."""
    small_batches(docs.sparkSession)
    docs = docs.select(key, text)
    rows = staged(_describe(docs, key, text, n, percent, _plan(docs, text, n, percent)), "sets")
    by_key = F.struct(F.col(key).isNull().alias("last"), F.col(key).alias("least"), "owner")
    full = rows.where("hi is not null").groupBy("hi", "lo").agg(F.min(by_key).alias("of"), *[F.first(c).alias(c) for c in ("n", "keys", "sig")])
    nodes = staged(full.select("hi", "lo", "of.least", "of.owner", "n", "keys", "sig").withColumn("node", F.monotonically_increasing_id()), "nodes")  # fixed by being written
    stars = _stars(nodes, percent)
    ends = stars.select(F.col("a").alias("node")).unionByName(stars.select(F.col("b").alias("node"))).distinct()
    sets = staged(_sets(docs, key, text, nodes.select("node", "owner", "least").join(ends, "node", "left_semi"), n), "elements")
    labels = _resolve(stars, sets, percent)
    discard(sets, stars)
    named = nodes.select("hi", "lo", "node", "least").join(labels, "node", "left").select("hi", "lo", F.coalesce("comp", "node").alias("group"), "least")
    least = named.groupBy("group").agg(F.min("least").alias("component_id"))
    of_node = staged(named.join(least, "group").select("hi", "lo", "component_id", "group"), "named")
    discard(nodes, labels)
    found = rows.select(key, F.col("n").alias("n_shingles"), "owner", "hi", "lo").join(of_node, ["hi", "lo"], "left")
    return found.select(key, "n_shingles", F.when(F.col("hi").isNull(), F.col(key)).otherwise(F.col("component_id")).alias("component_id"), "owner", "group")


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each component: that of the least key (null last), then of the least text hash; of
    rows equal in both, any one. Texts without words all stay; an empty table stays empty; columns of any name pass."""
    worded = F.coalesce(F.col(text).rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    found = join_components(docs, key, text, n, percent).where("group is not null")
    chosen = F.min(F.struct(F.col(key).isNull().alias("last"), F.col(key).alias("k"), "owner", "times")).alias("f")
    times = found.groupBy("group", key, "owner").agg(F.count("*").alias("times"))
    first = staged(times.groupBy("group").agg(chosen).select("f.k", "f.owner", "f.times"), "chosen")
    mine, kept_key, kept_owner = unused(docs, "mine"), unused(docs, "kept_key"), unused(docs, "kept_owner")
    rows = docs.where(worded).withColumn(mine, text_id(text))
    sent = first.count() <= SENT  # else all texts are shuffled

    def those(where: str) -> DataFrame:
        wanted = first.where(where).select(F.col("k").alias(kept_key), F.col("owner").alias(kept_owner))
        return rows.join(F.broadcast(wanted) if sent else wanted, (F.col(mine) == F.col(kept_owner)) & F.col(key).eqNullSafe(F.col(kept_key)))

    kept = those("times = 1")
    if first.where("times > 1").limit(1).count():  # only repeated rows meet
        kept = kept.unionByName(those("times > 1").dropDuplicates([kept_owner, kept_key]))
    return kept.select(docs.columns).unionByName(docs.where(~worded))
