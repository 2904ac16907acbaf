"""Removal of repeated byte strings across a corpus, by suffix arrays over candidate segments.

A window is ``match`` bytes of one text. Its anchor is the 64-byte string in it with the least hash (the leftmost
of equals), so equal windows have equal anchors at equal offsets. Consecutive windows with one anchor make a run.

1. Each batch sends each different anchor once (anchor, a text that has it, count) to the anchor's partition;
   anchors met in two places there, or twice in one batch, are candidates, told to the texts that have them.
2. Those texts send the segments of their candidate runs to the anchor's partition, equal segments of a batch
   once with their number. Runs of the few anchors with a large share of all occurrences (so few, and all known) are
   cut into runs of 16 offsets and keyed by the 185 bytes that all their windows share, so no anchor gathers a large
   group.
3. There, different segments of an anchor are sorted as suffixes (``suffixes.two_stage``); a window whose common
   prefix with a neighbour reaches ``match`` bytes, or whose segment came more than once, is repeated.
4. The repeated spans go back to their texts. A text is known by 128 bits, so equal texts share their spans and copies
   are handled once; 64 of them route its messages, where two texts of one number only get more told than they need.

Texts are UTF-8 bytes; strings never cross texts; strings are judged on the input.
Defined cases: null or empty text has zero bytes; texts shorter than ``match`` keep all bytes; a text that occurs
in two rows is removed whole if it is long enough; overlapping repeats inside one text count; an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelpie.llm._common import column, discard, mix, partitions, staged, text_bytes, unused
from kelpie.llm.suffixes import common_prefixes, two_stage

GRAM = 64
#: Offsets that share a key in the runs of a hot anchor.
STEP = 16
#: Occurrences from which an anchor may count as hot, and the part of a partition's fair share that makes it so.
HOT_FROM, HOT_PART = 1_000, 1 / 64
_PLACE = 18  # bits of a position in a chunk, whose arrays are eight bytes a position; more for a long match
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _FACTOR)
#: Bytes sorted together, unless one anchor has more.
SORTED_BYTES = 500_000
#: Bytes of segments held for merging equal ones; then they are sent.
HELD_BYTES = 8_000_000


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _FACTOR), np.full(n, np.uint64(pow(int(_FACTOR), -1, 1 << 64)))
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def runs(raw: np.ndarray, at: np.ndarray, match: int) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor: text number, first and last window start, anchor start, anchor hash.
    Positions count from the first text's first byte."""
    none = tuple(np.zeros(0, np.int64) for _ in range(4)) + (np.zeros(0, np.uint64),)
    n = len(raw)
    if n < match:
        return none
    reach = match - GRAM + 1
    lengths = np.diff(at)
    spans = np.flatnonzero(lengths >= match)
    if not len(spans):
        return none
    place = max(_PLACE, (4 * match).bit_length())
    size = (1 << place) - 2 * match
    up, down = _powers(min(n, size + 2 * match) + 1)
    found = []
    edges = np.zeros(n + 1, np.int8)
    edges[at[spans]] = 1
    edges[at[spans] + lengths[spans] - match + 1] = -1
    allowed = np.cumsum(edges[:-1], dtype=np.int8, out=edges[:-1]).view(bool)
    mask = np.uint64((1 << place) - 1)
    for lo in range(0, n - match + 1, size):
        part = raw[lo : min(n, lo + size + match - 1)]
        m = len(part)
        prefix = np.concatenate([[np.uint64(0)], np.cumsum(_BYTE[part] * up[:m], dtype=np.uint64)])
        grams = mix((prefix[GRAM:] - prefix[:-GRAM]) * down[: m - GRAM + 1])
        least = (grams & ~mask) | np.arange(len(grams), dtype=np.uint64)
        width = 1
        while 2 * width <= reach:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        least = np.minimum(least[: len(least) - (reach - width)], least[reach - width :])
        window = np.flatnonzero(allowed[lo : lo + len(least)])
        if not len(window):
            continue
        anchor = (least[window] & mask).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (window[1:] != window[:-1] + 1)]))
        last = np.append(first[1:], len(window)) - 1
        found.append((window[first] + lo, window[last] + lo, anchor[first] + lo, grams[anchor[first]]))
    if not found:
        return none
    begin, last, anchor, grams = (np.concatenate(c) for c in zip(*found))
    # runs that go on over a chunk's end are joined
    first = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (begin[1:] != last[:-1] + 1)]))
    last = last[np.append(first[1:], len(begin)) - 1]
    begin = begin[first]
    return np.searchsorted(at, begin, "right") - 1, begin, last, anchor[first], grams[first]


def _slices(batch: pa.RecordBatch, text: str, most: int = 2_000_000) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    raw, at = text_bytes(column(batch, text))
    lo = 0
    while lo < len(at) - 1:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + most, "right")) - 1)
        yield lo, hi, raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi


def _by_text(owner: np.ndarray, hashes: np.ndarray) -> tuple[list[int], list[bytes]]:
    """The hashes of each text as bytes."""
    if not len(owner):
        return [], []
    order = np.argsort(owner, kind="stable")
    owner, hashes = owner[order], hashes[order]
    cuts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    return owner[cuts].tolist(), [hashes[a:b].tobytes() for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(owner)])]


_TOLD = "part long, owner long, data binary"
_ENTRY = np.dtype([("hash", "<u8"), ("owner", "<i8"), ("n", "<i8")])


def _tell_anchors(keyed: DataFrame, match: int, parts: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            owners = column(b, "owner").to_numpy(zero_copy_only=False)
            whose, grams = [], []
            for lo, _, raw, at in _slices(b, "text"):
                doc, _, _, _, h = runs(raw, at, match)
                whose.append(owners[lo + doc])
                grams.append(h)
            if not whose:
                continue
            whose, grams = np.concatenate(whose), np.concatenate(grams)
            order = np.argsort(grams, kind="stable")
            whose, grams = whose[order], grams[order]
            first = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]])) if len(grams) else np.zeros(0, np.int64)
            n = np.diff(np.append(first, len(grams)))
            entries = np.zeros(len(first), _ENTRY)
            entries["hash"], entries["owner"], entries["n"] = grams[first], whose[first], n
            part = (grams[first] % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            entries, part = entries[order], part[order]
            bounds = np.searchsorted(part, np.arange(parts + 1))
            rows = [(p, None, entries[bounds[p] : bounds[p + 1]].tobytes()) for p in range(parts) if bounds[p] < bounds[p + 1]]
            many = np.repeat(n > 1, n)  # those met twice here are known to be candidates
            pairs = np.unique(np.stack([whose[many].view(np.uint64), grams[many]], axis=1), axis=0) if many.any() else np.zeros((0, 2), np.uint64)
            names, blobs = _by_text(pairs[:, 0].astype(np.uint64).view(np.int64), np.ascontiguousarray(pairs[:, 1]))
            rows += [(o % parts, o, d) for o, d in zip(names, blobs)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 3, (pa.int64(), pa.int64(), pa.binary()))], ["part", "owner", "data"])

    return keyed.mapInArrow(run, _TOLD)


def _meet(hot_from: int):
    """Candidates of a partition: (owner, data), and with a null owner anchors that may be hot."""

    def run(table: pa.Table) -> pa.Table:
        owner = table["owner"].combine_chunks()
        direct = table.filter(owner.is_valid()).select(["owner", "data"])
        blobs = table.filter(owner.is_null())["data"].to_pylist()
        entries = np.frombuffer(b"".join(blobs), _ENTRY)
        entries = entries[np.argsort(entries["hash"], kind="stable")]
        h = entries["hash"]
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
        met = np.diff(np.append(first, len(h)))
        total = np.add.reduceat(entries["n"], first) if len(first) else first
        wanted = np.repeat(met > 1, met)
        o, x = entries["owner"][wanted], h[wanted]  # in the order of the hashes
        by = np.lexsort((x, o))
        o, x = o[by], x[by]
        new = np.ones(len(o), bool)
        new[1:] = (o[1:] != o[:-1]) | (x[1:] != x[:-1])  # a text's copies tell once
        names, data = _by_text(o[new], np.ascontiguousarray(x[new]))
        hot = (total >= hot_from) & (total >= HOT_PART * total.sum())  # at most 1 / HOT_PART of them here
        names += [None] * int(hot.sum())
        data += [a.tobytes() for a in h[first[hot]]]
        made = pa.table({"owner": pa.array(names, pa.int64()), "data": pa.array(data, pa.binary())})
        return pa.concat_tables([direct.cast(made.schema), made])

    return run


_SEGMENTS = "part long, anchor long, n long, content binary, places binary"
_PLACES = np.dtype([("owner", "<i8"), ("check", "<i8"), ("start", "<i8")])


def _cut_segments(told: DataFrame, match: int, parts: int, hot: frozenset) -> DataFrame:
    core = match - STEP + 1

    def send(held: dict) -> Iterator[pa.RecordBatch]:
        items = iter(held.items())
        while part := list(itertools.islice(items, 10_000)):
            rows = [(key % parts, key - (1 << 63), n, content, np.array(places, _PLACES).tobytes()) for (key, content), (n, places) in part]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()))], ["part", "anchor", "n", "content", "places"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            owners = list(zip(column(b, "owner").to_pylist(), column(b, "check").to_pylist()))
            wanted = column(b, "told").to_pylist()
            copies: dict[tuple[int, int], int] = {}
            for o in owners:
                copies[o] = copies.get(o, 0) + 1
            held: dict[tuple[int, bytes], list] = {}
            size = 0
            done: set[tuple[int, int]] = set()

            def add(key: int, content: bytes, owner: tuple[int, int], start: int) -> None:
                mine = held.get((key, content))
                if mine is None:
                    nonlocal size
                    held[key, content] = mine = [0, []]
                    size += len(content)
                mine[0] += copies[owner]
                mine[1].append((*owner, start))

            for lo, _, raw, at in _slices(b, "text"):
                doc, begin, last, anchor, grams = runs(raw, at, match)
                whole = raw.tobytes()
                bounds = np.searchsorted(doc, np.arange(len(at)))
                for d in range(len(at) - 1):
                    owner = owners[lo + d]
                    if owner in done:
                        continue
                    done.add(owner)
                    i, j = int(bounds[d]), int(bounds[d + 1])
                    asked = np.frombuffer(b"".join(wanted[lo + d]), np.uint64)
                    for k in (np.flatnonzero(np.isin(grams[i:j], asked)) + i).tolist():
                        h, p0, p1, a, base = int(grams[k]), int(begin[k]), int(last[k]), int(anchor[k]), int(at[d])
                        if h not in hot:
                            add(h, whole[p0 : p1 + match], owner, p0 - base)
                            continue
                        p = p0
                        while p <= p1:
                            step = (a - p) // STEP
                            end = min(p1, a - STEP * step)
                            left = a - STEP * step - STEP + 1  # the leftmost window of this step
                            add(xxhash.xxh3_64_intdigest(whole[left + STEP - 1 : left + STEP - 1 + core], step), whole[p : end + match], owner, p - base)
                            p = end + 1
                if size >= HELD_BYTES:
                    yield from send(held)
                    held, size = {}, 0
            yield from send(held)

    return told.mapInArrow(run, _SEGMENTS)


def repeated_windows(contents: list[bytes], match: int) -> list[np.ndarray]:
    """For each segment, which of its windows also starts elsewhere in the segments."""
    text = np.frombuffer(b"".join(contents), np.uint8)
    size = np.array([len(c) for c in contents])
    ends = np.cumsum(size)
    is_start = np.zeros(len(text) + 1, np.int32)
    np.add.at(is_start, ends - size, 1)
    np.add.at(is_start, ends - match + 1, -1)
    is_start = np.cumsum(is_start[:-1]) > 0
    order, rank = two_stage(text, match)
    order = order[is_start[order]]
    equal = common_prefixes(order, text, rank, match) >= match
    found = np.zeros(len(text), bool)
    found[order[1:][equal]] = True
    found[order[:-1][equal]] = True
    return [found[e - s : e - match + 1] for s, e in zip(size.tolist(), ends.tolist())]


def _judge(match: int):
    """Repeated spans (owner, check, pairs of start and end) of a partition's segments."""

    def run(table: pa.Table) -> pa.Table:
        groups: dict[int, dict[bytes, list]] = {}
        for anchor, n, content, places in zip(*(table[c].to_pylist() for c in ("anchor", "n", "content", "places"))):
            mine = groups.setdefault(anchor, {}).setdefault(content, [0, []])
            mine[0] += n
            mine[1].append(places)
        spans: dict[tuple[int, int], list[np.ndarray]] = {}

        def tell(places: list[bytes], found: np.ndarray) -> None:
            edge = np.diff(np.concatenate([[0], found.astype(np.int8), [0]]))
            first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1
            if len(first):
                pair = np.stack([first, last + match], axis=1)
                at = np.frombuffer(b"".join(places), _PLACES)
                for p in np.unique(at) if len(places) > 1 else at:  # several batches may tell of one text
                    spans.setdefault((int(p["owner"]), int(p["check"])), []).append(pair + p["start"])

        held: list[tuple[bytes, list]] = []
        size = 0

        def sort() -> None:
            for (content, (n, places)), found in zip(held, repeated_windows([c for c, _ in held], match)):
                tell(places, np.ones(len(found), bool) if n > 1 else found)

        for mine in groups.values():
            if len(mine) == 1:  # nothing to compare: repeated whole, or met by chance of the hash
                (content, (n, places)), = mine.items()
                if n > 1:
                    tell(places, np.ones(len(content) - match + 1, bool))
                continue
            held += mine.items()
            size += sum(map(len, mine))
            if size >= SORTED_BYTES:
                sort()
                held, size = [], 0
        if held:
            sort()
        return pa.table({"owner": pa.array([o for o, _ in spans], pa.int64()), "check": pa.array([c for _, c in spans], pa.int64()), "data": pa.array([merged(np.concatenate(s)).astype("<i8").tobytes() for s in spans.values()], pa.binary())})

    return run


def merged(spans: np.ndarray) -> np.ndarray:
    """Maximal spans of the union; touching spans join."""
    if not len(spans):
        return spans.reshape(0, 2)
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    first = np.flatnonzero(np.concatenate([[True], spans[1:, 0] > reach[:-1]]))
    return np.stack([spans[first, 0], reach[np.append(first[1:], len(spans)) - 1]], axis=1)


def find_repeats(docs: DataFrame, text: str = "text", match: int = 200, hot_from: int = HOT_FROM, out: str = "__repeated") -> DataFrame:
    """``docs`` with the column ``out``: the pairs (start, end) of the bytes covered by repeated strings, as 64-bit
    integers, or null. Its name must be free."""
    if match < 2 * GRAM:
        raise ValueError(f"match must be {2 * GRAM} at least")
    if unused(docs, out) != out:
        raise ValueError(f"there is a column {out} already")
    parts = partitions(docs.sparkSession)
    plain = F.coalesce(F.col(text), F.lit(""))
    owner, check = F.xxhash64(plain), F.xxhash64(F.lit(match), plain, F.length(plain))
    light = docs.select(owner.alias("owner"), check.alias("check"), plain.alias("text"))
    told = staged(_tell_anchors(light, match, parts).groupBy("part").applyInArrow(_meet(hot_from), "owner long, data binary"), "anchors")
    hot = [np.frombuffer(r["data"], "<u8") for r in told.where("owner is null").select("data").collect()]  # at most parts / HOT_PART
    asked = staged(told.where("owner is not null").groupBy("owner").agg(F.collect_set("data").alias("told")), "asked")  # by itself, so that a hot owner's rows can be split
    discard(told)
    segments = _cut_segments(light.join(asked, "owner"), match, 8 * parts, frozenset(int(x[0]) for x in hot))
    spans = segments.groupBy("part").applyInArrow(_judge(match), "owner long, check long, data binary")
    spans = staged(spans.groupBy("owner", "check").agg(F.collect_list("data").alias("data")), "spans")
    discard(asked)
    owner_name, check_name = unused(docs, "text_owner"), unused(docs, "text_check")
    keyed = docs.withColumns({owner_name: owner, check_name: check})
    return keyed.join(spans.toDF(owner_name, check_name, out), [owner_name, check_name], "left").drop(owner_name, check_name)


def summarise(docs: DataFrame, key: str = "doc_id", text: str = "text", match: int = 200, hot_from: int = HOT_FROM) -> DataFrame:
    """Per row: key, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 of the remaining bytes."""
    kind = docs.schema[key].dataType.simpleString()
    found = unused(docs.select(key, text), "repeated")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, at = text_bytes(column(b, text))
            raw = raw.tobytes()
            rows: list[list] = [[], [], [], []]
            for i, spans in enumerate(column(b, found).to_pylist()):
                own = raw[at[i] : at[i + 1]]
                cut = merged(np.frombuffer(b"".join(spans or ()), "<i8").reshape(-1, 2))
                kept = keep(own, cut)
                for col, v in zip(rows, (len(own), len(own) - len(kept), len(cut), hashlib.sha256(kept).hexdigest())):
                    col.append(v)
            yield pa.RecordBatch.from_arrays([column(b, key), *(pa.array(c, t) for c, t in zip(rows, (pa.int64(), pa.int64(), pa.int64(), pa.string())))], [key, "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return find_repeats(docs.select(key, text), text, match, hot_from, found).mapInArrow(run, f"`{key}` {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def keep(own: bytes, cut: np.ndarray) -> bytes:
    if not len(cut):
        return own
    edges = [0, *cut.ravel().tolist(), len(own)]
    return b"".join(own[a:b] for a, b in zip(edges[::2], edges[1::2]))


def remove_repeats(docs: DataFrame, text: str = "text", match: int = 200) -> DataFrame:
    """``docs`` with the repeated bytes of ``text`` removed; a character cut in two goes whole. Nulls stay;
    columns of any name pass."""
    names, found = list(docs.columns), unused(docs, "repeated")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = column(b, text).to_pylist()
            out = []
            for t, spans in zip(texts, column(b, found).to_pylist()):
                if spans and t:
                    t = keep(t.encode(), merged(np.frombuffer(b"".join(spans), "<i8").reshape(-1, 2))).decode(errors="ignore")
                out.append(t)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if n == text else column(b, n) for n in names], names)

    return find_repeats(docs, text, match, out=found).mapInArrow(run, docs.schema)
