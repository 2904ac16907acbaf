"""Benchmark decontamination over a distributed positional inverted index.

The index holds every token of the training texts: for each shard (a bounded run of documents, indexed where it
is read) one row per term with its positions, and one row that lists the shard's documents. Texts lie end to
end in a shard with a gap between them that no phrase or proximity window can bridge. Searching reads only the
rows of the terms asked for and intersects offset-adjusted lists: the rarest term of each window gives candidate
diagonals (position minus offset), which the other terms then confirm. Terms are 64-bit hashes of words.

Items are a stated query set. They are searched in blocks of bounded size, each against the whole index.

Words: A-Z lower-cased, then runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]``.
Defined cases: a null or empty text has no words and is never contaminated; an item without words matches nothing; one
of fewer words than a window is one window; items of equal text are all reported, those of equal id once; an item with
a null id marks words but is not listed; repeated documents are judged each by itself; long documents are indexed
whole; terms of equal frequency go by their hashes, which changes no result; an empty table gives an empty result; an
empty item table leaves every document clean.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kelpie.llm._common import ALNUM, Words, column, staged, text_bytes

WINDOW = 13
#: Unused positions between two texts of a shard; windows and proximity stay below it.
GAP = 128
#: Bytes of text in a shard at most, unless one text has more.
SHARD_BYTES = 8_000_000
#: Bytes of item texts in a block at most.
BLOCK_BYTES = 16_000_000
_WORD = re.compile(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
INDEX = "shard long, term long, n long, positions binary, ids array<{key}>, words array<long>"
HITS = "shard long, doc long, spans array<struct<s:long,e:long>>, items array<string>"


def term_ids(text: str | None) -> np.ndarray:
    import xxhash

    words = _WORD.findall((text or "").encode().translate(ALNUM))
    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words)).view(np.int64)


def build_index(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Postings (shard, term, n, positions as 32-bit differences) and, with a null term, the shard's documents."""
    kind = docs.schema[key].dataType.simpleString()
    from pyspark.sql.pandas.types import to_arrow_type

    arrow = to_arrow_type(docs.schema[key].dataType)
    schema = pa.schema([("shard", pa.int64()), ("term", pa.int64()), ("n", pa.int64()), ("positions", pa.binary()), ("ids", pa.list_(arrow)), ("words", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId() << 32
        for b in batches:
            keys, texts = column(b, key), column(b, text)
            _, at = text_bytes(texts)
            lo = 0
            while lo < len(keys):
                hi = max(lo + 1, int(np.searchsorted(at, at[lo] + SHARD_BYTES, "right")) - 1)
                w = Words(texts.slice(lo, hi - lo), ALNUM)
                counts = np.diff(w.offsets)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([shard]), pa.array([None], pa.int64()), pa.array([len(counts)]), pa.array([None], pa.binary()), pa.array([keys.slice(lo, hi - lo).to_pylist()], schema.field("ids").type), pa.array([counts.tolist()], pa.list_(pa.int64()))], schema=schema)
                position = np.arange(len(w.codes), dtype=np.int64) + GAP * np.repeat(np.arange(len(counts)), counts)
                order = np.argsort(w.codes, kind="stable")
                n = np.bincount(w.codes, minlength=len(w.dictionary)).astype(np.int64)
                listed = position[order]
                delta = np.diff(listed, prepend=0)
                firsts = (np.cumsum(n) - n)[n > 0]
                delta[firsts] = listed[firsts]
                ends = np.concatenate([[0], np.cumsum(4 * n)]).astype(np.int32)
                lists = pa.BinaryArray.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(ends), pa.py_buffer(delta.astype("<u4"))])
                none = pa.nulls
                for s in range(0, len(n), 50_000):
                    m = min(50_000, len(n) - s)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(m, shard)), pa.array(_hashes(w)[s : s + m]), pa.array(n[s : s + m]), lists.slice(s, m), none(m, schema.field("ids").type), none(m, schema.field("words").type)], schema=schema)
                shard += 1
                lo = hi

    return docs.select(key, text).mapInArrow(run, INDEX.format(key=kind))


def _hashes(w: Words) -> np.ndarray:
    if not hasattr(w, "_hashed"):
        w._hashed = w.hashes().view(np.int64)
    return w._hashed


def _item_blocks(items: DataFrame, key: str, text: str) -> Iterator[list[tuple[str | None, np.ndarray]]]:
    """The items with words, in blocks of bounded size."""
    block, size = [], 0
    for r in items.select(F.col(key).cast("string").alias("k"), F.col(text).alias("t")).toLocalIterator():
        terms = term_ids(r["t"])
        if len(terms):
            block.append((r["k"], terms))
            size += len(r["t"])
        if size >= BLOCK_BYTES:
            yield block
            block, size = [], 0
    if block:
        yield block


def _needed(index: DataFrame, terms: np.ndarray) -> DataFrame:
    """Index rows of the terms: a block has a bounded number of them."""
    wanted = index.sparkSession.createDataFrame(pd.DataFrame({"term": terms}), T.StructType([T.StructField("term", T.LongType())]))
    return index.where("term is not null").select("shard", "term", "n", "positions").join(F.broadcast(wanted), "term")


def _lists(group: pd.DataFrame) -> dict[int, np.ndarray]:
    return {t: np.cumsum(np.frombuffer(p, "<u4").astype(np.int64)) for t, p in zip(group["term"].tolist(), group["positions"])}


_NONE = np.zeros(0, np.int64)


def has(sorted_list: np.ndarray, x: np.ndarray) -> np.ndarray:
    at = np.searchsorted(sorted_list, x)
    at[at == len(sorted_list)] = 0
    return sorted_list[at] == x if len(sorted_list) else np.zeros(len(x), bool)


def phrase_positions(terms: np.ndarray, lists: dict[int, np.ndarray], frequency: dict[int, int], window: int = WINDOW) -> np.ndarray:
    """Positions at which a window of the item starts, sorted."""
    m = len(terms)
    w = min(window, m)
    q = terms.tolist()
    df = np.array([frequency.get(t, 0) for t in q])
    anchors = np.unique(np.lib.stride_tricks.sliding_window_view(df, w).argmin(axis=1) + np.arange(m - w + 1))
    found = [lists[q[a]] - a for a in anchors.tolist() if q[a] in lists]
    if not found:
        return _NONE
    diagonals = np.unique(np.concatenate(found))
    out = []
    for lo in range(0, len(diagonals), 100_000):
        d = diagonals[lo : lo + 100_000]
        present = np.stack([has(lists.get(t, _NONE), d + j) for j, t in enumerate(q)], axis=1)
        run = np.concatenate([np.zeros((len(d), 1), np.int64), np.cumsum(present, axis=1)], axis=1)
        row, i = np.nonzero(run[:, w:] - run[:, :-w] == w)
        out.append(d[row] + i)
    return np.unique(np.concatenate(out))


def near_positions(terms: np.ndarray, lists: dict[int, np.ndarray], frequency: dict[int, int], slop: int) -> np.ndarray:
    """Positions of the item's rarest term that have each of its terms within ``slop`` words, in any order."""
    q = sorted(set(terms.tolist()), key=lambda t: (frequency.get(t, 0), t))
    p = lists.get(q[0], _NONE)
    for t in q[1:]:
        other = lists.get(t, _NONE)
        if not len(p) or not len(other):
            return _NONE
        at = np.searchsorted(other, p - slop)
        p = p[(at < len(other)) & (other[np.minimum(at, len(other) - 1)] <= p + slop)]
    return p


def _hit_frame(shard: int, spans: dict[int, list], named: dict[int, set]) -> pd.DataFrame:
    return pd.DataFrame({
        "shard": pd.Series([shard] * len(spans), dtype="int64"), "doc": pd.Series(list(spans), dtype="int64"),
        "spans": pd.Series(list(spans.values()), dtype=object), "items": pd.Series([sorted(named[d]) for d in spans], dtype=object)})


def _matcher(by_text: dict[bytes, list[str]], frequency: dict[int, int], window: int, slop: int | None):
    """Searches one shard for a block of items."""

    def run(ids: tuple, group: pd.DataFrame, docs: pd.DataFrame) -> pd.DataFrame:
        if group.empty or docs.empty:
            return _hit_frame(ids[0], {}, {})
        lists = _lists(group)
        counts = np.asarray(docs["words"].iloc[0], np.int64)
        starts = np.concatenate([[0], np.cumsum(counts + GAP)])
        spans: dict[int, list] = {}
        named: dict[int, set] = {}
        for raw, keys in by_text.items():
            t = np.frombuffer(raw, np.int64)
            at = phrase_positions(t, lists, frequency, window) if slop is None else near_positions(t, lists, frequency, slop)
            width = min(window, len(t)) if slop is None else 1
            for d, p in zip((np.searchsorted(starts, at, "right") - 1).tolist(), at.tolist()):
                mine = spans.setdefault(d, [])
                if mine and mine[-1]["s"] <= p <= mine[-1]["e"]:
                    mine[-1]["e"] = max(mine[-1]["e"], p + width)
                else:
                    mine.append({"s": p, "e": p + width})
                named.setdefault(d, set()).update(k for k in keys if k is not None)
        return _hit_frame(ids[0], spans, named)

    return run


def search(index: DataFrame, items: DataFrame, key: str = "item_id", text: str = "text", window: int = WINDOW, slop: int | None = None) -> DataFrame:
    """(shard, doc, spans, items): matched spans, by position in the shard, and item ids, for each document with a
    match. Exact phrases of ``window`` consecutive item words, or with ``slop`` proximity matches."""
    if max(window, slop or 0) >= GAP:
        raise ValueError(f"window and slop must be below {GAP}")
    spark = index.sparkSession
    out = spark.createDataFrame([], HITS)
    lengths = index.where("term is null").select("shard", "words").toDF("shard", "words")
    for block in _item_blocks(items, key, text):
        terms = np.unique(np.concatenate([t for _, t in block]))
        rows = _needed(index, terms).toDF("term", "shard", "n", "positions")
        frequency = {r["term"]: r["df"] for r in rows.groupBy("term").agg(F.sum("n").alias("df")).collect()}
        by_text: dict[bytes, list[str]] = {}
        for k, t in block:
            by_text.setdefault(t.tobytes(), []).append(k)

        out = out.unionByName(rows.groupBy("shard").cogroup(lengths.groupBy(lengths["shard"])).applyInPandas(_matcher(by_text, frequency, window, slop), HITS))
    return out


def contamination(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", share: int = 20) -> DataFrame:
    """Per document: key, n_words, n_hit (words inside an occurrence of a window), n_items, items (sorted ids),
    contaminated (any hit, and ``share`` times the hits are at least the words)."""
    index = staged(build_index(docs, key, text), "postings")
    hits = search(index, items, item_key, item_text).groupBy("shard", "doc").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    covered = F.aggregate(
        "spans", F.struct(F.lit(-1).cast("long").alias("end"), F.lit(0).cast("long").alias("n")),
        lambda a, x: F.struct(F.greatest(a["end"], x["e"]).alias("end"), (a["n"] + F.greatest(F.lit(0).cast("long"), x["e"] - F.greatest(x["s"], a["end"]))).alias("n")))
    hits = hits.select("shard", "doc", covered["n"].alias("n_hit"), "items")
    each = index.where("term is null").select("shard", F.posexplode(F.arrays_zip("ids", "words")).alias("doc", "d")).select("shard", F.col("doc").cast("long").alias("doc"), F.col("d.ids").alias(key), F.col("d.words").alias("n_words"))
    n_hit, listed = F.coalesce("n_hit", F.lit(0).cast("long")), F.coalesce("items", F.array().cast("array<string>"))
    return each.join(hits, ["shard", "doc"], "left").select(
        key, "n_words", n_hit.alias("n_hit"), F.size(listed).cast("long").alias("n_items"), listed.alias("items"), ((n_hit > 0) & (n_hit * share >= F.col("n_words"))).alias("contaminated"))
