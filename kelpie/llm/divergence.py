"""Source divergence audit by chunk factorization.

Texts are cut at white space into chunks, and chunks are counted document by document where the rows are read. A task
hands on one row per chunk and language: occurrences by source, and the numbers of a few documents that hold it. Rows of
a chunk meet once, there its text is cut into terms once, and the terms take over the chunk's counts. Rows of a term
meet then, which gives its occurrences by source and whether enough documents hold it. Cutting at white space first
loses nothing, since no term contains white space; what moves is chunks with counts, never texts.

A term is kept when at least ``min_docs`` documents of its language hold it. To tell that exactly, the ``min_docs``
least document numbers of each row suffice: the least of a union are among the least of its parts. So a row's
size is bounded by its sources, however many documents share the chunk.

Sources are then compared as smoothed distributions over the kept terms of their language, in whole numbers:
p = 1 + floor(SCALE * (count + 1) / (N + V)), and a term adds floor((p - q)^2 / q) to the divergence of p from q.
Each pair of sources is a row of the result, so pairs cost sources^2 * terms by nature; terms are dealt into shards of
about ``SHARD`` entries, or as many as there are pairs if these are more, whose sums are added up; a shard's work is
tiled.

Defined cases: every row is a document of its own, also repeated ones; null text, lang and source are empty; a long
text is one document like any other and never cut short; a chunk without letters has no terms; equal values are ranked
by item in UTF-8 order; a language without kept terms gives pairs of value 0 and no terms; a language with one source
has no pairs; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kelpie.llm._common import Words, column, doc_index, ragged, staged

#: Lower-cases A-Z and blanks every ASCII byte that is no letter.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
SCALE = 1_000_000_000
#: Bytes of text that a task counts at a time.
SLICE_BYTES = 16_000_000
#: Entries (term, source) of a shard of terms, at least.
SHARD = 20_000
#: Cells of a tile of counts.
CELLS = 2_000_000
COUNTED = "chunk string, lang string, sources binary, docs binary"


def source_code(lang: str, source: str, seed: int) -> int:
    """64 bits that stand for a source of a language; ``sources_of`` finds a seed without collisions."""
    return xxhash.xxh3_64_intdigest(f"{len(lang)}:{lang}{source}".encode(), seed=seed) - (1 << 63)


def _filled(docs: DataFrame) -> DataFrame:
    return docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])


def sources_of(docs: DataFrame) -> tuple[DataFrame, int]:
    """lang, source and code of every group that occurs, and the seed of the codes."""
    named = staged(_filled(docs).select("lang", "source").distinct(), "sources")
    n = named.count()
    for seed in range(100):
        def coded(batches: Iterator[pa.RecordBatch], seed=seed) -> Iterator[pa.RecordBatch]:
            for b in batches:
                codes = [source_code(x, y, seed) for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(codes, pa.int64())], ["lang", "source", "code"])

        out = named.mapInArrow(coded, "lang string, source string, code long")
        if out.select("code").distinct().count() == n:
            return staged(out, "codes"), seed
    raise ValueError("no seed without collisions")


def _binary(values: np.ndarray, starts: np.ndarray, width: int) -> pa.Array:
    """Runs of ``values`` (rows of ``width`` bytes) as binaries; ``starts`` has one more entry than runs."""
    return pa.Array.from_buffers(pa.binary(), len(starts) - 1, [None, pa.py_buffer((starts * width).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def _runs(changes: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal rows, given where a row differs from the one before."""
    return np.concatenate([[0], 1 + np.flatnonzero(changes)])


def _first_of_runs(start: np.ndarray, total: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the first ``most`` items of each run, and the offsets of these."""
    lengths = np.minimum(np.diff(np.append(start, total)), most)
    return ragged(start, lengths), np.concatenate([[0], np.cumsum(lengths)])


def _count(texts: pa.Array, langs: pa.Array, sources: pa.Array, first: int, seed: int, min_docs: int) -> pa.RecordBatch | None:
    """Rows of one slice of documents: per chunk and language, (code, occurrences) of each source and some documents."""
    words = Words(texts)
    if not len(words.codes):
        return None
    pairs = list(zip(langs.to_pylist(), sources.to_pylist(), strict=True))
    groups = sorted(set(pairs))
    number = {x: i for i, x in enumerate(groups)}
    group = np.fromiter((number[x] for x in pairs), np.int64, len(pairs))
    order = np.argsort(group, kind="stable")  # documents of a group, and groups of a language, are neighbours
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    names = sorted({x for x, _ in groups})
    lang_of = np.array([names.index(x) for x, _ in groups], np.int64)
    codes = np.array([source_code(*x, seed) for x in groups], np.int64)
    found, n = np.unique(words.codes.astype(np.int64) * len(order) + rank[doc_index(words.offsets)], return_counts=True)
    chunk, doc = np.divmod(found, len(order))
    g = group[order[doc]]
    moved = chunk[1:] != chunk[:-1]
    by_source = _runs(moved | (g[1:] != g[:-1]))
    row = _runs(moved | (lang_of[g[1:]] != lang_of[g[:-1]]))
    entries = np.stack([codes[g[by_source]], np.add.reduceat(n, by_source)], axis=1)
    at, doc_starts = _first_of_runs(row, len(found), min_docs)
    return pa.RecordBatch.from_arrays([
        words.dictionary.take(pa.array(chunk[row])), pa.DictionaryArray.from_arrays(pa.array(lang_of[g[row]]), pa.array(names, pa.string())).cast(pa.string()),
        _binary(entries, np.append(np.searchsorted(by_source, row), len(by_source)), 16), _binary(first + order[doc[at]], doc_starts, 8)], ["chunk", "lang", "sources", "docs"])


def chunk_counts(docs: DataFrame, seed: int, min_docs: int) -> DataFrame:
    """One row per slice, chunk and language; chunks are lower-cased (A-Z)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, held, size = TaskContext.get().partitionId() << 40, [], 0
        for b in batches:
            for at in range(0, b.num_rows, 1000):  # so that slices keep their bound with long texts
                part = b.slice(at, 1000)
                held.append(part)
                size += part.nbytes
                if size >= SLICE_BYTES:
                    yield from counted(held, done)
                    done, held, size = done + sum(x.num_rows for x in held), [], 0
        yield from counted(held, done)

    def counted(held: list[pa.RecordBatch], done: int) -> Iterator[pa.RecordBatch]:
        if held:
            t = pa.Table.from_batches(held).combine_chunks()
            out = _count(*[pa.concat_arrays(t[c].chunks) for c in ("text", "lang", "source")], done, seed, min_docs)
            if out is not None:
                yield out

    return _filled(docs).mapInArrow(count, COUNTED)


class _Rows:
    """Rows with a key each: (code, occurrences) entries and document numbers, end to end."""

    def __init__(self, key: np.ndarray, sources: pa.Array, docs: pa.Array):
        self.entries, sizes = self._unpack(sources, 16)
        self.docs, doc_sizes = self._unpack(docs, 8)
        self.entry_key, self.doc_key = np.repeat(key, sizes), np.repeat(key, doc_sizes)

    @staticmethod
    def _unpack(col: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
        _, offs, data = col.buffers()
        at = np.frombuffer(offs, np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
        flat = np.frombuffer(data, np.uint8)[at[0] : at[-1]].view(np.int64) if data is not None and at[-1] > at[0] else np.zeros(0, np.int64)
        return (flat.reshape(-1, 2) if width == 16 else flat), np.diff(at) // width

    def repeated(self, key_of: np.ndarray, new_key: np.ndarray, n_keys: int) -> None:
        """Hand every row on to the new keys that its key stands for: pairs (key_of, new_key), sorted by the first."""
        at = np.searchsorted(key_of, np.arange(n_keys + 1))
        for name in ("entry", "doc"):
            key = getattr(self, f"{name}_key")
            times = (at[1:] - at[:-1])[key]
            values = "entries" if name == "entry" else "docs"
            setattr(self, values, np.repeat(getattr(self, values), times, axis=0))
            setattr(self, f"{name}_key", new_key[ragged(at[:-1][key], times)])

    def merged(self, n_keys: int, min_docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Entries added up by key and source, their offsets by key; the least documents of each key, their offsets."""
        order = np.lexsort((self.entries[:, 0], self.entry_key))
        key, entries = self.entry_key[order], self.entries[order]
        start = _runs((key[1:] != key[:-1]) | (entries[1:, 0] != entries[:-1, 0])) if len(key) else np.zeros(0, np.int64)
        out = np.stack([entries[start, 0], np.add.reduceat(entries[:, 1], start) if len(start) else entries[:, 1]], axis=1)
        order = np.lexsort((self.docs, self.doc_key))
        doc_key, docs = self.doc_key[order], self.docs[order]
        new = np.ones(len(docs), bool)
        new[1:] = (doc_key[1:] != doc_key[:-1]) | (docs[1:] != docs[:-1])
        doc_key, docs = doc_key[new], docs[new]
        at, doc_starts = _first_of_runs(np.searchsorted(doc_key, np.arange(n_keys)), len(docs), min_docs)
        return out, np.searchsorted(key[start], np.arange(n_keys + 1)), docs[at], doc_starts


def _merge_sorted(batches: Iterator[pa.RecordBatch], min_docs: int, text: str) -> Iterator[pa.RecordBatch]:
    """Rows sorted by ``text`` and lang, one per key; the last key of a batch is held back until another key follows."""
    held = None
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([x for x in (held, pa.RecordBatch.from_arrays([column(b, c) for c in (text, "lang", "sources", "docs")], [text, "lang", "sources", "docs"])) if x is not None]).combine_chunks()
        names, langs = (pa.concat_arrays(t[c].chunks).dictionary_encode() for c in (text, "lang"))
        key = names.indices.to_numpy().astype(np.int64) * len(langs.dictionary) + langs.indices.to_numpy()
        start = _runs(key[1:] != key[:-1])
        rows = _Rows(np.repeat(np.arange(len(start)), np.diff(np.append(start, len(key)))), *[pa.concat_arrays(t[c].chunks) for c in ("sources", "docs")])
        entries, starts, docs, doc_starts = rows.merged(len(start), min_docs)
        out = pa.RecordBatch.from_arrays([t[text].take(pa.array(start)).combine_chunks(), t["lang"].take(pa.array(start)).combine_chunks(), _binary(entries, starts, 16), _binary(docs, doc_starts, 8)], [text, "lang", "sources", "docs"])
        held = out.slice(out.num_rows - 1)
        if out.num_rows > 1:
            yield out.slice(0, out.num_rows - 1)
    if held is not None:
        yield held


def _terms_of(rows: pa.RecordBatch, min_docs: int) -> pa.RecordBatch | None:
    """Cut each chunk into its terms, which take over its counts; a term that occurs twice takes them twice."""
    texts = column(rows, "chunk").dictionary_encode()  # a chunk of several languages is cut once
    words = Words(texts.dictionary, LETTERS)
    if not len(words.codes):
        return None
    langs = column(rows, "lang").dictionary_encode()
    n_langs, n_terms = len(langs.dictionary), len(words.dictionary)
    chunk, lang = texts.indices.to_numpy().astype(np.int64), langs.indices.to_numpy().astype(np.int64)
    lengths = np.diff(words.offsets)[chunk]
    row = np.repeat(np.arange(len(chunk)), lengths)
    term = words.codes[ragged(words.offsets[:-1][chunk], lengths)].astype(np.int64)
    keys, new = np.unique(lang[row] * n_terms + term, return_inverse=True)
    held = _Rows(np.arange(len(chunk)), column(rows, "sources"), column(rows, "docs"))
    held.repeated(row, new, len(chunk))
    entries, starts, docs, doc_starts = held.merged(len(keys), min_docs)
    lang, term = np.divmod(keys, n_terms)
    return pa.RecordBatch.from_arrays([words.dictionary.take(pa.array(term)), langs.dictionary.take(pa.array(lang)), _binary(entries, starts, 16), _binary(docs, doc_starts, 8)], ["term", "lang", "sources", "docs"])


def kept_terms(docs: DataFrame, seed: int, min_docs: int = 3) -> DataFrame:
    """lang, term, codes and counts (arrays: occurrences by source) of the terms that ``min_docs`` documents hold."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _merge_sorted(batches, min_docs, "chunk"):
            if (out := _terms_of(rows, min_docs)) is not None:
                yield out

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _merge_sorted(batches, min_docs, "term"):
            rows = rows.filter(pc.equal(pc.binary_length(rows.column(3)), 8 * min_docs))
            entries, sizes = _Rows._unpack(rows.column(2), 16)
            starts = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
            lists = [pa.ListArray.from_arrays(starts, pa.array(np.ascontiguousarray(entries[:, i]))) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([rows.column(1), rows.column(0), *lists], ["lang", "term", "codes", "counts"])

    cutting = chunk_counts(docs, seed, min_docs).repartition("chunk").sortWithinPartitions("chunk", "lang").mapInArrow(cut, COUNTED.replace("chunk", "term"))
    return cutting.repartition("lang", "term").sortWithinPartitions("term", "lang").mapInArrow(keep, "lang string, term string, codes array<long>, counts array<long>")


def _share(count: Column, total: Column) -> Column:
    """1 + floor(SCALE * (count + 1) / total) by long division, so that no product leaves 64 bits."""
    whole = lambda a: F.call_function("div", a, total)
    out, rest = whole(count + 1), (count + 1) % total
    for _ in range(3):
        out, rest = out * 1000 + whole(rest * 1000), (rest * 1000) % total
    return out + 1


def _shares(counts: np.ndarray, total: np.ndarray) -> np.ndarray:
    """As ``_share``, of arrays."""
    out, rest = np.divmod(counts + 1, total)
    for _ in range(3):
        more, rest = np.divmod(rest * 1000, total)
        out = out * 1000 + more
    return out + 1


def _pair_sums(key, terms: pa.Table, sources: pa.Table) -> pa.Table:
    """Divergences of all ordered pairs of a language's sources over the terms of one shard."""
    codes = np.sort(sources["code"].to_numpy())
    order = np.argsort(sources["code"].to_numpy())
    totals = sources["total"].to_numpy()[order][:, None]
    sums = np.zeros((len(codes), len(codes)), np.int64)
    n = terms.num_rows
    step = max(1, CELLS // max(1, len(codes)))
    for at in range(0, n, step):
        part = terms.slice(at, step).combine_chunks()
        lists, counts = (pa.concat_arrays(part[c].chunks) for c in ("codes", "counts"))
        sizes = np.diff(lists.offsets.to_numpy())
        block = np.zeros((len(codes), part.num_rows), np.int64)
        block[np.searchsorted(codes, lists.flatten().to_numpy()), np.repeat(np.arange(part.num_rows), sizes)] = counts.flatten().to_numpy()
        shares = _shares(block, totals)
        for i in range(len(codes)):
            gap = shares[i] - shares
            sums[i] += (gap * gap // shares).sum(axis=1)
    x, y = np.divmod(np.arange(len(codes) ** 2), max(1, len(codes)))
    apart = x != y
    x, y = x[apart], y[apart]
    return pa.table({"code": codes[x], "other": codes[y], "value": sums[x, y]})


def audit(docs: DataFrame, min_docs: int = 3, top: int = 200) -> DataFrame:
    """Rows of docs(text, lang, source): lang, source, part, item, value, rank. Part ``pair``: the divergence of a
    source's terms from each other source's; part ``term``: the ``top`` terms that a source uses more than its language."""
    sources, seed = sources_of(docs)
    kept = staged(kept_terms(docs, seed, min_docs), "terms")
    uses = kept.select("lang", "term", F.explode(F.arrays_zip("codes", "counts")).alias("u")).select("lang", "term", F.col("u.codes").alias("code"), F.col("u.counts").alias("n"))
    langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, n: a + n)).alias("lang_n"))
    by_source = uses.groupBy("code").agg(F.sum("n").alias("n"))
    totals = sources.join(by_source, "code", "left").join(langs, "lang", "left").select(
        "lang", "source", "code", (F.coalesce("n", F.lit(0)) + F.coalesce("v", F.lit(0))).alias("total"), F.coalesce("v", F.lit(0)).alias("v"), (F.coalesce("lang_n", F.lit(0)) + F.coalesce("v", F.lit(0))).alias("lang_total"))
    totals = staged(totals, "totals")

    q = _share(F.col("lang_n"), F.col("lang_total"))
    of_terms = kept.select("lang", "term", F.aggregate("counts", F.lit(0).cast("long"), lambda a, n: a + n).alias("lang_n"), F.explode(F.arrays_zip("codes", "counts")).alias("u"))
    of_terms = of_terms.select("lang", "term", "lang_n", F.col("u.codes").alias("code"), F.col("u.counts").alias("n")).join(totals.drop("lang"), "code")
    of_terms = of_terms.select("lang", "source", F.col("term").alias("item"), _share(F.col("n"), F.col("total")).alias("p"), q.alias("q")).where("p > q")
    of_terms = of_terms.select("lang", "source", F.lit("term").alias("part"), "item", F.call_function("div", (F.col("p") - F.col("q")) * (F.col("p") - F.col("q")), F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    of_terms = of_terms.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)

    entries = kept.agg(F.coalesce(F.sum(F.size("codes")), F.lit(0)).alias("n")).first()["n"]
    most = totals.groupBy("lang").count().agg(F.coalesce(F.max("count"), F.lit(0)).alias("n")).first()["n"]
    shards = 1 + entries // max(SHARD, most * most)
    dealt = kept.withColumn("shard", F.pmod(F.xxhash64("term"), F.lit(shards))).groupBy("lang", "shard")
    copies = totals.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long")))).groupBy("lang", "shard")
    pairs = dealt.cogroup(copies).applyInArrow(_pair_sums, "code long, other long, value long").groupBy("code", "other").agg(F.sum("value").alias("value"))
    named = sources.select(F.col("code").alias("other"), F.col("source").alias("item"))
    pairs = pairs.join(sources, "code").join(named, "other").select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    pairs = pairs.withColumn("rank", F.row_number().over(order))
    return pairs.unionByName(of_terms)
