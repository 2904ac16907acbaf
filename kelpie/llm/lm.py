"""Language-model scoring with sharded Elias-Fano n-gram tries.

The model is an interpolated bigram model with absolute discounting. A shard's trie has two levels: contexts,
sorted by hash, with exact counts; and for each context its successors, sorted, with quantised smoothed
probabilities (one byte, logarithmic). Word hashes, successor ids relative to their context (made monotone by
adding up the ranges) and the pointers from contexts to successors are Elias-Fano coded in one compact file per
shard, which the task that answers queries maps into memory. A query finds its context by successor search in the
first level, its successor by successor search within the context's range of the second.

1. Documents are dealt to chunks. A chunk sends each shard its different bigrams there once, with counts over the
   training documents: counts for the model and queries to it are one message.
2. A shard adds up the counts, builds its trie, and answers each chunk in the order of its message: counts and
   successor numbers of the contexts, one byte for each bigram.
3. Chunks read the answers in the same order and score their documents.

A context that is frequent in a bounded sample is spread over several shards by its successor; its partial
answers add up. So messages grow with the corpus, and no context or document gathers in one task.

P(w | v) = max(c(v, w) - D, 0) / c(v) + D * T(v) / c(v) * P(w), T: different successors; after an unknown word P(w).
P(w) = (c(w) - E) / N for known words, E * V / N for the class of all unknown words, E from the counts of counts.

Defined cases: null or empty text has only its end; words of training texts outside the held-out fold count, also in
copies; without any training text all words are unknown; repeated rows score alike; a long text is scored whole, with
the chunk of its row; words that tie among the frequent ones go by their hashes, which changes where pairs are counted
but no score; rows that are equal in id and text meet in one chunk; an empty table gives an empty result.
"""

from __future__ import annotations

import mmap
import tempfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kelpie.llm._common import Words, column, mix, partitions, ragged, staged

#: Reserved ids: the end of a text (a token) and its beginning (a context only).
END, BEGIN = np.uint64(1), np.uint64(2)
DISCOUNT = 0.75
#: Successors are known in their context by so many bits of their hash.
SUCCESSOR_BITS = 40
#: Sampled texts for the spread of frequent contexts; a context's share of tokens that one shard takes.
SAMPLE, SHARE = 2_000, 1 / 512
#: Bytes of an upper part between two samples of its number of ones.
STRIDE = 16
_STEPS = 254
_LEAST = -9.0  # log10 of the least probability that the code can tell


# ---------------------------------------------------------------- Elias-Fano


def ef_encode(values: np.ndarray, universe: int) -> bytes:
    """A monotone sequence of integers below ``universe``: low bits packed, high bits in unary, and how many ones lie
    before each ``STRIDE`` bytes of the latter."""
    n = len(values)
    low = max(0, int(universe // max(1, n)).bit_length() - 1)
    values = values.astype(np.uint64)
    high = (values >> np.uint64(low)).astype(np.int64) + np.arange(n)
    size = ((int(high[-1]) + 9) // 8 if n else 0) + STRIDE  # zeros follow, so that each bucket has an end
    size += -size % STRIDE
    upper = np.zeros(8 * size, np.uint8)
    upper[high] = 1
    lower = np.zeros((n * low + 7) // 8, np.uint8)
    for lo in range(0, n if low else 0, 1 << 20):  # a multiple of eight values, so of whole bytes
        part = values[lo : lo + (1 << 20)]
        packed = np.packbits(((part[:, None] >> np.arange(low, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little")
        lower[lo * low // 8 : lo * low // 8 + len(packed)] = packed
    ones = np.concatenate([[0], np.cumsum(upper.reshape(-1, 8 * STRIDE).sum(axis=1, dtype=np.int64))])[:-1]
    a, b, c = lower.tobytes(), np.packbits(upper, bitorder="little").tobytes(), ones.astype("<i8").tobytes()
    return np.array([n, low, len(a), len(b), len(c)], "<i8").tobytes() + a + b + c


class EliasFano:
    """Reads ``ef_encode`` from a buffer, such as a memory map, at an offset; nothing is decoded but what is asked."""

    def __init__(self, buffer, at: int = 0):
        self.n, self.low, a, b, c = np.frombuffer(buffer, "<i8", 5, at).tolist()
        self.lower = np.frombuffer(buffer, np.uint8, a, at + 40)
        self.upper = np.frombuffer(buffer, np.uint8, b, at + 40 + a).reshape(-1, STRIDE)
        self.ones = np.frombuffer(buffer, "<i8", c // 8, at + 40 + a + b)

    def _select(self, i: np.ndarray, bit: int) -> np.ndarray:
        """Positions of the i-th bits (from 0) of the value ``bit`` in the upper part, by the samples, then in a stride."""
        out = np.empty(len(i), np.int64)
        before = self.ones if bit else 8 * STRIDE * np.arange(len(self.ones)) - self.ones
        for lo in range(0, len(i), 100_000):
            want = i[lo : lo + 100_000]
            stride = np.searchsorted(before, want, "right") - 1
            held = self.upper[stride] if bit else ~self.upper[stride]
            upto = np.cumsum(_POP[held], axis=1, dtype=np.int32)
            rest = want - before[stride]
            byte = (upto <= rest[:, None]).sum(axis=1)
            row = np.arange(len(want))
            rest = rest - np.where(byte, upto[row, byte - 1], 0)
            out[lo : lo + 100_000] = 8 * (STRIDE * stride + byte) + _SELECT[held[row, byte], rest]
        return out

    def _low(self, i: np.ndarray) -> np.ndarray:
        out = np.zeros(len(i), np.uint64)
        first = i.astype(np.int64) * self.low
        for k in range((self.low + 14) // 8 if self.low else 0):
            at = (first >> 3) + k
            shift = 8 * k - (first & 7)
            b = self.lower[np.minimum(at, len(self.lower) - 1)].astype(np.uint64)
            out |= np.where(shift >= 0, b << np.maximum(shift, 0).astype(np.uint64), b >> np.maximum(-shift, 0).astype(np.uint64))
        return out & np.uint64((1 << self.low) - 1)

    def get(self, i: np.ndarray) -> np.ndarray:
        """Values at indices i."""
        i = np.asarray(i, np.int64)
        return ((self._select(i, 1) - i).astype(np.uint64) << np.uint64(self.low)) | self._low(i)

    def all(self) -> np.ndarray:
        return self.get(np.arange(self.n))

    def find(self, values: np.ndarray) -> np.ndarray:
        """Index of the first element equal to each value, -1 where there is none: successor search, in the bucket of
        the high bits by selected zeros, then by halving over the low bits."""
        values = np.asarray(values, np.uint64)
        high = (values >> np.uint64(self.low)).astype(np.int64)
        out = np.full(len(values), -1, np.int64)
        most = 8 * STRIDE * len(self.ones) - (int(self.ones[-1]) + int(_POP[self.upper[-1]].sum())) if self.n else 0  # zeros
        asked = np.flatnonzero((high >= 0) & (high < most))
        if not len(asked):
            return out
        h = high[asked]
        end = self._select(h, 0) - h
        begin = np.zeros(len(h), np.int64)
        begin[h > 0] = self._select(h[h > 0] - 1, 0) - h[h > 0] + 1
        wanted = values[asked] & np.uint64((1 << self.low) - 1)
        hi = end.copy()
        live = np.flatnonzero(begin < hi)
        while len(live):  # the first element of the bucket that is not less
            mid = (begin[live] + hi[live]) >> 1
            less = self._low(mid) < wanted[live]
            begin[live[less]] = mid[less] + 1
            hi[live[~less]] = mid[~less]
            live = live[begin[live] < hi[live]]
        inside = np.flatnonzero(begin < end)
        inside = inside[self._low(begin[inside]) == wanted[inside]]
        out[asked[inside]] = begin[inside]
        return out


_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")
_POP = _BITS.sum(axis=1).astype(np.uint8)
_SELECT = np.array([np.append(np.flatnonzero(r), [0] * (8 - int(r.sum()))) for r in _BITS], np.int64)


def quantise(p: np.ndarray) -> np.ndarray:
    """Codes 1 to 255 for probabilities, by equal steps of the logarithm."""
    return (1 + np.rint(np.clip(np.log10(p) / _LEAST, 0, 1) * _STEPS)).astype(np.uint8)


_DECODED = np.concatenate([[0.0], 10 ** (_LEAST * np.arange(_STEPS + 1) / _STEPS)])


# ---------------------------------------------------------------- tries


def build_trie(contexts: np.ndarray, counts: np.ndarray, owner: np.ndarray, successors: np.ndarray, pair_counts: np.ndarray, discount: float = DISCOUNT) -> bytes:
    """contexts: sorted 63-bit hashes with the counts of their tokens. owner, successors: context number and successor
    id of each pair, sorted; pair_counts > 0. The total of a context's pairs is what its codes are relative to."""
    total = np.bincount(owner, weights=pair_counts, minlength=len(contexts)).astype(np.int64)
    fanout = np.bincount(owner, minlength=len(contexts)).astype(np.int64)
    codes = quantise(np.maximum(pair_counts - discount, 1e-9) / np.maximum(total[owner], 1)) if len(owner) else np.zeros(0, np.uint8)
    relative = successors.astype(np.uint64) + (owner.astype(np.uint64) << np.uint64(SUCCESSOR_BITS))
    sums = lambda x: np.concatenate([[0], np.cumsum(x)])
    levels = [
        ef_encode(contexts, 1 << 63), ef_encode(sums(counts), int(counts.sum()) + 1), ef_encode(sums(total), int(total.sum()) + 1),
        ef_encode(sums(fanout), len(owner) + 1), ef_encode(relative, max(1, len(contexts)) << SUCCESSOR_BITS), codes.tobytes()]
    return np.array([len(x) for x in levels], "<i8").tobytes() + b"".join(levels)


class Trie:
    """A trie in a buffer, queried on its compact levels: counts, totals and pointers are running sums, so monotone."""

    def __init__(self, buffer):
        sizes = np.frombuffer(buffer, "<i8", 6)
        at = 48 + np.concatenate([[0], np.cumsum(sizes)])
        self.contexts, self._counts, self._totals, self._pointers, self.successors = (EliasFano(buffer, int(x)) for x in at[:5])
        self.codes = np.frombuffer(buffer, np.uint8, self.successors.n, int(at[5]))

    def context(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of contexts, -1 where unknown, by successor search in the first level."""
        return self.contexts.find(hashes)

    @staticmethod
    def _between(sums: EliasFano, context: np.ndarray) -> np.ndarray:
        known = np.maximum(context, 0)
        return np.where(context >= 0, (sums.get(known + 1) - sums.get(known)).astype(np.int64), 0)

    def counts(self, context: np.ndarray) -> np.ndarray:
        return self._between(self._counts, context)

    def totals(self, context: np.ndarray) -> np.ndarray:
        return self._between(self._totals, context)

    def fanout(self, context: np.ndarray) -> np.ndarray:
        return self._between(self._pointers, context)

    def code(self, context: np.ndarray, successor: np.ndarray) -> np.ndarray:
        """Codes of successors in known contexts, 0 where unseen. Ids grow by context, so the search for an id
        in its context's range is a successor search for the id relative to that context."""
        at = self.successors.find(successor.astype(np.uint64) + (np.maximum(context, 0).astype(np.uint64) << np.uint64(SUCCESSOR_BITS)))
        found = (at >= 0) & (context >= 0)
        out = np.zeros(len(context), np.uint8)
        out[found] = self.codes[at[found]]
        return out


# ---------------------------------------------------------------- messages


class Chunk:
    """The tokens of a chunk, its different contexts and bigrams, in an order that its texts alone decide."""

    def __init__(self, texts: pa.Array, train: np.ndarray, spread: dict[int, int]):
        w = Words(texts)
        counts = np.diff(w.offsets)
        n = len(counts)
        self.bounds = np.concatenate([[0], np.cumsum(counts + 1)])
        names = np.concatenate([w.hashes(), [END, BEGIN]]).astype(np.uint64)
        size = len(names)
        ids = np.full(int(self.bounds[-1]), size - 2, np.int64)
        ids[ragged(self.bounds[:-1], counts)] = w.codes
        order = np.argsort(names, kind="stable")
        self.names = names[order]
        place = np.empty(size, np.int64)
        place[order] = np.arange(size)
        self.tokens = place[ids]
        before = np.concatenate([[0], self.tokens[:-1]])
        before[self.bounds[:-1]] = place[size - 1]
        doc = np.repeat(np.arange(n), counts + 1)
        counted = train[doc].astype(np.int64)
        self.token_counts = np.bincount(self.tokens, weights=counted, minlength=size).astype(np.int64)
        pair = before * size + self.tokens
        by = np.argsort(pair, kind="stable")
        ordered = pair[by]
        first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(by) else np.zeros(0, np.int64)
        number = np.zeros(len(by), np.int64)
        number[first] = 1
        self.bigram_of = np.empty(len(by), np.int64)
        self.bigram_of[by] = np.cumsum(number) - 1
        self.left, self.right = ordered[first] // size, ordered[first] % size
        self.pair_counts = np.add.reduceat(counted[by], first) if len(first) else first
        # virtual contexts: a frequent word has several, by successor
        ways = np.ones(size, np.int64)
        for h, k in spread.items():
            at = np.searchsorted(self.names, np.uint64(h))
            if at < size and self.names[at] == np.uint64(h):
                ways[at] = k
        self.successor = (mix(self.names) >> np.uint64(64 - SUCCESSOR_BITS)).astype(np.int64)
        salt = self.successor[self.right] % ways[self.left]
        self.word = np.repeat(np.arange(size), ways)
        self.salt = ragged(np.zeros(size, np.int64), ways)
        self.virtual = mix(self.names[self.word] + self.salt.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        base = np.cumsum(ways) - ways
        self.context_of = base[self.left] + salt
        # the order of messages: contexts by hash, bigrams by context and successor
        self.order = np.argsort(self.virtual, kind="stable")
        rank = np.empty(len(self.order), np.int64)
        rank[self.order] = np.arange(len(self.order))
        self.pair_order = np.lexsort((self.successor[self.right], rank[self.context_of]))
        self.pair_rank = rank[self.context_of][self.pair_order]
        self.pair_lengths = np.bincount(self.pair_rank, minlength=len(self.order))

    def shards(self, n: int) -> np.ndarray:
        """The shard of each context, in message order."""
        return ((self.virtual[self.order] >> np.uint64(16)) % np.uint64(n)).astype(np.int64)

    def messages(self, n: int) -> Iterator[tuple[int, bytes]]:
        """For each shard: contexts, their counts (once a word, at salt 0), their numbers of bigrams; successor
        ids and counts of the bigrams."""
        shard = self.shards(n)
        word = self.word[self.order]
        counts = np.where(self.salt[self.order] == 0, self.token_counts[word], 0)
        virtual = self.virtual[self.order]
        successor = self.successor[self.right][self.pair_order]
        pairs = self.pair_counts[self.pair_order]
        pair_shard = shard[self.pair_rank]
        by, pby = np.argsort(shard, kind="stable"), np.argsort(pair_shard, kind="stable")
        cut, pcut = np.searchsorted(shard[by], np.arange(n + 1)), np.searchsorted(pair_shard[pby], np.arange(n + 1))
        for s in range(n):
            mine, own = by[cut[s] : cut[s + 1]], pby[pcut[s] : pcut[s + 1]]
            if len(mine):
                yield s, _pack(virtual[mine], counts[mine], self.pair_lengths[mine], successor[own], pairs[own])


def _pack(virtual, counts, lengths, successor, pairs) -> bytes:
    five = successor.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : SUCCESSOR_BITS // 8].tobytes()
    small = np.minimum(pairs, 255).astype(np.uint8)
    return b"".join([np.array([len(virtual), len(successor), int((pairs >= 255).sum())], "<i8").tobytes(), virtual.astype("<u8").tobytes(), counts.astype("<i8").tobytes(), lengths.astype("<i4").tobytes(), five, small.tobytes(), pairs[pairs >= 255].astype("<i8").tobytes()])


def _unpack(data: bytes) -> tuple[np.ndarray, ...]:
    c, p, large = np.frombuffer(data, "<i8", 3).tolist()
    at = 24
    virtual, counts, lengths = np.frombuffer(data, "<u8", c, at), np.frombuffer(data, "<i8", c, at + 8 * c), np.frombuffer(data, "<i4", c, at + 16 * c).astype(np.int64)
    at += 20 * c
    width = SUCCESSOR_BITS // 8
    wide = np.zeros((p, 8), np.uint8)
    wide[:, :width] = np.frombuffer(data, np.uint8, width * p, at).reshape(-1, width)
    at += width * p
    pairs = np.frombuffer(data, np.uint8, p, at).astype(np.int64)
    pairs[pairs == 255] = np.frombuffer(data, "<i8", large, at + p)
    return virtual, counts, lengths, wide.reshape(-1).view("<u8").astype(np.int64), pairs


_ANSWERS = "chunk int, shard int, data binary, tokens long, words long, once long, twice long"


def _answer(messages: pa.Table) -> pa.Table:
    """Builds a shard's trie from the counts in all messages, then answers each. The statistics of the shard
    (tokens, different words, those with one and with two) come with a row of chunk -1."""
    shard = messages["shard"][0].as_py()
    chunks, data = messages["chunk"].to_pylist(), messages["data"].to_pylist()
    del messages
    parts = [_unpack(d) for d in data]
    contexts, number = np.unique(np.concatenate([p[0] >> np.uint64(1) for p in parts]), return_inverse=True)
    counts = np.bincount(number, weights=np.concatenate([p[1] for p in parts]), minlength=len(contexts)).astype(np.int64)
    owner = np.repeat(number, np.concatenate([p[2] for p in parts])).astype(np.uint64)
    key = (owner << np.uint64(SUCCESSOR_BITS)) | np.concatenate([p[3] for p in parts]).astype(np.uint64)
    pairs = np.concatenate([p[4] for p in parts])
    del owner, number, parts
    seen = pairs > 0
    key, pairs = key[seen], pairs[seen]
    by = np.argsort(key, kind="stable")
    key, pairs = key[by], pairs[by]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    key = key[first]
    summed = np.add.reduceat(pairs, first) if len(first) else pairs
    trie_bytes = build_trie(contexts, counts, (key >> np.uint64(SUCCESSOR_BITS)).astype(np.int64), (key & np.uint64((1 << SUCCESSOR_BITS) - 1)).astype(np.int64), summed)
    known = counts[counts > 0]
    rows = [(-1, shard, None, int(known.sum()), len(known), int((known == 1).sum()), int((known == 2).sum()))]
    with tempfile.TemporaryFile() as f:  # the task's own, for the map alone: lost with the task, built again by the next
        f.write(trie_bytes)
        f.flush()
        del trie_bytes, contexts, counts, known, key, pairs, by, seen, first, summed  # from here on the mapped levels answer
        with mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ) as mapped:
            trie = Trie(mapped)
            for chunk, d in zip(chunks, data):
                virtual, _, lengths, successors, _ = _unpack(d)
                at = trie.context(virtual >> np.uint64(1))
                codes = trie.code(np.repeat(at, lengths), successors)
                told = [trie.counts(at), trie.totals(at), trie.fanout(at)]
                rows.append((chunk, shard, b"".join([np.array([len(at), len(codes)], "<i8").tobytes(), *(x.astype("<i8").tobytes() for x in told), codes.tobytes()]), 0, 0, 0, 0))
            del trie
    names = [x.split()[0] for x in _ANSWERS.split(", ")]
    kinds = [pa.int32(), pa.int32(), pa.binary(), *[pa.int64()] * 4]
    return pa.table([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def _score(chunk: Chunk, answers: dict[int, bytes], shards: int, stats: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Base score, model score and number of known tokens of each text of the chunk."""
    size, m = len(chunk.names), len(chunk.order)
    counts, totals, fans = (np.zeros(m, np.int64) for _ in range(3))
    codes = np.zeros(len(chunk.pair_order), np.uint8)
    shard = chunk.shards(shards)
    pair_shard = shard[chunk.pair_rank]
    by, pby = np.argsort(shard, kind="stable"), np.argsort(pair_shard, kind="stable")
    cut, pcut = np.searchsorted(shard[by], np.arange(shards + 1)), np.searchsorted(pair_shard[pby], np.arange(shards + 1))
    for s, data in answers.items():
        c, p = np.frombuffer(data, "<i8", 2).tolist()
        mine, own = by[cut[s] : cut[s + 1]], pby[pcut[s] : pcut[s + 1]]
        if (c, p) != (len(mine), len(own)):
            raise ValueError("an answer doesn't fit its chunk")
        counts[mine], totals[mine], fans[mine] = np.frombuffer(data, "<i8", 3 * c, 16).reshape(3, c)
        codes[own] = np.frombuffer(data, np.uint8, p, 16 + 24 * c)
    word = chunk.word[chunk.order]
    total = lambda x: np.bincount(word, weights=x, minlength=size)
    c, follow, kinds = total(counts), total(totals), total(fans)
    N, V = stats["tokens"], stats["words"]
    e = stats["once"] / max(1, stats["once"] + 2 * stats["twice"]) if stats["once"] else 0.5
    e = min(max(e, 0.05), 0.95)
    uni = np.where(c > 0, (c - e) / max(1, N), e * V / N if N else 1.0)
    pair_prob = np.zeros(len(codes))
    pair_prob[chunk.pair_order] = _DECODED[codes] * totals[chunk.pair_rank]
    left, right = chunk.left, chunk.right
    f = follow[left]
    prob = np.where(f > 0, pair_prob / np.maximum(f, 1) + DISCOUNT * kinds[left] / np.maximum(f, 1) * uni[right], uni[right])
    log_model = np.log10(np.maximum(prob, 1e-300))[chunk.bigram_of]
    log_base = np.log10((c + 1) / (N + 1 * (V + 1)))[chunk.tokens]
    known = (c > 0)[chunk.tokens]
    at = chunk.bounds[:-1]
    add = lambda x: np.add.reduceat(x, at) if len(at) else np.zeros(0)
    return add(log_base), add(log_model), add(known.astype(np.int64))


def _spread(docs: DataFrame, text: str, total: int) -> dict[int, int]:
    """Numbers of shards over which frequent contexts are spread; decided on a bounded sample, as it changes only
    where pairs are counted."""
    share = F.pmod(F.xxhash64(*[F.col(c) for c in docs.columns]), F.lit(1 << 30)) < int((1 << 30) * min(1.0, SAMPLE / max(1, total))) + 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            w = Words(column(b, text))
            times = np.bincount(w.codes, minlength=len(w.dictionary)).astype(np.int64)
            keep = times >= max(1, int(len(w.codes) * SHARE / 4))
            yield pa.RecordBatch.from_arrays([pa.array([*w.hashes()[keep].view(np.int64).tolist(), None], pa.int64()), pa.array([*times[keep].tolist(), len(w.codes)], pa.int64())], ["word", "times"])

    # a word rare in a batch isn't told of by it, which changes its share by a quarter of the bound at most; null: all words
    counted = docs.where(share).select(text).mapInArrow(count, "word long, times long").groupBy("word").agg(F.sum("times").alias("times"))
    rows = counted.orderBy(F.desc("times"), F.col("word").asc_nulls_first()).limit(1 + int(1 / SHARE)).collect()  # the first is all words
    return {r["word"] % (1 << 64): 1 + int(r["times"] / rows[0]["times"] / SHARE) for r in rows[1:] if r["times"] >= SHARE * rows[0]["times"]}


def score(docs: DataFrame, train: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, train, n_tokens, n_known, train_tokens, base_score (unigrams, one added to each count) and
    score (the model's log10 probability of the text). ``train`` says from which rows the model learns."""
    spark = docs.sparkSession
    n = 2 * partitions(spark)
    rows = docs.select(key, F.coalesce(F.col(text), F.lit("")).alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64(key, "text"), F.lit(n)).cast("int")).repartition(n, "chunk")
    spread = _spread(docs.select(key, text), text, docs.count())
    order = [(key, "ascending"), ("text", "ascending"), ("train", "ascending")]

    def ask(table: pa.Table) -> pa.Table:
        table = table.sort_by(order)
        chunk = Chunk(table["text"].combine_chunks(), np.asarray(table["train"].to_numpy(zero_copy_only=False), bool), spread)
        held = list(chunk.messages(n))
        number = table["chunk"][0].as_py()
        return pa.table({"chunk": pa.array([number] * len(held), pa.int32()), "shard": pa.array([s for s, _ in held], pa.int32()), "data": pa.array([d for _, d in held], pa.binary())})

    answers = staged(rows.groupBy("chunk").applyInArrow(ask, "chunk int, shard int, data binary").groupBy("shard").applyInArrow(_answer, _ANSWERS), "answers")
    stats = answers.where("chunk = -1").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tokens", "words", "once", "twice")]).first().asDict()
    names = [key, "train", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    schema = f"`{key}` {docs.schema[key].dataType.simpleString()}, train boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"

    def finish(table: pa.Table, told: pa.Table) -> pa.Table:
        table = table.sort_by(order)
        chunk = Chunk(table["text"].combine_chunks(), np.asarray(table["train"].to_numpy(zero_copy_only=False), bool), spread)
        base, model, known = _score(chunk, dict(zip(told["shard"].to_pylist(), told["data"].to_pylist())), n, stats)
        return pa.table([table[key], table["train"], pa.array(np.diff(chunk.bounds)), pa.array(known.astype(np.int64)), pa.array(np.full(len(base), stats["tokens"])), pa.array(base), pa.array(model)], names=names)

    replies = answers.where("chunk >= 0").select("chunk", "shard", "data")
    return rows.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(finish, schema)
