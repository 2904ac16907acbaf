"""Cost-balanced packing of documents into sequences of a fixed number of tokens.

A piece of n tokens costs n + n^2 / scale (linear layers plus attention). Documents are tokenised and packed
where they are read: a window of documents with at most ``window`` tokens (or one longer document) is packed
by itself, so nothing is shuffled and memory is bounded. Within a window sequences are as many as its tokens
fill; what is left over takes sequences of the powers of two of its binary form, which need no padding.
Documents go in descending order to the sequence of lowest cost with room left; a document that is longer than
the room is cut, and its rest goes on in turn. So no token is padding and costs differ little.

Defined cases: null or empty text has only the end id; a document longer than a sequence is cut; ties go to the
earlier row and the lower sequence; repeated rows are packed each by itself; an empty table gives no pieces.
"""

from __future__ import annotations

import heapq
import itertools
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from kelpie.llm._common import Words, column, ragged, text_bytes

#: Tokens packed together at most; bounds a task's memory.
WINDOW = 1_000_000
#: Words other than of a-z that a worker keeps encoded at most; then its cache starts anew.
CACHE = 200_000


def capacities(total: int, size: int) -> np.ndarray:
    """Room of the sequences that ``total`` tokens fill exactly: full ones, then powers of two."""
    full, rest = divmod(total, size)
    powers = [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]
    return np.array([size] * full + powers, np.int64)


def balance(lengths: np.ndarray, size: int, scale: float) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) for each piece."""
    room = capacities(int(lengths.sum()), size).tolist()
    cost = [(0.0, s) for s in range(len(room))]
    used = [0] * len(room)
    pieces = []
    for d in np.argsort(-lengths, kind="stable").tolist():
        start, left = 0, int(lengths[d])
        while left:
            c, s = heapq.heappop(cost)
            n = min(left, room[s])
            pieces.append((d, start, n, s, used[s]))
            used[s] += n
            room[s] -= n
            start += n
            left -= n
            if room[s]:
                heapq.heappush(cost, (c + n + n * n / scale, s))
    return pieces


class WordEncoder:
    """Ids of whole texts by encoding each different word of a batch once.

    The tokenizer lower-cases, drops white space, and keeps a run of letters apart from a run of these marks, so
    a text's ids are its words' ids end to end, and a word's are those of its letters and its closing marks. Words
    of a-z go through the same merges as byte ranks, many at a time: their last letter stands in upper case for
    the end of a word. Other words go through the tokenizer itself. ``encoder_of`` tries all this on probes first, and
    ``tests/llm`` holds it against encoding whole texts."""

    _WORD = re.compile(rb"([A-Za-z]+)([.,;:!?*$%&#]*)")

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task has one core
        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        ranks = {}
        self.is_end = np.zeros(max(vocabulary.values()) + 1, bool)
        for token, i in vocabulary.items():
            plain = token.removesuffix("</w>")
            if re.fullmatch("[a-z]+", plain):
                ranks[(plain[:-1] + plain[-1].upper() if plain != token else plain).encode()] = i
                self.is_end[i] = plain != token
        self.ranks = tiktoken.Encoding("letters", pat_str="[a-z]*[A-Z]", mergeable_ranks=ranks, special_tokens={})
        self.other: dict[bytes, list[int]] = {}

    def _encode_other(self, words: list[bytes]) -> list[list[int]]:
        new = [w for w in dict.fromkeys(words) if w not in self.other]
        if len(self.other) + len(new) > CACHE:
            self.other = {}
            new = list(dict.fromkeys(words))
        for lo in range(0, len(new), 10_000):
            part = new[lo : lo + 10_000]
            for w, e in zip(part, self.tokenizer.encode_batch_fast([w.decode() for w in part], add_special_tokens=False)):
                self.other[w] = e.ids
        return [self.other[w] for w in words]

    def words(self, names: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of the words, anywhere in one array, and each word's start and length there."""
        plain, cores, tails, rest = [], [], [], []
        for i, w in enumerate(names):
            if m := self._WORD.fullmatch(w):
                plain.append(i)
                cores.append(m[1])
                tails.append(m[2])
            else:
                rest.append(i)
        ends = list({t: None for t in tails})
        marks = self._encode_other(ends)
        which = {t: k for k, t in enumerate(ends)}
        joined = "".join([c[:-1].lower().decode() + c[-1:].upper().decode() for c in cores])
        core_ids = np.array(self.ranks.encode_ordinary(joined), np.uint32) if joined else np.zeros(0, np.uint32)
        last = np.flatnonzero(self.is_end[core_ids]) + 1
        core_length = np.diff(np.concatenate([[0], last]))
        if len(core_length) != len(cores):
            raise ValueError("the vocabulary doesn't end words as expected")
        mark_length = np.array([len(m) for m in marks], np.int64)
        mark_start = np.cumsum(mark_length) - mark_length
        mark_ids = np.array([i for m in marks for i in m], np.uint32)
        tail = np.fromiter((which[t] for t in tails), np.int64, len(tails))
        other = self._encode_other([names[i] for i in rest])
        lengths = np.zeros(len(names), np.int64)
        lengths[plain] = core_length + mark_length[tail]
        lengths[rest] = [len(o) for o in other]
        starts = np.cumsum(lengths) - lengths
        ids = np.zeros(int(lengths.sum()), np.uint32)
        ids[ragged(starts[plain], core_length)] = core_ids
        ids[ragged(starts[plain] + core_length, mark_length[tail])] = mark_ids[ragged(mark_start[tail], mark_length[tail])]
        ids[ragged(starts[rest], lengths[rest])] = np.fromiter(itertools.chain.from_iterable(other), np.uint32, int(lengths[rest].sum()))
        return ids, starts, lengths

    def encode(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids end to end, each text followed by ``end``, and the n + 1 offsets."""
        words = Words(texts, bytes(range(256)))
        ids, starts, lengths = self.words(words.dictionary.cast(pa.binary()).to_pylist())
        codes, offsets = words.codes, words.offsets
        n = lengths[codes]
        before = np.concatenate([[0], np.cumsum(n)])
        bounds = before[offsets] + np.arange(len(offsets))
        out = np.full(int(bounds[-1]), end, np.uint32)
        keep = np.ones(len(out), bool)
        keep[bounds[1:] - 1] = False
        out[keep] = ids[ragged(starts[codes], n)]
        return out, bounds


class TextEncoder:
    """Ids of whole texts by any tokenizer."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)

    def encode(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        ids, bounds = [], [0]
        for lo in range(0, len(texts), 100):
            part = [t or "" for t in texts.slice(lo, 100).to_pylist()]
            for e in self.tokenizer.encode_batch_fast(part, add_special_tokens=False):
                ids.append(np.array([*e.ids, end], np.uint32))
                bounds.append(bounds[-1] + len(e.ids) + 1)
        return np.concatenate([np.zeros(0, np.uint32), *ids]), np.array(bounds, np.int64)


#: Texts that tell whether a tokenizer works word by word.
PROBES = [
    "", " ", "a", "The quick BROWN fox, jumped over!! 13 lazy dogs...", "Straße élève Ñandú ÄÖÜ ß", "tab\tand\nnew line\r\n  blanks", "it's mother-in-law's (so-called) e.g. x_y a/b", "unbelievable internationalisation zzzzqqqxxx", "???!!! ,,, $5.00 100% #tag @you &amp; a*b", "日本語 текст ελληνικά 🙂 e\u0301", "A.B.C. a.b,c;d:e", "x" * 300,
]


def encoder_of(path: str) -> WordEncoder | TextEncoder:
    """The encoder by words where it gives what whole texts give on the probes, else the one by whole texts."""
    plain = TextEncoder(path)
    texts = pa.array(PROBES)
    try:
        fast = WordEncoder(path)
        same = all(np.array_equal(a, b) for a, b in zip(fast.encode(texts, 1), plain.encode(texts, 1)))
    except (ValueError, KeyError):  # not such a vocabulary
        return plain
    return fast if same else plain


def pack(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", size: int = 2048, end: int = 1, scale: float = 2048.0, window: int = WINDOW) -> DataFrame:
    """Per piece: key, start, length, ids_crc32 (of little-endian 32-bit ids), doc_tokens, sequence_id, offset."""
    names = [key, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    schema = f"`{key}` {docs.schema[key].dataType.simpleString()}, " + ", ".join(f"`{n}` long" for n in names[1:])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence, encoder = TaskContext.get().partitionId() << 40, None
        for b in batches:
            keys, texts = column(b, key), column(b, text)
            _, at = text_bytes(texts)
            lo = 0
            while lo < len(keys):  # by bytes, of which a token has one at least
                hi = max(lo + 1, int(np.searchsorted(at, at[lo] + 4 * window, "right")) - 1)
                encoder = encoder or encoder_of(tokenizer)  # a task's own, so that an idle worker keeps none
                ids, bounds = encoder.encode(texts.slice(lo, hi - lo), end)
                first = 0
                while first < hi - lo:
                    last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + window, "right")) - 1)
                    lengths = np.diff(bounds[first : last + 1])
                    pieces = np.array(balance(lengths, size, scale), np.int64).reshape(-1, 5)
                    d, start, length, seq, offset = pieces.T
                    begin = bounds[first + d] + start
                    crc = np.fromiter((zlib.crc32(ids[x : x + n].astype("<u4").tobytes()) for x, n in zip(begin.tolist(), length.tolist())), np.int64, len(d))
                    yield pa.RecordBatch.from_arrays([keys.take(pa.array(lo + first + d)), *map(pa.array, (start, length, crc, lengths[d], sequence + seq, offset))], names)
                    sequence += int(seq.max()) + 1 if len(seq) else 0
                    first = last
                lo = hi
            pa.default_memory_pool().release_unused()

    return docs.select(key, text).mapInArrow(run, schema)
