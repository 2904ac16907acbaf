"""Edit-aware token counts.

Each document keeps its pre-tokens in leaves under a segment tree of sums (characters, tokens). An edit finds its
place by descending the tree, is pre-tokenised again from a boundary just before it (context that the pattern may
look at) until a boundary meets an old one, and only those pre-tokens are encoded; sums change along the paths of
the touched leaves.

Documents are independent: each is counted where it is read, nothing is shuffled. Edits are applied in order, each
to the result of those before; positions count code points.

Defined cases: null or empty text has no tokens; null edits are none; a start beyond the end appends, a deletion
beyond the end stops there, negative numbers count as zero, a null insertion as empty; repeated rows are counted each
by itself; a long text is one tree in the task that reads it; there are no ties, since no result depends on an order
of rows; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kelpie.llm._common import column

#: Fixed value: the published pattern that splits text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters after its end that a pre-token may depend on.
CONTEXT = 3
LEAF = 64
CACHE = 500_000
EDITS = "array<struct<start:long,remove:long,insert:string>>"


class Counter:
    """Tokens of a pre-token, each different one encoded once."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=r"(?s:.+)", mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(PATTERN)
        self.known: dict[str, int] = {}

    def __call__(self, piece: str) -> int:
        n = self.known.get(piece)
        if n is None:
            if len(self.known) >= CACHE:
                self.known.clear()
            n = self.known[piece] = len(self.encoding.encode_ordinary(piece))
        return n


@functools.lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


class CountedText:
    """A text with its pre-tokens in the leaves of a segment tree."""

    def __init__(self, text: str, count: Counter):
        self.text, self.count, self.reencoded = text, count, 0
        self._build(count.pattern.findall(text))

    def _build(self, pieces: list[str]) -> None:
        sizes, tokens = list(map(len, pieces)), list(map(self.count, pieces))
        self.sizes = [sizes[i : i + LEAF] for i in range(0, len(sizes), LEAF)] or [[]]
        self.tokens = [tokens[i : i + LEAF] for i in range(0, len(tokens), LEAF)] or [[]]
        self.width = 1 << (len(self.sizes) - 1).bit_length()
        self.tree = [(0, 0)] * (2 * self.width)
        for i in range(len(self.sizes)):
            self.tree[self.width + i] = (sum(self.sizes[i]), sum(self.tokens[i]))
        for i in range(self.width - 1, 0, -1):
            (a, b), (c, d) = self.tree[2 * i], self.tree[2 * i + 1]
            self.tree[i] = (a + c, b + d)

    @property
    def total(self) -> int:
        return self.tree[1][1]

    def _leaf(self, at: int) -> tuple[int, int]:
        """The leaf that holds character ``at`` and the leaf's first character; the last leaf for the end."""
        i, base = 1, 0
        while i < self.width:
            i *= 2
            if at >= base + self.tree[i][0] and self.tree[i + 1][0]:
                base += self.tree[i][0]
                i += 1
        return i - self.width, base

    def _update(self, leaf: int) -> None:
        i = self.width + leaf
        self.tree[i] = (sum(self.sizes[leaf]), sum(self.tokens[leaf]))
        while i > 1:
            i //= 2
            (a, b), (c, d) = self.tree[2 * i], self.tree[2 * i + 1]
            self.tree[i] = (a + c, b + d)

    def edit(self, start: int, remove: int, insert: str) -> None:
        start = min(max(start, 0), len(self.text))
        end = min(start + max(remove, 0), len(self.text))
        shift = len(insert) - (end - start)
        self.text = self.text[:start] + insert + self.text[end:]
        first, begin = self._leaf(max(0, start - CONTEXT))
        k = 0
        while k < len(self.sizes[first]) and begin + self.sizes[first][k] <= start - CONTEXT:
            begin += self.sizes[first][k]
            k += 1
        # old boundaries, walked in step with the new ones
        leaf, j, old = first, k, begin
        sizes, tokens = [], []
        done = begin
        met = False
        for m in self.count.pattern.finditer(self.text, begin):
            piece = m[0]
            sizes.append(len(piece))
            tokens.append(self.count(piece))
            done = m.end()
            self.reencoded += len(piece)
            if done - shift < end or done < start + len(insert):
                continue
            leaf, j, old = self._walk(leaf, j, old, done - shift)
            if old == done - shift:
                met = True
                break
        if not met:  # up to the end of the text
            leaf, j = len(self.sizes) - 1, len(self.sizes[-1])
        if leaf == first:
            self.sizes[first][k:j], self.tokens[first][k:j] = sizes, tokens
        else:
            self.sizes[first][k:], self.tokens[first][k:] = sizes, tokens
            for x in range(first + 1, leaf):
                self.sizes[x], self.tokens[x] = [], []
                self._update(x)
            del self.sizes[leaf][:j], self.tokens[leaf][:j]
            self._update(leaf)
        self._update(first)
        if len(self.sizes[first]) > 8 * LEAF:  # a large insertion: deal the leaves anew, without encoding
            flat, counts = [x for s in self.sizes for x in s], [x for s in self.tokens for x in s]
            self._rebuild(flat, counts)

    def _walk(self, leaf: int, j: int, old: int, to: int) -> tuple[int, int, int]:
        """Goes on over old pre-tokens until the boundary ``old`` is at least ``to``."""
        while old < to:
            if j < len(self.sizes[leaf]):
                old += self.sizes[leaf][j]
                j += 1
            elif leaf + 1 < len(self.sizes):
                leaf, j = leaf + 1, 0
            else:
                break
        return leaf, j, old

    def _rebuild(self, sizes: list[int], tokens: list[int]) -> None:
        self.sizes = [sizes[i : i + LEAF] for i in range(0, len(sizes), LEAF)] or [[]]
        self.tokens = [tokens[i : i + LEAF] for i in range(0, len(tokens), LEAF)] or [[]]
        self.width = 1 << (len(self.sizes) - 1).bit_length()
        self.tree = [(0, 0)] * (2 * self.width)
        for i in range(len(self.sizes)):
            self.tree[self.width + i] = (sum(self.sizes[i]), sum(self.tokens[i]))
        for i in range(self.width - 1, 0, -1):
            (a, b), (c, d) = self.tree[2 * i], self.tree[2 * i + 1]
            self.tree[i] = (a + c, b + d)


def edited_counts(docs: DataFrame, edits: Column, ranks: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, n_tokens, n_edits, n_tokens_edited, edited_chars (code points), reencoded_chars (code points
    of the pre-tokens that the edits made encode again). ``edits``: array of struct(start, remove, insert)."""
    kind = docs.schema[key].dataType.simpleString()
    names = [key, "n_tokens", "n_edits", "n_tokens_edited", "edited_chars", "reencoded_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[list[int]] = [[] for _ in names[1:]]
            for t, changes in zip(column(b, text).to_pylist(), column(b, "edits").to_pylist()):
                doc = CountedText(t or "", counter(ranks))
                before = doc.total
                for e in changes or ():
                    doc.edit(e["start"] or 0, e["remove"] or 0, e["insert"] or "")
                for col, v in zip(rows, (before, len(changes or ()), doc.total, len(doc.text), doc.reencoded)):
                    col.append(v)
            yield pa.RecordBatch.from_arrays([column(b, key), *(pa.array(c, pa.int64()) for c in rows)], names)

    rows = docs.select(key, text, edits.cast(EDITS).alias("edits"))
    return rows.mapInArrow(run, f"`{key}` {kind}, " + ", ".join(f"{n} long" for n in names[1:]))


def review_edits(text: Column) -> Column:
    """Three edits of a text for the query: a correction, an insertion and a deletion, placed by its length."""
    n = F.length(F.coalesce(text, F.lit(""))).cast("long")
    at = lambda start, remove, insert: F.struct(start.cast("long").alias("start"), F.lit(remove).cast("long").alias("remove"), F.lit(insert).alias("insert"))
    return F.array(at(F.floor(n / 4), 3, "Edited, "), at(F.floor(n / 2), 0, " it's new\n\n"), at(F.floor(3 * n / 4), 10, ""))
