"""Suffix arrays by two-stage sorting, for byte strings of bounded size held in one task.

First only suffixes smaller than their successors are sorted directly, by eight bytes at a time, up to a depth;
then the rest is induced by scanning the buckets of first bytes in order. Common prefixes are those of
neighbours in the array, to that depth.
"""

from __future__ import annotations

import numpy as np


def eight_bytes(text: np.ndarray, depth: int) -> np.ndarray:
    """Big-endian value of the eight bytes from each position on; zeros follow the text."""
    padded = np.zeros(len(text) + depth + 16, np.uint64)
    padded[: len(text)] = text
    one = padded
    two = (one[:-1] << np.uint64(8)) | one[1:]
    four = (two[:-2] << np.uint64(16)) | two[2:]
    return (four[:-4] << np.uint64(32)) | four[4:]


def smaller_than_successor(text: np.ndarray) -> np.ndarray:
    n = len(text)
    out = np.zeros(n, bool)
    if n < 2:
        return out
    differs = text[:-1] != text[1:]
    at = np.where(differs, np.arange(n - 1), n - 1)
    nearest = np.minimum.accumulate(at[::-1])[::-1]
    known = nearest < n - 1
    out[:-1][known] = text[nearest[known]] < text[nearest[known] + 1]
    return out


def _sort_directly(starts: np.ndarray, rank: np.ndarray, depth: int) -> np.ndarray:
    """``starts`` in the order of their suffixes, to ``depth`` bytes; rank orders eight bytes from a position on."""
    order = starts[np.argsort(rank[starts], kind="stable")]
    value = rank[order].astype(np.int64)
    group = np.cumsum(np.concatenate([[True], value[1:] != value[:-1]])) - 1
    at = 8
    tied = np.arange(len(order))
    while at < depth:
        same = np.zeros(len(tied), bool)
        g = group[tied]
        same[1:] = g[1:] == g[:-1]
        same[:-1] |= same[1:].copy() if len(tied) else False
        tied = tied[same]
        if not len(tied):
            break
        g = group[tied]
        key = (g << np.int64(32)) | rank[order[tied] + at]
        by = np.argsort(key, kind="stable")
        order[tied] = order[tied][by]
        key = key[by]
        step = np.concatenate([[False], key[1:] != key[:-1]])
        # a tie group that splits gets numbers of its own: the place of its first member
        first = np.maximum.accumulate(np.where(np.concatenate([[True], step[1:]]), np.arange(len(tied)), 0)) if len(tied) else tied
        group[tied] = tied[first]
        at += 8
    return order


def two_stage(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array to ``depth`` bytes, and the ranks of eight bytes from each position on."""
    n = len(text)
    if not n:
        return np.zeros(0, np.int64), np.zeros(depth + 8, np.int64)
    keys = eight_bytes(text, depth)
    rank = np.zeros(len(keys), np.int64)
    by = np.argsort(keys, kind="stable")
    ordered = keys[by]
    rank[by] = np.cumsum(np.concatenate([[0], ordered[1:] != ordered[:-1]]))
    small = smaller_than_successor(text)
    direct = _sort_directly(np.flatnonzero(small), rank, depth) if small.any() else np.zeros(0, np.int64)
    firsts = text[direct]
    direct_at = np.searchsorted(firsts, np.arange(257))
    induced: list[list[np.ndarray]] = [[] for _ in range(256)]
    induced[int(text[-1])].append(np.array([n - 1]))  # the last suffix has no successor
    out = []
    for c in range(256):
        wave = np.concatenate(induced[c]) if induced[c] else np.zeros(0, np.int64)
        parts = [wave]
        while len(wave):  # of the same first byte: in the order in which a scan would append them
            before = wave[wave > 0] - 1
            wave = before[(text[before] == c) & ~small[before]]
            parts.append(wave)
        parts.append(direct[direct_at[c] : direct_at[c + 1]])
        bucket = np.concatenate(parts)
        if not len(bucket):
            continue
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[(text[before] > c) & ~small[before]]
        if len(before):
            to = text[before]
            by = np.argsort(to, kind="stable")
            before, to = before[by], to[by]
            cuts = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]]))
            for lo, hi in zip(cuts.tolist(), [*cuts[1:].tolist(), len(to)]):
                induced[int(to[lo])].append(before[lo:hi])
    return np.concatenate(out), rank


def common_prefixes(array: np.ndarray, text: np.ndarray, rank: np.ndarray, depth: int) -> np.ndarray:
    """For each neighbour pair of ``array`` (positions in the text) the length of the common prefix, up to
    ``depth``."""
    a, b = array[:-1], array[1:]
    out = np.zeros(len(a), np.int64)
    live = np.arange(len(a))
    ends = np.concatenate([text, np.zeros(depth + 16, text.dtype)])
    at = 0
    while at < depth and len(live):
        equal = rank[a[live] + at] == rank[b[live] + at]
        rest = live[~equal]
        if len(rest):
            x, y = a[rest] + at, b[rest] + at
            going = np.ones(len(rest), bool)
            for k in range(8):
                going &= ends[x + k] == ends[y + k]
                out[rest] += going
        live = live[equal]
        out[live] += 8
        at += 8
    return np.minimum(np.minimum(out, depth), len(text) - np.maximum(a, b))
