"""The conversation trie against a brute-force version."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pytest

from kelpie.llm import convtrie


def brute(rows, group=100):
    convs = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            convs[c].append((turn is not None, turn or 0, role, hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest(), text))
    convs = {c: [(t[2], t[4]) for t in sorted(ts)] for c, ts in convs.items()}
    rebuilt = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        rebuilt[c] = convs.get(c - int(math.fmod(c, group)), [])[:h] + own[h:]
    members = collections.defaultdict(list)
    for c, ts in rebuilt.items():
        for d in range(len(ts) + 1):
            members[tuple(ts[:d])].append(c)
    kids = collections.Counter(p[:-1] for p in members if p)
    leaves, saved = collections.Counter(), collections.Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in kids
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1]) if p else 0
    ends = {p: ",".join(str(c) for c in sorted(m) if len(rebuilt[c]) == len(p)) for p, m in members.items()}
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p], hashlib.sha256(ends[p].encode()).hexdigest()) for p, m in members.items())


def found(spark, rows, **options):
    df = spark.createDataFrame([(*r, "kept", 7) for r in rows], "conv_id long, turn long, role string, text string, run string, n int")
    return sorted(map(tuple, convtrie.prefix_nodes(df, **options).collect()))


def odd_rows():
    rng = random.Random(11)
    rows = []
    for c in [*range(0, 40), *range(100, 130), *range(-5, 0), 250, 251, 307, 10**12 + 1]:
        for t in range(rng.choice([1, 1, 2, 3, 4, 7, 9])):
            rows.append((c, t, rng.choice(["user", "assistant", None]), rng.choice(["hi", "yes", "é😀", "", None])))
    rows += [(7, None, "user", "first"), (7, None, "system", "x"), (7, 0, "user", "tie"), (7, 0, "user", "tie"), (None, 0, "user", "nobody"), (101, 3, "user", "z" * 50_000), (100, 20, "", "tail")]
    return rows


@pytest.mark.parametrize("options", [{}, {"run": 2, "block_turns": 7}, {"run": 1, "block_turns": 1}, {"run": 4, "block_turns": 30}])
def test_equals_brute_force(spark, options):
    rows = odd_rows()
    assert found(spark, rows, **options) == brute(rows)


def test_long_conversations_and_copies(spark):
    rows = [(c, t, "user", f"t{t}") for c in range(60) for t in range(5)]  # copies
    rows += [(500 + c, t, "user", "same" if t < 150 or c == 0 else f"x{c}") for c in range(3) for t in range(200)]
    rows += [(600 + c, 0, "user", "hello") for c in range(30)] + [(600 + c, 1, "user", f"{c}") for c in range(30)]
    random.Random(1).shuffle(rows)
    assert found(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert found(spark, [(1, 1, "a", "b")][:0]) == [] and found(spark, [(None, 1, "a", "b")]) == []


def test_double_array():
    rng = np.random.default_rng(2)
    trie = convtrie.DoubleArray(3, 10)
    nodes, paths = np.arange(3), {0: (), 1: (), 2: ()}
    seen = {}
    for _ in range(6):
        parents, numbers = [], []
        for p in nodes[:40]:
            c = rng.choice(300, rng.choice([0, 1, 1, 2, 5, 90]), replace=False)
            parents += [p] * len(c)
            numbers += c.tolist()
        parents, numbers = np.array(parents, np.int64), np.array(numbers, np.int64)
        trie.add_level(parents, numbers)
        nodes = trie.step(parents, numbers)
        assert len(set(nodes.tolist()) | set(seen)) == len(nodes) + len(seen) and (trie.check[nodes] == parents).all()
        seen.update(zip(nodes.tolist(), zip(parents.tolist(), numbers.tolist())))
    for node, (p, c) in seen.items():
        assert trie.step(np.array([p]), np.array([c]))[0] == node
    known = set(seen.values())
    for p in list(paths) + list(seen):
        for c in (0, 17, 299, 5000):
            assert (trie.step(np.array([p]), np.array([c]))[0] == convtrie.ROOT) == ((p, c) not in known)
