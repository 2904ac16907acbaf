"""Counterfactual-regularised toxicity classifier.

A sparse logistic model over the words of a text and their prefixes, present or not. Evidence adds up, and the
length of a text does not: weights are at least zero, but for those of identity terms, which may have either sign.
Features are 64-bit hashes without buckets, so a long text hits no toxic feature by chance.

Counterfactual pairing: in each labelled text that mentions a term, the term is swapped for every other of its kind,
and the squared change of the logit is penalised, so that naming a group does not by itself move the score. Kinds
are the lists of ``IDENTITIES`` and, as other corpora name groups otherwise, kinds learned from the labelled texts:
words that neutral texts use at least as often as toxic ones, though toxic ones use them more than their share, put
together by the number of their texts (``learned`` of them, ``KIND`` in a kind).

Learning takes a bounded sample of labelled rows (``max_rows``, by hash of the id), in Spark: feature counts per
class, then the features of each text; the driver gets only counts of the ``max_features`` best that ``min_texts``
toxic texts have, the sparse rows over them, and the different changes that swaps make. The intercept stays within
``SLACK`` of the base rate's logit, so that a text without evidence scores near the base rate and the evidence that
0.7 asks for doesn't depend on how certain the sample's clean texts are. Scoring reads whole texts and shuffles
nothing.

Defined cases: a null or empty text has no features and scores as the intercept says; labels that are null or of
unknown documents are passed over; with no positive label all scores are the base rate; repeated rows score alike; a
long text is scored whole, each of its features once; features that tie for the last places go by their hashes,
labelled rows by the hash of their id, then the id; an empty table gives an empty result of the same columns.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kelpie.llm._common import ALNUM, BATCH_BYTES, Words, column, discard, ragged, small_batches, staged, text_runs, unused

PREFIXES = (4, 5, 6)
#: Terms in a learned kind.
KIND = 4
#: How far below the logit of the base rate the intercept may go.
SLACK = 1.5
#: Identity terms by kind and language; a term may be swapped for any other of its list.
IDENTITIES = [
    ["women", "men", "girls", "boys"],
    ["muslims", "christians", "jews", "hindus", "buddhists", "atheists"],
    ["muslim", "christian", "jewish", "hindu", "buddhist", "atheist"],
    ["black", "white", "asian", "latino", "arab"],
    ["gay", "lesbian", "bisexual", "straight", "transgender"],
    ["immigrants", "refugees", "natives", "foreigners"],
    ["femmes", "hommes", "filles"],
    ["musulmans", "chrétiens", "juifs"],
    ["frauen", "männer", "mädchen"],
    ["muslime", "christen", "juden"],
    ["mujeres", "hombres", "chicas"],
    ["musulmanes", "cristianos", "judíos"],
]


def word_features(word: str) -> list[str]:
    """The word, marked as whole, and its prefixes."""
    return ["=" + word, *(word[:n] for n in PREFIXES if len(word) >= n)]


def hashed(feature: str) -> int:
    return xxhash.xxh3_64_intdigest(feature) - (1 << 63)


@dataclass
class Model:
    intercept: float
    weights: dict[int, float] = field(default_factory=dict)
    kinds: list[list[str]] = field(default_factory=list)


def _texts_features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Text number and word number of each different word of each text, and the words."""
    w = Words(texts, ALNUM)
    doc = np.repeat(np.arange(len(texts)), np.diff(w.offsets))
    pairs = np.unique(doc * np.int64(max(1, len(w.dictionary))) + w.codes)
    names = [x.lower() for x in w.dictionary.to_pylist()]
    n = max(1, len(names))
    return pairs // n, pairs % n, names


def _count_features(sample: DataFrame, text: str, toxic: str) -> DataFrame:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            labels, texts = np.asarray(column(b, toxic).to_numpy(zero_copy_only=False), np.int64), column(b, text)
            for lo in range(0, len(labels), 200):
                label = labels[lo : lo + 200]
                doc, word, names = _texts_features(texts.slice(lo, 200))
                ids = [[hashed(f) for f in word_features(x)] for x in names]
                size = np.array([len(x) for x in ids], np.int64)
                flat = np.array([x for y in ids for x in y], np.int64)
                whole = np.array([x[0] for x in ids], np.int64)
                begin = np.cumsum(size) - size
                f = flat[ragged(begin[word], size[word])]
                d = np.repeat(doc, size[word])
                order = np.lexsort((f, d))
                f, d = f[order], d[order]
                first = np.ones(len(f), bool)
                first[1:] = (f[1:] != f[:-1]) | (d[1:] != d[:-1])
                f, d = f[first], d[first]
                uniq, at = np.unique(f, return_inverse=True)
                pos = np.bincount(at, weights=label[d], minlength=len(uniq)).astype(np.int64)
                every = np.bincount(at, minlength=len(uniq))
                yield pa.RecordBatch.from_arrays([pa.array(uniq), pa.array(pos), pa.array(every - pos), pa.array(np.isin(uniq, whole))], ["feature", "pos", "neg", "whole"])

    found = sample.select(text, toxic).mapInArrow(count, "feature long, pos long, neg long, whole boolean")
    return found.groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.max("whole").alias("whole"))


def swapped(text: str, kinds: list[list[str]] = IDENTITIES) -> list[str]:
    """Counterfactuals of a text: each identity term it mentions, swapped for every other of its kind."""
    low = text.lower()
    out = []
    for kind in kinds:
        for term in kind:
            if re.search(rf"\b{term}\b", low):
                out += [re.sub(rf"\b{term}\b", other, low) for other in kind if other != term]
    return out


def _named(sample: DataFrame, text: str, wanted: set[int]) -> dict[int, str]:
    """The words of the wanted hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = {x.lower() for x in Words(column(b, text), ALNUM).dictionary.to_pylist()}
            found = {h: x for x in names if (h := hashed("=" + x)) in wanted}
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.string())], ["feature", "word"])

    return {r["feature"]: r["word"] for r in sample.select(text).mapInArrow(run, "feature long, word string").distinct().collect()} if wanted else {}


def _rows(sample: DataFrame, text: str, toxic: str, chosen: dict[int, int], kinds: list[list[str]]) -> DataFrame:
    """(toxic, features, pairs): chosen features present, and for each counterfactual those gained and lost."""
    kind_of = {t: kind for kind in kinds for t in kind}

    def of_word(w: str) -> list[int]:
        return [chosen[h] for f in word_features(w) if (h := hashed(f)) in chosen]

    terms = {t: frozenset(of_word(t)) for t in kind_of}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, labels = column(b, text), column(b, toxic).cast(pa.int64())
            for lo in range(0, len(texts), 200):
                doc, word, names = _texts_features(texts.slice(lo, 200))
                ids = [of_word(x) for x in names]
                mine: list[dict[int, int]] = [{} for _ in range(min(200, len(texts) - lo))]
                said: list[list[str]] = [[] for _ in mine]
                for d, w in zip(doc.tolist(), word.tolist()):
                    for f in ids[w]:
                        mine[d][f] = mine[d].get(f, 0) + 1
                    if names[w] in kind_of:
                        said[d].append(names[w])
                pairs = []
                for support, mentioned in zip(mine, said):
                    changes = []
                    for t in mentioned:
                        alone = {f for f in terms[t] if support[f] == 1}
                        for other in kind_of[t]:
                            gained, lost = {f for f in terms[other] if f not in support}, alone - terms[other]
                            if other != t and (gained or lost):
                                changes.append(sorted(f + 1 for f in gained) + sorted(-f - 1 for f in lost))
                    pairs.append(changes)
                yield pa.RecordBatch.from_arrays([labels.slice(lo, len(mine)), pa.array([sorted(m) for m in mine], pa.list_(pa.int64())), pa.array(pairs, pa.list_(pa.list_(pa.int64())))], ["toxic", "features", "pairs"])

    return sample.select(text, toxic).mapInArrow(run, "toxic long, features array<long>, pairs array<array<long>>")


def fit_rows(
    rows: list[tuple[int, list[int]]], pairs: list[list[int]], n_features: int, l1: float = 3e-6, pairing: float = 1.0, steps: int = 2500,
    times: list[int] | None = None, signed: frozenset[int] = frozenset()) -> tuple[float, np.ndarray]:
    """Intercept and weights by accelerated proximal gradient on log loss + l1 + pairing * mean squared logit change
    over the counterfactual pairs (each counted ``times``). Weights are at least zero, but for the ``signed``."""
    y = np.array([r[0] for r in rows], float)
    size = np.array([len(r[1]) for r in rows], np.int64)
    doc, col = np.repeat(np.arange(len(rows)), size), np.array([j for r in rows for j in r[1]], np.int64)
    p_row = np.array([i for i, p in enumerate(pairs) for _ in p], np.int64)
    p_col = np.array([abs(j) - 1 for p in pairs for j in p], np.int64)
    p_val = np.array([np.sign(j) for p in pairs for j in p], float)
    weight = np.array(times if times is not None else [1] * len(pairs), float)
    weight = 2 * pairing * weight / max(1.0, weight.sum())
    low = np.zeros(n_features)
    low[list(signed)] = -np.inf
    n = max(1, len(rows))
    rate = min(max(y.mean() if len(y) else 0.0, 1e-4), 1 - 1e-4)
    w, b = np.zeros(n_features), np.log(rate / (1 - rate))
    floor = b - SLACK
    vw, vb, t = w.copy(), b, 1.0
    # a bound of the curvature for each weight: in its texts, as many features as they have, and the intercept
    curve = 0.25 / n * np.bincount(col, weights=(size[doc] + 1.0), minlength=n_features)
    if len(pairs):
        width = np.array([len(p) for p in pairs], float)
        curve += np.bincount(p_col, weights=(weight * width)[p_row], minlength=n_features)
    step = 1 / np.maximum(curve, 1e-9)
    step_b = 1 / (0.25 / n * max(1.0, float((size + 1).sum())))
    for k in range(steps):
        z = np.bincount(doc, weights=vw[col], minlength=len(rows)) + vb
        g = (1 / (1 + np.exp(-np.clip(z, -35, 35))) - y) / n
        gw = np.bincount(col, weights=g[doc], minlength=n_features)
        if len(pairs):
            change = np.bincount(p_row, weights=vw[p_col] * p_val, minlength=len(pairs))
            gw += np.bincount(p_col, weights=(weight * change)[p_row] * p_val, minlength=n_features)
        moved = vw - step * gw
        nw, nb = np.maximum(np.sign(moved) * np.maximum(np.abs(moved) - step * l1, 0), low), max(vb - step_b * g.sum(), floor)
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        vw, vb = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b)
        moved = max(float(np.abs(nw - w).max(initial=0.0)), abs(nb - b))
        w, b, t = nw, nb, nt
        if k > 100 and moved < 1e-4:  # at rest
            break
    return float(b), w


def train(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", toxic: str = "toxic", where: Column | None = None, max_rows: int = 20_000, max_features: int = 4_000,
    min_texts: int = 3, learned: int = 160, pairing: float = 1.0) -> Model:
    """Learn from documents with a label for which ``where`` (over the key) holds, at most ``max_rows`` of them."""
    given = labels.select(key, F.col(toxic).cast("int").alias("toxic")).where(f"toxic is not null and {key} is not null")
    given = given.where(where) if where is not None else given
    given = given.groupBy(key).agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64(key), key).limit(max_rows)
    sample = docs.select(key, F.col(text).alias("text")).join(F.broadcast(given), key).repartition(12, key).select("text", "toxic")
    sample = staged(sample, "sample")  # of max_rows rows; read by three passes
    counts = staged(_count_features(sample, "text", "toxic"), "features")
    gain = F.col("pos") * F.log(F.col("pos") / (F.col("neg") + 0.5))
    # few of the texts of either class hold a feature that one class has by chance
    best = counts.where((F.col("pos") >= min_texts) & (F.col("pos") > F.col("neg"))).select("feature", gain.alias("gain")).orderBy(F.desc("gain"), "feature").limit(max_features).collect()
    share = given.agg(F.avg("toxic").alias("rate")).first()["rate"] or 0.0
    odd = F.col("pos") * F.log(F.col("pos") / ((F.col("pos") + F.col("neg")) * F.lit(max(share, 1e-9))))
    both = counts.where("whole and pos >= 5 and neg >= pos").select("feature", (F.col("pos") + F.col("neg")).alias("texts"), odd.alias("odd")).where("odd > 0")
    words = both.orderBy(F.desc("odd"), "feature").limit(learned).collect()
    names = _named(sample, "text", {r["feature"] for r in words})
    known = {t for kind in IDENTITIES for t in kind}
    by_use = [x for _, x in sorted((r["texts"], names[r["feature"]]) for r in words if r["feature"] in names) if x not in known]
    kinds = IDENTITIES + [kind for i in range(0, len(by_use), KIND) if len(kind := by_use[i : i + KIND]) > 1]
    chosen = {r["feature"]: i for i, r in enumerate(best)}
    for t in (t for kind in kinds for t in kind):
        chosen.setdefault(hashed("=" + t), len(chosen))
    signed = frozenset(chosen[hashed("=" + t)] for kind in kinds for t in kind)
    rows = staged(_rows(sample, "text", "toxic", chosen, kinds), "rows")
    pairs = rows.select(F.explode("pairs").alias("p")).groupBy("p").agg(F.count("*").alias("n")).orderBy("p").collect()  # a kind's few swaps, apart from prefixes shared
    b, w = fit_rows([(r["toxic"], r["features"]) for r in rows.select("toxic", "features").collect()], [r["p"] for r in pairs], len(chosen), pairing=pairing, times=[r["n"] for r in pairs], signed=signed)
    discard(sample, counts, rows)
    return Model(b, {f: float(w[i]) for f, i in chosen.items() if abs(w[i]) > 1e-3}, kinds)


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with the column ``out`` (0 to 1), from whole texts; an existing column of that name is an error."""
    if unused(docs, out) != out:
        raise ValueError(f"there is a column {out} already")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields) + f", `{out}` double"
    weights, intercept, names = model.weights, model.intercept, list(docs.columns)
    small_batches(docs.sparkSession)

    def logits(texts: pa.Array) -> np.ndarray:
        w = Words(texts, ALNUM)
        hits: list[list[int]] = []
        which = np.zeros(len(w.dictionary), bool)
        for i, x in enumerate(w.dictionary.to_pylist()):
            if found := [h for f in word_features(x.lower()) if (h := hashed(f)) in weights]:
                which[i] = True
                hits.append(found)
        number = np.cumsum(which) - 1
        at = np.flatnonzero(which[w.codes]) if len(w.codes) else np.zeros(0, np.int64)
        doc = np.searchsorted(w.offsets, at, "right") - 1
        present: dict[int, set[int]] = {}
        for d, n in zip(doc.tolist(), number[w.codes[at]].tolist()):
            present.setdefault(d, set()).update(hits[n])
        z = np.full(len(texts), intercept)
        for d, features in present.items():
            z[d] += sum(weights[f] for f in features)
        return z

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            z = np.concatenate([np.zeros(0), *(logits(t) for t in text_runs(column(b, text), BATCH_BYTES))])
            yield pa.RecordBatch.from_arrays([*(column(b, f) for f in names), pa.array(1 / (1 + np.exp(-z)))], [*names, out])

    return docs.mapInArrow(run, schema)
