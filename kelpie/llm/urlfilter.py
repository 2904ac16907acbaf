"""URL filters: rules on hosts and paths, and a naive Bayes model over segmented host names for the rest.

Host names are concatenated words (``freebets``). Word counts come from the text of all pages, from the parts of
hyphenated host labels (``free-bets``) and, once each, from the seed words. A run of letters is split where the product
of word probabilities is largest (unigram Viterbi). Lookups are a join: every substring of each *different* run is
joined with the word counts, so neither the counts nor the pages are gathered anywhere; a run's substrings, which
its length bounds, meet in one row, and the Viterbi pass is a small helper over that row.

A multinomial naive Bayes model then scores the host's words and the path's tokens together. It learns from all pages:
hosts with a seed word among their words are block, all others allow; words that come with seeds (``farm`` in
``spam-farm``) so get weights too. Counts and weights are tables, joined by token. All is worked out once per different
host and once per different path; pages join both. A page is blocked when its log odds are above 0.

Costs and weights are whole millionths, so sums don't depend on their order. Equal costs prefer the longer first word.

Rules (``net/``) have a host and a path. A rule fits its host and all subdomains where the path starts with the rule's;
of several the longest rule wins, of equally long ones that of the longer host. Each different host is joined with the
rules by its suffixes, so rules may be a large table; the rules of one host and its parents meet in one row.

Defined cases: a null URL, or one without ``://``, has empty host and path; so has ``x://``; null html has no words;
a long URL is judged whole; a run of over ``RUN_LETTERS`` letters (no host label may be so long) is one word; runs of
digits are the token ``0``; runs of characters beyond ASCII are one token each; without pages that have seeds all
pages are allowed; repeated rows are judged each; other columns are not read; an empty table gives an empty result.
Hosts and paths that a thousandth of the pages or more have, at most a thousand each, are joined by broadcast.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kelpie.llm._common import Words, column, staged

UPPER, LOWERED = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words whose hosts are the model's block examples.
SEEDS = ("ads", "adult", "bets", "casino", "jackpot", "lottery", "pills", "poker", "porn", "spam", "viagra", "xxx")
RUN_LETTERS = 63
#: Lower-cases A-Z and blanks every byte that is no ASCII letter.
ASCII_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 else 32 for b in range(256))
TAG = re.compile(rb"<[^>]*>")
RUNS = r"([a-z]+|[0-9]+|[^\x00-\x7F]+)"
#: Keys that one in so many pages has are hot.
HOT_SHARE = 1000
#: Bytes of html that a task counts at a time.
SLICE_BYTES = 16_000_000


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1), UPPER, LOWERED)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.locate("://", F.coalesce(url, F.lit("")))
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def _tokens(text: Column) -> Column:
    """Runs of letters, ``0`` for each run of digits, runs beyond ASCII."""
    return F.transform(F.regexp_extract_all(F.translate(text, UPPER, LOWERED), F.lit(RUNS)), lambda t: F.when(t.rlike("^[0-9]"), F.lit("0")).otherwise(t))


def word_counts(pages: DataFrame, hosts: DataFrame, seeds: Sequence[str]) -> DataFrame:
    """word and n over all pages; ``hosts``: host and n_pages."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            html, at = column(b, "html"), 0
            sizes = pc.fill_null(pc.binary_length(html), 0).to_pylist()
            while at < len(html):
                end, size = at, 0
                while end < len(html) and (end == at or size + sizes[end] <= SLICE_BYTES):
                    size, end = size + sizes[end], end + 1
                words = Words(pa.array([TAG.sub(b" ", x.as_buffer().to_pybytes()).translate(ASCII_LETTERS).decode() if x.is_valid else "" for x in html.slice(at, end - at)], pa.string()), ASCII_LETTERS)
                at = end
                if len(words.dictionary):
                    found = pc.value_counts(pa.array(words.codes))
                    yield pa.RecordBatch.from_arrays([words.dictionary.take(found.field(0)), found.field(1)], ["word", "n"])

    in_text = pages.select("html").mapInArrow(count, "word string, n long")
    compound = hosts.select(F.explode(F.split("host", r"\.")).alias("label"), "n_pages").where(F.col("label").contains("-"))
    in_hosts = compound.select(F.explode(F.regexp_extract_all("label", F.lit("([a-z]+)"))).alias("word"), F.col("n_pages").alias("n"))
    in_seeds = pages.sparkSession.createDataFrame([(w, 1) for w in seeds], "word string, n long")
    return in_text.unionByName(in_hosts).unionByName(in_seeds).groupBy("word").agg(F.sum("n").alias("n"))


def unknown_cost(total: int, length: int) -> int:
    """Millionths of the log of one over the probability of a word never seen: a tenth for each of its letters."""
    return math.floor(1e6 * (math.log(total) + length * math.log(10)) + 0.5)


def viterbi(run: str, known: dict[tuple[int, int], int], total: int) -> list[str]:
    """The cheapest split; ``known``: cost by start and length."""
    n = len(run)
    unknown = [unknown_cost(total, k) for k in range(n + 1)]
    best, step = [0] * (n + 1), [0] * n
    for i in range(n - 1, -1, -1):
        cost, back = min((known.get((i, k), unknown[k]) + best[i + k], -k) for k in range(1, n - i + 1))
        best[i], step[i] = cost, -back
    out, i = [], 0
    while i < n:
        out.append(run[i : i + step[i]])
        i += step[i]
    return out


def segment(runs: DataFrame, words: DataFrame) -> DataFrame:
    """Each row of runs(run), different runs of ASCII letters, with the list ``words`` that it is split into."""
    total = words.agg(F.sum("n").alias("n")).first()["n"] or 1
    short = runs.where(F.length("run") <= RUN_LETTERS)
    starts = short.select("run", F.explode(F.expr("sequence(1, length(run))")).alias("i")).select("run", "i", F.explode(F.expr("sequence(1, length(run) - i + 1)")).alias("k"))
    edges = starts.withColumn("word", F.expr("substring(run, i, k)")).join(words.where(F.length("word") <= RUN_LETTERS), "word")
    edges = edges.groupBy("run").agg(F.collect_list(F.struct((F.col("i") - 1).alias("i"), "k", F.round(F.log(F.lit(float(total)) / F.col("n")) * 1e6).cast("long").alias("cost"))).alias("edges"))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [viterbi(r, {(e["i"], e["k"]): e["cost"] for e in es or []}, total) if len(r) <= RUN_LETTERS else [r] for r, es in zip(column(b, "run").to_pylist(), column(b, "edges").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([column(b, "run"), pa.array(found, pa.list_(pa.string()))], ["run", "words"])

    return runs.join(edges, "run", "left").mapInArrow(split, "run string, words array<string>")


def segmented_hosts(hosts: DataFrame, words: DataFrame) -> DataFrame:
    """``hosts`` with the list ``tokens``: its runs in order, runs of letters split into words."""
    runs = hosts.select("host", F.posexplode(_tokens(F.col("host"))).alias("at", "run"))
    split = segment(runs.select("run").where(F.col("run").rlike("^[a-z]")).distinct(), words)
    found = runs.join(split, "run", "left").groupBy("host").agg(F.array_sort(F.collect_list(F.struct("at", F.coalesce("words", F.array("run")).alias("w")))).alias("parts"))
    return hosts.join(found.select("host", F.flatten(F.transform("parts", lambda x: x["w"])).alias("tokens")), "host", "left").withColumn("tokens", F.coalesce("tokens", F.array().cast("array<string>")))


def train(hosts: DataFrame, pages: DataFrame) -> tuple[DataFrame, int]:
    """token and weight (millionths of log odds of block) of hosts(host, n_pages, tokens, blocked) and pages(path,
    blocked), and the weight of the shares of pages."""
    block, allow = F.col("blocked"), ~F.col("blocked")
    n = hosts.agg(*[F.coalesce(F.sum(F.when(c, F.col("n_pages"))), F.lit(0)).alias(a) for c, a in ((block, "b"), (allow, "a"))]).first()
    of_hosts = hosts.select(F.explode("tokens").alias("token"), F.when(block, F.col("n_pages")).otherwise(0).alias("b"), F.when(allow, F.col("n_pages")).otherwise(0).alias("a"))
    of_paths = pages.select(F.explode(_tokens(F.col("path"))).alias("token"), block.cast("long").alias("b"), allow.cast("long").alias("a"))
    counts = staged(of_hosts.unionByName(of_paths).groupBy("token").agg(F.sum("b").alias("b"), F.sum("a").alias("a")), "tokens")
    t = counts.agg(F.count("*").alias("v"), F.coalesce(F.sum("b"), F.lit(0)).alias("b"), F.coalesce(F.sum("a"), F.lit(0)).alias("a")).first()
    odds = ((F.col("b") + 1) / F.lit(float(t["b"] + t["v"]))) / ((F.col("a") + 1) / F.lit(float(t["a"] + t["v"])))
    return counts.select("token", F.round(F.log(odds) * 1e6).cast("long").alias("weight")), round(math.log((n["b"] + 1) / (n["a"] + 1)) * 1e6)


def _per_page(pages: DataFrame, key: str, table: DataFrame, total: int) -> DataFrame:
    """``pages`` with the row of ``table`` for its key; the table has a row for each key, with its number of pages."""
    hot = table.where(F.col("n_pages") * HOT_SHARE >= total).drop("n_pages")  # HOT_SHARE rows at most
    rest = pages.join(F.broadcast(hot.select(key)), key, "left_anti").join(table.drop("n_pages"), key)
    return pages.join(F.broadcast(hot), key).unionByName(rest)


def _scores(texts: DataFrame, name: str, tokens: Column, weights: DataFrame) -> DataFrame:
    """``name`` and the sum of the weights of its tokens, where it has any."""
    return texts.select(name, F.explode(tokens).alias("token")).join(weights, "token").groupBy(name).agg(F.sum("weight").alias(f"{name}_score"))


def fitting(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """host and ``fits``: the rules of the host and its parents, the first to apply first; ``rules``: rule, verdict."""
    rules = rules.select("rule", "verdict", F.substring_index("rule", "/", 1).alias("suffix")).withColumn("from", F.expr("substring(rule, length(suffix) + 1)"))
    most = rules.agg(F.coalesce(F.max(F.length("suffix")), F.lit(0)).alias("n")).first()["n"]
    tail = F.split(F.expr(f"right(host, {most + 1})"), r"\.")
    suffixes = hosts.select("host", tail.alias("labels")).select("host", F.explode(F.expr("transform(sequence(1, size(labels)), i -> array_join(slice(labels, i, size(labels)), '.'))")).alias("suffix"))
    first = F.struct((-F.length("rule")).alias("a"), (-F.length("suffix")).alias("b"), "rule", "verdict", "from")
    return suffixes.join(rules, "suffix").groupBy("host").agg(F.array_sort(F.collect_list(first)).alias("fits"))


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]] | DataFrame, seeds: Sequence[str] = SEEDS) -> DataFrame:
    """page_id, host, path, rule, verdict, score (millionths of log odds) of pages(page_id, url, html). ``rules``:
    (verdict, rule) pairs, or a table of rule and verdict."""
    spark = pages.sparkSession
    if not isinstance(rules, DataFrame):
        rules = spark.createDataFrame([(r, v) for v, r in rules], "rule string, verdict string")
    parsed = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    hosts = staged(parsed.groupBy("host").agg(F.count("*").alias("n_pages")), "hosts")
    words = staged(word_counts(pages, hosts, seeds), "words")
    split = segmented_hosts(hosts, words).withColumn("blocked", F.arrays_overlap("tokens", F.lit(list(seeds))))
    split = staged(split, "split")
    total = split.agg(F.coalesce(F.sum("n_pages"), F.lit(0)).alias("n")).first()["n"]
    weights, prior = train(split, _per_page(parsed, "host", split.select("host", "n_pages", "blocked"), total))
    weights = staged(weights, "weights")
    per_host = split.select("host", "n_pages").join(_scores(split, "host", F.col("tokens"), weights), "host", "left").join(fitting(hosts, rules), "host", "left")
    paths = parsed.groupBy("path").agg(F.count("*").alias("n_pages"))
    per_path = paths.join(_scores(paths, "path", _tokens(F.col("path")), weights), "path", "left")
    found = _per_page(_per_page(parsed, "host", staged(per_host, "per_host"), total), "path", staged(per_path, "per_path"), total)
    fit = F.get(F.filter("fits", lambda r: F.startswith(F.col("path"), r["from"])), F.lit(0))
    score = F.lit(prior) + F.coalesce("host_score", F.lit(0)) + F.coalesce("path_score", F.lit(0))
    return found.select("page_id", "host", "path", fit.alias("fit"), score.alias("score")).select(
        "page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", F.when(F.col("score") > 0, "block").otherwise("allow")).alias("verdict"), "score")
