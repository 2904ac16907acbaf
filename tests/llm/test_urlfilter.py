"""URL filters against a brute-force version, on odd URLs."""

import collections
import functools
import math
import random
import re

import pytest

from kelpie.llm import urlfilter

LOWER = str.maketrans(urlfilter.UPPER, urlfilter.LOWERED)
RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"), ("block", "b.com/aa"), ("allow", "com/aabb"), ("allow", "com/")]


def parse(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return host.translate(LOWER), re.match(r"[^?#]*", rest[len(host) :])[0]


def tokens(text):
    return ["0" if t[0] in "0123456789" else t for t in re.findall(r"[a-z]+|[0-9]+|[^\x00-\x7F]+", text.translate(LOWER))]


def brute(pages, rules, seeds):
    parsed = [(i, *parse(u)) for i, u, _ in pages]
    words = collections.Counter(seeds)
    for _, _, html in pages:
        words.update(re.findall("[a-z]+", re.sub("<[^>]*>", " ", html or "").translate(LOWER)))
    for _, host, _ in parsed:
        for label in host.split("."):
            if "-" in label:
                words.update(re.findall("[a-z]+", label))
    total = sum(words.values())

    @functools.cache
    def split(run):
        if not run:
            return 0, ()
        best = None
        for k in range(1, len(run) + 1):
            cost = math.floor(math.log(total / words[run[:k]]) * 1e6 + 0.5) if run[:k] in words else math.floor(1e6 * (math.log(total) + k * math.log(10)) + 0.5)
            more, after = split(run[k:])
            if best is None or cost + more <= best[0]:
                best = cost + more, (run[:k], *after)
        return best

    def host_tokens(host):
        return [w for t in tokens(host) for w in (split(t)[1] if "a" <= t[0] <= "z" and len(t) <= 63 else [t])]

    blocked = {h: bool(set(host_tokens(h)) & set(seeds)) for _, h, _ in parsed}
    count = {True: collections.Counter(), False: collections.Counter()}
    for _, h, p in parsed:
        count[blocked[h]].update(host_tokens(h) + tokens(p))
    v, n = len(count[True] | count[False]), {c: sum(count[c].values()) for c in count}
    weight = lambda t: round(math.log(((count[True][t] + 1) / (n[True] + v)) / ((count[False][t] + 1) / (n[False] + v))) * 1e6)
    pages_of = collections.Counter(blocked[h] for _, h, _ in parsed)
    prior = round(math.log((pages_of[True] + 1) / (pages_of[False] + 1)) * 1e6)
    out = []
    for i, h, p in parsed:
        score = prior + sum(map(weight, host_tokens(h) + tokens(p)))
        fits = [(len(r), len(r.split("/")[0]), r, x) for x, r in rules if (h == r.split("/")[0] or h.endswith("." + r.split("/")[0])) and p.startswith(r[r.index("/") :])]
        rule, verdict = max(fits)[2:] if fits else (None, "block" if score > 0 else "allow")
        out.append((i, h, p, rule, verdict, score))
    return out


PAGES = [
    (1, "http://free-bets.example.com/en/1.html?x#y", "<p>free lunch and bets</p>"), (2, "https://freebets.example.org/fr", "<b>Win</b> a casino"), (3, "HTTP://A.Example.NET/en/", None), (4, "http://net", ""), (5, "http://net/", "net"),
    (6, "nothing", "plain"), (7, None, None), (None, "x://", "x"), (8, "http://a.b.com/aabb/c", "the"), (9, "http://xb.com/aabb", "of"), (10, "http://example.com/de/7?b://c", "<"), (11, "a://b://c/d", ">"), (12, "http://h?q=1/2", "a<b>c</b>"),
    (13, "http://" + "ab" * 40 + ".casinowin99.org/" + "p/" * 3000, "win win"), (14, "http://bücher.example.org/fr/ä-ö", "ü"), (15, "http://.../", "."), (16, "http://u:p@example.net:80/en/", "t"), (1, "http://free-bets.example.com/en/1.html?x#y", "<p>free lunch and bets</p>"), (17, "http://" + ".a" * 500 + ".net/x", "a\nb"), (18, "http://line\nfeed.org/fr/\nz", "q")]


def frame(spark, pages):
    return spark.createDataFrame([(*p, "kept", 5) for p in pages], "page_id long, url string, html string, host string, n long")


@pytest.mark.parametrize("slice_bytes", [16_000_000, 5])
def test_equals_brute_force(spark, monkeypatch, slice_bytes):
    monkeypatch.setattr(urlfilter, "SLICE_BYTES", slice_bytes)
    rng = random.Random(7)
    more = [(100 + i, f"http://{''.join(rng.choices(['casino', 'win', 'free', 'the', 'news', 'spam', 'farm'], k=2))}{rng.choice(['', '7'])}.{rng.choice(['com', 'example.net', 'b.com', 'org'])}/{rng.choice(['en/', 'fr/', 'de/x', 'aabb', ''])}", "the news <i>win</i> free farm the") for i in range(60)]
    for pages in (PAGES + more, more[:5]):
        got = urlfilter.judge(frame(spark, pages), RULES).collect()
        key = lambda r: tuple(map(str, r))
        assert sorted(map(tuple, got), key=key) == sorted(brute(pages, RULES, urlfilter.SEEDS), key=key)


def test_concatenated_names_are_split_and_blocked(spark):
    text = "free casino games and win more the daily news paper of the town"
    pages = [(i, f"http://site{i}.example.org/a", text) for i in range(30)] + [(50, "http://freecasino.example.org/a", text), (51, "http://dailynews.example.org/a", text)]
    got = {r.page_id: r.verdict for r in urlfilter.judge(frame(spark, pages), []).collect()}
    assert got.pop(50) == "block" and set(got.values()) == {"allow"}


def test_rules_as_a_table_and_no_rows(spark):
    rules = spark.createDataFrame([("org/", "block")], "rule string, verdict string")
    assert [r.rule for r in urlfilter.judge(frame(spark, [(1, "http://a.org/", "")]), rules).collect()] == ["org/"]
    assert urlfilter.judge(frame(spark, PAGES).limit(0), RULES).count() == 0
