import math
import random
import re

import pytest
from pyspark.sql import functions as F

from gridweave.llm import url_filter
from gridweave.llm.catalogue import ALLOW, BLOCK
from gridweave.llm.url_filter import ALPHABET, BINS, RANGE, filter_urls, log_ratios


def brute(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    best = None
    for verdict, texts in (("block", BLOCK), ("allow", ALLOW)):
        for t in texts:
            h, p = t.split("/", 1)
            if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(t) > len(best[0])):
                best = (t, verdict)
    return host, path, *(best or (None, None))


URLS = [None, "", "example.com/en/7", "http://example.com/en/71", "http://example.com/en/8", "https://WWW.Example.NET/de/8?x#y", "http://a.net/de/", "http://a.net/de", "http://net/de/x", "x://badexample.net/de/8", "http://a.org?/es/", "http://o.org/es/", "http://o.org#/es/", "://", "http:///path", "http://a.com/en/\nx", "http://com/en/" + "y" * 40000, "a://b://c.com/en/"]


def test_rules(spark):
    df = spark.createDataFrame([(i, u, "<p>", i) for i, u in enumerate(URLS)], "page_id long, url string, html string, host long")
    got = {r.page_id: r for r in filter_urls(df, ALLOW, BLOCK).collect()}
    for i, u in enumerate(URLS):
        host, path, rule, verdict = brute(u)
        r = got[i]
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == verdict if verdict else r.verdict in ("allow", "block")


def labelled(n=300):
    rng = random.Random(4)
    return [(f"http://news{rng.randrange(99)}.org/story/{rng.randrange(9999)}", True) if i % 2 else (f"http://x{rng.randrange(99)}.biz/win-casino-{rng.randrange(9999)}", False) for i in range(n)]


def test_models_tell_classes_apart(spark):
    train = spark.createDataFrame(labelled(), "url string, accepted boolean")
    pages = spark.createDataFrame([(1, "http://news7.org/story/1"), (2, "http://x7.biz/win-casino-3"), (3, None)], "page_id long, url string")
    got = {r.page_id: r for r in filter_urls(pages, [], [], train).collect()}
    assert got[1].verdict == "allow" and got[2].verdict == "block" and got[1].score > 0 > got[2].score and got[3].score == 0


class Model:
    """A class's counts, all contexts kept, and Witten-Bell probabilities, plainly."""

    def __init__(self, urls, order):
        self.order, self.next = order, {}
        for u in urls:
            t = "\x02" * order + read(u)
            for i in range(order, len(t)):
                for n in range(order + 1):
                    own = self.next.setdefault(t[i - n : i], {})
                    own[t[i]] = own.get(t[i], 0) + 1

    def probability(self, context, c):
        p = 1 / ALPHABET
        for k in range(len(context) + 1):
            own = self.next.get(context[len(context) - k :])
            if own:
                p = (own.get(c, 0) + len(own) * p) / (sum(own.values()) + len(own))
        return p

    def log_likelihood(self, text):
        t = "\x02" * self.order + text
        return sum(math.log(self.probability(t[i - self.order : i], t[i])) for i in range(self.order, len(t)))


def read(url):
    return url.split("://", 1)[1].lower() if url and "://" in url else ""


def plain(train, aside, urls, order):
    """Scores, threshold and verdicts of the models, without Spark."""
    good, bad = (Model([u for u, a in train if a == w and u not in aside], order) for w in (True, False))
    score = lambda u: round((good.log_likelihood(read(u)) - bad.log_likelihood(read(u))) / len(read(u)), 10) if read(u) else 0.0
    seen = [(score(u), a) for u, a in train if u in aside]
    edges = [k * RANGE / BINS - RANGE / 2 for k in range(BINS + 1)]
    errors = [round(sum(a and s < e for s, a in seen) / sum(a for _, a in seen) + sum(not a and s >= e for s, a in seen) / sum(not a for _, a in seen), 9) for e in edges]
    best = [e for e, x in zip(edges, errors) if x == min(errors)]
    return [(score(u), "block" if read(u) and score(u) < best[len(best) // 2] else "allow") for u in urls]


@pytest.mark.parametrize("order,share", [(3, 1e-3), (5, 1e-3), (2, 0.9)])
def test_scores_and_verdicts_against_brute_force(spark, monkeypatch, order, share):
    """Odd URLs, ties, repeated rows and characters that no class has seen; grams joined by broadcast or not."""
    monkeypatch.setattr(url_filter, "HOT_SHARE", share)
    rows = labelled(120) + [("http://é.org/Straße\U0001f600", True), ("http://é.biz/", False), ("http://a", True), ("http://a", False), ("http://", True)]
    train = spark.createDataFrame([*rows, (None, True), ("http://z", None)], "url string, accepted boolean")
    aside = {r.url for r in train.where("pmod(xxhash64(url), 5) = 0").collect()}
    urls = [u for u in URLS if len(u or "") < 1000] + [u for u, _ in rows[:20]] + ["http://new.org/x", "http://new.org/x", "http://\u4e16\u754c/", "http://b.biz/win" * 300]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").repartition(3)
    got = {r.page_id: r for r in filter_urls(pages, [], [], train, order).collect()}
    assert len(got) == len(urls)
    for i, (score, verdict) in enumerate(plain(rows, aside, urls, order)):
        assert abs(got[i].score - score) < 1e-8 and got[i].verdict == verdict, urls[i]


def test_models_of_rules_read_all_that_rules_decide(spark):
    """Without labels the URLs that a rule decides teach; all contexts are kept, once seen too."""
    rows = [(f"http://{h}/{p}{i}", h == "net") for i in range(40) for h, p in (("net", "de/"), ("com", "en/"))]
    urls = [u for u, _ in rows] + ["http://other.io/de/1", "http://other.io/en/39"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    aside = {r.url for r in pages.where("pmod(xxhash64(url), 5) = 0").collect()}
    got = {r.page_id: r for r in filter_urls(pages, ALLOW, BLOCK).collect()}
    want = plain(rows, aside, urls, 5)
    assert all(abs(got[i].score - w[0]) < 1e-8 for i, w in enumerate(want))
    assert all(got[i].verdict == want[i][1] for i in range(len(rows), len(urls)))


def test_ratios_of_known_counts(spark):
    """The difference of both models' log-probabilities, worked out by hand from the counts."""
    seen = [("ab", 3, 1), ("aa", 2, 0), ("cb", 1, 4)]
    asked = [("a" + c, 0, 0) for c in "abc"]
    counts = spark.createDataFrame([(g, a, r, 0) for g, a, r in seen] + [(g, a, r, 1) for g, a, r in asked], "gram string, a long, r long, s long").groupBy("gram").agg(*(F.sum(c).alias(c) for c in "ars"))
    got = {r.gram: r.ratio for r in log_ratios(counts, 1).collect()}
    base = {c: ((n + kinds / ALPHABET) / (total + kinds)) for c, n, total, kinds in (("a", 2, 6, 2), ("b", 4, 6, 2), ("c", 0, 6, 2))}
    left = {c: (n + 2 * base[c]) / 7 for c, n in (("a", 2), ("b", 3), ("c", 0))}
    other = {c: (n + 1 / ALPHABET) / 6 for c, n in (("a", 0), ("b", 5), ("c", 0))}
    right = {c: (n + 1 * other[c]) / 2 for c, n in (("a", 0), ("b", 1), ("c", 0))}
    assert set(got) == {"aa", "ab", "ac"} and all(abs(got["a" + c] - math.log(left[c] / right[c])) < 1e-12 for c in "abc")


def test_without_classes(spark):
    pages = spark.createDataFrame([(1, "http://a.b/c"), (None, None)], "page_id long, url string")
    assert {r.verdict for r in filter_urls(pages, ["a.b/"], []).collect()} == {"allow"}
    assert filter_urls(spark.createDataFrame([], "page_id long, url string"), ALLOW, BLOCK).collect() == []
