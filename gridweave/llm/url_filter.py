"""URL filter: host and path rules, then the ratio of two character language models.

The models are smoothed variable-order Markov models over the characters of accepted and of
rejected URLs. Every context of up to ``order`` characters that occurs is kept, with all its
counts, so what the models gather grows with the input: the counts are tables, joined with the
grams of the URLs to judge, and nothing that grows is broadcast or sent to the driver.
Probabilities interpolate a context's counts with those of its next shorter context
(Witten-Bell). A URL's score is the difference of the two log-likelihoods over its number of
characters; the threshold is calibrated on labelled URLs that the models have not seen (a fifth,
by hash), at the least sum of both error rates. All counts are taken over all labelled rows.

Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: from
there up to ``?``, ``#`` or the end. A null URL or one without ``://`` has neither, and fits no
rule; it and a URL that ends at its ``://`` have nothing for the models to read: their score is zero
and they are allowed. Without labelled URLs of both classes, scores are null and what fits no rule
is allowed. A score at the threshold is allowed; scores are rounded to ``DIGITS`` digits, so the
order of summation can't turn a verdict. Rows are kept one for one, repeated rows included.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import in_batches, lower_az, pick, stash

ORDER = 5
_START = "\x02"
#: Characters of the alphabet that the order-0 model spreads over.
ALPHABET = 1 << 11
DIGITS = 10
#: Bins of the calibration histogram, and the range of scores that they cover.
BINS, RANGE = 4000, 8.0
#: Grams that make up this share of all occurrences or more are joined by broadcast: at most 1 / share of them exist.
HOT_SHARE = 1e-3


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


def rules(allow: list[str], block: list[str]) -> list[Rule]:
    """Rules from texts like ``example.com/en/``; longest first, block before allow in a tie."""
    out = [Rule(t.partition("/")[0], "/" + t.partition("/")[2], v) for v, texts in (("block", block), ("allow", allow)) for t in texts]
    return sorted(out, key=lambda r: -len(r.name))


def host_of(url: Column) -> Column:
    return F.when(url.contains("://"), lower_az(F.regexp_extract(url, r"^(?s).*?://([^/?#]*)", 1))).otherwise("")


def path_of(url: Column) -> Column:
    return F.when(url.contains("://"), F.regexp_extract(url, r"^(?s).*?://[^/?#]*([^?#]*)", 1)).otherwise("")


def rule_columns(host: Column, path: Column, all_rules: list[Rule]) -> tuple[Column, Column]:
    """The name and verdict of the longest rule that fits, or null."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in reversed(all_rules):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        name, verdict = F.when(fits, r.name).otherwise(name), F.when(fits, r.verdict).otherwise(verdict)
    return name, verdict


def _text(url: str | None) -> str:
    """What the models read: the URL without its scheme, in lower case."""
    at = (url or "").find("://")
    return "" if at < 0 else url[at + 3 :].lower()


def _grams(order: int, most: int = 100_000):
    """Rows (row, judge, accepted, url) as (row, judge, accepted, gram, n): each character with the order before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["row", "judge", "accepted", "gram", "n"]
        types = [pa.int64(), pa.bool_(), pa.bool_(), pa.string(), pa.int64()]
        held: list[list] = [[] for _ in names]

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(h, t) for h, t in zip(held, types)], names=names)

        for b in batches:
            for row, judge, accepted, url in zip(*(b.column(c).to_pylist() for c in ("row", "judge", "accepted", "url"))):
                t = _START * order + _text(url)
                seen = Counter([t[i - order : i + 1] for i in range(order, len(t))])
                for h, more in zip(held, ([row] * len(seen), [judge] * len(seen), [accepted] * len(seen), seen.keys(), seen.values())):
                    h.extend(more)
                if len(held[0]) >= most:
                    yield out()
                    held = [[] for _ in names]
        if held[0]:
            yield out()

    return run


def log_ratios(counts: DataFrame, order: int) -> DataFrame:
    """counts: gram of order + 1 characters, a and r (times seen in accepted and rejected URLs) and s (times to be
    judged). Per gram to be judged: the difference of its log-probabilities under both models.

    Order by order, the longest last: a context's total and number of kinds are sums over its
    grams, and a gram takes its shorter context's probability from the table before.
    """
    known = None
    for k in range(order + 1):
        gram = F.substring("gram", -(k + 1), k + 1)
        own = counts.groupBy(gram.alias("gram")).agg(*(F.sum(c).alias(c) for c in "ars"))
        context = Window.partitionBy(F.substring("gram", 1, k) if k else F.lit(0))
        for c in "ar":
            own = own.withColumn(f"n{c}", F.sum(c).over(context)).withColumn(f"k{c}", F.sum((F.col(c) > 0).cast("long")).over(context))
        own = own.where("s > 0")
        if known is None:
            own = own.withColumns({f"q{c}": F.lit(1.0 / ALPHABET) for c in "ar"})
        else:
            own = own.withColumn("shorter", F.substring("gram", 2, k)).join(known, "shorter")
        seen = {f"p{c}": F.when(F.col(f"n{c}") > 0, (F.col(c) + F.col(f"k{c}") * F.col(f"q{c}")) / (F.col(f"n{c}") + F.col(f"k{c}"))).otherwise(F.col(f"q{c}")) for c in "ar"}
        own = own.select("gram", "s", *(p.alias(n) for n, p in seen.items()))
        known = own.select(F.col("gram").alias("shorter"), F.col("pa").alias("qa"), F.col("pr").alias("qr"))
    return own.select("gram", "s", (F.log("pa") - F.log("pr")).alias("ratio"))


def score_urls(urls: DataFrame, order: int = ORDER, scope: str = "default") -> DataFrame | None:
    """urls: row (unique), url, accepted (null: unlabelled), learn and judge (booleans). Per row to be judged that
    has a text: row and score. None if a class has no URL to learn from."""
    read = urls.select("row", "judge", F.when(F.col("learn"), F.col("accepted")).alias("accepted"), "url").where("accepted is not null or judge")
    one = stash(read.transform(in_batches, _grams(order), "row long, judge boolean, accepted boolean, gram string, n long"), "url-grams", scope)
    times = lambda which: F.sum(F.when(which, F.col("n")).otherwise(0))
    counts = stash(one.groupBy("gram").agg(times(F.col("accepted")).alias("a"), times(~F.col("accepted")).alias("r"), times(F.col("judge")).alias("s")), "url-counts", scope)
    total = counts.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in "ars")).first()
    if not total.a or not total.r:
        return None
    ratios = stash(log_ratios(counts, order), "url-ratios", scope)
    hot = F.col("s") >= max(2, HOT_SHARE * total.s)
    frequent = F.broadcast(ratios.where(hot).select("gram", F.col("ratio").alias("known")))
    near = one.where("judge").select("row", "gram", "n").join(frequent, "gram", "left")
    rare = near.where("known is null").join(ratios.where(~hot).select("gram", "ratio").hint("merge"), "gram")
    parts = [near.where("known is not null").select("row", (F.col("n") * F.col("known")).alias("x"), "n"), rare.select("row", (F.col("n") * F.col("ratio")).alias("x"), "n")]
    return reduce(DataFrame.unionAll, (p.groupBy("row").agg(F.sum("x").alias("x"), F.sum("n").alias("n")) for p in parts)).groupBy("row").agg(F.round(F.sum("x") / F.sum("n"), DIGITS).alias("score"))


def threshold_of(scored: DataFrame) -> float:
    """scored: accepted and score of labelled URLs that taught nothing. The least score that is accepted: the
    middle one of the bin edges with the least sum of both error rates; 0 without URLs of both classes."""
    bins = F.least(F.greatest(F.floor((F.col("score") + RANGE / 2) * (BINS / RANGE)), F.lit(0)), F.lit(BINS - 1))
    histogram = scored.groupBy("accepted", bins.alias("bin")).agg(F.count("*").alias("n")).collect()  # at most 2 * BINS rows
    counts = np.zeros((2, BINS + 1))
    for r in histogram:
        counts[int(r.accepted), r.bin + 1] += r.n
    if not counts.sum(axis=1).all():
        return 0.0
    below = np.cumsum(counts, axis=1) / counts.sum(axis=1, keepdims=True)
    errors = np.round(below[1] + 1 - below[0], 12)
    best = np.flatnonzero(errors == errors.min())
    return float(best[len(best) // 2] * RANGE / BINS - RANGE / 2)


def filter_urls(pages: DataFrame, allow: list[str], block: list[str], labelled: DataFrame | None = None, order: int = ORDER, scope: str = "default") -> DataFrame:
    """page_id, url, host, path, rule, score (null without models), verdict: allow or block.

    Without ``labelled`` URLs (url, accepted), those that a rule decides teach the models.
    """
    all_rules = rules(allow, block)
    rows = pick(pages, "page_id", "url", page_id="long", url="string").withColumn("row", F.monotonically_increasing_id())
    rows = rows.withColumn("host", host_of(F.col("url"))).withColumn("path", F.coalesce(path_of(F.col("url")), F.lit(""))).withColumn("host", F.coalesce("host", F.lit("")))
    name, verdict = rule_columns(F.col("host"), F.col("path"), all_rules)
    rows = stash(rows.withColumn("rule", name).withColumn("decided", verdict), "url-rows", scope)
    if labelled is None:
        urls = rows.select("row", "url", (F.col("decided") == "allow").alias("accepted"), F.lit(True).alias("page"))
    else:
        taught = pick(labelled, "url", "accepted", url="string", accepted="boolean").where("url is not null and accepted is not null")
        taught = stash(taught.select((-1 - F.monotonically_increasing_id()).alias("row"), "url", "accepted", F.lit(False).alias("page")), "url-labels", scope)
        urls = rows.select("row", "url", F.lit(None).cast("boolean").alias("accepted"), F.lit(True).alias("page")).unionAll(taught)
    aside = F.pmod(F.xxhash64("url"), F.lit(5)) == 0
    marked = urls.where("url is not null").select("row", "url", "accepted", (F.col("accepted").isNotNull() & ~aside).alias("learn"), (F.col("page") | aside).alias("judge"))
    scores = score_urls(marked, order, scope)
    if scores is None:
        return rows.select("page_id", "url", "host", "path", "rule", F.lit(None).cast("double").alias("score"), F.coalesce("decided", F.lit("allow")).alias("verdict"))
    scores = stash(scores, "url-scores", scope)
    threshold = threshold_of(marked.where("accepted is not null and not learn").join(scores, "row"))
    by_model = F.when(F.col("score") < threshold, "block").otherwise("allow")
    return rows.join(scores, "row", "left").select("page_id", "url", "host", "path", "rule", F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("decided", by_model).alias("verdict"))
