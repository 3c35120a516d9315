"""Very long texts, hot groups, empty tables and clashing columns, for the operators whose own tests lack them."""

import random
import re
from collections import Counter

import pytest

import corpus_pipeline
from gridweave.llm import exact_dedup as ed
from gridweave.llm.catalogue import ALLOW, BLOCK, op2_url_filter
from gridweave.llm.decontamination import contamination_report, decontaminate
from gridweave.llm.simhash import simhash_dedup
from gridweave.llm.url_filter import filter_urls

from .helpers import docs, odd_docs, words
from .test_decontamination import brute as brute_hits
from .test_exact_dedup import brute as brute_groups
from .test_simhash import plain_fingerprint
from .test_url_filter import URLS
from .test_url_filter import brute as brute_url


def test_urls_with_clashing_columns_and_an_empty_table(spark, tmp_path):
    df = spark.createDataFrame([(i, u, "<p>") for i, u in enumerate(URLS)], "page_id long, url string, html string")
    for name in ("host", "path", "rule", "verdict", "score", "gram", "n", "row", "Url"):
        df = df.selectExpr("*", f"page_id AS `{name}`")
    got = {r.page_id: (r.host, r.path, r.rule) for r in filter_urls(df, ALLOW, BLOCK).select("page_id", "host", "path", "rule").collect()}
    assert got == {i: brute_url(u)[:3] for i, u in enumerate(URLS)}
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    found = op2_url_filter(spark, str(tmp_path))
    assert found.columns == ["page_id", "host", "path", "rule", "verdict", "score"] and found.collect() == []


def test_decontamination_of_a_very_long_text(spark):
    rng = random.Random(3)
    item = " ".join(words(rng, 14, 90))
    long = words(rng, 120_000, 4000)
    texts = [" ".join([*long[:-9], item]), " ".join(long), "x" * 300_000 + " " + item]
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items) for r in contamination_report(decontaminate(odd_docs(spark, texts), bench)).collect()}
    assert got == {0: (120_005, 14, 1), 1: (120_000, 0, 0), 2: (15, 14, 1)}
    assert brute_hits(texts[2], [(1, item)])[:2] == (15, 14)


def test_simhash_of_very_long_texts(spark):
    rng = random.Random(4)
    long = words(rng, 60_000)
    texts = [" ".join(long), " ".join([*long[:-1], "other"]), "y" * 400_000, " ".join(words(rng, 50_000))]
    got = {r.doc_id: (r.fp & (2**64 - 1), r.component_id) for r in simhash_dedup(docs(spark, texts)).collect()}
    assert {i: fp for i, (fp, _) in got.items()} == {i: plain_fingerprint(t) for i, t in enumerate(texts)}
    assert got[1][1] == 0 and got[2][1] == 2 and got[3][1] == 3


@pytest.mark.parametrize("share", [0.2, 1e-9, 2.0])
def test_hot_digests(spark, monkeypatch, share):
    """A third of all rows has one text: joined by broadcast above the share, by a shuffle below it."""
    monkeypatch.setattr(ed, "HOT", share)
    texts = [f"t{i}" if i % 3 else " hot text" + " " * (i % 5) for i in range(300)] + ["pair", "pa ir"] * 2
    ids = [7 * i % 304 for i in range(304)]
    want = Counter(brute_groups(texts, ids).values())
    got = ed.exact_dedup(docs(spark, texts, ids)).collect()
    assert Counter({k: 1 for k in want}) == Counter({(r.keep_id, r.group_size): 1 for r in got}) and len(got) == 304
    by_text = {i: re.sub(r"\s", "", t) for t, i in zip(texts, ids)}
    assert all(r.keep_id == brute_groups(texts, ids)[by_text[r.doc_id]][0] for r in got)


def test_pipeline_stages_with_a_very_long_text(spark, tmp_path):
    rng = random.Random(6)
    lines = [" ".join(words(rng, 12)) for _ in range(6000)]
    long = "\n".join(lines)
    near = "\n".join([*lines[:-3], "changed", *lines[-2:]]).replace("\n", " ")
    df = docs(spark, [long, lines[100] + "\nown line", near, " ".join(words(rng, 40))])
    kept = {r.doc_id: r.text for r in corpus_pipeline.lines(spark, df, "").collect()}
    assert kept[0] == long and kept[1] == "own line" and kept[2] == near
    left = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, df, "").collect()}
    assert left == {0, 1, 3}
