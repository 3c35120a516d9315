import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gridweave.llm.catalogue import op9_line_dedup
from gridweave.llm.line_dedup import line_report, repeated_lines

from .helpers import docs, words
from .test_line_dedup import brute, corpus


def test_single_lines_and_pairs_go(spark, tmp_path):
    import random

    rng = random.Random(2)
    long = " ".join(words(rng, 60))
    texts = [*corpus(3), f"a1\n{long}\na2", f"b1\n{long}\nb2", f"c1\n{long}", f"{long}\nd1\na1\na2"]
    df = docs(spark, texts)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    want = [set().union(*x) for x in brute(texts, 1)]
    got = {r.doc_id: {int(n) for n in r.deleted.split(",") if n} for r in op9_line_dedup(spark, str(tmp_path)).collect()}
    assert got == dict(enumerate(want)) and all(want[-3:])
    left = {r.doc_id: r.text for r in corpus_pipeline.lines(spark, df, "").collect()}
    assert left[len(texts) - 2] == "c1" and left[len(texts) - 1] == "d1"


@pytest.mark.parametrize("window", [2, 4, 7])
def test_both_passes_delete_exactly_what_occurred_before(spark, window):
    for seed in (4, 5):
        texts = corpus(seed, 40)
        want = [set().union(*x) for x in brute(texts, 1)]
        got = {r.doc_id: set(r.deleted) for r in line_report(docs(spark, texts), 1, window, short=True).collect()}
        assert got == dict(enumerate(want))


def test_each_pass_has_its_part(spark):
    """Runs of the guaranteed length come through fingerprints and extension alone; a single line whose
    neighbours hide it from them through the second pass."""
    long = [f"long {k}" for k in range(9)]
    texts = ["\n".join(["a", *long, "b"]), "\n".join(["c", *long, "d"]), "\n".join(f"e{k}" for k in range(30)), *(f"x{k}\ny{k}\ne{k}\nz{k}\nw{k}" for k in range(30))]
    count = lambda short: sum(r.n for r in repeated_lines(docs(spark, texts), 1, 4, short=short)[1].select(F.size("gone").alias("n")).collect())
    first, both = count(False), count(True)
    assert both == 39 and 9 <= first < both
    rows = {r.doc_id: r.deleted for r in line_report(docs(spark, texts), 1, 4).collect()}
    assert rows[1] == list(range(1, 10))


def test_long_texts_and_repeated_rows(spark):
    line = "a line of a very long text"
    texts = ["\n".join(f"{line} {k % 5000}" for k in range(30_000)), line + " 7", "\n".join(f"{line} {k}" for k in range(4000, 6000)), line + " 7"]
    got = {r.doc_id: r for r in line_report(docs(spark, texts, [1, 2, 3, 2]), 1, 4, short=True).collect()}
    assert got[1].n_deleted == 25_000 and got[2].n_deleted == 1 and got[3].deleted == list(range(1000))
