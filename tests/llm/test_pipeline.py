"""The pipeline's stages against a plain restatement on a small fixture."""

import random

import numpy as np
import pytest

import corpus_pipeline
from gridweave.llm.simhash import fingerprint, keep_one_each

from .helpers import DOCS, classes, docs, odd_docs, words
from .test_decontamination import brute as brute_hits
from .test_line_dedup import brute as brute_windows
from .test_near_dedup import brute_jaccard
from .test_tokens import ids_of

LANGS = {"aa": ["ka", "to", "mi", "ru"], "bb": ["sche", "eng", "urt", "pfi"]}


def sentence(rng, lang, n=12):
    return " ".join("".join(rng.choice(LANGS[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n)).capitalize() + "."


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(3)
    rows = []
    for i in range(60):
        lang = "aa" if i % 2 else "bb"
        rows.append([i, "\n".join(sentence(rng, lang) for _ in range(rng.randrange(2, 9))), lang])
    item = " ".join(words(rng, 14, 90)).replace("w", "ka")
    rows += [[60, "12345 !!", "aa"], [61, None, None], [62, rows[0][1], "bb"], [63, sentence(rng, "bb") + "\n" + rows[2][1], "bb"]]
    rows += [[64, rows[4][1].replace("\n", " "), "bb"], [65, rows[4][1].replace("\n", " ") + " " + sentence(rng, "bb", 1), "bb"], [66, rows[7][1] + " " + item + " " + sentence(rng, "aa"), "aa"]]
    folder = tmp_path_factory.mktemp("sf")
    df = spark.createDataFrame([(i, t, g, "s", len(t or "")) for i, t, g in rows], DOCS)
    df.repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), rows, item


def test_whole_run(spark, corpus):
    folder, rows, item = corpus
    df = spark.read.parquet(f"{folder}/documents.parquet")
    held, columns = df, df.columns
    stages = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        held = spark.createDataFrame(stage(spark, held, folder).collect(), df.schema)
        assert held.columns == columns
        stages[name] = {r.doc_id: r.text for r in held.collect()}
    texts = {i: t for i, t, _ in rows}
    # Language ID: only documents without letters go.
    assert set(stages["language ID"]) == set(texts) - {60, 61}
    # Line dedup: soundness, and whole copies go.
    order = sorted(stages["language ID"])
    every = {d: set().union(*w) for d, w in zip(order, brute_windows([texts[d] for d in order], 2))}
    lines = stages["line dedup"]
    for d in order:
        left = [x for i, x in enumerate(texts[d].split("\n")) if i not in every[d]]
        if d not in lines:
            assert not any(left)
        else:
            assert set(left) <= set(lines[d].split("\n")) and lines[d].count("\n") <= texts[d].count("\n")
    assert 62 not in lines
    # Near-duplicates: one of each class stays, the smallest.
    ids = sorted(lines)
    own = classes(len(ids), [(i, j) for i in range(len(ids)) for j in range(i) if brute_jaccard(lines[ids[i]].lower(), lines[ids[j]].lower()) >= 0.8])
    near = stages["SimHash near-dedup"]
    assert set(near) == {ids[i] for i in range(len(ids)) if own[i] == i} and 64 not in near
    # Decontamination: documents with a window of an item go, no others.
    clean = stages["benchmark decontamination"]
    assert set(clean) == {d for d, t in near.items() if not brute_hits(t, [(1, item)])[1]} and 66 in near and 66 not in clean
    # Packing: every token of every document that is left, once.
    got = corpus_pipeline.run(spark, folder).collect()
    sizes = {}
    for r in got:
        sizes[r.doc_id] = sizes.get(r.doc_id, 0) + r.length
    assert sizes == {d: len(ids_of(t)) + 1 for d, t in clean.items()}


def test_one_of_repeated_rows_stays(spark):
    rng = random.Random(1)
    a, b = " ".join(words(rng, 80)), " ".join(words(rng, 80))
    df = odd_docs(spark, [a, a, b, b, "c", None, ""], [4, 4, 9, 7, None, 1, 2])
    kept = keep_one_each(df)
    assert kept.columns == df.columns
    assert sorted((r[0] is None, r[0] or 0) for r in kept.collect()) == [(False, 1), (False, 4), (False, 7), (True, 0)]


def test_stages_on_empty_tables(spark, corpus):
    folder = corpus[0]
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs(spark, []), folder).collect() == [], name


def test_fingerprint_of_an_empty_text_is_zero():
    assert fingerprint(b"") == 0 and np.uint64(0) == 0
