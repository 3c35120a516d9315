import random

import numpy as np
import pytest

import corpus_pipeline
from gridweave.llm.near_dedup import SHINGLE, fingerprinted, shingles, similar_roots, tables, wide_fingerprint, words_of

from .helpers import classes, docs, words


def brute_jaccard(a, b):
    a, b = ({tuple(t.split()[i : i + SHINGLE]) for i in range(max(1, len(t.split()) - SHINGLE + 1))} for t in (a, b))
    return len(a & b) / len(a | b)


def edited(rng, text, n):
    """n words replaced next to each other, so n + 4 shingles differ at most."""
    own = text.split()
    at = rng.randrange(len(own) - n)
    return " ".join(own[:at] + words(rng, n, 10**6) + own[at + n :])


def test_stage_against_brute_force(spark):
    rng = random.Random(6)
    texts = []
    for _ in range(25):
        text = " ".join(words(rng, 200))
        texts += [text, *(edited(rng, text, n) for n in (4, 9, 13, 17, 22, 40))]
    texts += ["one two", "ONE  two\n", "three", None, ""]
    n = len(texts)
    own = classes(n, [(i, j) for i in range(n) for j in range(i) if brute_jaccard((texts[i] or "").lower(), (texts[j] or "").lower()) >= 0.8])
    got = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs(spark, texts), "").collect()}
    assert got == {i for i in range(n) if own[i] == i}
    assert 30 < len(got) < n - 60


@pytest.mark.parametrize("part_rows", [8192, 9])
def test_one_dense_cluster(spark, part_rows):
    """Copies of one text, two words changed in each: all are linked, in parts of a group too."""
    rng = random.Random(8)
    text = " ".join(words(rng, 150))
    texts = [edited(rng, edited(rng, text, 1), 1) for _ in range(120)] + [" ".join(words(rng, 150)) for _ in range(20)]
    source = docs(spark, texts).selectExpr("doc_id doc", "xxhash64(text) h", "text")
    held = fingerprinted(source)
    roots = {r.node: r.root for r in similar_roots(held, source, "dense", part_rows=part_rows).collect()}
    node = {r.doc: r.fp for r in held.collect()}
    assert len({roots.get(node[i], node[i]) for i in range(120)}) == 1 and all(node[i] not in roots for i in range(120, 140))


def test_bits_that_differ():
    rng = random.Random(2)
    away = []
    for _ in range(60):
        text = " ".join(words(rng, 300))
        held = [shingles(words_of(t.encode())) for t in (text, edited(rng, text, 29))]
        (a, b), (c, d) = (wide_fingerprint(h) for h in held)
        away.append((a ^ c).bit_count() + (b ^ d).bit_count())
    assert 17 < np.mean(away) < 22 and max(away) <= 34


def test_choices_grow_with_the_input():
    got = [tables(n) for n in (0, 10**5, 10**7, 10**9)]
    assert all(x <= y for x, y in zip(got, got[1:])) and got[0][1] == 3
    assert all((1 - 0.83**bits) ** choices <= 1e-3 for choices, bits in got)
