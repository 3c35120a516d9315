import random

import numpy as np
import pytest

from gridweave.llm.language import fit, fit_languages, forward_backward, keep_known_language, language_spans, marginals, predict_languages, sample_labelled, split_words, text_scores

from .helpers import docs, odd_docs

SYLLABLES = {"aa": ["ka", "to", "mi", "ru"], "bb": ["sch", "eng", "ürt", "pf"], "cc": ["ció", "ndo", "ez", "aja"]}


def text(rng, lang, n=40):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 5))) for _ in range(n)).capitalize() + "."


def training(n=30):
    rng = random.Random(1)
    return [(text(rng, lang), lang) for _ in range(n) for lang in SYLLABLES]


@pytest.fixture(scope="module")
def model():
    return fit(training())


def log_sum(x, axis):
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)


@pytest.mark.parametrize("segment", [1, 7, 128])
def test_marginals_against_plain_recursion(segment):
    rng = np.random.default_rng(0)
    lengths = np.array([1, 30, 41, 2, 7, 14])
    e, moves, begin = rng.normal(size=(lengths.sum(), 3)) * 2, rng.normal(size=(3, 3)), rng.normal(size=3)
    want, at = [], 0
    for n in lengths:
        own = e[at : at + n]
        at += n
        a, b = np.zeros((n, 3)), np.zeros((n, 3))
        a[0] = begin + own[0]
        for i in range(1, n):
            a[i] = log_sum(a[i - 1][:, None] + moves, 0) + own[i]
        for i in range(n - 2, -1, -1):
            b[i] = log_sum(moves + own[i + 1] + b[i + 1], 1)
        p = np.exp(a + b - (a + b).max(axis=1, keepdims=True))
        want.append(p / p.sum(axis=1, keepdims=True))
    assert np.abs(marginals(e, lengths, moves, begin, segment) - np.concatenate(want)).max() < 1e-9


def test_transition_gradient_by_finite_differences():
    rng = np.random.default_rng(3)
    lengths = np.array([5, 1, 9])
    e, moves, begin = rng.normal(size=(15, 3)), rng.normal(size=(3, 3)), rng.normal(size=3)

    def log_partition(m):
        total, at = 0.0, 0
        for n in lengths:
            a = begin + e[at]
            for i in range(at + 1, at + n):
                a = log_sum(a[:, None] + m, 0) + e[i]
            at += n
            total += log_sum(a, 0)
        return total

    got = forward_backward(e, lengths, moves, begin, 9, True)[1]
    for i in range(3):
        for j in range(3):
            step = np.zeros((3, 3))
            step[i, j] = 1e-5
            assert got[i, j] == pytest.approx((log_partition(moves + step) - log_partition(moves - step)) / 2e-5, abs=1e-6)
    with pytest.raises(ValueError):
        forward_backward(e, lengths, moves, begin, 4, True)


def test_words():
    w = split_words(["Ab é1c", "", "日 x"])
    assert w.sizes.tolist() == [2, 1, 1, 1, 1] and w.text.tolist() == [0, 0, 0, 2, 2] and w.start.tolist() == [0, 3, 5, 0, 2]


def test_unseen_texts(model):
    rng = random.Random(99)
    cases = [(text(rng, lang, n), lang) for n in (3, 40, 3000) for lang in SYLLABLES]
    got, scores = text_scores(model, [t for t, _ in cases])
    assert got == [lang for _, lang in cases] and min(scores) > 0.8 and max(scores) <= 1


def test_code_switching(model):
    rng = random.Random(5)
    parts = [text(rng, "aa", 25), text(rng, "bb", 25), text(rng, "cc", 25)]
    spans = language_spans(model, " ".join(parts))
    assert [s[2] for s in spans] == ["aa", "bb", "cc"]
    assert abs(spans[0][1] - len(parts[0])) < 12 and language_spans(model, "123") == [] and language_spans(model, None) == []


def test_one_and_no_label():
    assert fit([]) is None
    assert text_scores(fit([("one two three four five", "xx")]), ["what", "1"]) == (["xx", "und"], [1.0, 0.0])


def test_prediction_is_by_text_alone(spark, model):
    rng = random.Random(3)
    texts = [text(rng, "aa"), text(rng, "bb"), None, "", "12 !?", text(rng, "cc", 20000), text(rng, "aa")]
    got = {r.doc_id: (r.lang_pred, r.score) for r in predict_languages(odd_docs(spark, texts), model).collect()}
    assert [got[i][0] for i in range(7)] == ["aa", "bb", "und", "und", "und", "cc", "aa"] and got[2][1] == 0
    kept = keep_known_language(odd_docs(spark, texts), model, 0.4)
    assert {r[0] for r in kept.collect()} == {0, 1, 5, 6} and kept.columns == odd_docs(spark, texts).columns
    assert predict_languages(docs(spark, []), None).collect() == []
    assert [r.lang_pred for r in predict_languages(docs(spark, ["word"]), None).collect()] == ["und"]


def test_sample_leaves_out_held_rows(spark):
    import zlib

    pairs = training(20)
    df = docs(spark, [t for t, _ in pairs], lang=[g for _, g in pairs[:-1]] + [None])
    got = sample_labelled(df, 1000)
    want = {(t, g) for i, (t, g) in enumerate(pairs[:-1]) if zlib.crc32(str(i).encode()) % 4 != 2}
    assert set(got) == want
    assert len(sample_labelled(df, 15)) <= 30


def test_held_out_labels_are_never_read(spark):
    import zlib

    pairs = training(8)
    held = [zlib.crc32(str(i).encode()) % 4 == 2 for i in range(len(pairs))]
    texts, langs = [t for t, _ in pairs], [g for _, g in pairs]
    other = ["zz" if h else g for h, g in zip(held, langs)]
    got = [[(r.doc_id, r.lang_pred, r.score) for r in predict_languages(df, fit_languages(df, 12)).orderBy("doc_id").collect()] for df in (docs(spark, texts, lang=langs), docs(spark, texts, lang=other))]
    assert any(held) and got[0] == got[1]


def test_held_out_accuracy(spark):
    from gridweave.llm.catalogue import op8_language_id

    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    rows = op8_language_id(spark, sf).collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == len(truth) and len(held) > 150
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.97
