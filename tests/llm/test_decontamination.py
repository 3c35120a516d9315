import hashlib
import random
import re

import pytest

from gridweave.llm.decontamination import contamination_report, decontaminate, drop_contaminated

from .helpers import docs, odd_docs, words

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, items, window=10):
    w = split(text)
    hit, found = set(), set()
    for item, t in items:
        x = split(t)
        n = min(window, len(x))
        for i in range(len(x) - n + 1 if n else 0):
            for j in range(len(w) - n + 1):
                if w[j : j + n] == x[i : i + n]:
                    hit.update(range(j, j + n))
                    found.add(str(item))
    return len(w), len(hit), sorted(found)


def case():
    rng = random.Random(11)
    items = [(i, " ".join(words(rng, n, 40))) for i, n in ((3, 30), (10, 12), (2, 4), (5, 1), (7, 0), (8, 10))] + [(9, None), (20, "Same WORDS, é"), (21, "same words é")]
    texts = [None, "", "?!", "same  words-É same words é"]
    for _ in range(12):
        own = words(rng, 40, 200)
        _, t = items[rng.randrange(4)]
        own[20:20] = [x.upper() + "," for x in split(t)[rng.randrange(3) :]]
        texts.append(" ".join(own))
    return texts, items


@pytest.mark.parametrize("block_words", [1 << 20, 7])
def test_against_brute_force(spark, block_words):
    texts, items = case()
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate(odd_docs(spark, texts), bench, block_words=block_words)
    got = {r.doc_id: r for r in contamination_report(found).collect()}
    offsets = {r.doc_id: r.offsets for r in found.collect()}
    some = 0
    for i, t in enumerate(texts):
        n, hit, own = brute(t, items)
        r = got[i]
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (n, hit, len(own), hit > 0)
        assert r.items_sha256 == hashlib.sha256(",".join(own).encode()).hexdigest()
        assert sum(len(split(t[a:b])) for a, b in zip(offsets[i][::2], offsets[i][1::2])) == hit
        some += hit > 0
    assert 3 < some < len(texts)
    kept = {r.doc_id for r in drop_contaminated(odd_docs(spark, texts), bench, block_words=block_words).select("doc_id").collect()}
    assert kept == {i for i, t in enumerate(texts) if not brute(t, items)[1]}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate(docs(spark, []), none).collect() == []
    assert [r.contaminated for r in contamination_report(decontaminate(docs(spark, ["a b", None]), none)).collect()] == [False, False]
    assert drop_contaminated(docs(spark, ["a", None]), none).count() == 2
