import random

import numpy as np
import pytest
import xxhash

from gridweave.llm.simhash import choose_blocks, fingerprint, near_links, simhash_dedup, trie_pairs
from gridweave.llm.components import connected_components

from .helpers import classes, docs, odd_docs, words


def plain_fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        text = text.replace(c, " ")
    w = [x for x in text.split(" ") if x]
    if not w:
        return 0
    grams = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprint():
    rng = random.Random(1)
    for n in (0, 1, 3, 4, 5, 200):
        t = " \n".join(words(rng, n)).upper()
        assert fingerprint(t.encode()) == plain_fingerprint(t)
    assert fingerprint(None) == fingerprint(b" \t\n") == 0
    assert fingerprint("A É b".encode()) == plain_fingerprint("A É b")


def test_spark_hash_agrees(spark):
    r = spark.sql("select xxhash64('a b c d') h").first().h
    assert r & (2**64 - 1) == xxhash.xxh64_intdigest(b"a b c d", 42)


def test_trie_pairs():
    rng = random.Random(3)
    keys = sorted({(x ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(7)))) & (2**64 - 1) for x in [rng.getrandbits(64) for _ in range(20)] * 20})
    a = np.array(keys, np.uint64)
    i, j = trie_pairs(a, [(0, len(a), 0, len(a))], 0, 4)
    want = {(x, y) for x in range(len(keys)) for y in range(x + 1, len(keys)) if (keys[x] ^ keys[y]).bit_count() <= 4}
    got = {(min(p), max(p)) for p in zip(i.tolist(), j.tolist())}
    assert got == want and len(want) > 100


def test_blocks_grow_with_the_input():
    got = [choose_blocks(n, 4, 1500) for n in (0, 10**5, 10**7, 10**9, 10**11)]
    assert got[0] == 5 and got == sorted(got) and got[-1] > 6


@pytest.mark.parametrize("group_rows,blocks", [(1500, None), (7, None), (1500, 6), (3, 7)])
def test_links_span_all_components(spark, group_rows, blocks):
    rng = random.Random(5)
    fps = [0, 2**64 - 1]
    for _ in range(30):
        x = rng.getrandbits(64)
        for _ in range(12):
            x ^= sum({1 << rng.randrange(64) for _ in range(rng.randrange(1, 6))})
            fps.append(x)
    fps = sorted({x - 2**64 if x >= 2**63 else x for x in fps})
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    links = [(r.u, r.v) for r in near_links(df, 4, group_rows, blocks).collect()]
    at = {x: i for i, x in enumerate(fps)}
    m = 2**64 - 1
    want = classes(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if ((fps[i] ^ fps[j]) & m).bit_count() <= 4])
    assert all((((u ^ v) & m).bit_count() <= 4) or want[at[u]] == want[at[v]] for u, v in links)
    assert classes(len(fps), [(at[u], at[v]) for u, v in links]) == want


def test_dedup_rows(spark):
    rng = random.Random(7)
    base = words(rng, 300)
    near = base[:150] + ["changed"] + base[151:]
    texts = [" ".join(base), " ".join(near), None, "", "one two", " ".join(words(rng, 250)), "ONE  two", " ".join(base) + "\n"]
    ids = [9, 4, 20, 21, 30, 40, 31, 9]
    got = simhash_dedup(odd_docs(spark, texts, ids)).collect()
    prints = [plain_fingerprint(t) for t in texts]
    n = len(texts)
    want = classes(n, [(i, j) for i in range(n) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4])
    least = {c: min(ids[i] for i in range(n) if want[i] == c) for c in want}
    assert sorted((r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in got) == sorted((ids[i], prints[i], least[want[i]]) for i in range(n))


def test_empty_and_null_ids(spark):
    assert simhash_dedup(docs(spark, [])).collect() == []
    got = simhash_dedup(docs(spark, ["a b", "a b", "c"], [None, 3, None])).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1) for r in got) == [(-1, -1), (-1, 3), (3, 3)]


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (7, 7)], "u long, v long")
    got = {r.node: r.root for r in connected_components(edges).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, 101: 100}
