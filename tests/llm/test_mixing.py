import random
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest

from gridweave.llm import mixing as m
from gridweave.llm.catalogue import op11_mixing

from .helpers import DOCS, words

BLOCK = 16


def test_permutations():
    for n in (1, 2, 3, 7, 64, 1000, 4097):
        x = m.permuted(np.arange(n), n, 12345)
        assert sorted(x.tolist()) == list(range(n))
        assert m.permuted(x, n, 12345, back=True).tolist() == list(range(n))
    assert m.permuted(np.arange(100), 100, 1).tolist() != m.permuted(np.arange(100), 100, 2).tolist()
    # No order is left: neighbours lie far apart.
    x = m.permuted(np.arange(10_000), 10_000, 7)
    assert abs(np.corrcoef(x[1:], x[:-1])[0, 1]) < 0.05


def test_targets():
    rng = random.Random(1)
    for _ in range(100):
        sizes = [rng.choice([0, 1, 10, 1000, 100_000]) * rng.randrange(1, 9) for _ in range(rng.randrange(1, 12))]
        weights = [(3, 1, 2)[i % 3] for i in range(len(sizes))]
        got = m.targets(sizes, weights, 1.5 * sum(sizes), 2)
        # The level of a water-filling, found by trying every set of full sources.
        left = Fraction(3, 2) * sum(sizes)
        order = sorted(range(len(sizes)), key=lambda i: Fraction(2 * sizes[i], weights[i]))
        want = [Fraction(0)] * len(sizes)
        for k, i in enumerate(order):
            level = left / sum(weights[j] for j in order[k:])
            want[i] = min(Fraction(2 * sizes[i]), level * weights[i])
            left -= want[i]
        assert got == pytest.approx([float(x) for x in want])


def test_slots_take_what_is_wanted():
    rng = random.Random(2)
    for _ in range(300):
        size, block = rng.randrange(1, 200), rng.choice([1, 7, 16])
        want = rng.randrange(2 * size + 1)
        count, last = m.slots_of(size, want, block, 3, 5)
        n = -(-size // block)
        taken = 0
        for k in range(count):
            at = int(m.permuted(np.array([k % n]), n, m._key(3, 5, k // n))[0])
            own = min(block, size - at * block)
            assert k < count - 1 or 0 < last <= own
            taken += last if k == count - 1 else own
        assert taken == want


def test_shards_add_up():
    counts = np.array([5000, 0, 17, 9001, 1], np.int64)
    shards = list(m.shard_counts(counts, 0, 4, 4096, 9))
    assert sum(own for *_, own in shards).tolist() == counts.tolist() and [int(own.sum()) for *_, own in shards] == [4096, 4096, 4096, 14019 - 3 * 4096]
    before = np.zeros(5, np.int64)
    for s, b, own in shards:
        assert b.tolist() == before.tolist() and [(x, y.tolist(), z.tolist()) for x, y, z in m.shard_counts(counts, s, s + 1, 4096, 9)] == [(s, b.tolist(), own.tolist())]
        before = before + own
    # Multinomial: near the share, not equal to it.
    assert 1200 < shards[0][2][0] < 1700
    big = np.array([3 * 10**12, 10**12], np.int64)
    left = m._halved(big, 2 * 10**12, np.random.default_rng(0))
    assert left.sum() == 2 * 10**12 and (left <= big).all()


def table(spark, rows, parts=3):
    return spark.createDataFrame([(i, t, "en", s, 0) for i, t, s in rows], DOCS).repartition(parts)


def corpus(seed=4, n=150):
    rng = random.Random(seed)
    rows = [(i, "  ".join(words(rng, rng.choice([1, 5, 40, 90]))) + rng.choice(["", "\n", "\x0b "]), "hot" if i % 3 == 0 else rng.choice(["b", "é", "Z", "\U0001f600", None])) for i in range(n)]
    rows += [(900, " ".join(words(rng, 20_000)), "Z"), (901, None, "b"), (902, "", "only empty"), (903, " \t\n", None), (None, "a b c", "hot"), (None, "a b", None), (5, rows[5][1], rows[5][2]), (5, rows[5][1], rows[5][2]), (7, "x\u00a0y z", "tiny")]
    return rows


def brute(rows, block, seed):
    """Every word of every slot, a source at a time."""
    by = defaultdict(list)
    for i, t, s in rows:
        by[s].append((i is None, i or 0, len((t or "").encode().split()), i))
    names = sorted(by, key=lambda s: (s is None, s or ""))
    sizes = [sum(x[2] for x in by[s]) for s in names]
    goals = m.targets(sizes, [(3, 1, 2)[k % 3] for k in range(len(names))], 1.5 * sum(sizes), 2)
    out = Counter()
    for k, s in enumerate(names):
        stream = [n for n, x in enumerate(sorted(by[s], key=lambda x: x[:3])) for _ in range(x[2])]
        taken, left, turn = Counter(), round(goals[k]), 0
        n = -(-sizes[k] // block)
        while left:
            for b in m.permuted(np.arange(n), n, m._key(seed, k, turn)).tolist():
                some = stream[b * block : (b + 1) * block][:left]
                taken.update(some)
                left -= len(some)
            turn += 1
        for j, x in enumerate(sorted(by[s], key=lambda x: x[:3])):
            out[x[3], x[2], sizes[k], round(goals[k], 6), taken[j]] += 1
    return out


def test_report_against_brute_force(spark):
    rows = corpus()
    runs = [Counter((r.doc_id, r.size, r.source_size, round(r.target, 6), r.taken) for r in m.Mix(table(spark, rows, parts), block=BLOCK).report().collect()) for parts in (3, 7)]
    assert runs[0] == runs[1] == brute(rows, BLOCK, 11)
    for _, size, _, _, taken in runs[0]:
        assert taken <= 2 * size


def test_texts_are_the_words_of_the_report(spark, tmp_path):
    rows = [r for r in corpus() if r[0] is not None and r[1] != "x"]
    mix = m.Mix(table(spark, rows), block=BLOCK)
    got = m.write_mix(mix, f"{tmp_path}/mix").collect()
    slots = {(r.shard, r.slot): r for r in mix.slots().collect()}
    assert len(got) == len(slots) and {r.slot for r in got} == {s for _, s in slots}
    want = Counter()
    texts = {(i, len((t or "").encode().split())): (t or "").encode().split() for i, t, _ in rows}
    docs = {r.row: r for r in mix.documents().collect()}
    by_slot = defaultdict(list)
    for r in mix.spans().collect():
        own = texts[r.doc_id, docs[r.row]["size"]][r.skip : r.skip + r.words]
        assert len(own) == r.words
        by_slot[r.slot].append((r["at"], own))
    for s, parts in by_slot.items():
        want[b" ".join(w for _, own in sorted(parts) for w in own).decode()] += 1
    assert Counter(r.text for r in got) == want


def test_query_and_empty_tables(spark, tmp_path):
    table(spark, corpus()).selectExpr("*", "doc_id AS size", "doc_id AS taken", "source AS start", "1 AS block").write.parquet(f"{tmp_path}/documents.parquet")
    got = op11_mixing(spark, str(tmp_path))
    assert got.columns == ["doc_id", "size", "source_size", "target", "taken"] and got.count() == len(corpus())
    assert m.Mix(table(spark, [])).report().collect() == [] and m.Mix(table(spark, [])).texts().collect() == []
    only = m.Mix(table(spark, [(1, None, "a"), (2, "", None)])).report().collect()
    assert [(r["size"], r.source_size, r.target, r.taken) for r in only] == [(0, 0, 0.0, 0)] * 2


def test_bad_arguments(spark):
    with pytest.raises(ValueError):
        m.Mix(table(spark, []), weights=(0,))
    with pytest.raises(ValueError):
        m.Mix(table(spark, []), share=3)
