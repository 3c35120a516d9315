import hashlib
import re

import pytest

from gridweave.llm.exact_dedup import RunFilters, build_index, compact, exact_dedup, flush_runs, run_filters, seen_before

from .helpers import docs, odd_docs

TEXTS = ["a b", "ab", " a\tb ", None, "", " \n", "é x", "éx", "long " * 5000, "long" * 5000, "c", "a b", "a b"]
IDS = [5, 3, 9, 4, 4, 8, 1, 2, 30, 31, 40, 51, 50]


def brute(texts, ids):
    groups = {}
    for t, i in zip(texts, ids):
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i))
    return {k: (min(v)[1], len(v)) for k, v in groups.items()}


@pytest.mark.parametrize("digest_bytes,memtable", [(32, 200_000), (32, 2), (1, 3), (0, 3)])
def test_groups(spark, digest_bytes, memtable):
    want = brute(TEXTS, IDS)
    got = exact_dedup(odd_docs(spark, TEXTS, IDS), memtable, digest_bytes).collect()
    assert len(got) == len(TEXTS)
    by = {}
    for r in got:
        by.setdefault((r.keep_id, r.group_size), []).append(r)
    assert sorted((k[0], k[1]) for k in by) == sorted(want.values())
    for (_, size), rows in by.items():
        assert len(rows) == size and sum(r.kept for r in rows) == 1
    if digest_bytes == 32:
        assert {r.doc_id: r.digest.hex() for r in got}[5] == hashlib.sha256(b"ab").hexdigest()


def test_repeated_rows_and_null_ids(spark):
    got = exact_dedup(docs(spark, ["x", "x", "x", "y"], [7, 7, None, None])).collect()
    assert sorted((r.keep_id is None, r.group_size, r.kept) for r in got) == [(False, 3, False), (False, 3, False), (False, 3, True), (True, 1, True)]


def test_empty(spark):
    assert exact_dedup(docs(spark, [])).collect() == []


def test_levels_merge_in_any_order(spark):
    schema = "row long, doc_id long, digest binary, points long"
    rows = [(i, 100 - i, bytes([i % 7]), i % 3) for i in range(40)]
    parts = [flush_runs(spark.createDataFrame(rows[a::3], schema), 4) for a in range(3)]
    once = compact(parts[0].unionByName(parts[1]).unionByName(parts[2]))
    steps = compact(compact(parts[2].unionByName(parts[0])).unionByName(parts[1]))
    entries = ("digest", "points", "keep_id", "keep_row", "n")
    assert sorted(map(tuple, once.select(*entries).collect())) == sorted(map(tuple, steps.select(*entries).collect()))
    assert once.count() == 7 and once.selectExpr("sum(n) s").first().s == 40


def test_runs_are_sorted_and_disjoint(spark):
    texts = [f"text {i % 40}" for i in range(100)]
    index = build_index(docs(spark, texts, list(range(100))), 3)
    entries = [r for p in index.rdd.glom().collect() for r in p]
    runs = []
    for r in entries:
        runs.append([]) if r.footer else None
        runs[-1].append(r)
    assert len(entries) == 40 and sum(r.n for r in entries) == 100
    for run in runs:
        digests = [bytes(r.digest) for r in run]
        assert digests == sorted(set(digests)) and digests[-1] == bytes(run[0].footer.last)
        assert RunFilters([(digests[0], digests[-1], run[0].footer.filter)]).passing(digests).all()
    spans = sorted((bytes(run[0].digest), bytes(run[-1].digest)) for run in runs)
    assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))
    for r in entries:
        # Of equal texts of equal length the smallest identifier stays.
        assert r.keep_id == min(i for i in range(100) if hashlib.sha256(texts[i].replace(" ", "").encode()).digest() == bytes(r.digest))


def test_filters_keep_new_digests_out(spark):
    index = build_index(docs(spark, [f"old {i}" for i in range(500)], list(range(500))), 50)
    old, new = ([hashlib.sha256(f"{w}{i}".encode()).digest() for i in range(500)] for w in ("old", "new"))
    filters = run_filters(index, "filter")
    assert filters.passing(old).all() and filters.passing(new).mean() < 0.1
    assert not run_filters(index, "hits").passing(old).any()


@pytest.mark.parametrize("digest_bytes", [32, 1, 0])
def test_adding_a_batch(spark, digest_bytes):
    old = docs(spark, TEXTS, IDS)
    batch = ["ab ", None, "new", "é\tx", "new", "longer"]
    index = build_index(old, 3, digest_bytes)
    got = seen_before(index, old, odd_docs(spark, batch, list(range(100, 106))), digest_bytes).collect()
    known = brute(TEXTS, IDS)
    want = {100 + i: known.get(re.sub(r"[\x20\x09-\x0D]", "", t or ""), (None,))[0] for i, t in enumerate(batch)}
    assert {r.doc_id: r.known_id for r in got} == want and len(got) == len(batch)
    assert all(r.seen == (r.known_id is not None) for r in got)
    both = compact(index.unionByName(build_index(docs(spark, batch, list(range(100, 106))), 2, digest_bytes)), 4)
    assert both.selectExpr("sum(n) s").first().s == len(TEXTS) + len(batch)
    if digest_bytes == 32:
        assert {(r.keep_id, r.n) for r in both.collect()} == {v for v in brute(TEXTS + batch, IDS + list(range(100, 106))).values()}
    assert seen_before(index, old, docs(spark, []), digest_bytes).collect() == []
    empty = docs(spark, [])
    assert not any(r.seen for r in seen_before(build_index(empty), empty, old).collect())
