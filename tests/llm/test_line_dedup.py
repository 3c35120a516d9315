import random

import numpy as np
import pytest

from gridweave.llm.line_dedup import drop_lines, extend, grams_of, line_dedup, line_report, winnow

from .helpers import docs, odd_docs


def content(text):
    return [(i, x) for i, x in enumerate((text or "").split("\n")) if x.strip()]


def brute(rows, least):
    """For every row, the windows of ``least`` lines that occurred before, as line numbers; rows
    in order of doc_id."""
    seen, out = set(), []
    for text in rows:
        own = content(text)
        gone = []
        for i in range(len(own) - least + 1):
            key = tuple(x for _, x in own[i : i + least])
            if key in seen:
                gone.append([n for n, _ in own[i : i + least]])
            seen.add(key)
        out.append(gone)
    return out


def corpus(seed, n=25):
    rng = random.Random(seed)
    passages = [[f"p{k} line {j}" for j in range(rng.randrange(3, 9))] for k in range(6)]
    out = []
    for d in range(n):
        lines = [f"own {d} {j}" for j in range(rng.randrange(6))]
        for _ in range(rng.randrange(3)):
            p = rng.choice(passages)
            a = rng.randrange(len(p) - 2)
            lines[len(lines) // 2 : len(lines) // 2] = p[a : a + rng.randrange(2, 9)] + rng.choice([[], ["", " "]])
        lines.insert(rng.randrange(len(lines) + 1), "common line")
        out.append("\n".join(lines))
    return out


def test_winnow_guarantee():
    rng = np.random.default_rng(2)
    for _ in range(200):
        g = rng.integers(0, 9, rng.integers(0, 30)).astype(np.uint64)
        w = int(rng.integers(1, 6))
        at = set(winnow(g, w).tolist())
        for i in range(len(g) - w + 1):
            low = g[i : i + w].min()
            assert max(j for j in range(i, i + w) if g[j] == low) in at


@pytest.mark.parametrize("run,window", [(1, 1), (2, 1), (2, 2), (3, 3)])
def test_against_brute_force(spark, run, window):
    for seed in (1, 2):
        texts = corpus(seed)
        got = {r.doc_id: set(r.deleted) for r in line_report(docs(spark, texts), run, window).collect()}
        every, sure = [set().union(*x) for x in brute(texts, run)], brute(texts, run + window - 1)
        for d, text in enumerate(texts):
            assert got[d] <= every[d]
            if window == 1:
                assert got[d] == every[d]
            # Of every repeated window of lines, all but window - 1 at either end.
            for own in sure[d]:
                assert set(own[window - 1 : len(own) - window + 1]) <= got[d]


def test_text_comes_back(spark):
    texts = ["a\nb\nc", "x\na\nb\n\ny", None, "", "a\nb\nc", "\n\n", "c\na\nb\nc"]
    df = odd_docs(spark, texts, [1, 2, 3, 4, 5, 6, None])
    out = line_dedup(df)
    assert out.columns == [*df.columns, "n_deleted"] and out.count() == 7
    rows = {r[0]: r for r in out.collect()}
    assert {k: (r[1], r[-1]) for k, r in rows.items()} == {1: ("a\nb\nc", 0), 2: ("x\n\ny", 2), 3: (None, 0), 4: ("", 0), 5: ("", 3), 6: ("\n\n", 0), None: ("c", 3)}
    assert rows[5][2:5] == ("en", "s1", 5)


def test_repeated_rows_are_one_document(spark):
    got = line_report(docs(spark, ["a\nb\nc\nd", "a\nb\nc\nd", "b\nc\nd\ne"], [1, 1, 2])).collect()
    assert sorted((r.doc_id, r.n_deleted) for r in got) == [(1, 0), (1, 0), (2, 3)]


def test_repeats_inside_a_text(spark):
    got = line_report(docs(spark, ["a\nb\nq\na\nb", "z\nz\nz\nz"])).collect()
    assert {r.doc_id: r.deleted for r in got} == {0: [3, 4], 1: [1, 2, 3]}


def test_empty_table(spark):
    assert line_report(docs(spark, [])).collect() == [] and line_dedup(docs(spark, [])).collect() == []


def test_other_columns_of_any_type_are_kept(spark):
    df = docs(spark, ["a\nb", "a\nb"]).selectExpr("*", "named_struct('odd name', doc_id, 'b', array(1)) AS `x y`", "date'2024-01-01' AS day", "cast(1 AS decimal(9,2)) AS d", "map('k', doc_id) AS m")
    rows = {r.doc_id: r for r in line_dedup(df).collect()}
    assert rows[1]["x y"]["odd name"] == 1 and rows[1].m == {"k": 1} and rows[1].text == "" and rows[0].text == "a\nb"


def test_small_parts():
    assert drop_lines(None, [0]) == "" and drop_lines("a\nb", [1]) == "a"
    h = np.arange(10, dtype=np.int64)
    assert extend(h, np.concatenate([h[3:8], [99]]), [(4, 1), (5, 2)], 2, False) == [(3, 8)]
    assert len(grams_of(h.astype(np.uint64), 11)) == 0
