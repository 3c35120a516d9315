import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridweave.llm import hard_negatives as h
from gridweave.llm.catalogue import op12_hard_negatives

ROW = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType())])
OUT = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def brute(rows, every=50):
    held = set()
    for i, e, label in rows:
        if i is not None and label is not None and e is not None and all(x is not None and math.isfinite(x) for x in e):
            held.add((i, (label + 1) % 10 if i % 7 == 0 else label, tuple(math.floor(256 * float(np.float32(x))) for x in e)))
    out = []
    for a in held:
        if a[0] % every:
            continue
        score = lambda b: sum(x * y for x, y in zip(a[2], b[2]))  # noqa: B023, E731
        positives = sorted(((-score(b), b[0]) for b in held if b != a and b[1] == a[1]))[:5]
        others = sorted((-score(b), b[0]) for b in held if b[1] != a[1])
        for p, pid in positives:
            fit = [(n, i) for n, i in others if 50 * -p <= 100 * -n <= 95 * -p][:3]
            out += [(a[0], pid, k + 1, i, -p, -n) for k, (n, i) in enumerate(fit)]
    return sorted(out)


def corpus(seed, n=400, dim=12):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 0.3) for _ in range(dim)] for _ in range(6)]
    rows = []
    for i in range(n):
        size = rng.choice([0.2, 1, 1, 3])
        rows.append((i, [size * (x + rng.gauss(0, 0.3)) for x in rng.choice(centres)], 0 if rng.random() < 0.35 else rng.randrange(10)))
    return rows


def table(spark, rows, parts=4):
    return spark.createDataFrame(rows, ROW).repartition(parts)


def found(spark, tmp_path, rows):
    table(spark, rows).withColumns({"score": F.lit("x"), "block": F.lit(1), "tie": F.lit(0)}).write.parquet(f"{tmp_path}/embeddings.parquet")
    return sorted(tuple(r) for r in op12_hard_negatives(spark, str(tmp_path)).select(*OUT).collect())


@pytest.mark.parametrize("bucket,block", [(1024, 4096), (16, 3)])
def test_against_brute_force(spark, tmp_path, monkeypatch, bucket, block):
    monkeypatch.setattr(h, "BUCKET", bucket)
    monkeypatch.setattr(h, "BLOCK", block)
    rows = corpus(1)
    same = [0.5] * 12  # one vector for a third of all rows
    rows += [(400 + i, same, i % 3) for i in range(200)]
    assert found(spark, tmp_path, rows) == brute(rows)


def test_odd_rows(spark, tmp_path):
    rows = corpus(2, 160)
    rows += [rows[50], rows[50], rows[3]]  # rows that repeat wholly
    rows += [(50, [0.1] * 12, 4), (100, [0.9] * 5, 2), (150, [0.0] * 12, 3), (200, [], 3)]
    rows += [(250, None, 1), (300, [0.1, None], 1), (350, [float("nan")] * 12, 1), (400, [float("inf")] * 12, 1), (450, [0.1] * 12, None), (None, [0.2] * 12, 1)]
    assert found(spark, tmp_path, rows) == brute(rows)


def test_scores_beyond_doubles(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, [float(np.float32(rng.uniform(-4e5, 4e5))) for _ in range(4)], i % 3) for i in range(120)]
    assert found(spark, tmp_path, rows) == brute(rows)


def test_empty_table_and_single_label(spark, tmp_path):
    assert found(spark, tmp_path / "a", []) == []
    assert found(spark, tmp_path / "b", [(50, [1.0, 0.0], 1), (51, [1.0, 0.5], 2)]) == []


def test_buckets_are_passed_over(spark, monkeypatch):
    """Of long and short vectors, a stream meets only buckets whose norm may still matter."""
    monkeypatch.setattr(h, "BUCKET", 8)
    met = []
    x = h._Search({"ids": np.array([50]).tobytes(), "ties": np.array([1]).tobytes(), "labels": np.array([1]).tobytes(), "norms": np.array([10.0]).tobytes(), "vecs": np.array([[6, 8]], np.int16).tobytes(), "n": 1, "dim": 2, "width": 2, "top": 10.0, "lows": np.array([[h._NONE + 1]]).tobytes(), "highs": np.array([[1 << 62]]).tobytes()}, 1, True)
    for k, top in enumerate([10, 5, 1]):
        v = np.array([[0.6 * top, 0.8 * top]]).round().astype(np.int16)
        if (h._bound(x.norms, float(top)) >= x.asked()).any():
            met.append(k)
            x.meet({"label": 1, "top": float(top), "n": 1, "dim": 2, "width": 2, "ids": np.array([k]).tobytes(), "ties": np.array([9]).tobytes(), "vecs": v.tobytes()})
    assert met == [0] and x.found[2].tolist() == [100]
