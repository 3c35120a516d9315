"""The incremental job over a growing copy, against the batch operators."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from gridweave.operators import analysis
from gridweave.streaming.moments import merged, moments, trend
from jobs import series_monitor as job
from jobs.config import read_config

COLUMNS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
START = dt.datetime(2024, 1, 1)


def rows(seed, n, users=4):
    rng = random.Random(seed)
    return [(i, START + dt.timedelta(seconds=rng.randrange(86400 * 30), microseconds=rng.randrange(10**6)), rng.randrange(users), rng.choice(["view", "1", "a b"]), round(rng.gauss(50, 20), 2), "{}") for i in range(n)]


def add(spark, folder, batch, parts=2):
    spark.createDataFrame(batch, COLUMNS).repartition(parts).write.mode("append").parquet(folder)


def result(df):
    return sorted(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in df.select("location", "channel", "rows", "n", "mean", "slope", "sd", "tsnr").collect())


def whole(spark, every):
    """The same by the batch operators."""
    df = job.samples(spark.createDataFrame(every, COLUMNS), job.DEFAULTS).withColumnRenamed("channel", "c").withColumnRenamed("location", "l")
    keys = ("l", "c")
    flat = analysis.detrend(df, values=("v",), keys=keys)
    snr = analysis.tsnr(flat, F.col("v"), keys=keys)
    return {(r.l, r.c): r.tsnr for r in snr.collect()}


def test_two_runs_over_growing_input(spark, tmp_path):
    source, out, checkpoint = (f"{tmp_path}/{x}" for x in ("source", "out", "checkpoint"))
    first, second = rows(1, 300), rows(2, 200, users=6)
    add(spark, source, first)
    before = {tuple(sorted(spark.conf.getAll.items()))}
    job.run(spark, source, out, checkpoint)
    add(spark, source, second)
    got = job.run(spark, source, out, checkpoint)
    assert {tuple(sorted(spark.conf.getAll.items()))} == before
    want = whole(spark, first + second)
    assert {(r.location, r.channel): r.n for r in got.collect()} and len(want) == got.count()
    for r in got.collect():
        assert r.n < 3 and r.tsnr is None or r.tsnr == pytest.approx(want[r.location, r.channel], rel=1e-6)
    assert sum(r.n for r in got.collect()) == 500
    # Each run took only its own rows.
    by_batch = {r.batch: r.n for r in spark.read.parquet(f"{out}/moments").groupBy("batch").agg(F.sum("n").alias("n")).collect()}
    assert sorted(by_batch.values()) == [200, 300]
    held = result(got)
    # A third run finds nothing new and changes nothing.
    assert result(job.run(spark, source, out, checkpoint)) == held
    # From the start in one go, in small batches: the same.
    assert result(job.run(spark, source, f"{tmp_path}/again", f"{tmp_path}/c2", {"files_per_batch": 1})) == held


def test_replayed_batch_counts_once(spark, tmp_path):
    source, out = f"{tmp_path}/source", f"{tmp_path}/out"
    add(spark, source, rows(3, 100), 1)
    once = result(job.run(spark, source, out, f"{tmp_path}/a"))
    # The checkpoint is lost after the batch was written: it comes again under the same number.
    assert result(job.run(spark, source, out, f"{tmp_path}/b")) == once


def test_odd_rows(spark, tmp_path):
    t = START + dt.timedelta(days=2)
    odd = [(1, None, 1, "a", 5.0, None), (2, t, None, None, 4.0, None), (3, t, 1, "a", None, None), (4, t, 1, "a", float("nan"), None), (5, t, 1, "a", float("inf"), None), (6, t, 2, "b", 6.0, None), (7, t, 3, "b", 1.0, None), (7, t, 3, "b", 1.0, None), (8, t, 3, "b", 3.0, None)]
    add(spark, f"{tmp_path}/s", odd)
    got = {(r.location, r.channel): r for r in job.run(spark, f"{tmp_path}/s", f"{tmp_path}/o", f"{tmp_path}/c").collect()}
    assert set(got) == {(1, "a"), (None, None), (2, "b"), (3, "b")}
    assert (got[1, "a"].rows, got[1, "a"].n, got[1, "a"]["mean"]) == (4, 0, None)
    assert got[2, "b"].slope == pytest.approx(6 * 2 / 5) and got[2, "b"].tsnr is None
    assert (got[3, "b"].n, got[3, "b"].slope, got[3, "b"].tsnr) == (3, None, None)


def test_no_rows(spark, tmp_path):
    add(spark, f"{tmp_path}/s", [])
    assert job.run(spark, f"{tmp_path}/s", f"{tmp_path}/o", f"{tmp_path}/c").collect() == []


def test_moments_merge(spark):
    every = spark.createDataFrame([(k % 3, float(k), float((k * 7) % 11)) for k in range(60)], "k int, t double, v double")
    part = lambda r: moments(every.where(F.col("t") % 2 == r), t=F.col("t"), v=F.col("v"), keys=("k",))
    both = merged(part(0).unionByName(part(1)), ("k",))
    one = moments(every, t=F.col("t"), v=F.col("v"), keys=("k",))
    assert sorted(both.collect()) == sorted(one.collect())
    want = {r.k: r.tsnr for r in analysis.tsnr(analysis.detrend(every, values=("v",), keys=("k",)), F.col("v"), keys=("k",)).collect()}
    assert {r.k: r.tsnr for r in trend(both, ("k",)).collect()} == pytest.approx(want)


def test_config(spark, tmp_path):
    from pathlib import Path

    given = Path(__file__).parents[2] / "jobs/series_monitor.json"
    assert read_config(spark, str(given), job.DEFAULTS) == job.DEFAULTS
    Path(f"{tmp_path}/bad.json").write_text(json.dumps({"colour": 1}))
    with pytest.raises(ValueError, match="colour"):
        read_config(spark, f"{tmp_path}/bad.json", job.DEFAULTS)
