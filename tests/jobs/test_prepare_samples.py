"""The batch job against a plain restatement."""

import random
from pathlib import Path

import numpy as np
import pytest

from jobs import prepare_samples as job
from jobs.config import read_config

COLUMNS = "conv_id long, turn long, role string, text string"


def table(spark, path, rows):
    spark.createDataFrame(rows, COLUMNS).repartition(3).write.mode("overwrite").parquet(path)
    return path


def plain(rows):
    cells = {}
    for c, turn, role, text in rows:
        if None not in (c, turn, role, text) and text:
            cells[c, role, turn + 1] = max(cells.get((c, role, turn + 1), 0), len(text))
    frames = max(t for *_, t in cells)
    scale = np.quantile(list(cells.values()), 0.99)
    out = []
    for c, role in {k[:2] for k in cells}:
        own = sorted(k[2] for k in cells if k[:2] == (c, role))
        for t in range(1, frames + 1):
            src = min(own, key=lambda s: (abs(s - t), s))
            out.append((c, role, t, src, round(float(cells[c, role, src] / scale), 9)))
    return sorted(out)


def result(df):
    return sorted((r.location, r.channel, r.t, r.t_src, round(r.v, 9)) for r in df.collect())


def corpus(seed=1):
    rng = random.Random(seed)
    rows = [(c, t, ("user", "assistant", "1")[rng.randrange(3)], "x" * rng.randrange(60)) for c in range(25) for t in range(rng.randrange(1, 9))]
    return [*rows, rows[3], (*rows[4][:3], "longer " * 9), (None, 1, "user", "a"), (1, None, "user", "a"), (1, 1, None, "a"), (1, 1, "user", None), (2, 3, "user", "")]


def test_against_plain_restatement_and_rerun(spark, tmp_path):
    rows = corpus()
    source = table(spark, f"{tmp_path}/s", rows)
    got = result(job.run(spark, source, f"{tmp_path}/o"))
    assert got == plain(rows)
    assert result(job.run(spark, source, f"{tmp_path}/o")) == got
    cover = {r.channel: r for r in spark.read.parquet(f"{tmp_path}/o/coverage").collect()}
    own = [r for r in cover.values()]
    assert all(r.acceleration == pytest.approx(r.locations * r.frames / r.samples) and r.acceleration >= 1 for r in own)


def test_only_named_channels_are_written_again(spark, tmp_path):
    rows = corpus()
    source = table(spark, f"{tmp_path}/s", rows)
    job.run(spark, source, f"{tmp_path}/o")
    more = [*rows, (99, 4, "user", "y" * 30), (99, 4, "assistant", "y" * 30)]
    got = result(job.run(spark, table(spark, f"{tmp_path}/s", more), f"{tmp_path}/o", {"channels": ["user"]}))
    assert [r for r in got if r[1] == "user"] == [r for r in plain(more) if r[1] == "user"]
    assert [r for r in got if r[1] != "user"] == [r for r in plain(rows) if r[1] != "user"]


def test_frames_below_one_and_no_rows(spark, tmp_path):
    with pytest.raises(ValueError, match="count from 1"):
        job.run(spark, table(spark, f"{tmp_path}/s", [(1, -1, "user", "a")]), f"{tmp_path}/o")
    assert job.run(spark, table(spark, f"{tmp_path}/e", []), f"{tmp_path}/e2").collect() == []


def test_config(spark):
    given = Path(__file__).parents[2] / "jobs/prepare_samples.json"
    assert read_config(spark, str(given), job.DEFAULTS) == job.DEFAULTS
