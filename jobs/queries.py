"""The jobs as registered queries: each runs its job twice into one new folder, and returns all
that is there after the second run."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridweave.schema import EPS32
from gridweave.scratch import shared_folder
from jobs import prepare_samples, series_monitor


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def job1_series_monitor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drift and signal-to-noise of the events of each user and type."""
    at = _folder(spark, "job1")
    for _ in range(2):
        # A pattern, since a file stream takes folders and patterns and the table may be a single file.
        found = series_monitor.run(spark, f"{sf_dir}/events.parquet*", f"{at}/out", f"{at}/checkpoint")
    return found.select("location", "channel", "rows", "n", F.round("mean", 8).alias("mean"), *(F.round(c, 4).alias(c) for c in ("slope", "sd", "tsnr")))


def job2_prepare_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths of the texts of each conversation and role, filled over all turns and normalised."""
    at = _folder(spark, "job2")
    for _ in range(2):
        found = prepare_samples.run(spark, f"{sf_dir}/conversations.parquet", at)
    return found.select("location", "channel", "t", "t_src", F.round("v", 9).alias("v"))


JOB1_SQL = f"""
WITH s AS (
  SELECT user_id AS location, event_type AS channel,
         CASE WHEN ts IS NOT NULL AND isfinite(value) THEN (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 86400e6 END AS t,
         CASE WHEN ts IS NOT NULL AND isfinite(value) THEN value END AS v
  FROM events),
g AS (
  SELECT location, channel, count(*) AS rows, count(v) AS n, avg(v) AS mean, avg(t) AS mt,
         CASE WHEN count(v) = 1 THEN max(v) * max(t) / (1 + max(t) * max(t)) ELSE regr_slope(v, t) END AS slope,
         regr_syy(v, t) AS syy, regr_sxy(v, t) AS sxy
  FROM s GROUP BY ALL),
d AS (SELECT *, CASE WHEN n > 2 THEN sqrt(greatest(syy - slope * sxy, 0) / (n - 1)) END AS sd FROM g)
SELECT location, channel, rows, n, round(mean, 8) AS mean, round(slope, 4) AS slope, round(sd, 4) AS sd,
       round((mean - slope * mt) / (sd + {EPS32!r}), 4) AS tsnr
FROM d
"""

JOB2_SQL = f"""
WITH k AS (
  SELECT conv_id AS location, role AS channel, CAST(turn + 1 AS INTEGER) AS t, max(CAST(length(text) AS DOUBLE)) AS v
  FROM conversations
  WHERE conv_id IS NOT NULL AND role IS NOT NULL AND turn IS NOT NULL AND text IS NOT NULL AND length(text) > 0
  GROUP BY ALL),
q AS (SELECT greatest(quantile_cont(v, 0.99), {EPS32!r}) AS q, max(t) AS frames FROM k),
grid AS (
  SELECT location, channel, CAST(unnest(range(1, frames + 1)) AS INTEGER) AS t
  FROM (SELECT DISTINCT location, channel FROM k), q),
near AS (
  SELECT grid.location, grid.channel, grid.t, k.t AS t_src, k.v,
         row_number() OVER (PARTITION BY grid.location, grid.channel, grid.t ORDER BY abs(grid.t - k.t), k.t) AS rn
  FROM grid JOIN k ON grid.location = k.location AND grid.channel = k.channel)
SELECT location, channel, t, t_src, round(v / q, 9) AS v FROM near, q WHERE rn = 1
"""


def job_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"job1_series_monitor": job1_series_monitor, "job2_prepare_samples": job2_prepare_samples}


def job_oracle_sql() -> dict[str, str]:
    return {"job1_series_monitor": JOB1_SQL, "job2_prepare_samples": JOB2_SQL}
