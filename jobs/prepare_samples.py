"""Batch job: an irregularly sampled table made ready for reconstruction.

    python -m jobs.prepare_samples SOURCE OUT [--config jobs/prepare_samples.json]

``location``, ``frame``, ``channel`` and ``value`` are SQL expressions over the columns of SOURCE (Parquet),
so measurements and text tables are read alike; the given file takes a conversation as a location, its
turns as frames, the roles as channels that take turns in being sampled, and the length of a text as value.

1. ``OUT/samples``, a folder a channel: one value a cell (the largest of several); rows without location,
   frame or channel, or with a value that is null, not finite or exactly zero (not sampled), are left out.
2. ``OUT/coverage``: of each channel its samples, locations, frames and the acceleration, which is
   locations times frames over samples.
3. ``OUT/filled``, a folder a channel: every frame of every sampled location of a channel, with the value of the
   nearest sampled frame (the earlier of two as near) over the quantile of all samples' magnitudes.

Frames count from 1 to the largest there is, for all channels; a frame under 1 stops the job. With ``channels``, a list,
only those are written again (dynamic partition overwrite) and the others stay as they are; scale and frames still
follow from all samples. A rerun gives the same result.
"""

from __future__ import annotations

import argparse
import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridweave.operators.kspace import nearest_frame, quantile_scale
from gridweave.schema import EPS32
from jobs.config import log_to_stderr, read_config

log = logging.getLogger("prepare_samples")

DEFAULTS = {"location": "conv_id", "frame": "turn + 1", "channel": "role", "value": "char_length(text)", "quantile": 0.99, "channels": None}
KEYS = ("location", "channel")


def samples(rows: DataFrame, config: dict) -> DataFrame:
    """location, channel, t, v: a row a sampled cell."""
    cells = rows.select(F.expr(config["location"]).alias("location"), F.expr(config["channel"]).cast("string").alias("channel"), F.expr(config["frame"]).cast("int").alias("t"), F.expr(config["value"]).cast("double").alias("v"))
    there = F.col("location").isNotNull() & F.col("channel").isNotNull() & F.col("t").isNotNull() & F.col("v").isNotNull()
    sampled = cells.where(there & ~F.isnan("v") & (F.abs("v") < float("inf")) & (F.col("v") != 0))
    return sampled.groupBy("location", "channel", "t").agg(F.max("v").alias("v"))


def _write(df: DataFrame, path: str, *, by: str = "channel") -> None:
    """Partitions that ``df`` has are replaced, others stay. Files of a fitting size, large partitions split."""
    df.hint("rebalance", by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def _read(spark: SparkSession, df: DataFrame, path: str) -> DataFrame:
    return spark.read.schema(T.StructType([f for f in df.schema if f.name != "channel"] + [T.StructField("channel", T.StringType())])).parquet(path)


def run(spark: SparkSession, source: str, out: str, config: dict | None = None) -> DataFrame:
    """Writes samples, coverage and filled; returns filled read back: location, t, t_src, v, channel."""
    config = {**DEFAULTS, **(config or {})}
    rows = spark.read.parquet(source)
    own = samples(rows, config)
    # All later passes read what is written here, not the source.
    own.hint("rebalance", "channel").write.mode("overwrite").partitionBy("channel").parquet(f"{out}/samples")
    own = _read(spark, own, f"{out}/samples")
    first, frames, n = own.agg(F.min("t"), F.max("t"), F.count("t")).first()
    log.info("read %s; wrote %d samples to %s/samples", source, n, out)
    if n and first < 1:
        raise ValueError(f"frame {first}: frames count from 1")
    scale = quantile_scale(own, F.abs("v"), float(config["quantile"])).first().scale
    if config["channels"] is not None:
        own = own.where(F.col("channel").isin(list(config["channels"])))
    counted = own.groupBy("channel").agg(F.count("t").alias("samples"), F.count_distinct("location").alias("locations"), F.lit(frames or 0).alias("frames"))
    _write(counted.withColumn("acceleration", F.col("locations") * F.col("frames") / F.col("samples")), f"{out}/coverage")
    filled = nearest_frame(own, frames or 0, location=KEYS, values=("v",)).withColumn("v", F.col("v") / F.lit(max(scale or 0.0, EPS32)))
    _write(filled, f"{out}/filled")
    result = _read(spark, filled.select("location", "t", "t_src", "v", "channel"), f"{out}/filled")
    log.info("wrote %d cells of %d frames, scaled by %s, to %s/filled", result.count(), frames or 0, scale, out)
    return result


def main() -> None:
    parser = argparse.ArgumentParser(description=__doc__.split("\n")[0])
    parser.add_argument("source")
    parser.add_argument("out")
    parser.add_argument("--config")
    args = parser.parse_args()
    log_to_stderr()
    spark = SparkSession.builder.appName("prepare-samples").getOrCreate()
    try:
        run(spark, args.source, args.out, read_config(spark, args.config, DEFAULTS) if args.config else None)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
