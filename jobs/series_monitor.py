"""Incremental job: drift and temporal signal-to-noise of series whose samples still arrive.

    python -m jobs.series_monitor SOURCE OUT CHECKPOINT [--config jobs/series_monitor.json]

SOURCE is a folder of Parquet files, or a pattern of paths, that grows while a measurement goes on. A file stream takes the
files that its checkpoint has not seen (``availableNow``: all that is there, then it ends). Each
micro-batch is reduced to sums a series and written to ``OUT/moments/batch=N``; a batch that is
replayed after a failure replaces its own partition, so nothing counts twice. Then ``OUT/series``, a
folder a channel, is written anew from all moments: location, channel, rows, n, mean, slope, sd, tsnr.

OUT and CHECKPOINT belong together: with a new checkpoint, take a new OUT. A run without new files leaves the same result. Samples are read once; what later runs read again are
the sums, a row a series and batch. Times count in units of ``unit_seconds`` from the start of the
day ``origin``.
Rows whose time or value is null or not finite are counted in ``rows``, not in ``n``; null locations and
channels are series of their own. Without any file the output is empty.
"""

from __future__ import annotations

import argparse
import logging

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridweave.streaming.moments import merged, moments, trend
from jobs.config import log_to_stderr, read_config

log = logging.getLogger("series_monitor")

DEFAULTS = {"location": "user_id", "channel": "event_type", "time": "ts", "value": "value", "origin": "2024-01-01", "unit_seconds": 86400, "files_per_batch": 64}
KEYS = ("location", "channel")


def elapsed(time: str, origin: str, unit: float) -> Column:
    """Units since midnight of the origin's day, to the microsecond. Times without a zone stay so."""
    at = F.col(time)
    seconds = F.datediff(at, F.lit(origin).cast("date")).cast("long") * 86400 + F.hour(at) * 3600 + F.minute(at) * 60
    micros = seconds * 1_000_000 + (F.extract(F.lit("SECOND"), at) * 1_000_000).cast("long")
    return micros / F.lit(unit * 1e6)


def samples(rows: DataFrame, config: dict) -> DataFrame:
    """location, channel, t, v of a table of measurements."""
    t = elapsed(config["time"], config["origin"], float(config["unit_seconds"]))
    return rows.select(F.col(config["location"]).alias("location"), F.col(config["channel"]).cast("string").alias("channel"), t.alias("t"), F.col(config["value"]).cast("double").alias("v"))


def take_new(spark: SparkSession, source: str, out: str, checkpoint: str, config: dict, schema: T.StructType) -> list[int]:
    """Adds the moments of files that the checkpoint has not seen; the numbers of the batches written."""
    taken: list[int] = []

    def add(batch: DataFrame, number: int) -> None:
        part = moments(samples(batch, config), t=F.col("t"), v=F.col("v"), keys=KEYS).withColumn("batch", F.lit(number).cast("long"))
        part.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{out}/moments")
        taken.append(number)
        log.info("wrote batch %d to %s/moments", number, out)

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", config["files_per_batch"]).parquet(source)
    query = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(add).start()
    query.awaitTermination()
    return taken


def _moments_schema(schema: T.StructType, config: dict) -> T.StructType:
    keys = [T.StructField("location", schema[config["location"]].dataType), T.StructField("channel", T.StringType())]
    sums = [T.StructField("rows", T.LongType()), T.StructField("n", T.LongType()), *(T.StructField(c, T.DoubleType()) for c in ("st", "stt", "sv", "svv", "stv"))]
    return T.StructType([*keys, *sums, T.StructField("batch", T.LongType())])


def read_series(spark: SparkSession, out: str, location: T.DataType) -> DataFrame:
    """OUT/series with its types, whatever channels are called."""
    numbers = [T.StructField(c, T.LongType()) for c in ("rows", "n")] + [T.StructField(c, T.DoubleType()) for c in ("mean", "slope", "sd", "tsnr")]
    return spark.read.schema(T.StructType([T.StructField("location", location), *numbers, T.StructField("channel", T.StringType())])).parquet(f"{out}/series")


def run(spark: SparkSession, source: str, out: str, checkpoint: str, config: dict | None = None) -> DataFrame:
    """Takes what is new in ``source`` and writes the series anew; returns them read back."""
    config = {**DEFAULTS, **(config or {})}
    schema = spark.read.parquet(source).schema
    batches = take_new(spark, source, out, checkpoint, config, schema)
    held = _moments_schema(schema, config)
    spark.createDataFrame([], held).write.mode("append").parquet(f"{out}/moments")  # there is a folder to read, even without a batch
    parts = spark.read.schema(held).parquet(f"{out}/moments")
    rows = parts.where(F.col("batch").isin(batches)).agg(F.sum("rows")).first()[0] if batches else 0
    log.info("read %d new rows of %s in %d batches", rows or 0, source, len(batches))
    series = trend(merged(parts, KEYS), KEYS)
    # Files of a fitting size; a channel with much of the series is split.
    series.hint("rebalance", "channel").write.mode("overwrite").partitionBy("channel").parquet(f"{out}/series")
    result = read_series(spark, out, held["location"].dataType)
    log.info("wrote %d series to %s/series", result.count(), out)
    return result


def main() -> None:
    parser = argparse.ArgumentParser(description=__doc__.split("\n")[0])
    parser.add_argument("source")
    parser.add_argument("out")
    parser.add_argument("checkpoint")
    parser.add_argument("--config")
    args = parser.parse_args()
    log_to_stderr()
    spark = SparkSession.builder.appName("series-monitor").getOrCreate()
    try:
        run(spark, args.source, args.out, args.checkpoint, read_config(spark, args.config, DEFAULTS) if args.config else None)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
