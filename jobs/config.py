"""Configuration files and logging of the jobs."""

from __future__ import annotations

import json
import logging
import sys

from pyspark.sql import SparkSession


def read_config(spark: SparkSession, path: str, defaults: dict) -> dict:
    """A JSON object from any path that Spark reads; unknown names are refused."""
    text = spark.read.text(path, wholetext=True).first()[0]
    given = json.loads(text)
    if unknown := sorted(set(given) - set(defaults)):
        raise ValueError(f"unknown settings: {', '.join(unknown)}")
    return {**defaults, **given}


def log_to_stderr() -> None:
    logging.basicConfig(stream=sys.stderr, level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
