"""Sessions: settings that hold on a laptop and on a cluster alike."""

from __future__ import annotations

import os
import re

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def _master_given() -> bool:
    """A submitted application talks to a JVM that has a master; a plain one may name it in the environment."""
    submitted = "PYSPARK_GATEWAY_PORT" in os.environ
    return submitted or "MASTER" in os.environ or re.search(r"--master\b|spark\.master=", os.environ.get("PYSPARK_SUBMIT_ARGS", "")) is not None


def session(name: str = "sieveworks", cores: int | None = None, partitions: int | None = None) -> SparkSession:
    """The active session, or a new one; local only where neither a submit script nor the environment names a master."""
    builder = SparkSession.builder.appName(name)
    if cores or not (SparkSession.getActiveSession() or _master_given()):
        builder = builder.master(f"local[{cores or '*'}]")
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    return builder.getOrCreate()
