"""A Spark session with the settings the jobs count on."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import SparkSession


def builder() -> SparkSession.Builder:
    """UTC, AQE with its skew handling, session windows merged before the shuffle; sizes stay those of the cluster."""
    return (
        SparkSession.builder.appName("fleetlens")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition", "true")
    )


def local_session(cores: str | None = None) -> SparkSession:
    """A local session for tests and measurements."""
    cores = cores or os.environ.get("BENCH_CPUS", "8")
    spark = (
        builder()
        .master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.checkpoint.dir", f"/tmp/checkpoints/fleetlens-{uuid.uuid4().hex}")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
