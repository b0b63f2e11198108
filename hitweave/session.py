"""A session with the settings that the operators are planned for."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

#: Adaptive plans, splitting of skewed joins, UTC, and Arrow for what leaves the JVM.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def session(name: str = "hitweave", master: str | None = None, **settings: str) -> SparkSession:
    """A session; on one machine with as many shuffle partitions as threads, on a cluster with the cluster's own number."""
    builder = SparkSession.builder.appName(name)
    if master:
        threads = os.cpu_count() if "*" in master else int("".join(c for c in master if c.isdigit()) or 1)
        builder = builder.master(master).config("spark.sql.shuffle.partitions", str(threads))
    for k, v in {**SETTINGS, **{k.replace("__", "."): v for k, v in settings.items()}}.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
