"""Spark settings that the engine is meant to run under. On a cluster, submit-time settings come first."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

#: Exact names, errors instead of wrap-around, plans that adapt at run time, and time stamps that do not move.
SETTINGS = {
    "spark.sql.caseSensitive": "true",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def get_session(name: str = "tessera", **settings: str) -> SparkSession:
    """The running session, or a new one with SETTINGS; local where no master is named, with a shuffle partition for each core."""
    builder = SparkSession.builder.appName(name)
    if "spark.master" not in settings and not os.environ.get("MASTER"):
        cores = os.cpu_count() or 1
        builder = builder.master("local[*]").config("spark.sql.shuffle.partitions", str(cores))
    for key, value in (SETTINGS | settings).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
