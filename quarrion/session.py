"""Sessions with the settings that the engine's semantics rest on."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.ansi.enabled": "true",  # an integer sum that overflows is an error, not a wrapped number
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(master: str | None = None, partitions: int | None = None, **more: str) -> SparkSession:
    """A session; on a cluster the master and its sizes come from spark-submit, so nothing is set unless given."""
    b = SparkSession.builder.appName("quarrion")
    if master:
        b = b.master(master)
    if partitions:
        b = b.config("spark.sql.shuffle.partitions", str(partitions))
    for k, v in (SETTINGS | more).items():
        b = b.config(k, v)
    return b.getOrCreate()


def local(**more: str) -> SparkSession:
    cores = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 2))
    return session(f"local[{cores}]", cores, **({"spark.ui.enabled": "false", "spark.driver.memory": "8g"} | more))


def share_package(spark: SparkSession) -> None:
    """Python workers that inherit no path to this package get the driver's."""
    root = str(Path(__file__).parents[1])
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])
