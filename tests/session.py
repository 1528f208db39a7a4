"""The local session of tests, checks and bench."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def session(cpus: str | int = 8) -> SparkSession:
    os.environ.setdefault("PYTHONPATH", os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="tidemark-session-"))
        .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark
