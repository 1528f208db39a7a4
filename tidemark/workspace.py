"""Shared staging area: written tables that cut lineage between passes.

A fitted operator reads its input once per fitted statistic, so an expensive
upstream (joins, dedup shuffle) is written once as Parquet and read back with
only the columns each later pass needs.  Files live under the cluster's
``spark.checkpoint.dir``, so a lost executor costs a re-read and not a
recomputation.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_LOCAL_ROOTS: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Only a ``local`` master, where driver and executors are one machine, may
    fall back to a fresh temporary folder.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    app = context.applicationId
    if app not in _LOCAL_ROOTS:
        _LOCAL_ROOTS[app] = tempfile.mkdtemp(prefix="tidemark-")
    return _LOCAL_ROOTS[app]


class Workspace:
    """One run's staged tables."""

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark = spark
        self.root = root or f"{shared_root(spark)}/run-{uuid.uuid4().hex}"
        self.rows: dict[str, int] = {}
        self._sequence = 0

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def stage(self, df: DataFrame, name: str, **options) -> DataFrame:
        """Write ``df`` once and return the table that reads it back.

        ``options`` are those of the Parquet writer.

        The write counts its rows on the way; ``rows[name]`` then bounds the
        size of everything derived from the table by filtering.
        """
        self._sequence += 1
        target = self.path(f"{self._sequence:03d}-{name}")
        seen = Observation()
        df.observe(seen, F.count(F.lit(1)).alias("rows")).write.options(**options).parquet(target)
        self.rows[name] = seen.get["rows"]
        # Passing the schema saves the footer-reading inference job.
        return self.spark.read.schema(df.schema).parquet(target)
