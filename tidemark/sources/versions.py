"""Stored tables in whole versions.

A version is a folder of its own, written first and named by one pointer row written last,
so readers see whole versions only.  An upsert may therefore read the version that it
replaces, and a publish that fails on the way leaves the old version visible.  Pointers are
small tables ``_versions/<number>``; writing one that exists fails, so of two writers that
start from the same version one is refused.  Old versions stay readable by their number.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from tidemark.sources.upserts import upsert_predictions, upsert_rows


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def versions(self) -> dict[int, str]:
        """Folder of each published version."""
        try:
            # Pointers are rows of a few bytes, one per publish.
            rows = self.spark.read.schema("version bigint, folder string").json(f"{self.path}/_versions/*").collect()
        except AnalysisException as error:
            if error.getCondition() == "PATH_NOT_FOUND":
                return {}
            raise
        return {r.version: r.folder for r in rows}

    def current(self) -> int:
        """Number of the newest version; 0 before the first one."""
        return max(self.versions(), default=0)

    def read(self, version: int | None = None) -> DataFrame | None:
        """A version, by default the newest; None before the first one."""
        known = self.versions()
        if not known:
            return None
        return self.spark.read.parquet(f"{self.path}/{known[max(known) if version is None else version]}")

    def publish(self, df: DataFrame, after: int | None = None) -> int:
        """Write ``df`` as the version that follows ``after`` (by default the newest)."""
        number = (self.current() if after is None else after) + 1
        folder = f"data/{number:08d}-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{folder}")
        self._point(number, folder)
        return number

    def _point(self, number: int, folder: str) -> None:
        pointer = self.spark.createDataFrame([(number, folder)], "version bigint, folder string").coalesce(1)
        pointer.write.mode("errorifexists").json(f"{self.path}/_versions/{number:08d}")

    def replace(self, change: Callable[[DataFrame | None], DataFrame]) -> int:
        """Publish what ``change`` makes of the newest version."""
        known = self.versions()
        newest = max(known, default=0)
        return self.publish(change(self.read(newest) if known else None), after=newest)

    def upsert(self, new: DataFrame, keys: Sequence[str] = ("model",)) -> int:
        """Rows of ``new`` replace the stored rows with the same key."""
        return self.replace(lambda base: upsert_rows(base, new, keys))

    def upsert_predictions(self, new: DataFrame, model: str = "model", row_id: str = "row_id") -> int:
        """Models of ``new`` are added or replaced; stored predictions of other rows go."""
        return self.replace(lambda base: upsert_predictions(base, new, model, row_id))
