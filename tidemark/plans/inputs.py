"""What the registered queries start from, built lazily per query run."""

from __future__ import annotations

from collections.abc import Sequence
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.quantiles import exact_medians
from tidemark.operators.clean import clean_transactions, deduplicated
from tidemark.operators.learners import ConstantModel, Learner, fit_naive_median
from tidemark.operators.metrics import leaderboard, regression_metrics
from tidemark.operators.temporal import SplitBounds, assign_split, fit_calendar_split, walk_forward_folds
from tidemark.operators.walkforward import walk_forward
from tidemark.plans import fixtures
from tidemark.workspace import Workspace

#: The model binned and drawn in the diagnostics queries.
DRAWN_MODEL = "saleEstimate_currentPrice"

#: Columns that cleaning, splitting and the untrained predictions read.
KEYS = ("row_id", "fullAddress", "history_date", "history_price")
SCORED = (*KEYS, "bedrooms", "outcode", "propertyType", *fixtures.ESTIMATES)


class Inputs:
    """One query's tables; nothing is shared between queries.

    ``columns`` names what the query reads, so that staged tables hold no
    more and the aggregates behind other columns are never computed.
    """

    def __init__(self, spark: SparkSession, sf_dir: str, columns: Sequence[str] | None = None):
        self.spark, self.sf_dir, self.columns = spark, sf_dir, columns

    @cached_property
    def workspace(self) -> Workspace:
        return Workspace(self.spark)

    @cached_property
    def sales(self) -> DataFrame:
        rows = fixtures.sales(self.spark, self.sf_dir)
        return rows if self.columns is None else rows.select(*self.columns)

    @cached_property
    def dirty(self) -> DataFrame:
        return fixtures.dirty(self.spark, self.sf_dir)

    @cached_property
    def deduplicated(self) -> DataFrame:
        """Unclipped rows, staged for the passes that fit on them."""
        return self.workspace.stage(deduplicated(self.sales), "deduplicated")

    @cached_property
    def clean(self) -> DataFrame:
        return clean_transactions(self.sales, self.workspace)

    @property
    def size(self) -> int:
        """Rows of the clean table, counted while it was staged."""
        return self.workspace.rows["deduplicated"]

    @cached_property
    def bounds(self) -> SplitBounds:
        return fit_calendar_split(self.clean)

    @cached_property
    def split(self) -> DataFrame:
        return assign_split(self.clean, self.bounds)

    def rows_of(self, *splits: str) -> DataFrame:
        keep = F.lit(False)
        for s in splits:
            keep = keep | self.bounds.rows_of(s)
        return self.split.where(keep)

    @cached_property
    def medians(self) -> dict[str, float | None]:
        """Train medians of the price and of the price per room."""
        train = self.rows_of("train").select(
            "history_price", (F.col("history_price") / F.col("bedrooms")).alias("rate"))
        return exact_medians(train, ["history_price", "rate"], rows=self.size)

    def predictions(self, *splits: str) -> DataFrame:
        """Untrained predictions: two train medians and the vendor columns."""
        scores = {
            "NaiveMedian": F.lit(self.medians["history_price"]),
            "RoomRate": F.col("bedrooms") * F.lit(self.medians["rate"]),
            **{c: F.col(c) for c in fixtures.ESTIMATES},
        }
        cells = [F.struct(F.lit(n).alias("model"), p.alias("y_pred")) for n, p in scores.items()]
        return self.rows_of(*(splits or ("val", "test"))).select(
            "row_id", "split", "history_date", "outcode_area", "propertyType",
            F.col("history_price").alias("y_true"), F.inline(F.array(*cells)))

    def mainline(self) -> DataFrame:
        """Leaderboard of the models that see no vendor column."""
        own = self.predictions().where(F.col("model").isin("NaiveMedian", "RoomRate"))
        return leaderboard(regression_metrics(own))

    def assisted(self) -> DataFrame:
        """Results of two fixed blends of vendor columns.

        Neither blend is a benchmark column itself: that would be an exact tie,
        which the order of summation would decide.
        """
        low, middle, high = (F.col(c) for c in fixtures.ESTIMATES)
        cells = [
            F.struct(F.lit(n).alias("model"), p.alias("y_pred"))
            for n, p in (("AssistedBlend", (low + high) / 2), ("AssistedMix", (low + middle) / 2))]
        scored = self.rows_of("test").select("split", F.col("history_price").alias("y_true"), F.inline(F.array(*cells)))
        return regression_metrics(scored).select(
            "model", F.col("mae").alias("test_mae"), F.col("rmse").alias("test_rmse"))

    def fold_metrics(self) -> DataFrame:
        """Fold RMSE of two constant families."""
        return walk_forward(
            self.clean, walk_forward_folds(self.clean),
            [Learner("NaiveMedian", fit_naive_median), Learner("NaiveMean", fit_mean)], None)


def fit_mean(train: DataFrame) -> ConstantModel:
    return ConstantModel(train.agg(F.avg("y_true")).first()[0])
