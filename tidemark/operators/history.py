"""Training histories: early stopping and loss curves."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.workspace import Workspace

TOLERANCE = 1e-6
PATIENCE = 10
#: Epochs per chunk when looking for running minima.
CHUNK = 65_536
#: Chunk summaries composed at once.
FAN_IN = 256
ENTRIES = "array<struct<epoch: bigint, value: double, exit_epoch: bigint, exit_value: double>>"


def running_minima(history: DataFrame, value: str = "val_rmse", chunk: int = CHUNK) -> DataFrame:
    """Epochs that undercut every earlier epoch of their run.

    Works chunk by chunk, so a very long run is spread over tasks: a window
    inside each chunk, and one over the chunk minima.
    """
    rows = history.where(F.col(value).isNotNull() & ~F.isnan(value)).withColumn(
        "_chunk", F.expr(f"epoch div {chunk}"))
    inside = Window.partitionBy("run_id", "_chunk").orderBy("epoch").rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy("run_id").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    earlier = (
        rows.groupBy("run_id", "_chunk").agg(F.min(value).alias("_chunk_min"))
        .withColumn("_before", F.min("_chunk_min").over(across)).drop("_chunk_min"))
    first = F.coalesce(F.least(F.min(value).over(inside), F.col("_before")), F.lit(float("inf")))
    return (
        rows.join(earlier, ["run_id", "_chunk"])
        .withColumn("_best", first).where(F.col(value) < F.col("_best"))
        .select("run_id", "epoch", F.col(value).alias("value")))


def early_stop(
    history: DataFrame, patience: int = PATIENCE, tol: float = TOLERANCE, value: str = "val_rmse",
    chunk: int = CHUNK, fan_in: int = FAN_IN,
) -> DataFrame:
    """Best epoch and stop epoch of each run with epochs 1, 2, 3, ...

    An epoch counts as better only when it undercuts the best by more than
    ``tol``, at most ``patience`` epochs after it, and such an epoch is always
    a running minimum.  What a chunk of minima does to the best is known from
    few numbers: a best from before the chunk can only be followed by one of
    the minima within ``patience`` epochs of the chunk's first, and each of
    these leaves the chunk with one best.  Such summaries of at most
    ``patience`` entries compose to summaries of the same kind, so a run is
    folded ``fan_in`` chunks at a time and no task sees all of it.
    ``stop_epoch`` is NULL for a run that ends before patience runs out.
    """
    ends = history.groupBy("run_id").agg(F.max("epoch").alias("last_epoch"))
    minima = running_minima(history, value, chunk).select(
        "run_id", F.col("epoch").cast("bigint").alias("epoch"), F.col("value").cast("double").alias("value"))
    kind = minima.schema["run_id"].dataType.simpleString()
    schema = f"run_id {kind}, part bigint, entries {ENTRIES}"
    # A chunk holds at most as many minima as epochs.
    parts = minima.groupBy("run_id", F.expr(f"epoch div {chunk}").alias("part")).agg(
        F.sort_array(F.collect_list(F.struct("epoch", "value"))).alias("rows"))
    parts = Workspace(history.sparkSession).stage(parts.mapInArrow(_per_row(lambda rows: _summary(rows, patience, tol)), schema), "summaries")
    last = parts.agg(F.max("part")).first()[0] or 0
    while last:
        last //= fan_in
        parts = parts.groupBy("run_id", F.expr(f"part div {fan_in}").alias("part")).agg(
            F.transform(F.sort_array(F.collect_list(F.struct("part", "entries"))), lambda p: p["entries"]).alias("rows"))
        parts = parts.mapInArrow(_per_row(lambda rows: _composed(rows, patience, tol)), schema)
    # The first entry is the first minimum; it is met with no best at epoch 0.
    first = F.get("entries", 0)
    met = first["epoch"] <= patience
    best = parts.select("run_id", F.when(met, first["exit_epoch"]).otherwise(0).alias("best_epoch"),
                        F.when(met, first["exit_value"]).otherwise(float("inf")).alias("best_value"))
    # A run without a single usable value has no minima, and stops too.
    stop = F.coalesce("best_epoch", F.lit(0)) + patience
    return (
        ends.join(best, "run_id", "left")
        .select("run_id", "best_epoch", "best_value",
                F.when(stop <= F.col("last_epoch"), stop).alias("stop_epoch"), "last_epoch"))


def _after(entries: list[dict], epoch: int, value: float, patience: int, tol: float) -> tuple[int, float]:
    """The best behind a chunk that is entered with this best."""
    for entry in entries:
        if entry["value"] < value - tol:
            late = entry["epoch"] > epoch + patience
            return (epoch, value) if late else (entry["exit_epoch"], entry["exit_value"])
    return epoch, value


def _summary(minima: list[dict], patience: int, tol: float) -> list[dict]:
    """Every minimum that an earlier best may be followed by, with the best that it leads to."""
    found = []
    for i, entered in enumerate(minima):
        if entered["epoch"] >= minima[0]["epoch"] + patience:
            break
        epoch, value = entered["epoch"], entered["value"]
        for row in minima[i + 1:]:
            if row["epoch"] > epoch + patience:
                break
            if row["value"] < value - tol:
                epoch, value = row["epoch"], row["value"]
        found.append({"epoch": entered["epoch"], "value": entered["value"], "exit_epoch": epoch, "exit_value": value})
    return found


def _composed(parts: list[list[dict]], patience: int, tol: float) -> list[dict]:
    """The summary of consecutive chunks from theirs."""
    done: list[dict] = []
    for entries in parts:
        moved = []
        for entry in done:
            epoch, value = _after(entries, entry["exit_epoch"], entry["exit_value"], patience, tol)
            moved.append({**entry, "exit_epoch": epoch, "exit_value": value})
        first = (done or entries)[0]["epoch"] if done or entries else 0
        done = moved + [e for e in entries if e["epoch"] < first + patience]
    return done


def _per_row(body):
    """``mapInArrow`` function that turns the list ``rows`` of every row into ``entries``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = [("epoch", pa.int64()), ("value", pa.float64()), ("exit_epoch", pa.int64()), ("exit_value", pa.float64())]
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([body(rows) for rows in batch.column(2).to_pylist()], pa.list_(pa.struct(fields)))],
                names=["run_id", "part", "entries"])

    return run


def curve_table(spark, losses: Sequence[float]) -> DataFrame:
    """``(iteration, loss)`` from 1; the list has one entry per training round."""
    return spark.createDataFrame(
        [(i, float(x)) for i, x in enumerate(losses, start=1)], "iteration int, loss double")


def loss_curve(model, data: DataFrame | None = None) -> DataFrame:
    """Loss per boosting round on ``data``, or per solver iteration of a linear fit."""
    if hasattr(model, "evaluateEachIteration"):
        return curve_table(data.sparkSession, model.evaluateEachIteration(data, "squared"))
    summary = model.summary
    return curve_table(summary.predictions.sparkSession, summary.objectiveHistory)
