"""Tidemark: time-ordered model evaluation as Spark DataFrame operators.

Every operator takes and returns DataFrames.  Row-level work stays on the
executors; what reaches the driver is a fitted statistic of fixed size (cut
points, medians, bin edges) or a metric table.  Fitted statistics become
literals in the next plan, so split filters reach the Parquet scan and no join
is needed to apply them.
"""

__version__ = "0.1.0"
