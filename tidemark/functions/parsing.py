"""Lenient parsing: bad input becomes NULL, never an error."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Text that a delimited-file reader treats as missing.
MISSING_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None",
    "n/a", "nan", "null",
]

# A cast alone would accept Java suffixes such as '12d'.
NUMBER_PATTERN = r"(?i)^\s*[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf|infinity)\s*$"


def named(name: str) -> Column:
    """Column by exact name, also when the name contains a dot."""
    return F.col("`" + name.replace("`", "``") + "`")


def col_or_null(df: DataFrame, name: str, dtype: str = "string") -> Column:
    """The column cast to ``dtype``, or all NULL when the table lacks it."""
    if name in df.columns:
        return named(name).cast(dtype)
    return F.lit(None).cast(dtype)


def missing_to_null(c: Column) -> Column:
    return F.when(~c.isin(MISSING_TOKENS), c)


def parse_number(text: Column) -> Column:
    """Text to double; anything that is not wholly a number is NULL."""
    return F.when(text.rlike(NUMBER_PATTERN), F.trim(text).try_cast("double"))


#: A clock time followed by a zone offset.
OFFSET_PATTERN = r":\d{2}(\.\d+)?\s*(Z|[+-]\d{1,2}(:?\d{2})?)\s*$"


def parse_instant(text: Column, formats: Sequence[str] = ()) -> Column:
    """ISO text to timestamp_ntz; further formats are tried in order."""
    parsed = [text.try_cast("timestamp_ntz")]
    parsed += [F.try_to_timestamp(text, F.lit(f)).cast("timestamp_ntz") for f in formats]
    return F.coalesce(*parsed)


def double_of(df: DataFrame, name: str) -> Column:
    """Column ``name`` as double with NaN and bad text turned into NULL."""
    if name not in df.columns:
        return F.lit(None).cast("double")
    dtype = df.schema[name].dataType
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        value = named(name).cast("double")
        return F.when(~F.isnan(value), value)
    if isinstance(dtype, (T.NumericType, T.BooleanType)):
        return named(name).cast("double")
    return parse_number(named(name).cast("string"))


def instant_of(df: DataFrame, name: str, formats: Sequence[str] = ()) -> Column:
    """Column ``name`` as timestamp_ntz with bad text turned into NULL."""
    if name not in df.columns:
        return F.lit(None).cast("timestamp_ntz")
    if isinstance(df.schema[name].dataType, T.StringType):
        return parse_instant(named(name), formats)
    return named(name).cast("timestamp_ntz")


def utc_instant_of(df: DataFrame, name: str) -> Column:
    """Like :func:`instant_of`, but a text with an offset is moved to UTC.

    A text without an offset is taken as UTC already, whatever the session's zone.
    """
    plain = instant_of(df, name)
    if name not in df.columns or not isinstance(df.schema[name].dataType, T.StringType):
        return plain
    text = named(name)
    moved = F.convert_timezone(F.current_timezone(), F.lit("UTC"), text.try_cast("timestamp").cast("timestamp_ntz"))
    return F.when(text.rlike(OFFSET_PATTERN), moved).otherwise(plain)
