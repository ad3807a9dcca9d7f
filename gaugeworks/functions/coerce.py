"""Typed values out of untrusted text: anything unreadable becomes null, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Spark reads "1d" and "1f" as numbers (Java suffixes); readings do not use that spelling.
_JAVA_SUFFIX = r"[0-9.][dDfF]\s*$"
# Spark also reads "2024" and "10:00" as timestamps; only a full ISO date with an optional time is one.
_ISO_TIMESTAMP = (
    r"^\s*\d{4}-\d{2}-\d{2}"
    r"([T ]\d{2}(:\d{2}(:\d{2}(\.\d+)?)?)?\s*(Z|[+-]\d{2}(:?\d{2})?)?)?\s*$"
)


def number_from_text(text: Column) -> Column:
    """Text to double; NaN and unreadable text are null, infinities stay."""
    value = F.when(~text.rlike(_JAVA_SUFFIX), text).try_cast("double")
    return F.nanvl(value, F.lit(None).cast("double"))


def to_number(column: Column, data_type: T.DataType) -> Column:
    if isinstance(data_type, T.StringType):
        return number_from_text(column)
    return F.nanvl(column.cast("double"), F.lit(None).cast("double"))


def is_present(column: Column, data_type: T.DataType) -> Column:
    """Whether the raw value counts as given; a floating NaN is missing already."""
    if isinstance(data_type, (T.DoubleType, T.FloatType)):
        return column.isNotNull() & ~F.isnan(column)
    return column.isNotNull()


def timestamp_from_text(text: Column) -> Column:
    """ISO-8601 text to a timestamp; without an offset it is UTC (the session zone)."""
    return F.when(text.rlike(_ISO_TIMESTAMP), text).try_cast("timestamp")


def to_timestamp(column: Column, data_type: T.DataType) -> Column:
    if isinstance(data_type, T.StringType):
        return timestamp_from_text(column)
    return column.cast("timestamp")
