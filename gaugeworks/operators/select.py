"""Selection by rank without sorting everything: which rows are the newest so many.

The cut is found by histograms of the first key: its range is parted into ``STEPS`` steps, rows are counted per step, and the
step in which the asked rank lies is parted again, until one value is left. Only counts move. Rows above that value
stay by a filter; rows that have it are ranked by the other keys, laid out by range, so that no partition takes them all.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, TimestampType

from gaugeworks.session import write_down

STEPS = 1024
#: Stands for null keys.
LEAST = -(1 << 63)
# Below so many bits of ``monotonically_increasing_id`` is the place of a row in its partition.
_PLACE_BITS = 33


@dataclass(frozen=True)
class Cut:
    """``above`` rows have a key greater than ``value``; with those that have it they reach the asked number."""

    value: int
    above: int
    equal: int


def as_number(frame: DataFrame, name: str) -> Column:
    """A whole-number, date or timestamp column as a number of the same order."""
    kind = frame.schema[name].dataType
    if isinstance(kind, TimestampType):
        return F.unix_micros(name)
    if isinstance(kind, DateType):
        return F.unix_date(name).cast("bigint")
    return F.col(name).cast("bigint")


def find_cut(frame: DataFrame, key: Column, limit: int, steps: int = STEPS) -> Cut | None:
    """Where the ``limit`` greatest keys end, or ``None`` if there are no more rows than that. Null keys are the smallest.

    Each round reads the key only and brings at most ``steps`` counts to the driver; a range of 2 ** 60 takes six rounds.
    """
    low, high, known, count = frame.agg(F.min(key), F.max(key), F.count(key), F.count(F.lit(1))).first()
    if count <= limit:
        return None
    if known < limit:
        return Cut(LEAST, known, count - known)
    above = 0
    while True:
        width = -(-(high - low + 1) // steps)
        inside = frame.where(key.between(F.lit(low), F.lit(high))).select(key.alias("key"))
        counted = inside.groupBy(F.expr(f"(key - {low}L) div {width}L").alias("step")).count()
        counts = {row["step"]: row["count"] for row in counted.collect()}
        for place in sorted(counts, reverse=True):
            if above + counts[place] >= limit:
                break
            above += counts[place]
        low, high = low + place * width, min(high, low + (place + 1) * width - 1)
        if low == high:
            return Cut(low, above, counts[place])


def first_rows(frame: DataFrame, order: list[Column], limit: int) -> DataFrame:
    """The first ``limit`` rows in an order, by ranges: partitions before the rank stay whole, one is cut. Columns as before."""
    laid = frame.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    laid = write_down(laid)
    part, left, last = F.shiftright("_at", _PLACE_BITS), limit, None
    for row in sorted(laid.groupBy(part.alias("part")).count().collect()):
        if row["count"] >= left:
            last = (row["part"] << _PLACE_BITS) + left
            break
        left -= row["count"]
    kept = laid if last is None else laid.where(F.col("_at") < F.lit(last))
    return kept.drop("_at")


def newest_rows(frame: DataFrame, key: str, ties: list[Column], limit: int) -> DataFrame:
    """The ``limit`` rows with the greatest ``key``; of those that share the last one the first by ``ties`` stay.

    ``frame`` is read several times, so it should be stored. Rows alike in all keys are interchangeable.
    """
    if limit < 1:
        raise ValueError(f"at least one row has to stay, got {limit}")
    number = as_number(frame, key)
    cut = find_cut(frame, number, limit)
    if cut is None:
        return frame
    least = F.coalesce(number, F.lit(LEAST))
    if cut.above + cut.equal == limit:
        return frame.where(least >= F.lit(cut.value))
    tied = first_rows(frame.where(least == F.lit(cut.value)), ties, limit - cut.above)
    return frame.where(least > F.lit(cut.value)).unionByName(tied)
