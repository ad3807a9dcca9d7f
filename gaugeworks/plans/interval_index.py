"""Aggregates of stored metrics over blocks of days, for questions about time windows.

A window that begins and ends on one day belongs to that day. Days are put together by twos, fours and so on: block ``b`` of level
``j`` holds the days from ``b * 2 ** j`` on, counted from the table's first day. A question's whole days are a few such blocks,
at most two per level, whatever their number; only rows of the days on which it begins and ends are looked at one by one. Windows
over several days are in no block and stay rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Series of one device, and of all devices of a station together, whose device is null.
SERIES = ("station_id", "metric_name", "device_id")
BLOCK = ("level", "block")


def day_of(moment: str | Column) -> Column:
    return F.unix_date(F.to_date(moment))


def partials(rows_latest: Column) -> list[Column]:
    """What rows are reduced to; all of it can be added up further."""
    return [
        F.count(F.lit(1)).alias("matched"),
        F.count("metric_value").alias("known"),
        F.sum("metric_value").alias("total"),
        F.max("metric_value").alias("peak"),
        F.min(rows_latest).alias("latest"),
    ]


def merged() -> list[Column]:
    """Partials added up."""
    return [
        F.sum("matched").alias("matched"),
        F.sum("known").alias("known"),
        F.sum("total").alias("total"),
        F.max("peak").alias("peak"),
        F.min("latest").alias("latest"),
    ]


@dataclass(frozen=True)
class IntervalIndex:
    """``blocks`` has a row per series and block, ``short`` the rows that the blocks hold, ``long`` the others."""

    blocks: DataFrame
    short: DataFrame
    long: DataFrame
    first_day: int
    last_day: int

    @property
    def levels(self) -> int:
        return max(1, (self.last_day - self.first_day + 1).bit_length())


def build_index(metrics: DataFrame, latest: Column) -> IntervalIndex:
    """Index a stored table of metrics; ``latest`` sorts rows, the latest first. Building reads the table once more."""
    begins, ends = day_of("window_start"), day_of("window_end")
    first, last = metrics.agg(F.min(begins), F.max(ends)).first()
    first, last = (0, 0) if first is None or last is None else (first, last)
    short = metrics.where(begins == ends).withColumn("_day", begins - first)
    long = metrics.where(~(begins == ends))
    index = IntervalIndex(short, short, long, first, last)
    days = short.groupBy(*SERIES, "_day").agg(*partials(latest))
    # Of every day its own series and that of the station, and the block of each level.
    both = F.explode(F.array(F.struct(F.col("device_id").alias("d")), F.struct(F.lit(None).cast("string").alias("d"))))
    spread = days.withColumn("_of", both).withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(index.levels - 1))))
    blocks = (
        spread.withColumn("block", F.expr("shiftright(_day, level)"))
        .groupBy("station_id", "metric_name", F.col("_of.d").alias("device_id"), *BLOCK)
        .agg(*merged())
    )
    return IntervalIndex(blocks, short, long, first, last)


def blocks_between(first: Column, last: Column, levels: int) -> Column:
    """The blocks that make up the days ``first`` to ``last``, as structs of level and block; none if there is no day."""
    start = F.struct(
        first.cast("int").alias("a"),
        last.cast("int").alias("b"),
        F.array().cast("array<struct<level:int,block:int>>").alias("found"),
    )

    def step(state: Column, level: Column) -> Column:
        a, b = state["a"], state["b"]

        def here(block: Column, wanted: Column) -> Column:
            made = F.array(F.struct(level.cast("int").alias("level"), block.cast("int").alias("block")))
            return F.when(wanted, made).otherwise(F.array().cast("array<struct<level:int,block:int>>"))

        # An odd first block has no parent that lies within, nor has an even last one.
        odd, even = (a <= b) & (a % 2 == 1), (a <= b) & (b % 2 == 0)
        found = F.concat(state["found"], here(a, odd), here(b, even))
        a, b = F.when(odd, a + 1).otherwise(a), F.when(even, b - 1).otherwise(b)
        over = a > b
        return F.struct(
            F.when(over, 1).otherwise(F.shiftright(a, 1)).cast("int").alias("a"),
            F.when(over, 0).otherwise(F.shiftright(b, 1)).cast("int").alias("b"),
            found.alias("found"),
        )

    return F.aggregate(F.sequence(F.lit(0), F.lit(levels)), start, step, lambda state: state["found"])
