"""Bounded-state event processing: a watermark decides how late an event may be.

Opt-in alternative to the exact mode. State stays small because buckets and ids older than the
watermark are dropped; the price is that later events no longer count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.contract import Contract
from gaugeworks.functions.timegrid import BUCKETS
from gaugeworks.operators.events import GOOD, STAGE, in_range, parse_events
from gaugeworks.operators.normalize import DEVICE_KEYS


def windowed_aggregates(events: DataFrame, contract: Contract, bucket: str, lateness: str) -> DataFrame:
    """Aggregates of one bucket size over a stream, final once the watermark passes the bucket."""
    if bucket not in BUCKETS:
        raise ValueError(f"buckets are {", ".join(BUCKETS)}, not {bucket!r}")
    readings = (
        parse_events(events, contract)
        .filter(F.col(STAGE) == GOOD)
        .withWatermark("event_time", lateness)
        .dropDuplicatesWithinWatermark(["event_id"])
    )
    values = [
        F.struct(F.lit(rule.name).alias("metric_type"), in_range(rule).alias("value"))
        for rule in contract.numeric()
    ]
    long = readings.select(*DEVICE_KEYS, "event_time", F.inline(F.array(*values))).filter(
        F.col("value").isNotNull()
    )
    return (
        long.groupBy(F.window("event_time", f"1 {bucket}").alias("_window"), *DEVICE_KEYS, "metric_type")
        .agg(
            F.count(F.lit(1)).alias("count"),
            F.sum("value").alias("total"),
            F.min("value").alias("min_value"),
            F.max("value").alias("max_value"),
            F.avg("value").alias("avg"),
            F.max("event_time").alias("latest_timestamp"),
        )
        .select(
            *DEVICE_KEYS,
            "metric_type",
            F.lit(bucket).alias("bucket"),
            F.col("_window")["start"].alias("bucket_start"),
            "count",
            "total",
            "min_value",
            "max_value",
            "avg",
            "latest_timestamp",
        )
    )
