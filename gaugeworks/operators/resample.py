"""Means per device and time bin."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.functions.timegrid import (
    DAY_US,
    divides_day,
    floor_to_step,
    micros,
    parse_frequency,
    shared_grain,
)
from gaugeworks.operators.normalize import DEVICE_KEYS, TIME
from gaugeworks.operators.slices import join_per_key
from gaugeworks.session import write_down


def resample_mean(frame: DataFrame, frequency: str, sensors: Sequence[str]) -> DataFrame:
    """Mean of each sensor per device and bin; bins without any value are left out.

    Bins count from midnight of the device's first reading. Where the frequency divides a day every
    midnight is a bin start and no origin is needed: one aggregation. Otherwise readings are first
    reduced to the longest grain that both days and bins consist of, and the origin comes from those
    grains, which are written down, so the readings themselves are read and shuffled once.
    """
    step = parse_frequency(frequency)
    sums = [F.sum(name).alias(f"{name}_sum") for name in sensors]
    counts = [F.count(name).alias(f"{name}_n") for name in sensors]
    if divides_day(step):
        binned = frame.groupBy(*DEVICE_KEYS, _bin(step)).agg(*[F.avg(n).alias(n) for n in sensors])
    else:
        grains = write_down(frame.groupBy(*DEVICE_KEYS, _bin(shared_grain(step))).agg(*sums, *counts))
        origin_us = floor_to_step(F.min(micros(TIME)), DAY_US)
        origins = grains.groupBy(*DEVICE_KEYS).agg(origin_us.alias("_origin"))
        placed = join_per_key(grains, origins, DEVICE_KEYS, TIME).withColumn(
            TIME, F.timestamp_micros(floor_to_step(micros(TIME), step, F.col("_origin")))
        )
        binned = placed.groupBy(*DEVICE_KEYS, TIME).agg(
            *[
                F.try_divide(F.sum(f"{name}_sum"), F.sum(f"{name}_n")).alias(name)
                for name in sensors
            ]
        )
    return binned.select(*DEVICE_KEYS, TIME, *sensors).dropna(how="all", subset=list(sensors))


def _bin(step_us: int):
    return F.timestamp_micros(floor_to_step(micros(TIME), step_us)).alias(TIME)
