"""Seven operating figures per device from resampled readings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.config import MetricThresholds
from gaugeworks.functions.timegrid import HOUR_US, micros, parse_frequency
from gaugeworks.operators.normalize import DEVICE_KEYS, TIME
from gaugeworks.operators.slices import neighbours, slice_grid

# Metric names and their units.
METRIC_UNITS = {
    "active_duration_hours": "h",
    "active_ratio_pct": "%",
    "average_pressure_bar": "bar",
    "peak_pressure_bar": "bar",
    "mean_specific_power_kw_per_m3h": "kW/(m3/h)",
    "cycle_count": "count",
    "total_flow_volume_m3": "m3",
}


def is_active(thresholds: MetricThresholds) -> Column:
    """Running: speed strictly above the threshold; an unknown speed counts as standing still."""
    return F.coalesce(F.col("motor_speed"), F.lit(0.0)) > F.lit(float(thresholds.active_rpm))


def has_flow(thresholds: MetricThresholds) -> Column:
    """Flow strictly above the threshold; an unknown flow counts as none."""
    return _flow() > F.lit(float(thresholds.specific_power_flow))


def _flow() -> Column:
    return F.coalesce(F.col("air_flow_rate"), F.lit(0.0))


def bin_steps(
    resampled: DataFrame,
    frequency: str,
    thresholds: MetricThresholds,
    keys: Sequence[str] = DEVICE_KEYS,
) -> DataFrame:
    """Bins with whether the device ran, and the step and state coming from the bin before."""
    bins = resampled.withColumn("active", is_active(thresholds))
    sliced = slice_grid(bins, keys, TIME, parse_frequency(frequency))
    rows = neighbours(sliced, {"bin": F.struct(F.col(TIME).alias("at"), F.col("active").alias("ran"))})
    return rows.withColumn("step_us", micros(TIME) - micros(F.col("bin_before")["at"]))


def with_ranks(counted: DataFrame, keys: Sequence[str], value: str, count: str) -> DataFrame:
    """Add ``_reached``, how many of a key's positive values are as large as the row's or larger, and ``_all`` of them.

    ``counted`` has one row per key and value: a key has as many rows as it has different values, however often they occur.
    """
    positive = F.when(F.col(value) > 0, F.col(count)).otherwise(0)
    within = Window.partitionBy(*keys)
    falling = within.orderBy(F.desc(value)).rowsBetween(Window.unboundedPreceding, 0)
    return counted.select("*", F.sum(positive).over(falling).alias("_reached"), F.sum(positive).over(within).alias("_all"))


def upper_median(value: str) -> Column:
    """Of rows as ``with_ranks`` makes them: the largest positive value with half of all at least as large."""
    return F.max(F.when((F.col(value) > 0) & (F.col("_reached") * 2 >= F.col("_all")), F.col(value)))


def device_metrics_wide(
    resampled: DataFrame,
    frequency: str,
    thresholds: MetricThresholds | None = None,
    *,
    runs: Sequence[str] = (),
) -> DataFrame:
    """One row per device with the seven figures as columns.

    Bins are added up per device and step first. A device has few different steps, so the median step is found by counting
    through them, and the same rows give all other figures.

    ``runs`` names columns that tell several runs in one table apart, such as the day of daily runs;
    each run of a device is then computed on its own.
    """
    thresholds = thresholds or MetricThresholds()
    keys = (*DEVICE_KEYS, *runs)
    rows = bin_steps(resampled, frequency, thresholds, keys)
    active = F.col("active")
    started = active & F.coalesce(~F.col("bin_before")["ran"], F.lit(False))
    power_per_flow = F.when(
        has_flow(thresholds), F.try_divide(F.col("power_consumption"), F.col("air_flow_rate"))
    )
    by_step = (
        rows.withColumn("_power_per_flow", power_per_flow)
        .groupBy(*keys, "step_us")
        .agg(
            F.min(TIME).alias("window_start"),
            F.max(TIME).alias("window_end"),
            F.count(F.lit(1)).alias("bins"),
            F.count_if(active).alias("_active_bins"),
            F.sum("discharge_pressure").alias("_pressure"),
            F.count("discharge_pressure").alias("_pressures"),
            F.max("discharge_pressure").alias("_peak"),
            F.sum("_power_per_flow").alias("_power"),
            F.count("_power_per_flow").alias("_powers"),
            F.count_if(started).alias("_starts"),
            F.sum(_flow()).alias("_flow"),
        )
    )
    sums = ("bins", "_active_bins", "_pressure", "_pressures", "_power", "_powers", "_starts", "_flow")
    interval = F.coalesce(upper_median("step_us"), F.lit(parse_frequency(frequency))).cast("double")
    facts = (
        with_ranks(by_step, keys, "step_us", "bins")
        .groupBy(*keys)
        .agg(
            F.min("window_start").alias("window_start"),
            F.max("window_end").alias("window_end"),
            (interval / float(HOUR_US)).alias("interval_hours"),
            F.max("_peak").alias("_peak"),
            *[F.sum(name).alias(name) for name in sums],
        )
    )
    hours = F.col("interval_hours")
    figures = {
        "active_duration_hours": F.col("_active_bins") * hours,
        "active_ratio_pct": F.col("_active_bins") / F.col("bins") * 100.0,
        "average_pressure_bar": F.coalesce(F.try_divide("_pressure", "_pressures"), F.lit(0.0)),
        "peak_pressure_bar": F.coalesce("_peak", F.lit(0.0)),
        "mean_specific_power_kw_per_m3h": F.coalesce(F.try_divide("_power", "_powers"), F.lit(0.0)),
        "cycle_count": F.col("_starts").cast("double"),
        "total_flow_volume_m3": F.col("_flow") * hours,
    }
    return facts.select(
        *keys,
        "window_start",
        "window_end",
        "bins",
        "interval_hours",
        *[column.alias(name) for name, column in figures.items()],
    )


def device_metrics(
    resampled: DataFrame,
    frequency: str,
    strategy: str,
    thresholds: MetricThresholds | None = None,
    *,
    runs: Sequence[str] = (),
) -> DataFrame:
    """The stored form: seven rows per device, with unit, window and the options used."""
    wide = device_metrics_wide(resampled, frequency, thresholds, runs=runs)
    return metric_rows(wide, frequency, strategy)


def metric_rows(wide: DataFrame, frequency: str, strategy: str) -> DataFrame:
    """One row per device and metric from one row per device."""
    rows = [
        F.struct(
            F.lit(name).alias("metric_name"),
            F.col(name).alias("metric_value"),
            F.lit(unit).alias("unit"),
        )
        for name, unit in METRIC_UNITS.items()
    ]
    return wide.select(
        *DEVICE_KEYS,
        F.inline(F.array(*rows)),
        "window_start",
        "window_end",
        F.current_timestamp().alias("computed_at"),
        F.lit(frequency).alias("resample_frequency"),
        F.lit(strategy).alias("missing_strategy"),
    )
