"""Timestamp gaps and flatlines."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.contract import Contract
from gaugeworks.functions.timegrid import MINUTE_US, micros
from gaugeworks.operators.clean import known_points, known_time
from gaugeworks.operators.normalize import DEVICE, STATION, TIME
from gaugeworks.operators.slices import SLICE, SlicedRows, attach_per_key, gather, neighbours


def expected_intervals(steps: DataFrame, keys: Sequence[str], step: str) -> DataFrame:
    """The most frequent positive step per key, the shorter one on ties.

    Equal steps are counted first and every partition then sends its best candidate only, so a key with
    many steps, or with many different ones, never gathers them in one task.
    """
    counted = steps.filter(F.col(step) > 0).groupBy(*keys, step).agg(F.count(F.lit(1)).alias("_n"))
    best = F.max(F.struct(F.col("_n"), (-F.col(step)).alias("_minus")))
    return counted.groupBy(*keys).agg((-best["_minus"]).alias("expected_us"))


def time_steps(sliced: SlicedRows) -> DataFrame:
    """Every reading with the time since the device's previous one in ``step_us``."""
    rows = neighbours(sliced.select(), {"moment": F.col(TIME)})
    return rows.withColumn("step_us", micros(TIME) - micros("moment_before"))


def device_intervals(sliced: SlicedRows) -> DataFrame:
    """The expected interval of each device."""
    return expected_intervals(time_steps(sliced), sliced.keys, "step_us")


def detect_gaps(sliced: SlicedRows) -> DataFrame:
    """Steps longer than the device's expected interval, with the number of readings missing."""
    steps = time_steps(sliced)
    intervals = expected_intervals(steps, sliced.keys, "step_us")
    longer = attach_per_key(sliced, steps.filter(F.col("step_us") > 0), intervals).filter(
        F.col("step_us") > F.col("expected_us")
    )
    ratio = F.col("step_us").cast("double") / F.col("expected_us")
    return longer.select(
        STATION,
        DEVICE,
        F.col("moment_before").alias("gap_start"),
        F.col(TIME).alias("gap_end"),
        F.greatest(F.bround(ratio, 0).cast("bigint") - 1, F.lit(1).cast("bigint")).alias(
            "missing_intervals"
        ),
    )


def flatline_thresholds(contract: Contract, default_minutes: int) -> dict[str, int]:
    return {name: contract.flatline_minutes(name, default_minutes) for name in contract.numeric_names()}


def detect_flatlines(sliced: SlicedRows, thresholds: Mapping[str, int]) -> DataFrame:
    """Stretches in which a sensor repeats one value for at least its threshold in minutes.

    A stretch ends where the value changes or where the sensor pauses for more than one and a half of
    its own expected intervals. The five sensors go through the windows side by side, so readings are
    shuffled once and never multiplied before they are reduced to stretches.
    """
    sensors = list(thresholds)
    narrow = sliced.select(*sensors)
    if not narrow.laid_out:
        narrow = gather(narrow)  # looked at twice: for the sensors' intervals, and for the stretches
    rows = neighbours(narrow, known_points(sensors))
    rows = attach_per_key(sliced, rows, _sensor_intervals(narrow, sensors))

    within = sliced.within
    ordered = Window.partitionBy(*within).orderBy(*sliced.order)
    so_far = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.select(
        *within,
        TIME,
        *sensors,
        *[
            F.when(F.col(name).isNotNull() & ~_breaks(name), F.col(f"{name}_at_before")).alias(
                f"{name}_since"
            )
            for name in sensors
        ],
        *[
            F.sum(_breaks(name).cast("bigint")).over(so_far).alias(f"{name}_stretch")
            for name in sensors
        ],
        F.lead(F.lit(True)).over(ordered).isNull().alias("_closes"),
    )
    # Only readings that repeat the one before go on, each knowing when that one was read, and the last
    # row of a slice, which tells how many stretches it had. Stretches of a single reading, most of them
    # in a live signal, never reach the aggregation.
    fields = {"value": "{}", "since_us": "{}_since", "stretch": "{}_stretch"}
    repeats = F.col("since_us").isNotNull()
    pieces = (
        _per_sensor(rows, within, sensors, fields, TIME, "_closes")
        .filter(repeats | F.col("_closes"))
        .groupBy(*within, "column", "stretch")
        .agg(
            F.min("since_us").alias("start_us"),
            F.max(F.when(repeats, micros(TIME))).alias("end_us"),
            F.min(F.when(repeats, F.col("value"))).alias("value"),
        )
    )
    stretches = _joined_stretches(pieces, sliced.keys, thresholds).filter(_is_long(thresholds))
    return stretches.select(
        STATION,
        DEVICE,
        "column",
        F.timestamp_micros("start_us").alias("start_time"),
        F.timestamp_micros("end_us").alias("end_time"),
        _duration_minutes().alias("duration_minutes"),
        "value",
    )


def _breaks(name: str) -> Column:
    """Whether a reading of this sensor starts a new stretch; a missing one never does."""
    value, before = F.col(name), F.col(f"{name}_before")
    pause = micros(TIME) - F.col(f"{name}_at_before")
    # pause > 1.5 * expected, in whole microseconds; without an expected interval no pause is long.
    paused = F.coalesce(pause * 2 > F.col(f"{name}_expected") * 3, F.lit(False))
    return value.isNotNull() & (before.isNull() | (value != before) | paused)


def _sensor_intervals(sliced: SlicedRows, sensors: Sequence[str]) -> DataFrame:
    """One row per device with the expected interval of each sensor's own non-null series."""
    rows = neighbours(sliced, {name: known_time(name) for name in sensors})
    steps = rows.select(
        *sliced.keys, *[(known_time(name) - F.col(f"{name}_before")).alias(name) for name in sensors]
    )
    keys = list(sliced.keys)
    long = _per_sensor(steps, keys, sensors, {"step_us": "{}"})
    intervals = expected_intervals(long, [*keys, "column"], "step_us")
    return intervals.groupBy(*keys).agg(
        *[
            F.max(F.when(F.col("column") == name, F.col("expected_us"))).alias(f"{name}_expected")
            for name in sensors
        ]
    )


def _per_sensor(
    rows: DataFrame, keep: Sequence[str], sensors: Sequence[str], fields: Mapping[str, str], *also: str
) -> DataFrame:
    """One row per reading and sensor; ``fields`` maps new names to patterns of old ones."""
    entries = [
        F.struct(
            F.lit(name).alias("column"),
            *[F.col(pattern.format(name)).alias(field) for field, pattern in fields.items()],
        )
        for name in sensors
    ]
    return rows.select(*keep, *also, F.inline(F.array(*entries)))


def _joined_stretches(
    pieces: DataFrame, keys: Sequence[str], thresholds: Mapping[str, int]
) -> DataFrame:
    """Put stretches together that a slice boundary cut in two.

    Only a slice's last stretch can go on in a later slice, and only stretch 0 (readings before the
    slice's first break) can be such a continuation. All others are complete and matter only if they
    are long enough. What is left to order per series is bounded by its calendar time, not its readings.
    """
    series = [*keys, "column"]
    last = F.max("stretch").over(Window.partitionBy(*keys, SLICE, "column"))
    open_ended = (F.col("stretch") == 0) | (F.col("stretch") == F.col("_last"))
    left = pieces.withColumn("_last", last).filter(open_ended | _is_long(thresholds))

    along = Window.partitionBy(*series).orderBy(SLICE, "stretch")
    started = F.sum((F.col("stretch") > 0).cast("bigint")).over(
        along.rowsBetween(Window.unboundedPreceding, 0)
    )
    return (
        left.withColumn("_run", started)
        .groupBy(*series, "_run")
        .agg(
            F.min("start_us").alias("start_us"),
            F.max("end_us").alias("end_us"),
            F.min("value").alias("value"),
        )
    )


def _is_long(thresholds: Mapping[str, int]) -> Column:
    limits = F.create_map(
        *[F.lit(item) for name, minutes in thresholds.items() for item in (name, float(minutes))]
    )
    return _duration_minutes() >= limits[F.col("column")]


def _duration_minutes() -> Column:
    return (F.col("end_us") - F.col("start_us")).cast("double") / float(MINUTE_US)


def warning_texts(out_of_range_total: Column, gaps: Column, flatlines: Column) -> Column:
    """The report's warnings in fixed order; kinds without findings are left out."""

    def warn(count: Column, text: str) -> Column:
        return F.when(count > 0, F.concat(count.cast("string"), F.lit(text)))

    return F.array_compact(
        F.array(
            warn(out_of_range_total, " out-of-range values were nullified"),
            warn(gaps, " timestamp gaps detected"),
            warn(flatlines, " flatline periods detected"),
        )
    )
