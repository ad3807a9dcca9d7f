"""Missing-value strategies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks.config import STRATEGIES
from gaugeworks.functions.timegrid import micros
from gaugeworks.operators.normalize import DEVICE_KEYS, TIME
from gaugeworks.operators.slices import SlicedRows, neighbours, slice_rows


def drop_unusable(frame: DataFrame) -> DataFrame:
    """Without time, station or device a reading cannot be placed in any series."""
    placed = [F.col(name).isNotNull() for name in (*DEVICE_KEYS, TIME)]
    return frame.filter(placed[0] & placed[1] & placed[2])


def reading_order(frame: DataFrame, sensors: Sequence[str]) -> list[str]:
    """Time, then the event id where there is one, then the values themselves.

    Times repeat within a device; the extra columns make the order the same on every run. Rows that
    agree in all of them are copies of each other and need no order.
    """
    return [TIME, *(["event_id"] if "event_id" in frame.columns else sensors)]


def slice_readings(
    frame: DataFrame, sensors: Sequence[str], *, counted: DataFrame | None = None, **limits: int
) -> SlicedRows:
    usable = drop_unusable(frame)
    return slice_rows(usable, DEVICE_KEYS, reading_order(frame, sensors), counted=counted, **limits)


def drop_incomplete(frame: DataFrame, sensors: Sequence[str]) -> DataFrame:
    """Strategy ``drop``: only readings with every sensor present. No shuffle.

    The sensors pass through a one-element array first: the null checks would otherwise be moved in
    front of the coercion and repeat all of it.
    """
    others = [name for name in frame.columns if name not in sensors]
    values = F.inline(F.array(F.struct(*sensors)))
    return (
        drop_unusable(frame)
        .select(*others, values)
        .dropna(how="any", subset=list(sensors))
        .select(*frame.columns)
    )


def forward_fill(sliced: SlicedRows, sensors: Sequence[str]) -> DataFrame:
    """Strategy ``fill``: the device's last known value; nulls before the first one stay."""
    rows = neighbours(sliced, {name: F.col(name) for name in sensors})
    return _with_columns(
        sliced, rows, {name: F.coalesce(F.col(name), F.col(f"{name}_before")) for name in sensors}
    )


def interpolate(sliced: SlicedRows, sensors: Sequence[str]) -> DataFrame:
    """Strategy ``interpolate``: linear in time between known values.

    Nulls before the first known value stay; nulls after the last one take it.
    """
    rows = neighbours(sliced, known_points(sensors), following=True)
    return _with_columns(sliced, rows, {name: _linear(name) for name in sensors})


def _linear(name: str) -> Column:
    at, value = F.col(f"{name}_at_before"), F.col(f"{name}_before")
    span = (F.col(f"{name}_at_after") - at).cast("double")
    # No later value, or both neighbours at the same instant: no slope, keep the earlier value.
    slope = F.coalesce(F.try_divide(F.col(f"{name}_after") - value, span), F.lit(0.0))
    return F.coalesce(F.col(name), value + slope * (micros(TIME) - at))


def known_points(sensors: Sequence[str]) -> dict[str, Column]:
    """Each sensor's value under its own name, and when it was read under ``<name>_at``."""
    points = {}
    for name in sensors:
        points[name] = F.col(name)
        points[f"{name}_at"] = known_time(name)
    return points


def known_time(name: str) -> Column:
    """The time of a reading in microseconds, where it has a value for the sensor."""
    return F.when(F.col(name).isNotNull(), micros(TIME))


def apply_strategy(
    frame: DataFrame, sensors: Sequence[str], strategy: str, sliced: SlicedRows | None = None
) -> DataFrame:
    """Readings after the chosen strategy; rows without time, station or device are gone."""
    if strategy not in STRATEGIES:
        raise ValueError(f"missing_strategy must be one of {', '.join(STRATEGIES)}")
    if strategy == "drop":
        return drop_incomplete(frame, sensors)
    sliced = sliced or slice_readings(frame, sensors)
    rows = forward_fill(sliced, sensors) if strategy == "fill" else interpolate(sliced, sensors)
    return rows.select(*frame.columns)


def _with_columns(sliced: SlicedRows, rows: DataFrame, changed: dict[str, Column]) -> DataFrame:
    return rows.select(
        *[changed[name].alias(name) if name in changed else name for name in sliced.rows.columns]
    )
