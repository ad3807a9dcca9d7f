"""Job parameters with the bounds checked at construction."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from gaugeworks.functions.timegrid import as_utc, parse_frequency

# Missing-value strategies.
STRATEGIES = ("drop", "fill", "interpolate")
# Aggregations of the structured query.
AGGREGATIONS = ("mean", "max", "sum", "latest")


class WindowOrderError(ValueError):
    """A time window whose start is not before its end."""


def validate_window(start: datetime | None, end: datetime | None) -> None:
    """Both bounds given means start must lie strictly before end; naive bounds are UTC."""
    if start is not None and end is not None and as_utc(start) >= as_utc(end):
        raise WindowOrderError("start_time must be strictly before end_time")


@dataclass(frozen=True)
class ProcessingOptions:
    """How one batch run reads, cleans and resamples; ``stations=None`` means the whole fleet."""

    stations: tuple[str, ...] | None = None
    start_time: datetime | None = None
    end_time: datetime | None = None
    resample_frequency: str = "15min"
    missing_strategy: str = "fill"
    flatline_window_minutes: int = 30

    def __post_init__(self) -> None:
        if self.missing_strategy not in STRATEGIES:
            raise ValueError(f"missing_strategy must be one of {', '.join(STRATEGIES)}")
        if self.flatline_window_minutes < 1:
            raise ValueError("flatline_window_minutes must be at least 1")
        parse_frequency(self.resample_frequency)
        validate_window(self.start_time, self.end_time)


@dataclass(frozen=True)
class MetricThresholds:
    """When a device counts as running, and when its flow is large enough for a power ratio."""

    active_rpm: float = 500.0
    specific_power_flow: float = 1.0

    def __post_init__(self) -> None:
        if self.active_rpm < 0 or self.specific_power_flow < 0:
            raise ValueError("thresholds must not be negative")


@dataclass(frozen=True)
class MetricQuery:
    """Optional filters of a stored-metric read."""

    station_id: str | None = None
    device_id: str | None = None
    metric_name: str | None = None
    start_time: datetime | None = None
    end_time: datetime | None = None

    def __post_init__(self) -> None:
        validate_window(self.start_time, self.end_time)


@dataclass(frozen=True)
class StructuredQuery:
    """One bounded question about stored metrics; anything unclear must be left ``None``."""

    station_id: str | None = None
    device_id: str | None = None
    metric_name: str | None = None
    aggregation: str = "mean"
    start_time: str | None = None
    end_time: str | None = None
    needs_clarification: bool = False
    clarification_message: str | None = None

    def __post_init__(self) -> None:
        from gaugeworks.operators.metrics import METRIC_UNITS

        if self.aggregation not in AGGREGATIONS:
            raise ValueError(f"aggregation must be one of {', '.join(AGGREGATIONS)}")
        if self.metric_name is not None and self.metric_name not in METRIC_UNITS:
            raise ValueError(f"unsupported metric {self.metric_name!r}")
