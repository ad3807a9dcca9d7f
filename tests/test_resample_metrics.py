from datetime import datetime

import pytest
from frames import SENSORS, at, rows, series, typed
from pyspark.sql import functions as F

from gaugeworks.config import MetricThresholds
from gaugeworks.operators.metrics import METRIC_UNITS, device_metrics, device_metrics_wide
from gaugeworks.operators.resample import resample_mean


def test_mean_per_bin_without_empty_bins(spark):
    out = resample_mean(series(spark, [0, 5, 10, 15, 60], [6, 8, 10, 12, None]), "10min", SENSORS)
    assert rows(out, "timestamp", "discharge_pressure") == [(at(0), 7.0), (at(10), 11.0)]
    assert resample_mean(series(spark, [], []), "10min", SENSORS).count() == 0


def test_devices_have_their_own_bins(spark):
    frame = series(spark, [0, 1], [4, 6], device="A").unionByName(
        series(spark, [0, 1], [10, 20], device="B")
    )
    out = resample_mean(frame, "1h", SENSORS)
    assert rows(out, "device_id", "discharge_pressure") == [("A", 5.0), ("B", 15.0)]


def test_bins_count_from_midnight_of_the_first_reading(spark):
    day = 24 * 60
    frame = series(spark, [10, 9 * 60 + 10], [1, 2], device="A").unionByName(
        series(spark, [day + 63, 2 * day + 60], [3, 4], device="B")
    )
    out = resample_mean(frame, "5h", SENSORS)
    assert rows(out, "device_id", "timestamp", "discharge_pressure") == [
        ("A", at(0), 1.0),
        ("A", at(300), 2.0),
        ("B", at(day), 3.0),
        ("B", at(2 * day + 60), 4.0),
    ]


def quarter_hours(spark):
    columns = {
        "discharge_pressure": [8, 10, 12, 14],
        "air_flow_rate": [0, 100, 100, 50],
        "power_consumption": [0, 50, 60, 30],
        "motor_speed": [0, 1000, 1000, 0],
    }
    return typed(
        spark,
        [{"minute": 15 * i, **{name: values[i] for name, values in columns.items()}} for i in range(4)],
    ).drop("event_id")


def test_all_seven_metrics(spark):
    found = {r.metric_name: r for r in device_metrics(quarter_hours(spark), "15min", "fill").collect()}
    assert {name: r.unit for name, r in found.items()} == METRIC_UNITS
    values = {name: round(r.metric_value, 2) for name, r in found.items()}
    assert values == {
        "active_duration_hours": 0.5,
        "active_ratio_pct": 50.0,
        "average_pressure_bar": 11.0,
        "peak_pressure_bar": 14.0,
        "mean_specific_power_kw_per_m3h": 0.57,
        "cycle_count": 1.0,
        "total_flow_volume_m3": 62.5,
    }
    one = found["cycle_count"]
    assert (one.window_start, one.window_end) == (at(0), at(45))
    assert (one.resample_frequency, one.missing_strategy) == ("15min", "fill")


def test_zero_flow_and_no_pressure(spark):
    frame = typed(spark, [{"minute": m, "air_flow_rate": 0, "power_consumption": 50} for m in (0, 15)])
    row = device_metrics_wide(frame, "15min").first()
    assert row.mean_specific_power_kw_per_m3h == row.total_flow_volume_m3 == 0.0
    assert row.average_pressure_bar == row.peak_pressure_bar == 0.0


@pytest.mark.parametrize(("speeds", "cycles"), [([1000, 1000, 0, 1000], 1), ([0, 1, 0], 0), ([0, 900], 1)])
def test_cycles_never_count_the_first_row(spark, speeds, cycles):
    frame = typed(spark, [{"minute": 15 * i, "motor_speed": s} for i, s in enumerate(speeds)])
    assert device_metrics_wide(frame, "15min").first().cycle_count == cycles


@pytest.mark.parametrize(
    ("minutes", "hours"),
    [([0, 1, 2, 7, 12], 5 / 60), ([0, 4, 13], 9 / 60), ([0], 0.25)],
)
def test_interval_is_the_upper_median_or_the_frequency(spark, minutes, hours):
    row = device_metrics_wide(series(spark, minutes, [1] * len(minutes)), "15min").first()
    assert row.interval_hours == pytest.approx(hours)


def test_bins_are_compared_across_slices(spark, monkeypatch):
    from gaugeworks.operators import metrics

    whole = device_metrics_wide(quarter_hours(spark), "15min").first()
    small = metrics.slice_grid
    monkeypatch.setattr(metrics, "slice_grid", lambda *args: small(*args, steps=1))
    assert device_metrics_wide(quarter_hours(spark), "15min").first() == whole


def test_runs_are_computed_apart(spark):
    frame = typed(spark, [{"minute": m, "motor_speed": s} for m, s in [(0, 0), (60, 900), (1500, 900)]])
    daily = frame.withColumn("day", F.to_date("timestamp"))
    found = device_metrics_wide(daily, "1h", runs=["day"])
    assert sorted((r.day.day, r.cycle_count) for r in found.collect()) == [(1, 1.0), (2, 0.0)]


def test_thresholds_are_strict(spark):
    frame = typed(spark, [{"minute": 0, "motor_speed": 500}, {"minute": 15, "motor_speed": 501}])
    assert device_metrics_wide(frame, "15min", MetricThresholds()).first().active_ratio_pct == 50.0
    assert at(0) == datetime(2024, 2, 1)
