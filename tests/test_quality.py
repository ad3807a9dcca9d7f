import pytest
from frames import SENSORS, at, rows, series, typed

from gaugeworks.operators.clean import slice_readings
from gaugeworks.operators.quality import (
    detect_flatlines,
    detect_gaps,
    device_intervals,
    flatline_thresholds,
)

LIMITS = [{}, {"width_us": 600_000_000}, {"max_rows": 2}]


def gaps(frame, **limits):
    found = detect_gaps(slice_readings(frame, SENSORS, **limits))
    return rows(found, "device_id", "gap_start", "gap_end", "missing_intervals")


def flatlines(frame, contract, **limits):
    thresholds = flatline_thresholds(contract, 30)
    found = detect_flatlines(slice_readings(frame, SENSORS, **limits), thresholds)
    return rows(found, "device_id", "column", "start_time", "end_time", "duration_minutes", "value")


@pytest.mark.parametrize("limits", LIMITS)
def test_gap_with_missing_intervals(spark, limits):
    assert gaps(series(spark, [0, 1, 4], [1, 1, 1]), **limits) == [("D", at(1), at(4), 2)]


@pytest.mark.parametrize("limits", LIMITS)
def test_no_gap_in_even_series_or_single_reading(spark, limits):
    assert gaps(series(spark, [0, 5, 10], [1, 1, 1]), **limits) == []
    assert gaps(series(spark, [0], [1]), **limits) == []


def test_gap_stays_with_its_device(spark):
    frame = series(spark, [0, 5, 20], [1, 1, 1], device="A").unionByName(
        series(spark, [0, 5, 10], [1, 1, 1], device="B")
    )
    assert [row[0] for row in gaps(frame)] == ["A"]


def test_shorter_interval_wins_ties_and_equal_times_do_not_count(spark):
    sliced = slice_readings(series(spark, [0, 5, 15, 15], [1, 1, 1, 1]), SENSORS)
    assert device_intervals(sliced).first().expected_us == 5 * 60_000_000


@pytest.mark.parametrize("limits", LIMITS)
def test_flatline(spark, contract, limits):
    frame = series(spark, [0, 10, 20, 30, 40], [7.5] * 5)
    expected = [("D", "discharge_pressure", at(0), at(40), 40.0, 7.5)]
    assert flatlines(frame, contract, **limits) == expected


def test_short_flatline_and_empty_input(spark, contract):
    assert flatlines(series(spark, [0, 5, 10], [7.5] * 3), contract) == []
    assert flatlines(series(spark, [], []), contract) == []


@pytest.mark.parametrize("limits", LIMITS)
def test_pause_breaks_a_flatline(spark, contract, limits):
    minutes = [0, 10, 20, 30, 70, 80, 90, 100]
    found = flatlines(series(spark, minutes, [7.5] * 8), contract, **limits)
    assert [(row[2], row[3]) for row in found] == [(at(0), at(30)), (at(70), at(100))]


@pytest.mark.parametrize("limits", LIMITS)
def test_flatline_over_missing_values_and_many_slices(spark, contract, limits):
    # The sensor reports every other reading, so its own cadence is 20 minutes, not 10.
    minutes = list(range(0, 200, 10))
    values = [7.5 if position % 2 == 0 else None for position in range(20)]
    values[10] = 3.0
    found = flatlines(series(spark, minutes, values), contract, **limits)
    assert [(row[2], row[3]) for row in found] == [(at(0), at(80)), (at(120), at(180))]


def test_longer_threshold_of_a_sensor(spark, contract):
    frame = typed(spark, [{"minute": m, "motor_speed": 100} for m in (0, 20, 40, 50)])
    assert flatlines(frame, contract) == []
    frame = typed(spark, [{"minute": m, "motor_speed": 100} for m in (0, 20, 40, 60)])
    assert len(flatlines(frame, contract)) == 1


@pytest.mark.parametrize("limits", [*LIMITS, {"max_rows": 1}])
def test_equal_times_do_not_join_flatlines(spark, contract, limits):
    # At minute 20 the value leaves 7.5 and returns; the order of equal times decides, not the time.
    minutes = [0, 10, 20, 20, 20, 30, 40, 50, 60]
    values = [7.5, 7.5, 7.5, 3.0, 7.5, 7.5, 7.5, 7.5, 7.5]
    found = flatlines(series(spark, minutes, values), contract, **limits)
    assert [(row[2], row[3]) for row in found] == [(at(20), at(60))]
