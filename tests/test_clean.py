import pytest
from frames import SENSORS, rows, series, typed

from gaugeworks.operators.clean import apply_strategy, slice_readings

LIMITS = [{}, {"width_us": 600_000_000}, {"max_rows": 1}]


def pressures(frame, strategy, **limits):
    sliced = slice_readings(frame, SENSORS, **limits)
    out = apply_strategy(frame, SENSORS, strategy, sliced)
    return [value for _, _, value in rows(out, "timestamp", "event_id", "discharge_pressure")]


@pytest.mark.parametrize("limits", LIMITS)
@pytest.mark.parametrize(
    ("values", "expected"),
    [
        ([None, 7, None], [None, 7, 7]),
        ([None, 9, None], [None, 9, 9]),
        ([None, None, None], [None, None, None]),
        ([1, None, 3], [1, 1, 3]),
    ],
)
def test_fill_goes_forward_only(spark, values, expected, limits):
    assert pressures(series(spark, [0, 20, 4000], values), "fill", **limits) == expected


@pytest.mark.parametrize("limits", LIMITS)
def test_interpolate_in_time(spark, limits):
    assert pressures(series(spark, [0, 10, 20], [0, None, 20]), "interpolate", **limits) == [0, 10, 20]
    uneven = series(spark, [0, 5, 10, 25, 30], [None, 0, None, 20, None])
    assert pressures(uneven, "interpolate", **limits) == [None, 0, 5, 20, 20]


@pytest.mark.parametrize("limits", LIMITS)
def test_interpolate_between_equal_times(spark, limits):
    frame = series(spark, [0, 5, 5, 5, 9], [2, 3, None, 8, None])
    assert pressures(frame, "interpolate", **limits) == [2, 3, 3, 8, 8]


def test_drop_needs_every_sensor(spark):
    whole = {name: 1.0 for name in SENSORS}
    frame = typed(spark, [{"minute": 0, **whole}, {"minute": 1, **whole, "discharge_temp": None}])
    assert apply_strategy(frame, SENSORS, "drop").count() == 1


def test_rows_without_place_are_dropped_and_devices_kept_apart(spark):
    frame = typed(spark, [
        {"minute": 0, "device": "A", "discharge_pressure": 1},
        {"minute": 1, "device": "B"},
        {"minute": 2, "device": None, "discharge_pressure": 5},
        {"minute": 3, "device": "A"},
    ])
    out = apply_strategy(frame, SENSORS, "fill")
    assert rows(out, "device_id", "discharge_pressure") == [("A", 1.0), ("A", 1.0), ("B", None)]


def test_unknown_strategy(spark):
    with pytest.raises(ValueError):
        apply_strategy(series(spark, [0], [1]), SENSORS, "guess")
