import json
from datetime import UTC, datetime

import pytest

from gaugeworks.config import (
    MetricThresholds,
    ProcessingOptions,
    StructuredQuery,
    WindowOrderError,
    validate_window,
)
from gaugeworks.contract import ContractError, load_contract
from gaugeworks.functions.text import format_period
from gaugeworks.functions.timegrid import HOUR_US, MINUTE_US, parse_frequency, shared_grain


def test_bundled_contract(contract):
    assert contract.required() == ["timestamp", "station_id", "device_id"]
    assert contract.numeric_names() == [
        "discharge_pressure", "air_flow_rate", "power_consumption", "motor_speed", "discharge_temp",
    ]
    rule = contract.columns()["discharge_temp"]
    assert (rule.low, rule.high, rule.flatline_minutes) == (-10.0, 120.0, 60)


def test_rules_table(spark, contract):
    assert contract.rules(spark).filter("data_type = 'integer'").count() == 1


def test_unreadable_contract(tmp_path):
    with pytest.raises(ContractError):
        load_contract(tmp_path / "absent.json")
    broken = tmp_path / "broken.json"
    broken.write_text("{")
    with pytest.raises(ContractError):
        load_contract(broken)
    broken.write_text(json.dumps({"version": 1, "tables": {"t": {"columns": {"c": {}}}}}))
    with pytest.raises(ContractError):
        load_contract(broken)


def test_zero_flatline_threshold_counts_as_unset(tmp_path):
    path = tmp_path / "contract.json"
    path.write_text(json.dumps({
        "version": "1",
        "tables": {"sensor_readings": {"columns": {"p": {"type": "float"}}}},
        "sensor_types": {"p": {"flatline_threshold_minutes": 0}},
    }))
    assert load_contract(path).flatline_minutes("p", 30) == 30


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("15min", 15 * MINUTE_US),
        ("1h", HOUR_US),
        ("h", HOUR_US),
        ("1D", 24 * HOUR_US),
        ("1h30min", 90 * MINUTE_US),
        ("1.5h", 90 * MINUTE_US),
        ("30s", 30_000_000),
    ],
)
def test_frequency(text, expected):
    assert parse_frequency(text) == expected


@pytest.mark.parametrize("text", ["", "abc", "0min", "-1h", "1W", "1ME", "15 bananas"])
def test_bad_frequency(text):
    with pytest.raises(ValueError):
        parse_frequency(text)


def test_shared_grain():
    assert shared_grain(5 * HOUR_US) == HOUR_US
    assert shared_grain(7 * MINUTE_US) == MINUTE_US


def test_bounds_of_parameters():
    with pytest.raises(ValueError):
        ProcessingOptions(flatline_window_minutes=0)
    with pytest.raises(ValueError):
        ProcessingOptions(missing_strategy="guess")
    with pytest.raises(ValueError):
        MetricThresholds(active_rpm=-1)
    with pytest.raises(ValueError):
        StructuredQuery(metric_name="motor_speed")


def test_window_order_with_mixed_zones():
    with pytest.raises(WindowOrderError):
        validate_window(datetime(2024, 1, 1, 1), datetime(2024, 1, 1, 1, tzinfo=UTC))
    validate_window(datetime(2024, 1, 1), datetime(2024, 1, 1, 1, tzinfo=UTC))
    validate_window(None, datetime(2024, 1, 1))


def test_period_text():
    assert format_period(None, None) == "beginning to now"
    assert format_period(datetime(2024, 1, 1), None) == "2024-01-01T00:00:00 to now"
