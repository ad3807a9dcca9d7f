import pytest
from frames import raw, rows

from gaugeworks.contract import ContractError
from gaugeworks.operators.normalize import (
    counted_columns,
    malformed_counts,
    missing_percentages,
    normalize,
    out_of_range_counts,
    station_counts,
    sum_of,
)


def counts_of(frame, contract):
    counts = station_counts(normalize(frame, contract), contract)
    names = counted_columns(frame, contract)
    return counts.select(
        "*",
        malformed_counts(counts, names).alias("malformed"),
        out_of_range_counts(counts, names).alias("outside"),
        missing_percentages(["timestamp", *contract.numeric_names()]).alias("missing"),
        sum_of("out_of_range", contract).alias("nullified"),
    ).first()


def test_missing_required_columns_are_named(spark, contract):
    frame = spark.createDataFrame([("S", "D")], "station_id string, device_id string")
    with pytest.raises(ContractError, match="timestamp"):
        normalize(frame, contract)


def test_malformed_and_out_of_range_are_counted_apart(spark, contract):
    frame = raw(spark, [
        {"discharge_pressure": "bad", "air_flow_rate": 100},
        {"discharge_pressure": 20.0, "air_flow_rate": 900},
    ])
    found = counts_of(frame, contract)
    assert found.malformed["discharge_pressure"] == 1
    assert found.outside["discharge_pressure"] == 1
    assert found.outside["air_flow_rate"] == 1
    assert "timestamp" in found.malformed and "timestamp" not in found.outside
    assert found.malformed["station_id"] == found.outside["device_id"] == 0


def test_null_is_not_malformed_but_null_time_is(spark, contract):
    found = counts_of(raw(spark, [{"discharge_pressure": None}, {"timestamp": None}]), contract)
    assert found.malformed["discharge_pressure"] == 0
    assert found.malformed["timestamp"] == 1
    assert found.missing["timestamp"] == 50.0


def test_range_bounds_are_inclusive(spark, contract):
    found = counts_of(raw(spark, [{"discharge_pressure": 0.0}, {"discharge_pressure": 16.0}]), contract)
    assert found.outside["discharge_pressure"] == 0


def test_out_of_range_becomes_null(spark, contract):
    frame = raw(spark, [{"discharge_pressure": v} for v in (5, 20, -1, 10)])
    values = [row[0] for row in normalize(frame, contract).select("discharge_pressure").collect()]
    assert values == [5.0, None, None, 10.0]
    assert counts_of(frame, contract).nullified == 2


@pytest.mark.parametrize(
    ("text", "value", "malformed", "outside"),
    [
        ("1d", None, 1, 0),
        ("1f", None, 1, 0),
        ("NaN", None, 1, 0),
        ("inf", None, 0, 1),
        (" 12 ", 12.0, 0, 0),
        ("1e1", 10.0, 0, 0),
        ("0x10", None, 1, 0),
        ("", None, 1, 0),
    ],
)
def test_number_texts(spark, contract, text, value, malformed, outside):
    frame = raw(spark, [{"discharge_pressure": text}])
    assert normalize(frame, contract).first().discharge_pressure == value
    found = counts_of(frame, contract)
    assert (found.malformed["discharge_pressure"], found.outside["discharge_pressure"]) == (malformed, outside)


def test_floating_nan_is_missing_not_malformed(spark, contract):
    frame = spark.createDataFrame(
        [("2024-02-01", "S", "D", float("nan"))],
        "timestamp string, station_id string, device_id string, discharge_pressure double",
    )
    row = normalize(frame, contract).first()
    assert row.discharge_pressure is None and row.malformed == [False]


def test_time_texts(spark, contract):
    texts = {
        "2024-02-01T00:01:00": "2024-02-01 00:01:00",
        "2024-02-01 00:01:00.5": "2024-02-01 00:01:00.5",
        "2024-02-01": "2024-02-01 00:00:00",
        "2024-02-01T05:30:00+05:30": "2024-02-01 00:00:00",
        "2024-02-01T05:30:00Z": "2024-02-01 05:30:00",
        "2024": None,
        "10:00": None,
        "2024-13-01": None,
        "not-a-timestamp": None,
    }
    frame = raw(spark, [{"timestamp": text, "device_id": text} for text in texts])
    found = dict(rows(normalize(frame, contract).selectExpr("device_id", "string(timestamp) t"), "device_id", "t"))
    assert found == texts
