from datetime import datetime, timedelta
from uuid import uuid4

import pytest
from frames import SENSORS, raw, rows

from gaugeworks.config import ProcessingOptions
from gaugeworks.plans.reports import quality_findings_text
from gaugeworks.plans.stations import StationRunError, process_stations
from gaugeworks.session import shared_folder
from gaugeworks.sources.metric_store import MetricStore
from gaugeworks.sources.readings import read_sensor_readings, read_station_metadata, scan_readings


def station_rows():
    """Three devices, twelve hours every five minutes, with one slot missing everywhere."""
    for hour in range(12):
        for minute in range(0, 60, 5):
            if (hour, minute) == (2, 15):
                continue
            for i in range(3):
                active = hour % 3 != 0 or i == 1
                pressure = 8.0 + 0.5 * i if active else 4.0
                if i == 1 and hour in (4, 5):
                    pressure = 9.0
                if i == 0 and (hour, minute) == (6, 0):
                    pressure = None
                yield {
                    "timestamp": (datetime(2024, 2, 1) + timedelta(hours=hour, minutes=minute)).isoformat(),
                    "station_id": "S1",
                    "device_id": f"D{i}",
                    "discharge_pressure": pressure,
                    "air_flow_rate": 100 + 10 * i if active else 0,
                    "power_consumption": 50 + 5 * i if active else 0,
                    "motor_speed": 1500 + 100 * i if active else 0,
                    "discharge_temp": 45 + 2 * i if active else 20,
                }


@pytest.fixture(scope="module")
def result(spark):
    broken = [
        {"station_id": "S2", "timestamp": "never", "discharge_pressure": 1},
        {"station_id": "S3", "device_id": None, "discharge_pressure": 1},
        {"station_id": "S4", "discharge_pressure": 99},
    ]
    metadata = spark.createDataFrame(
        [("S1", "First", "here", "2020-01-01", "3")],
        "station_id string, station_name string, location string, commissioned_date string, num_compressors string",
    )
    options = ProcessingOptions(stations=("S1", "S2", "S3", "S4", "S5"), resample_frequency="30min")
    return process_stations(raw(spark, [*station_rows(), *broken]), options, metadata=metadata)


def test_summary_of_a_good_station(result):
    row = result.summary.filter("station_id = 'S1'").first()
    assert (row.run_status, row.station_name) == ("ok", "First")
    assert (row.rows_read, row.rows_after_cleaning, row.rows_after_resampling) == (429, 429, 72)
    assert (row.devices_processed, row.metrics_saved) == (3, 21)
    assert (row.range_start, row.range_end) == (datetime(2024, 2, 1), datetime(2024, 2, 1, 11, 30))
    assert row.quality_report.gap_count == 3
    assert row.quality_report.warnings[0] == "3 timestamp gaps detected"


def test_states_of_other_stations(result):
    assert rows(result.summary, "station_id", "run_status") == [
        ("S1", "ok"),
        ("S2", "timestamps_unreadable"),
        ("S3", "empty_after_cleaning"),
        ("S4", "empty_after_resampling"),
        ("S5", "no_data"),
    ]
    with pytest.raises(StationRunError, match="S2"):
        result.raise_for_failures()


def test_gaps_summary_and_devices(result):
    found = rows(result.gaps, "device_id", "gap_start", "missing_intervals")
    assert found == [(f"D{i}", datetime(2024, 2, 1, 2, 10), 1) for i in range(3)]
    row = result.cleaning_summary.filter("station_id = 'S2'").first()
    assert (row.rows_before_cleaning, row.rows_removed, row.malformed_values_coerced) == (1, 1, 1)
    assert result.cleaning_summary.filter("station_id = 'S4'").first().out_of_range_values_nullified == 1
    assert rows(result.devices, "device_id") == [("D0",), ("D1",), ("D2",)]


def test_findings_text(result):
    text = quality_findings_text(result.quality_report).filter("station_id = 'S1'").first().findings
    lines = text.split("\n")
    assert lines[0] == "total_rows_read: 429"
    assert lines[2].startswith('column_missing_pct: {"timestamp": 0.0, "discharge_pressure": 0.23')
    assert lines[5] == "timestamp_gaps: 3 detected" and lines[-1].startswith("warnings: 3 timestamp gaps")


def test_saving_twice_keeps_one_row_per_metric(spark, result):
    store = MetricStore(spark, f"{shared_folder(spark)}/metrics-{uuid4().hex}")
    result.save(store)
    result.save(store)
    assert store.load().count() == 21


def test_readers(spark, tmp_path, contract):
    frame = raw(spark, list(station_rows()))
    frame.write.parquet(str(tmp_path / "p"))
    frame.write.option("header", True).csv(str(tmp_path / "c"))
    frame.write.json(str(tmp_path / "j"))
    start, end = datetime(2024, 2, 1, 1), datetime(2024, 2, 1, 2)
    for folder, kind in (("p", "parquet"), ("c", "csv"), ("j", "json")):
        found = read_sensor_readings(
            spark, str(tmp_path / folder), file_format=kind, stations=["S1"], start=start, end=end
        )
        assert found.count() == 39  # both bounds belong to the range
        assert set(SENSORS) < set(found.columns)
    assert read_sensor_readings(spark, str(tmp_path / "p"), stations=["none"]).count() == 0


def test_scan_bounds_reach_typed_time_columns(spark):
    frame = raw(spark, list(station_rows())).selectExpr(
        "* EXCEPT (timestamp)", "cast(timestamp AS timestamp_ntz) AS timestamp"
    )
    assert scan_readings(frame, end=datetime(2024, 2, 1)).count() == 3


def test_metadata_reader(spark, tmp_path):
    (tmp_path / "m.csv").write_text(
        "station_id,station_name,location,commissioned_date,num_compressors\nS1,First,here,2020-01-01,3\n"
    )
    row = read_station_metadata(spark, str(tmp_path / "m.csv"), file_format="csv").first()
    assert (row.station_name, row.num_compressors, row.commissioned_date) == ("First", 3, "2020-01-01")


def test_readings_are_evaluated_twice(spark):
    evaluated = spark.sparkContext.accumulator(0)
    stored = raw(spark, list(station_rows()))

    def seen(batches):
        for batch in batches:
            evaluated.add(batch.num_rows)
            yield batch

    run = process_stations(stored.mapInArrow(seen, stored.schema), ProcessingOptions(missing_strategy="fill"))
    assert run.summary.count() == 1 and run.metrics.count() == 21
    assert evaluated.value == 2 * len(list(station_rows()))
