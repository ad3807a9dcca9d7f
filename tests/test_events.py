import json
from datetime import datetime

import pytest
from frames import rows
from pyspark.sql import functions as F

from gaugeworks.functions.timegrid import floor_to_bucket
from gaugeworks.operators.events import (
    accepted_readings,
    bucket_partials,
    classify_events,
    dead_letters,
    event_status,
    merge_aggregates,
    parse_events,
    query_stream_aggregates,
    recent_errors,
    rejected_events,
    retain_latest_buckets,
    retain_latest_ids,
)

TEN = "2024-02-01T10:05:00"
ALL_FIVE = {
    "discharge_pressure": 8.0, "air_flow_rate": 100, "power_consumption": 50,
    "motor_speed": 1500, "discharge_temp": 45,
}


def event(event_id="e1", **changes) -> dict:
    base = {
        "event_id": event_id, "event_type": "sensor_reading", "timestamp": TEN,
        "station_id": "S", "device_id": "D", "readings": ALL_FIVE,
    }
    return {name: value for name, value in (base | changes).items() if value != "absent"}


def raw_events(spark, payloads):
    texts = [p if isinstance(p, str) else json.dumps(p) for p in payloads]
    return spark.createDataFrame(list(enumerate(texts)), "arrival_seq bigint, payload string")


def parsed(spark, contract, payloads):
    return parse_events(raw_events(spark, payloads), contract)


def outcomes(spark, contract, payloads, seen=None):
    found = classify_events(parsed(spark, contract, payloads), seen)
    return [outcome for _, outcome in rows(found, "arrival_seq", "outcome")]


def aggregates(spark, contract, payloads):
    readings = accepted_readings(parsed(spark, contract, payloads), contract)
    return merge_aggregates(bucket_partials(readings, contract))


def test_structure_type_and_time_checks(spark, contract):
    cases = [
        (event("a"), "ok"),
        (event("b", station_id="absent"), "malformed_event"),
        (event("c", device_id="absent"), "malformed_event"),
        (event("d", timestamp="absent"), "malformed_event"),
        ({"garbage": "x"}, "malformed_event"),
        ("{not json", "malformed_event"),
        ("[1, 2]", "malformed_event"),
        (event(5), "malformed_event"),
        (event("e", readings=None), "malformed_event"),
        (event("f", readings=[1]), "malformed_event"),
        (event("g", metadata="text"), "malformed_event"),
        (event("h", event_type="station_alarm"), "validation_error"),
        (event("i", timestamp="not-a-date"), "validation_error"),
        (event("j", extra=1, readings={}), "ok"),
        (event("k", readings="absent"), "ok"),
        (event("l", timestamp="2024-02-01T10:05:00+02:00"), "ok"),
    ]
    assert outcomes(spark, contract, [case for case, _ in cases]) == [expected for _, expected in cases]


def test_sensor_values_are_coerced(spark, contract):
    values = {
        "discharge_pressure": "not_a_number", "air_flow_rate": [1, 2, 3], "power_consumption": None,
        "motor_speed": " 7 ", "discharge_temp": True,
    }
    row = parsed(spark, contract, [event(readings=values)]).first()
    assert (row.discharge_pressure, row.air_flow_rate, row.power_consumption) == (None, None, None)
    assert (row.motor_speed, row.discharge_temp) == (7.0, 1.0)
    row = parsed(spark, contract, [event(readings={"discharge_pressure": "1d", "motor_speed": 9})]).first()
    assert (row.discharge_pressure, row.motor_speed) == (None, 9.0)


def test_only_accepted_ids_are_remembered(spark, contract):
    bad_time = event("e1", timestamp="bad")
    assert outcomes(spark, contract, [bad_time, event("e1"), event("e1"), bad_time]) == [
        "validation_error", "ok", "duplicate", "duplicate",
    ]


def test_ids_seen_earlier_are_duplicates(spark, contract):
    seen = spark.createDataFrame([("e1",)], "event_id string")
    found = outcomes(spark, contract, [event("e1"), event("e1", timestamp="bad"), event("e2")], seen)
    assert found == ["duplicate", "duplicate", "ok"]


def test_one_event_gives_ten_aggregates_and_repeats_give_none(spark, contract):
    found = aggregates(spark, contract, [event("e1"), event("e1")])
    assert found.count() == 10
    assert {row["count"] for row in found.collect()} == {1}


def test_out_of_range_and_empty_readings_give_no_aggregate(spark, contract):
    payloads = [event("a", readings={"discharge_pressure": 999}), event("b", readings={"motor_speed": None})]
    assert aggregates(spark, contract, payloads).count() == 0
    assert outcomes(spark, contract, payloads) == ["ok", "ok"]


def pressure_events(values, times=None):
    times = times or [TEN] * len(values)
    return [
        event(f"e{i}", timestamp=time, readings={"discharge_pressure": value})
        for i, (value, time) in enumerate(zip(values, times, strict=True))
    ]


def test_running_aggregate(spark, contract):
    times = ["2024-02-01T10:30:00", TEN, TEN, TEN, TEN]
    payloads = pressure_events([5, 3, 7, 1, 6], times)
    row = aggregates(spark, contract, payloads).filter("bucket = 'hour'").first()
    assert (row["count"], row.total, row.avg, row.min_value, row.max_value) == (5, 22.0, 4.4, 1.0, 7.0)
    assert row.bucket_start == datetime(2024, 2, 1, 10)
    assert row.latest_timestamp == datetime(2024, 2, 1, 10, 30)


def test_hours_and_days(spark, contract):
    found = aggregates(spark, contract, pressure_events([8, 10], [TEN, "2024-02-01T11:15:00"]))
    assert found.filter("bucket = 'hour'").count() == 2
    day = found.filter("bucket = 'day'").first()
    assert (day["count"], day.total, day.bucket_start) == (2, 18.0, datetime(2024, 2, 1))


def test_unknown_bucket():
    with pytest.raises(ValueError):
        floor_to_bucket(F.col("x"), "week")


def test_bucket_range_is_half_open(spark, contract):
    found = aggregates(spark, contract, pressure_events([8, 10, 9], [TEN, "2024-02-01T11:15:00", "2024-02-01T12:00:00"]))
    picked = query_stream_aggregates(
        found, "S", bucket="hour", start=datetime(2024, 2, 1, 11), end=datetime(2024, 2, 1, 12)
    )
    assert [row.bucket_start.hour for row in picked.collect()] == [11]
    assert query_stream_aggregates(found, "other").count() == 0
    assert query_stream_aggregates(found, "S", device_id="D", metric_type="motor_speed").count() == 0


def test_status_counts_and_event_time(spark, contract):
    payloads = [
        event("a"),
        {"garbage": 1, "timestamp": "2024-03-01T00:00:00"},
        event("b", event_type="alarm", timestamp="2024-02-01T10:00:00+00:00"),
        event("a"),
        event("c", timestamp="bad"),
    ]
    row = event_status(parsed(spark, contract, payloads)).first()
    assert (row.events_consumed, row.events_processed_successfully) == (5, 2)
    assert (row.events_malformed, row.events_failed) == (1, 2)
    assert row.last_event_timestamp == datetime(2024, 3, 1)


def test_dead_letters(spark, contract):
    payloads = [event("a"), {"event_id": 7}, event("b", event_type="alarm"), event("c", timestamp="x")]
    frame = parsed(spark, contract, payloads)
    found = dead_letters(rejected_events(frame)).orderBy("arrival_seq").collect()
    assert [row.error_type for row in found] == ["malformed_event", "validation_error", "validation_error"]
    assert [row.event_id for row in found] == ["7", "b", "c"]
    assert [row.detail for row in found] == ["MalformedEventError", "EventValidationError", "EventValidationError"]
    assert "alarm" in found[1].message and "'x'" in found[2].message
    again = dead_letters(rejected_events(frame)).orderBy("arrival_seq").collect()
    assert [row.error_id for row in again] == [row.error_id for row in found]


def test_recent_errors_are_as_many_as_asked_for_newest_last(spark):
    errors = spark.range(101).selectExpr("id AS arrival_seq", "timestamp_seconds(id div 10) AS occurred_at")
    found = [row.arrival_seq for row in recent_errors(errors, 500).collect()]
    assert found == list(range(101))
    assert [row.arrival_seq for row in recent_errors(errors, 2).collect()] == [99, 100]
    with pytest.raises(ValueError):
        recent_errors(errors, 0)


def test_retention(spark, contract):
    times = [f"2024-02-01T{hour:02d}:00:00" for hour in range(5)]
    hours = aggregates(spark, contract, pressure_events([1] * 5, times)).filter("bucket = 'hour'")
    kept = [row.bucket_start.hour for row in retain_latest_buckets(hours, 4).collect()]
    assert sorted(kept) == [1, 2, 3, 4]
    with pytest.raises(ValueError):
        retain_latest_buckets(hours, 0)
    ids = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "event_id string, arrival_seq bigint")
    assert sorted(row.event_id for row in retain_latest_ids(ids, 2).collect()) == ["b", "c"]


def test_a_repeated_id_stays_exact(spark, contract):
    # One id on most events, accepted once; its copies with a bad time come before and after.
    many = [event("hot", timestamp="bad")] * 50 + [event("hot")] * 200 + [event("hot", timestamp="bad")] * 50
    found = outcomes(spark, contract, many + [event(f"e{i}") for i in range(20)])
    assert found.count("ok") == 21
    assert found.count("duplicate") == 249
    assert found.count("validation_error") == 50


def test_accepted_ids_are_never_broadcast(spark, contract, tmp_path):
    # However small the guess: there is a row per id, and guesses from the files' compressed size are far too small.
    payloads = [event("a"), event("a"), event("b"), event("b", timestamp="bad"), event("c", timestamp="bad")]
    raw_events(spark, payloads).write.parquet(f"{tmp_path}/raw")
    events = parse_events(spark.read.parquet(f"{tmp_path}/raw"), contract)
    for made in (classify_events(events), classify_events(events, spark.createDataFrame([("a",)], "event_id string")), event_status(events)):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan
    assert [outcome for _, outcome in rows(classify_events(events), "arrival_seq", "outcome")] == ["ok", "duplicate", "ok", "duplicate", "validation_error"]
