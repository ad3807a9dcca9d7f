import json
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime
from uuid import uuid4

import pytest
from frames import at, rows
from pyspark.sql import functions as F

from gaugeworks.config import MetricQuery, StructuredQuery
from gaugeworks.plans.reports import metrics_snapshot, snapshot_rows, station_summary_input
from gaugeworks.plans.structured import (
    REQUEST_SCHEMA,
    run_structured_queries,
    run_structured_query,
)
from gaugeworks.session import shared_folder
from gaugeworks.sources.metric_store import (
    METRIC_SCHEMA,
    Commit,
    CommitLog,
    ConflictError,
    MetricStore,
    query_metrics,
    upsert_metrics,
)


def metric(value=9.5, **changes):
    base = {
        "station_id": "S", "device_id": "D", "metric_name": "average_pressure_bar", "metric_value": float(value),
        "unit": "bar", "window_start": at(0), "window_end": at(60), "computed_at": at(0),
        "resample_frequency": "15min", "missing_strategy": "fill",
    }
    return tuple((base | changes).values())


def metrics(spark, *found):
    return spark.createDataFrame(list(found), METRIC_SCHEMA)


def test_upsert_replaces_by_key(spark):
    existing = metrics(spark, metric(1), metric(2, missing_strategy="drop"))
    new = metrics(spark, metric(3), metric(4, resample_frequency="1h"))
    assert sorted(v for (v,) in rows(upsert_metrics(existing, new), "metric_value")) == [2.0, 3.0, 4.0]


def test_later_row_of_a_batch_wins(spark):
    new = metrics(spark, metric(1), metric(2)).withColumn("row_seq", F.col("metric_value").cast("bigint"))
    assert rows(upsert_metrics(metrics(spark), new), "metric_value") == [(2.0,)]


def test_store_round_trip_and_overwrite(spark):
    store = MetricStore(spark, f"{shared_folder(spark)}/metrics-{uuid4().hex}")
    assert store.load().count() == 0 and store.next_batch() == 0
    store.save(metrics(spark, metric(9.5)), store.next_batch())
    overlapping = MetricQuery(station_id="S", start_time=at(0), end_time=at(120))
    assert rows(store.query(overlapping), "metric_value") == [(9.5,)]
    store.save(metrics(spark, metric(7.5)), store.next_batch())
    store.save(metrics(spark), store.next_batch())
    assert rows(store.load(), "metric_value") == [(7.5,)]


def test_runs_at_the_same_time_are_both_kept(spark):
    store = MetricStore(spark, f"{shared_folder(spark)}/metrics-{uuid4().hex}")
    numbers = iter([store.next_batch(), store.next_batch()])  # both look before either writes
    store.next_batch = lambda: next(numbers)
    store.save(metrics(spark, metric(1.5)))
    store.save(metrics(spark, metric(2.5, metric_name="other")))
    assert sorted(v for (v,) in rows(store.load(), "metric_value")) == [1.5, 2.5]
    store.save(metrics(spark, metric(3.5)), 7)
    store.save(metrics(spark, metric(4.5)), 7)
    assert sorted(v for (v,) in rows(store.load(), "metric_value")) == [2.5, 4.5]
    store.compact()
    assert sorted(v for (v,) in rows(store.load(), "metric_value")) == [2.5, 4.5]
    store.save(metrics(spark, metric(5.5)), 3)  # an older number than the compacted ones'
    assert sorted(v for (v,) in rows(store.load(), "metric_value")) == [2.5, 4.5]


def test_two_writers_and_a_compaction_between_them(spark):
    path = f"{shared_folder(spark)}/metrics-{uuid4().hex}"
    one, two = MetricStore(spark, path), MetricStore(spark, path)
    one.save(metrics(spark, metric(1), metric(2, metric_name="other")))
    one.save(metrics(spark, metric(3)))
    # The second writer commits after the compaction has read, before it commits.
    write = one._write
    one._write = lambda rows, run: (write(rows, run), two.save(metrics(spark, metric(4), metric(5, metric_name="third"))))
    one.compact()
    assert sorted(v for (v,) in rows(two.load(), "metric_value")) == [2.0, 4.0, 5.0]
    number, folders = two._log.live()
    assert number == 3 and len(folders) == 2 and len(two.vacuum()) == 2 and two.vacuum() == []
    assert sorted(v for (v,) in rows(one.load(), "metric_value")) == [2.0, 4.0, 5.0]
    # Of two compactions of the same folders the second finds them gone.
    one._write = lambda rows, run: (write(rows, run), two.compact())
    with pytest.raises(ConflictError):
        one.compact()
    assert sorted(v for (v,) in rows(one.load(), "metric_value")) == [2.0, 4.0, 5.0]


def test_commits_get_different_numbers_and_old_ones_are_not_read(spark):
    path = f"{shared_folder(spark)}/log-{uuid4().hex}"
    logs = [CommitLog(spark, path) for _ in range(4)]

    def run(log):
        return [log.commit(lambda number, folders: Commit(number, {uuid4().hex: number}, tuple(folders)[:1])).number for _ in range(6)]

    with ThreadPoolExecutor(4) as pool:
        numbers = sorted(number for found in pool.map(run, logs) for number in found)
    assert numbers == list(range(24))
    read, log = [], CommitLog(spark, path)
    log._read = lambda name, read_whole=log._read: (read.append(name), read_whole(name))[1]
    assert log.live()[0] == 23 and len(log.live()[1]) == 1
    assert len(set(read)) == 5  # the snapshot, entry 19, and those after it


def test_overlap_includes_touching_bounds(spark):
    stored = metrics(spark, metric())
    def hits(start, end):
        return query_metrics(stored, MetricQuery(start_time=start, end_time=end)).count()

    assert hits(at(60), None) == hits(None, at(0)) == 1
    assert hits(at(61), None) == hits(None, at(-1)) == 0
    assert query_metrics(stored, MetricQuery(device_id="other")).count() == 0
    with pytest.raises(ValueError):
        MetricQuery(start_time=at(1), end_time=at(1))


ASKED = {"station_id": "S", "metric_name": "average_pressure_bar"}


@pytest.mark.parametrize(
    ("changes", "refusal"),
    [
        ({"needs_clarification": True, "station_id": None}, "needs_clarification"),
        ({"station_id": None, "metric_name": None}, "station_missing"),
        ({"metric_name": None}, "metric_missing"),
        ({"start_time": "not-a-date"}, "start_time_unreadable"),
        ({"start_time": "2024-13-01"}, "start_time_unreadable"),
        ({"end_time": "yesterday", "start_time": "2024-01-01"}, "end_time_unreadable"),
        ({"start_time": "2024-01-02", "end_time": "2024-01-01T00:00:00+00:00"}, "window_inverted"),
        ({"start_time": "2024-01-02", "end_time": "2024-01-02"}, "window_inverted"),
    ],
)
def test_unclear_questions_are_refused(spark, changes, refusal):
    query = StructuredQuery(**{**ASKED, **changes})
    answer = run_structured_query(metrics(spark, metric()), query)
    assert answer.refusal == refusal and answer.message and answer.rows is None
    request = {"request_id": "r", "device_id": None, "aggregation": "mean", "start_time": None,
               "end_time": None, "needs_clarification": False, **ASKED, **changes}
    order = [part.split()[0] for part in REQUEST_SCHEMA.split(", ")]
    requests = spark.createDataFrame([tuple(request[name] for name in order)], REQUEST_SCHEMA)
    batch = run_structured_queries(metrics(spark, metric()), requests).first()
    assert (batch.refusal, batch.matched_rows, batch.aggregate_value) == (refusal, 0, None)


@pytest.mark.parametrize(
    ("aggregation", "value"), [("mean", 8.5), ("max", 9.0), ("sum", 17.0), ("latest", 8.0)]
)
def test_aggregations(spark, aggregation, value):
    stored = metrics(
        spark,
        metric(9, window_start=at(10)),
        metric(8),  # same end, earlier start: first in stored order
        metric(100, station_id="other"),
    )
    query = StructuredQuery(**ASKED, aggregation=aggregation)
    assert run_structured_query(stored, query).aggregate.first().aggregate_value == value
    requests = spark.createDataFrame(
        [("r", "S", None, "average_pressure_bar", aggregation, "2024-01-01", None, False)], REQUEST_SCHEMA
    )
    for limit in (100, 0):  # broadcast and shuffled join
        row = run_structured_queries(stored, requests, broadcast_limit=limit).first()
        assert (row.matched_rows, row.aggregate_value) == (2, value)


def test_no_rows_give_null(spark):
    answer = run_structured_query(metrics(spark), StructuredQuery(**ASKED))
    assert answer.aggregate.first().aggregate_value is None


def test_snapshot_shows_all_in_stored_order_or_the_newest(spark):
    many = [metric(i, device_id=f"D{i % 2}", window_start=at(i), window_end=at(i + 1)) for i in range(6)]
    stored = metrics(spark, *many)
    assert [v for _, v in rows(snapshot_rows(stored, 6), "position", "metric_value")] == [0, 2, 4, 1, 3, 5]
    assert [v for _, v in rows(snapshot_rows(stored, 5), "position", "metric_value")] == [5, 4, 3, 2, 1]
    snapshot = metrics_snapshot(stored, 5).first()
    assert (snapshot.rows_shown, snapshot.rows_total) == (5, 6)
    text = json.loads(snapshot.snapshot)
    assert len(text) == 5 and text[0]["window_start"] == "2024-02-01T00:05:00+00:00"
    assert list(text[0]) == ["device_id", "metric_name", "metric_value", "unit", "window_start", "window_end"]


def test_station_without_metrics_is_not_found(spark):
    found = station_summary_input(metrics(spark, metric()), ["S", "T"], None, datetime(2024, 3, 1))
    assert rows(found, "station_id", "found", "period", "rows_shown", "rows_total") == [
        ("S", True, "beginning to 2024-03-01T00:00:00", 1, 1),
        ("T", False, "beginning to 2024-03-01T00:00:00", 0, 0),
    ]
