"""Registered queries over raw JSON events, and the SQL each is compared with."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.contract import default_contract
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
from gaugeworks.session import shared_folder, write_down
from gaugeworks.sources.events import ARRIVAL, read_event_stream
from gaugeworks.streaming.exact import EventTables, start_exact
from gaugeworks.streaming.progress import StreamProgress, file_backlog
from gaugeworks.streaming.windowed import windowed_aggregates
from registered.sql import ACCEPTED, AGGREGATES, PARSED, each, query, rounded
from registered.views import comparable, raw_events

CONTRACT = default_contract()
#: Events of a micro-batch: what a task holds follows from it, not from the table's size.
BATCH_ROWS = 2_000_000
#: Files of a micro-batch at most: as many a task writes to side by side, for more Spark holds its rows in memory.
MOST_FILES = 200
#: Bytes of a row group of files that are few and large: tasks can then share a file.
SMALL_GROUPS = 8 << 20
STREAM_FROM, STREAM_TO = datetime(2024, 1, 5), datetime(2024, 1, 19, 12)


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_events(raw_events(spark, sf_dir), CONTRACT)


def _parsed_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For what looks at the events several times: the JSON is parsed once."""
    return write_down(_parsed(spark, sf_dir))


def event_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_events(_parsed_once(spark, sf_dir)).select("arrival_seq", "event_id", "outcome")


def event_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparable(event_status(_parsed_once(spark, sf_dir)))


def _errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dead_letters(rejected_events(_parsed_once(spark, sf_dir)))


def dead_letter_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _errors(spark, sf_dir).drop("error_id", "occurred_at")


def recent_error_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recent_errors(_errors(spark, sf_dir), 80).select("arrival_seq", "error_type", "event_id")


def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparable(accepted_readings(_parsed(spark, sf_dir), CONTRACT))


def _aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    readings = accepted_readings(_parsed(spark, sf_dir), CONTRACT)
    return merge_aggregates(bucket_partials(readings, CONTRACT))


def stream_hour_day_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparable(_aggregates(spark, sf_dir))


def stream_aggregates_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = query_stream_aggregates(
        _aggregates(spark, sf_dir),
        "S1",
        metric_type="air_flow_rate",
        bucket="hour",
        start=STREAM_FROM,
        end=STREAM_TO,
    )
    return comparable(found)


def latest_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparable(retain_latest_buckets(write_down(_aggregates(spark, sf_dir)), 500))


def latest_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    accepted = accepted_readings(_parsed(spark, sf_dir), CONTRACT)
    return retain_latest_ids(write_down(accepted.select("event_id", "arrival_seq")), 1_000)


def write_in_order(raw: DataFrame, path: str, files: int, batch_rows: int = BATCH_ROWS) -> None:
    """Write events as files of a folder, ``files`` for each micro-batch and some ``batch_rows`` events in them, but two batches
    at least. Those of a batch are written after those of the batch before: a stream takes files in the order of their times.

    Rows are dealt by what they hold: to deal them round, each task would have to sort its part of the table in memory."""
    batches = max(2, -(-raw.count() // batch_rows))
    cuts = raw.approxQuantile(ARRIVAL, [n / batches for n in range(1, batches)], 0.1 / batches)
    arrival = F.col(ARRIVAL)
    # Quantiles are values of the column; events without a number come first.
    bounds = [None, *sorted({int(cut) for cut in cuts}), None]
    for low, high in zip(bounds, bounds[1:]):
        inside = arrival.isNull() if low is None else arrival > low
        if high is not None:
            inside = inside | (arrival <= high) if low is None else inside & (arrival <= high)
        elif low is None:
            inside = F.lit(True)
        raw.filter(inside).repartition(files, *raw.columns).write.mode("append").parquet(path)


def batch_files(spark: SparkSession) -> int:
    """Files of a micro-batch."""
    return min(MOST_FILES, max(2, int(spark.conf.get("spark.sql.shuffle.partitions")) // 2))


def _streamed(spark: SparkSession, sf_dir: str) -> EventTables:
    """Run the exact stream over the events, written out as files of a shared folder, to the end."""
    root = f"{shared_folder(spark)}/stream-{uuid4().hex}"
    files = batch_files(spark)
    write_in_order(raw_events(spark, sf_dir), f"{root}/in", files)
    tables = EventTables(spark, f"{root}/out")
    events = read_event_stream(spark, f"{root}/in", source="parquet", max_per_trigger=files)
    start_exact(events, tables, CONTRACT, f"{root}/checkpoint", drain=True).awaitTermination()
    return tables


def stream_equals_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparable(_streamed(spark, sf_dir).aggregates())


def stream_folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = _streamed(spark, sf_dir)
    tables.fold()
    return comparable(tables.aggregates())


def stream_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = _streamed(spark, sf_dir).status()
    return comparable(
        status.drop("last_success_timestamp", "last_error_timestamp", "queue_depth")
    )


def write_dealt(raw: DataFrame, path: str, files: int, group_bytes: int = SMALL_GROUPS) -> None:
    """So many files whatever the table's size: rows are dealt round, in groups small enough for many tasks to share a file."""
    raw.repartition(files).write.option("parquet.block.size", group_bytes).parquet(path)


def stream_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the listener saw of a stream that takes two of six files at a time."""
    root = f"{shared_folder(spark)}/progress-{uuid4().hex}"
    write_dealt(raw_events(spark, sf_dir), f"{root}/in", 6)
    progress = StreamProgress.watch(spark, file_backlog(spark, f"{root}/in", f"{root}/checkpoint"))
    try:
        events = read_event_stream(spark, f"{root}/in", source="parquet", max_per_trigger=2)
        query = start_exact(events, EventTables(spark, f"{root}/out"), CONTRACT, f"{root}/checkpoint", drain=True)
        query.awaitTermination()
        progress.settle()
        rows = progress.table().filter(F.col("query_id") == str(query.id))
    finally:
        progress.stop()
    batches = rows.filter("batch_id IS NOT NULL AND events > 0")
    seen = batches.agg(
        F.count(F.lit(1)).alias("batches"),
        F.sum("events").alias("events_consumed"),
        F.max("queue_depth").alias("most_waiting"),
        F.max_by("queue_depth", "seq").alias("queue_depth"),
        F.bool_and("running").alias("consumer_running"),
    )
    ended = rows.agg(F.max_by("running", "seq").alias("running_at_last"))
    # Both sides are one row.
    return seen.join(F.broadcast(ended), F.lit(True))


def stream_windowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Day aggregates of the watermark mode, run to the end with room for every event's lateness."""
    root = f"{shared_folder(spark)}/windowed-{uuid4().hex}"
    raw_events(spark, sf_dir).write.parquet(f"{root}/in")
    events = read_event_stream(spark, f"{root}/in", source="parquet")
    days = windowed_aggregates(events, CONTRACT, "day", "60 days")
    (
        days.writeStream.outputMode("update")
        .option("checkpointLocation", f"{root}/checkpoint")
        .foreachBatch(
            lambda batch, number: batch.write.mode("overwrite").parquet(f"{root}/out/batch_id={number}")
        )
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )
    updates = spark.read.parquet(f"{root}/out")
    key = ["station_id", "device_id", "metric_type", "bucket", "bucket_start"]
    values = [name for name in days.columns if name not in key]
    # An update replaces what earlier batches said about the same bucket.
    last = F.max(F.struct("batch_id", *values)).alias("last")
    newest = updates.groupBy(*key).agg(last).select(*key, *[F.col("last")[n].alias(n) for n in values])
    return comparable(newest)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "event_classification": event_classification,
    "event_status": event_counters,
    "dead_letters": dead_letter_rows,
    "recent_errors": recent_error_rows,
    "stream_dedup": stream_dedup,
    "stream_hour_day_aggregates": stream_hour_day_aggregates,
    "stream_aggregates_filtered": stream_aggregates_filtered,
    "retain_latest_buckets": latest_buckets,
    "retain_latest_ids": latest_ids,
    "stream_equals_batch": stream_equals_batch,
    "stream_folded": stream_folded,
    "stream_status": stream_status,
    "stream_windowed": stream_windowed,
    "stream_progress": stream_progress,
}

_AGGREGATE_COLUMNS = (
    f"station_id, device_id, metric_type, bucket, bucket_start, count, {rounded('total')} AS total, "
    f"{rounded('min_value')} AS min_value, {rounded('max_value')} AS max_value, {rounded('avg')} AS avg, "
    "latest_timestamp"
)
_ALL_AGGREGATES = query(AGGREGATES, select=f"SELECT {_AGGREGATE_COLUMNS} FROM aggregates")
_STATUS = """count(*) AS events_consumed,
  count(*) FILTER (WHERE outcome IN ('ok', 'duplicate')) AS events_processed_successfully,
  count(*) FILTER (WHERE outcome = 'malformed_event') AS events_malformed,
  count(*) FILTER (WHERE outcome = 'validation_error') AS events_failed,
  max(event_time) AS last_event_timestamp FROM outcomes"""

ORACLES: dict[str, str] = {
    "event_classification": query(PARSED, select="SELECT arrival_seq, event_id, outcome FROM outcomes"),
    "event_status": query(PARSED, select=f"SELECT {_STATUS}"),
    "dead_letters": query(
        PARSED,
        select="""SELECT arrival_seq, outcome AS error_type, CASE stage
    WHEN 'broken' THEN 'Fields missing or of a wrong kind: ' || faults
    WHEN 'other_type' THEN 'Event type is ''' || event_type || ''', not ''sensor_reading'''
    ELSE 'No time can be read from ''' || timestamp || '''' END AS message,
  event_id, CASE outcome WHEN 'malformed_event' THEN 'MalformedEventError' ELSE 'EventValidationError' END AS detail
FROM outcomes WHERE outcome IN ('malformed_event', 'validation_error')""",
    ),
    "recent_errors": query(
        PARSED,
        select="""SELECT arrival_seq, outcome AS error_type, event_id FROM outcomes
WHERE outcome IN ('malformed_event', 'validation_error') ORDER BY arrival_seq DESC LIMIT 80""",
    ),
    "stream_dedup": query(
        ACCEPTED,
        select="SELECT event_id, arrival_seq, station_id, device_id, event_time, "
        + each(f"{rounded('num_{c}')} AS {{c}}")
        + " FROM accepted",
    ),
    "stream_hour_day_aggregates": _ALL_AGGREGATES,
    "stream_aggregates_filtered": query(
        AGGREGATES,
        select=f"""SELECT {_AGGREGATE_COLUMNS} FROM aggregates
WHERE station_id = 'S1' AND metric_type = 'air_flow_rate' AND bucket = 'hour'
  AND bucket_start >= TIMESTAMP '2024-01-05' AND bucket_start < TIMESTAMP '2024-01-19 12:00:00'""",
    ),
    "retain_latest_buckets": query(
        AGGREGATES,
        select=f"""SELECT {_AGGREGATE_COLUMNS} FROM aggregates
ORDER BY bucket_start DESC, station_id, device_id, metric_type, bucket LIMIT 500""",
    ),
    "retain_latest_ids": query(
        ACCEPTED, select="SELECT event_id, arrival_seq FROM accepted ORDER BY arrival_seq DESC LIMIT 1000"
    ),
    "stream_equals_batch": _ALL_AGGREGATES,
    "stream_folded": _ALL_AGGREGATES,
    "stream_status": query(PARSED, select=f"SELECT false AS consumer_running, {_STATUS}"),
    # Three batches of two files; after the first four are waiting, after the last none.
    "stream_progress": query(
        PARSED,
        select="""SELECT CAST(3 AS BIGINT) AS batches, count(*) AS events_consumed, CAST(4 AS BIGINT) AS most_waiting,
  CAST(0 AS BIGINT) AS queue_depth, true AS consumer_running, false AS running_at_last FROM outcomes""",
    ),
    "stream_windowed": query(
        AGGREGATES, select=f"SELECT {_AGGREGATE_COLUMNS} FROM aggregates WHERE bucket = 'day'"
    ),
}
