"""Queries over rougher views of ``events``: times as text, some bad or with an offset, null keys, stations that end in
each run state, ids that come again far away, and bad times under accepted ids."""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.config import ProcessingOptions
from gaugeworks.contract import default_contract
from gaugeworks.operators.events import accepted_readings, classify_events, parse_events
from gaugeworks.operators.normalize import malformed_counts, normalize, station_counts
from gaugeworks.operators.resample import resample_mean
from gaugeworks.plans.stations import process_stations
from gaugeworks.session import shared_folder, write_down
from gaugeworks.sources.events import read_event_stream
from gaugeworks.streaming.exact import EventTables, start_exact
from registered.events import batch_files, write_in_order
from registered.sql import AGGREGATES, DEVICE, HOUR_US, PARSED, READINGS, each, query, resampled, rounded
from registered.views import comparable, raw_events, sensor_readings

CONTRACT = default_contract()
# By user_id % 7: three usual stations, then only bad times, no device, no values, and a usual one with odd times.
STATIONS = ("S0", "S1", "S2", "BADTIME", "NODEVICE", "NOVALUE", "S6")
ASKED = (*STATIONS, "S9")
FAR = 402


def rough_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings to the minute, their time as text."""
    readings = sensor_readings(spark, sf_dir)
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id")
    minute = F.date_format(F.date_trunc("minute", F.col("ts").cast("timestamp")), "yyyy-MM-dd'T'HH:mm:ss")
    place, kind = F.col("user_id") % 7, F.col("event_id") % 20
    station = F.array(*[F.lit(name) for name in STATIONS])[place.cast("int")]
    time = (
        F.when((place == 3) | (kind == 0), "no time")
        .when(kind == 1, None)
        .when(kind == 2, F.concat(minute, F.lit("+02:00")))
        .otherwise(minute)
    )
    values = [F.when(place != 5, F.col(rule.name)).alias(rule.name) for rule in CONTRACT.numeric()]
    return readings.drop("timestamp", "station_id").join(events, "event_id").select(
        "event_id",
        time.alias("timestamp"),
        station.alias("station_id"),
        F.when((place != 4) & (kind != 3), F.col("device_id")).alias("device_id"),
        *values,
    )


def rough_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw events; of fifty one has the id of one long before, one a bad time under an id just accepted."""
    kind = F.col("arrival_seq") % 50

    def renamed(back: int):
        return F.regexp_replace("payload", r'"event_id":"e\d+"', F.concat(F.lit('"event_id":"e'), (F.col("arrival_seq") - back).cast("string"), F.lit('"')))

    far = F.when((kind == 8) & (F.col("arrival_seq") >= FAR), renamed(FAR))
    late = F.when(kind == 9, F.regexp_replace(renamed(3), r'"timestamp":"[^"]*"', '"timestamp":"not-a-date"'))
    return raw_events(spark, sf_dir).select("arrival_seq", F.coalesce(far, late, F.col("payload")).alias("payload"))


def _normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize(rough_readings(spark, sf_dir).drop("event_id"), CONTRACT)


def rough_run_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    options = ProcessingOptions(stations=ASKED, resample_frequency="15min", missing_strategy="fill")
    run = process_stations(rough_readings(spark, sf_dir).drop("event_id"), options, contract=CONTRACT)
    return comparable(run.summary.select("station_id", "run_status", "rows_read", "rows_after_cleaning", "devices_processed"))


def rough_malformed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = station_counts(_normalized(spark, sf_dir), CONTRACT)
    names = ["timestamp", *CONTRACT.numeric_names()]
    return counts.select("station_id", F.explode(malformed_counts(counts, names)).alias("column_name", "malformed"))


def rough_resample_15min(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = _normalized(spark, sf_dir).dropna(subset=["station_id", "device_id", "timestamp"])
    return comparable(resample_mean(placed, "15min", CONTRACT.numeric_names()))


def rough_event_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = write_down(parse_events(rough_events(spark, sf_dir), CONTRACT))
    return classify_events(parsed).select("arrival_seq", "event_id", "outcome")


def rough_accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = parse_events(rough_events(spark, sf_dir), CONTRACT)
    return accepted_readings(parsed, CONTRACT).select("event_id", "arrival_seq", "station_id")


def rough_stream_folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Micro-batches with ids that come again in a later one, folded. Files are taken in the order they were written in:
    the events of a batch are there before those of the next."""
    root = f"{shared_folder(spark)}/rough-{uuid4().hex}"
    files = batch_files(spark)
    # An event without a number has no place in the order.
    write_in_order(rough_events(spark, sf_dir).filter("arrival_seq IS NOT NULL"), f"{root}/in", files)
    tables = EventTables(spark, f"{root}/out")
    events = read_event_stream(spark, f"{root}/in", source="parquet", max_per_trigger=files)
    start_exact(events, tables, CONTRACT, f"{root}/checkpoint", drain=True).awaitTermination()
    tables.fold()
    return comparable(tables.aggregates())


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    run.__name__: run
    for run in (
        rough_run_status,
        rough_malformed_counts,
        rough_resample_15min,
        rough_event_classification,
        rough_accepted,
        rough_stream_folded,
    )
}

# ---- SQL side ------------------------------------------------------------------------------------

_R6 = each(f"{rounded('{c}')} AS {{c}}")
_NAMES = ", ".join(f"'{name}'" for name in STATIONS)
_ROUGH = f"""{READINGS},
rough AS (
  SELECT readings.* EXCLUDE (ts, station_id, device_id, {each("raw_{c}")}),
    CASE WHEN user_id % 7 = 3 OR readings.event_id % 20 = 0 THEN 'no time' WHEN readings.event_id % 20 = 1 THEN NULL
      ELSE strftime(date_trunc('minute', ev.ts), '%Y-%m-%dT%H:%M:%S') END AS text,
    CASE WHEN readings.event_id % 20 = 2 AND user_id % 7 <> 3 THEN 2 ELSE 0 END AS hours_ahead,
    [{_NAMES}][user_id % 7 + 1] AS station_id,
    CASE WHEN user_id % 7 <> 4 AND readings.event_id % 20 <> 3 THEN device_id END AS device_id,
    {each("CASE WHEN user_id % 7 <> 5 THEN raw_{c} END AS raw_{c}")}
  FROM readings JOIN ev ON ev.event_id = readings.event_id),
timed AS (SELECT *, try_cast(text AS TIMESTAMP) - to_hours(hours_ahead) AS ts,
  {each("try_cast(raw_{c} AS DOUBLE) AS num_{c}")} FROM rough),
norm AS (SELECT *, {each("CASE WHEN num_{c} BETWEEN {lo} AND {hi} THEN num_{c} END AS {c}")} FROM timed),
usable AS (SELECT * FROM norm WHERE ts IS NOT NULL AND station_id IS NOT NULL AND device_id IS NOT NULL)"""

_FAR_CASES = f"""  WHEN c = 8 AND event_id >= {FAR} THEN concat('{{"event_id":"e', event_id - {FAR}, '","event_type":"sensor_reading","timestamp":"', iso, '","station_id":"', s, '","device_id":"', d, '","readings":{{"discharge_pressure":', CAST(value / 8.0 AS VARCHAR), ',"air_flow_rate":', CAST(value * 4.0 AS VARCHAR), ',"motor_speed":', k * 40, '}}}}')
  WHEN c = 9 THEN concat('{{"event_id":"e', event_id - 3, '","event_type":"sensor_reading","timestamp":"not-a-date","station_id":"', s, '","device_id":"', d, '","readings":{{}}}}')
  WHEN c = 5 THEN"""


def _far(text: str) -> str:
    return text.replace("  WHEN c = 5 THEN", _FAR_CASES, 1)


_MALFORMED = " UNION ALL ".join(
    [
        "SELECT station_id, 'timestamp' AS column_name, count(*) FILTER (WHERE ts IS NULL) AS malformed FROM norm GROUP BY station_id",
        each(
            "SELECT station_id, '{c}', count(*) FILTER (WHERE raw_{c} IS NOT NULL AND num_{c} IS NULL) FROM norm GROUP BY station_id",
            " UNION ALL ",
        ),
    ]
)

ORACLES: dict[str, str] = {
    "rough_run_status": query(
        _ROUGH,
        f"""asked AS (SELECT unnest([{", ".join(f"'{name}'" for name in ASKED)}]) AS station_id),
facts AS (SELECT station_id, count(*) AS rows_read, count(ts) AS readable,
  count(*) FILTER (WHERE ts IS NOT NULL AND device_id IS NOT NULL) AS kept FROM norm GROUP BY station_id),
-- Filled: a device has bins from its first value of any sensor on.
found AS (SELECT station_id, count(DISTINCT device_id) AS devices FROM usable
  WHERE coalesce({each("{c}")}) IS NOT NULL GROUP BY station_id)""",
        select="""SELECT station_id, CASE WHEN rows_read IS NULL THEN 'no_data' WHEN readable = 0 THEN 'timestamps_unreadable'
    WHEN devices > 0 THEN 'ok' WHEN kept = 0 THEN 'empty_after_cleaning' ELSE 'empty_after_resampling' END AS run_status,
  coalesce(rows_read, 0) AS rows_read, coalesce(kept, 0) AS rows_after_cleaning, coalesce(devices, 0) AS devices_processed
FROM asked LEFT JOIN facts USING (station_id) LEFT JOIN found USING (station_id)""",
    ),
    "rough_malformed_counts": query(_ROUGH, select=_MALFORMED),
    "rough_resample_15min": query(
        _ROUGH,
        resampled(HOUR_US // 4, "usable"),
        select=f"SELECT {DEVICE}, ts AS timestamp, {_R6} FROM bins",
    ),
    "rough_event_classification": query(_far(PARSED), select="SELECT arrival_seq, event_id, outcome FROM outcomes"),
    "rough_accepted": query(
        _far(PARSED), select="SELECT event_id, arrival_seq, station_id FROM outcomes WHERE outcome = 'ok'"
    ),
    "rough_stream_folded": query(
        _far(AGGREGATES),
        select=f"""SELECT station_id, device_id, metric_type, bucket, bucket_start, count, {rounded('total')} AS total,
  {rounded('min_value')} AS min_value, {rounded('max_value')} AS max_value, {rounded('avg')} AS avg, latest_timestamp
FROM aggregates""",
    ),
}
