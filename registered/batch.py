"""Registered queries over sensor readings, and the SQL each is compared with."""

from __future__ import annotations

from collections.abc import Callable
from datetime import UTC, datetime
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.config import MetricQuery, MetricThresholds, ProcessingOptions, StructuredQuery
from gaugeworks.contract import default_contract
from gaugeworks.operators.clean import apply_strategy, slice_readings
from gaugeworks.operators.metrics import device_metrics, device_metrics_wide
from gaugeworks.operators.normalize import (
    MALFORMED,
    OUT_OF_RANGE,
    counted_columns,
    malformed_counts,
    missing_percentages,
    normalize,
    out_of_range_counts,
    station_counts,
)
from gaugeworks.operators.quality import (
    detect_flatlines,
    detect_gaps,
    device_intervals,
    flatline_thresholds,
)
from gaugeworks.operators.resample import resample_mean
from gaugeworks.plans.reports import metrics_snapshot, quality_findings_text, snapshot_rows, station_summary_input
from gaugeworks.plans.stations import ProcessedStations, process_stations
from gaugeworks.plans.structured import run_structured_queries, run_structured_query
from gaugeworks.session import shared_folder, write_down
from gaugeworks.sources.metric_store import MetricStore, query_metrics, upsert_metrics
from gaugeworks.sources.readings import scan_readings, sorted_readings, with_station_metadata
from registered import sql
from registered.sql import CLEANED, DEVICE, FLATLINES, GAPS, HOUR_US, NORMALIZED, each, query, rounded
from registered.views import comparable, sensor_readings, station_metadata

Query = Callable[[SparkSession, str], DataFrame]

CONTRACT = default_contract()
SENSORS = CONTRACT.numeric_names()
NAMES = ["timestamp", *SENSORS]
SCAN_FROM, SCAN_TO = datetime(2024, 1, 3, tzinfo=UTC), datetime(2024, 1, 27, 12, tzinfo=UTC)
QUERY_FROM, QUERY_TO = datetime(2024, 1, 10, tzinfo=UTC), datetime(2024, 1, 20, 6, tzinfo=UTC)
LATER_RUNS = datetime(2024, 1, 16, tzinfo=UTC)
OTHER_THRESHOLDS = MetricThresholds(active_rpm=1200.0, specific_power_flow=100.0)


# ---- Spark side ----------------------------------------------------------------------------------


def quality_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize(sensor_readings(spark, sf_dir), CONTRACT).drop(MALFORMED, OUT_OF_RANGE)


def scan_station_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    readings = sensor_readings(spark, sf_dir)
    rows = scan_readings(readings, stations=["S0", "S1"], start=SCAN_FROM, end=SCAN_TO)
    return comparable(rows.select("event_id", "station_id", "device_id", "timestamp"))


def normalized_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparable(quality_frame(spark, sf_dir))


def first_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 500 readings of a report, in its order."""
    return comparable(sorted_readings(quality_frame(spark, sf_dir)).limit(500))


def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return station_counts(normalize(sensor_readings(spark, sf_dir), CONTRACT), CONTRACT)


def _exploded(counts: DataFrame, column: Column, name: str) -> DataFrame:
    return counts.select("station_id", F.explode(column).alias("column_name", name))


def malformed_count_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = _counts(spark, sf_dir)
    names = counted_columns(sensor_readings(spark, sf_dir), CONTRACT)
    return _exploded(counts, malformed_counts(counts, names), "malformed")


def out_of_range_count_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = _counts(spark, sf_dir)
    names = counted_columns(sensor_readings(spark, sf_dir), CONTRACT)
    return _exploded(counts, out_of_range_counts(counts, names), "out_of_range")


def missing_pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _exploded(_counts(spark, sf_dir), missing_percentages(NAMES), "missing_pct")


def expected_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return device_intervals(slice_readings(quality_frame(spark, sf_dir), SENSORS))


def timestamp_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparable(detect_gaps(slice_readings(quality_frame(spark, sf_dir), SENSORS)))


def flatline_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    sliced = slice_readings(quality_frame(spark, sf_dir), SENSORS)
    found = detect_flatlines(sliced, flatline_thresholds(CONTRACT, 30))
    return comparable(found.withColumnRenamed("column", "column_name"))


def cleaned(spark: SparkSession, sf_dir: str, strategy: str) -> DataFrame:
    return apply_strategy(quality_frame(spark, sf_dir), SENSORS, strategy)


def _clean_query(strategy: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return comparable(cleaned(spark, sf_dir, strategy))

    return run


def _resample_query(strategy: str, frequency: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return comparable(resample_mean(cleaned(spark, sf_dir, strategy), frequency, SENSORS))

    return run


def interval_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    bins = resample_mean(cleaned(spark, sf_dir, "drop"), "1h", SENSORS)
    wide = device_metrics_wide(bins, "1h")
    return comparable(wide.select("station_id", "device_id", "bins", "interval_hours"))


def _metric_columns(metrics: DataFrame) -> DataFrame:
    return comparable(metrics.drop("computed_at"), metric_value=4)


def device_metric_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    bins = resample_mean(cleaned(spark, sf_dir, "fill"), "1h", SENSORS)
    return _metric_columns(device_metrics(bins, "1h", "fill"))


def average_pressure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: scan, validate, fill, resample to hours, mean pressure per device."""
    bins = resample_mean(cleaned(spark, sf_dir, "fill"), "1h", SENSORS)
    wide = device_metrics_wide(bins, "1h")
    return comparable(wide.select("station_id", "device_id", "average_pressure_bar", "peak_pressure_bar"))


def daily_metrics(
    spark: SparkSession,
    sf_dir: str,
    frequency: str = "1h",
    thresholds: MetricThresholds | None = None,
    start: datetime | None = None,
) -> DataFrame:
    """One run per device and day: a stored-metrics table that grows with the readings."""
    readings = scan_readings(sensor_readings(spark, sf_dir), start=start)
    clean = apply_strategy(
        normalize(readings, CONTRACT).drop(MALFORMED, OUT_OF_RANGE), SENSORS, "drop"
    )
    bins = resample_mean(clean, frequency, SENSORS).withColumn("day", F.to_date("timestamp"))
    return device_metrics(bins, frequency, "drop", thresholds, runs=["day"])


def processed(spark: SparkSession, sf_dir: str, strategy: str = "fill") -> ProcessedStations:
    options = ProcessingOptions(
        stations=("S0", "S1", "S2", "S9"), resample_frequency="1h", missing_strategy=strategy
    )
    return process_stations(
        sensor_readings(spark, sf_dir), options, contract=CONTRACT, metadata=station_metadata(spark)
    )


def cleaning_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return processed(spark, sf_dir, "drop").cleaning_summary


def time_range_devices(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = processed(spark, sf_dir)
    return comparable(result.devices.join(result.time_range, "station_id"))


def quality_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = processed(spark, sf_dir).quality_report
    return report.select("station_id", F.posexplode("warnings").alias("position", "warning"))


def run_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return processed(spark, sf_dir).summary.select("station_id", "run_status")


def process_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparable(processed(spark, sf_dir).summary.drop("quality_report"))


def quality_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_findings_text(processed(spark, sf_dir).quality_report)


def metadata_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = _counts(spark, sf_dir).select("station_id", "rows_read")
    return with_station_metadata(counts, station_metadata(spark))


def metrics_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily metrics of January, overwritten by runs of its second half and joined by two-hour runs."""
    new = daily_metrics(spark, sf_dir, "1h", OTHER_THRESHOLDS, LATER_RUNS).unionByName(
        daily_metrics(spark, sf_dir, "2h", None, LATER_RUNS)
    )
    return _metric_columns(upsert_metrics(daily_metrics(spark, sf_dir), new))


def metrics_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by way of a store: three commits, a compaction after the second, and a read."""
    store = MetricStore(spark, f"{shared_folder(spark)}/metrics-{uuid4().hex}")
    store.save(daily_metrics(spark, sf_dir))
    store.save(daily_metrics(spark, sf_dir, "1h", OTHER_THRESHOLDS, LATER_RUNS))
    store.compact()
    store.save(daily_metrics(spark, sf_dir, "2h", None, LATER_RUNS))
    return _metric_columns(store.load())


def metrics_overlap_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = MetricQuery(station_id="S1", start_time=QUERY_FROM, end_time=QUERY_TO)
    return _metric_columns(query_metrics(daily_metrics(spark, sf_dir), asked))


def _metric_query(aggregation: str, metric: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        asked = StructuredQuery(
            station_id="S2",
            metric_name=metric,
            aggregation=aggregation,
            start_time=QUERY_FROM.isoformat(),
            end_time="2024-01-20T06:00:00",
        )
        answer = run_structured_query(daily_metrics(spark, sf_dir), asked)
        return comparable(answer.aggregate, 4)

    return run


def metric_requests(metrics: DataFrame) -> DataFrame:
    """A question per stored station, metric and aggregation, some of them not answerable."""
    seven = F.array(*[F.lit(name) for name in sql.UNITS])
    wanted = metrics.select("station_id").distinct().select(
        "station_id", F.explode(seven).alias("metric_name")
    )
    names = F.array(*[F.lit(name) for name in ("mean", "max", "sum", "latest")])
    asked = wanted.select("*", F.explode(names).alias("aggregation"))
    day_of = {"mean": 5, "max": 9, "sum": 2, "latest": 20}
    start = F.coalesce(
        *[
            F.when(F.col("aggregation") == name, F.lit(f"2024-01-{day:02d}T06:00:00"))
            for name, day in day_of.items()
        ]
    )
    unclear = F.col("metric_name") == "peak_pressure_bar"
    return asked.select(
        F.concat_ws("/", "station_id", "metric_name", "aggregation").alias("request_id"),
        F.when(~(unclear & (F.col("aggregation") == "mean")), F.col("station_id")).alias("station_id"),
        F.lit(None).cast("string").alias("device_id"),
        F.when(~(unclear & (F.col("aggregation") == "max")), F.col("metric_name")).alias("metric_name"),
        "aggregation",
        F.when(unclear & (F.col("aggregation") == "sum"), "yesterday").otherwise(start).alias("start_time"),
        F.lit("2024-01-25").alias("end_time"),
        (unclear & (F.col("aggregation") == "latest")).alias("needs_clarification"),
    )


def metric_query_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    metrics = write_down(daily_metrics(spark, sf_dir))
    return comparable(run_structured_queries(metrics, metric_requests(metrics)), 4)


def metrics_snapshot_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparable(snapshot_rows(daily_metrics(spark, sf_dir)), 9)


def metrics_snapshot_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics_snapshot(daily_metrics(spark, sf_dir))


def station_health_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = station_summary_input(
        daily_metrics(spark, sf_dir), ["S0", "S1", "S2", "S9"], QUERY_FROM, QUERY_TO
    )
    return found.select("station_id", "found", "period", "snapshot", "rows_shown", "rows_total")


QUERIES: dict[str, Query] = {
    "scan_station_range": scan_station_range,
    "normalized_readings": normalized_readings,
    "first_readings": first_readings,
    "malformed_counts": malformed_count_rows,
    "out_of_range_counts": out_of_range_count_rows,
    "missing_pct": missing_pct,
    "expected_interval": expected_interval,
    "timestamp_gaps": timestamp_gaps,
    "flatline_periods": flatline_periods,
    "clean_drop": _clean_query("drop"),
    "clean_fill": _clean_query("fill"),
    "clean_interpolate": _clean_query("interpolate"),
    "resample_1h": _resample_query("fill", "1h"),
    "resample_15min": _resample_query("interpolate", "15min"),
    "resample_5h_origin": _resample_query("drop", "5h"),
    "interval_hours": interval_hours,
    "average_pressure": average_pressure,
    "device_metrics": device_metric_rows,
    "daily_metrics": lambda spark, sf_dir: _metric_columns(daily_metrics(spark, sf_dir)),
    "cleaning_summary": cleaning_summary,
    "time_range_devices": time_range_devices,
    "quality_warnings": quality_warnings,
    "run_status": run_status,
    "process_summary": process_summary,
    "quality_findings": quality_findings,
    "metadata_join": metadata_join,
    "metrics_upsert": metrics_upsert,
    "metrics_stored": metrics_stored,
    "metrics_overlap_filter": metrics_overlap_filter,
    "metric_query_mean": _metric_query("mean", "average_pressure_bar"),
    "metric_query_max": _metric_query("max", "peak_pressure_bar"),
    "metric_query_sum": _metric_query("sum", "total_flow_volume_m3"),
    "metric_query_latest": _metric_query("latest", "active_ratio_pct"),
    "metric_query_batch": metric_query_batch,
    "metrics_snapshot_rows": metrics_snapshot_rows,
    "metrics_snapshot": metrics_snapshot_text,
    "station_health_input": station_health_input,
}


# ---- SQL side ------------------------------------------------------------------------------------

_R6 = each(f"{rounded('{c}')} AS {{c}}")
_METRICS = (
    f"station_id, device_id, metric_name, {rounded('metric_value', 4)} AS metric_value, unit, "
    "window_start, window_end, resample_frequency, missing_strategy"
)
_FILLED_1H = (NORMALIZED, CLEANED["fill"], sql.resampled(HOUR_US))
_DAILY = (
    NORMALIZED,
    CLEANED["drop"],
    sql.resampled(HOUR_US),
    sql.metrics(HOUR_US, "1h", "drop", run="CAST(ts AS DATE)"),
)
_WINDOW = (
    f"window_end >= TIMESTAMP '{QUERY_FROM:%Y-%m-%d %H:%M:%S}' "
    f"AND window_start <= TIMESTAMP '{QUERY_TO:%Y-%m-%d %H:%M:%S}'"
)
_LATEST = (
    "first(metric_value ORDER BY window_end DESC, station_id, device_id, metric_name, window_start, "
    "resample_frequency, missing_strategy)"
)
_ASKED = "asked(station_id) AS (VALUES ('S0'), ('S1'), ('S2'), ('S9'))"
_META = """meta(station_id, station_name, location, commissioned_date, num_compressors) AS (VALUES
  ('S0', 'North plant', 'Hall 1', '2015-04-01', 2), ('S1', 'South plant', 'Hall 2', '2018-09-15', 2))"""


def _count_rows(pattern: str, name: str, others: tuple[str, ...]) -> str:
    sensors = each(
        "SELECT station_id, '{c}' AS column_name, " + pattern + f" AS {name} FROM norm GROUP BY station_id",
        " UNION ALL ",
    )
    fixed = "".join(
        f" UNION ALL SELECT DISTINCT station_id, '{other}', CAST(0 AS {'DOUBLE' if name == 'missing_pct' else 'BIGINT'}) FROM norm"
        for other in others
    )
    return query(NORMALIZED, select=sensors + fixed)


def _cleaned_sql(strategy: str) -> str:
    return query(
        NORMALIZED,
        CLEANED[strategy],
        select=f"SELECT event_id, ts AS timestamp, {DEVICE}, {_R6} FROM clean",
    )


def _resampled_sql(strategy: str, step_us: int) -> str:
    return query(
        NORMALIZED,
        CLEANED[strategy],
        sql.resampled(step_us),
        select=f"SELECT {DEVICE}, ts AS timestamp, {_R6} FROM bins",
    )


def _metric_query_sql(aggregate: str, metric: str) -> str:
    return query(
        *_DAILY,
        select=f"""SELECT {rounded(aggregate, 4)} AS aggregate_value FROM metrics
WHERE station_id = 'S2' AND metric_name = '{metric}' AND {_WINDOW}""",
    )


_STATION_COUNTS = f"""counted AS (
  SELECT station_id, count(*) AS rows_read,
    count(*) FILTER (WHERE {each("{c} IS NOT NULL", " AND ")}) AS complete_rows,
    CAST({each("count(*) FILTER (WHERE raw_{c} IS NOT NULL AND num_{c} IS NULL)", " + ")} AS BIGINT) AS malformed,
    CAST({each("count(*) FILTER (WHERE num_{c} < {lo} OR num_{c} > {hi})", " + ")} AS BIGINT) AS out_of_range
  FROM norm GROUP BY station_id)"""
_FINDINGS = """gap_counts AS (SELECT station_id, count(*) AS gap_count FROM gaps GROUP BY station_id),
flat_counts AS (SELECT station_id, count(*) AS flatline_count FROM flatlines GROUP BY station_id)"""
_BIN_COUNTS = f"""per_device AS (
  SELECT {DEVICE}, count(*) AS n, min(ts) AS lo, max(ts) AS hi FROM bins GROUP BY {DEVICE}),
per_station AS (
  SELECT station_id, CAST(sum(n) AS BIGINT) AS rows_after_resampling, count(*) AS devices_processed,
    min(lo) AS range_start, max(hi) AS range_end FROM per_device GROUP BY station_id)"""


def _json_of(pattern: str, leading: str) -> str:
    """A map as text, with the sensors in contract order after the ``leading`` entries."""
    entries = each("""', "{c}": ' || """ + pattern, " || ")
    return f"""'{{{leading}' || {entries} || '}}'"""


_PERCENT = "CAST(round_even(count(*) FILTER (WHERE {c} IS NULL) * 100.0 / count(*), 2) AS DOUBLE)"
_QUALITY_FINDINGS = query(
    NORMALIZED,
    GAPS,
    FLATLINES,
    _FINDINGS,
    _STATION_COUNTS,
    f"""maps AS (
  SELECT station_id,
    {_json_of("CAST(" + _PERCENT + " AS VARCHAR)", '"timestamp": 0.0')} AS missing,
    {_json_of("count(*) FILTER (WHERE num_{c} < {lo} OR num_{c} > {hi})", '"station_id": 0, "device_id": 0')} AS beyond,
    {_json_of("count(*) FILTER (WHERE raw_{c} IS NOT NULL AND num_{c} IS NULL)", '"timestamp": 0, "station_id": 0, "device_id": 0')} AS bad
  FROM norm GROUP BY station_id)""",
    _ASKED,
    """reported AS (SELECT * FROM asked JOIN counted USING (station_id) JOIN maps USING (station_id)
  LEFT JOIN gap_counts USING (station_id) LEFT JOIN flat_counts USING (station_id))""",
    select="""SELECT station_id, concat_ws(chr(10),
  'total_rows_read: ' || rows_read, 'total_rows_after_cleaning: ' || rows_read,
  'column_missing_pct: ' || missing, 'out_of_range_counts: ' || beyond, 'malformed_value_counts: ' || bad,
  'timestamp_gaps: ' || coalesce(gap_count, 0) || ' detected',
  'flatline_periods: ' || coalesce(flatline_count, 0) || ' detected',
  'warnings: ' || nullif(concat_ws('; ',
    CASE WHEN out_of_range > 0 THEN out_of_range || ' out-of-range values were nullified' END,
    CASE WHEN gap_count > 0 THEN gap_count || ' timestamp gaps detected' END,
    CASE WHEN flatline_count > 0 THEN flatline_count || ' flatline periods detected' END), '')) AS findings
FROM reported
UNION ALL
SELECT 'S9', concat_ws(chr(10), 'total_rows_read: 0', 'total_rows_after_cleaning: 0',
  'column_missing_pct: {"timestamp": 0.0, "discharge_pressure": 0.0, "air_flow_rate": 0.0, "power_consumption": 0.0, "motor_speed": 0.0, "discharge_temp": 0.0}',
  'out_of_range_counts: {"station_id": 0, "device_id": 0, "discharge_pressure": 0, "air_flow_rate": 0, "power_consumption": 0, "motor_speed": 0, "discharge_temp": 0}',
  'malformed_value_counts: {"timestamp": 0, "station_id": 0, "device_id": 0, "discharge_pressure": 0, "air_flow_rate": 0, "power_consumption": 0, "motor_speed": 0, "discharge_temp": 0}',
  'timestamp_gaps: 0 detected', 'flatline_periods: 0 detected')""",
)

_SNAPSHOT = (
    "station_id, device_id, metric_name, window_start, window_end, resample_frequency, missing_strategy"
)

def _half_even(column: str) -> str:
    """Four digits, ties to even, by the decimal digits that a double is written with."""
    exact = f"(CAST(CAST({column} AS VARCHAR) AS DECIMAL(30, 17)) * 10000)"
    even = f"(floor({exact}) + CASE WHEN floor({exact}) % 2 = 0 THEN 0 ELSE 1 END)"
    whole = f"CASE WHEN {exact} - floor({exact}) = 0.5 THEN {even} ELSE round({exact}) END"
    return f"(CAST({whole} AS DOUBLE) / 10000)"


def _snapshots(where: str = "") -> tuple[str, ...]:
    """Snapshot text per station. Spark writes doubles below a thousandth with an exponent."""
    number = """CASE WHEN v <> 0 AND abs(v) < 0.001 THEN CAST(CAST(round(v * 10000) AS INT) AS VARCHAR) || '.0E-4'
    ELSE CAST(v AS VARCHAR) END"""
    moment = "strftime({}, '%Y-%m-%dT%H:%M:%S+00:00')"
    entry = f"""'{{"device_id":"' || device_id || '","metric_name":"' || metric_name
    || coalesce('","metric_value":' || {number}, '"') || coalesce(',"unit":"' || unit || '"', '')
    || ',"window_start":"' || {moment.format("window_start")} || '","window_end":"' || {moment.format("window_end")} || '"}}'"""
    return (
        f"""chosen AS (
  SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY window_start DESC, {_SNAPSHOT}) AS newest,
    row_number() OVER (PARTITION BY station_id ORDER BY {_SNAPSHOT}) AS stored,
    count(*) OVER (PARTITION BY station_id) AS n, {_half_even("metric_value")} AS v FROM metrics {where})""",
        f"""entries AS (
  SELECT station_id, n, CASE WHEN n > 200 THEN newest ELSE stored END AS place, {entry} AS entry FROM chosen WHERE newest <= 200)""",
        """snapshots AS (
  SELECT station_id, '[' || string_agg(entry, ',' ORDER BY place) || ']' AS snapshot, count(*) AS rows_shown, max(n) AS rows_total
  FROM entries GROUP BY station_id)""",
    )


ORACLES: dict[str, str] = {
    "scan_station_range": query(
        NORMALIZED,
        select=f"""SELECT event_id, station_id, device_id, ts AS timestamp FROM readings
WHERE station_id IN ('S0', 'S1') AND ts BETWEEN TIMESTAMP '{SCAN_FROM:%Y-%m-%d %H:%M:%S}' AND TIMESTAMP '{SCAN_TO:%Y-%m-%d %H:%M:%S}'""",
    ),
    "normalized_readings": query(
        NORMALIZED, select=f"SELECT event_id, ts AS timestamp, {DEVICE}, {_R6} FROM norm"
    ),
    "first_readings": query(
        NORMALIZED,
        select=f"""SELECT event_id, ts AS timestamp, {DEVICE}, {_R6} FROM norm
ORDER BY station_id NULLS FIRST, device_id NULLS FIRST, ts NULLS FIRST, event_id LIMIT 500""",
    ),
    "malformed_counts": _count_rows(
        "count(*) FILTER (WHERE raw_{c} IS NOT NULL AND num_{c} IS NULL)",
        "malformed",
        ("timestamp", "station_id", "device_id"),
    ),
    "out_of_range_counts": _count_rows(
        "count(*) FILTER (WHERE num_{c} < {lo} OR num_{c} > {hi})",
        "out_of_range",
        ("station_id", "device_id"),
    ),
    "missing_pct": _count_rows(
        "round_even(count(*) FILTER (WHERE {c} IS NULL) * 100.0 / count(*), 2)",
        "missing_pct",
        ("timestamp",),
    ),
    "expected_interval": query(
        NORMALIZED, sql.EXPECTED, select=f"SELECT {DEVICE}, expected_us FROM expected"
    ),
    "timestamp_gaps": query(NORMALIZED, GAPS, select="SELECT * FROM gaps"),
    "flatline_periods": query(
        NORMALIZED,
        FLATLINES,
        select=f"""SELECT {DEVICE}, col AS column_name, start_time, end_time,
  {rounded("duration_minutes")} AS duration_minutes, {rounded("value")} AS value FROM flatlines""",
    ),
    "clean_drop": _cleaned_sql("drop"),
    "clean_fill": _cleaned_sql("fill"),
    "clean_interpolate": _cleaned_sql("interpolate"),
    "resample_1h": _resampled_sql("fill", HOUR_US),
    "resample_15min": _resampled_sql("interpolate", HOUR_US // 4),
    "resample_5h_origin": _resampled_sql("drop", 5 * HOUR_US),
    "interval_hours": query(
        NORMALIZED,
        CLEANED["drop"],
        sql.resampled(HOUR_US),
        sql.metrics(HOUR_US, "1h", "drop"),
        select=f"SELECT {DEVICE}, n AS bins, {rounded("h")} AS interval_hours FROM metrics_wide",
    ),
    "average_pressure": query(
        *_FILLED_1H,
        sql.metrics(HOUR_US, "1h", "fill"),
        select=f"""SELECT {DEVICE}, {rounded("average_pressure_bar")} AS average_pressure_bar,
  {rounded("peak_pressure_bar")} AS peak_pressure_bar FROM metrics_wide""",
    ),
    "device_metrics": query(
        *_FILLED_1H, sql.metrics(HOUR_US, "1h", "fill"), select=f"SELECT {_METRICS} FROM metrics"
    ),
    "daily_metrics": query(*_DAILY, select=f"SELECT {_METRICS} FROM metrics"),
    "cleaning_summary": query(
        NORMALIZED,
        CLEANED["drop"],
        sql.resampled(HOUR_US),
        _STATION_COUNTS,
        _BIN_COUNTS,
        _ASKED,
        select="""SELECT station_id, 'drop' AS strategy, coalesce(rows_read, 0) AS rows_before_cleaning,
  coalesce(complete_rows, 0) AS rows_after_cleaning, coalesce(rows_read - complete_rows, 0) AS rows_removed,
  coalesce(rows_after_resampling, 0) AS rows_after_resampling,
  coalesce(malformed, 0) AS malformed_values_coerced, coalesce(out_of_range, 0) AS out_of_range_values_nullified
FROM asked LEFT JOIN counted USING (station_id) LEFT JOIN per_station USING (station_id)""",
    ),
    "time_range_devices": query(
        *_FILLED_1H,
        _BIN_COUNTS,
        select="""SELECT station_id, device_id, range_start, range_end
FROM per_device JOIN per_station USING (station_id)""",
    ),
    "quality_warnings": query(
        NORMALIZED,
        GAPS,
        FLATLINES,
        _FINDINGS,
        _STATION_COUNTS,
        """warned AS (
  SELECT station_id, list_filter([
    CASE WHEN out_of_range > 0 THEN out_of_range || ' out-of-range values were nullified' END,
    CASE WHEN gap_count > 0 THEN gap_count || ' timestamp gaps detected' END,
    CASE WHEN flatline_count > 0 THEN flatline_count || ' flatline periods detected' END],
    lambda text: text IS NOT NULL) AS texts
  FROM counted LEFT JOIN gap_counts USING (station_id) LEFT JOIN flat_counts USING (station_id))""",
        select="""SELECT station_id, CAST(unnest(range(len(texts))) AS INT) AS position,
  unnest(texts) AS warning FROM warned""",
    ),
    "run_status": query(
        NORMALIZED,
        _ASKED,
        "present AS (SELECT DISTINCT station_id, true AS here FROM norm)",
        select="""SELECT station_id, CASE WHEN here THEN 'ok' ELSE 'no_data' END AS run_status
FROM asked LEFT JOIN present USING (station_id)""",
    ),
    "process_summary": query(
        *_FILLED_1H,
        _STATION_COUNTS,
        _BIN_COUNTS,
        _ASKED,
        _META,
        select="""SELECT station_id, station_name, CASE WHEN rows_read > 0 THEN 'ok' ELSE 'no_data' END AS run_status,
  coalesce(rows_read, 0) AS rows_read, coalesce(rows_read, 0) AS rows_after_cleaning,
  coalesce(rows_after_resampling, 0) AS rows_after_resampling,
  coalesce(devices_processed, 0) AS devices_processed, coalesce(devices_processed, 0) * 7 AS metrics_saved,
  '1h' AS resample_frequency, 'fill' AS missing_strategy, range_start, range_end
FROM asked LEFT JOIN counted USING (station_id) LEFT JOIN per_station USING (station_id)
  LEFT JOIN meta USING (station_id)""",
    ),
    "quality_findings": _QUALITY_FINDINGS,
    "metadata_join": query(
        NORMALIZED,
        _STATION_COUNTS,
        _META,
        select="""SELECT station_id, rows_read, station_name, location, commissioned_date, num_compressors
FROM counted LEFT JOIN meta USING (station_id)""",
    ),
    "metrics_upsert": query(
        *_DAILY,
        f"later AS (SELECT * FROM clean WHERE ts >= TIMESTAMP '{LATER_RUNS:%Y-%m-%d}')",
        sql.resampled(HOUR_US, "later", "bins1"),
        sql.metrics(HOUR_US, "1h", "drop", bins="bins1", name="new1", rpm=1200, flow=100, run="CAST(ts AS DATE)"),
        sql.resampled(2 * HOUR_US, "later", "bins2"),
        sql.metrics(2 * HOUR_US, "2h", "drop", bins="bins2", name="new2", run="CAST(ts AS DATE)"),
        f"""stored AS (SELECT 0 AS seq, * FROM metrics UNION ALL SELECT 1, * FROM new1 UNION ALL SELECT 1, * FROM new2),
latest AS (SELECT * FROM stored QUALIFY row_number() OVER (PARTITION BY {_SNAPSHOT} ORDER BY seq DESC) = 1)""",
        select=f"SELECT {_METRICS} FROM latest",
    ),
    "metrics_overlap_filter": query(
        *_DAILY, select=f"SELECT {_METRICS} FROM metrics WHERE station_id = 'S1' AND {_WINDOW}"
    ),
    "metric_query_mean": _metric_query_sql("avg(metric_value)", "average_pressure_bar"),
    "metric_query_max": _metric_query_sql("max(metric_value)", "peak_pressure_bar"),
    "metric_query_sum": _metric_query_sql("sum(metric_value)", "total_flow_volume_m3"),
    "metric_query_latest": _metric_query_sql(_LATEST, "active_ratio_pct"),
    "metric_query_batch": query(
        *_DAILY,
        """kinds(aggregation, since) AS (VALUES ('mean', TIMESTAMP '2024-01-05 06:00:00'), ('max', TIMESTAMP '2024-01-09 06:00:00'),
  ('sum', TIMESTAMP '2024-01-02 06:00:00'), ('latest', TIMESTAMP '2024-01-20 06:00:00')),
requests AS (
  SELECT DISTINCT concat_ws('/', station_id, metric_name, aggregation) AS request_id, station_id, metric_name, aggregation, since,
    CASE WHEN metric_name = 'peak_pressure_bar' THEN CASE aggregation WHEN 'mean' THEN 'station_missing'
      WHEN 'max' THEN 'metric_missing' WHEN 'sum' THEN 'start_time_unreadable' ELSE 'needs_clarification' END END AS refusal
  FROM metrics, kinds),
answers AS (
  SELECT r.request_id, count(*) AS matched, CASE any_value(r.aggregation) WHEN 'mean' THEN avg(metric_value)
    WHEN 'max' THEN max(metric_value) WHEN 'sum' THEN sum(metric_value)
    ELSE first(metric_value ORDER BY window_end DESC, device_id, window_start) END AS value
  FROM requests r JOIN metrics m ON r.refusal IS NULL AND r.station_id = m.station_id AND r.metric_name = m.metric_name
    AND m.window_end >= r.since AND m.window_start <= TIMESTAMP '2024-01-25 00:00:00'
  GROUP BY r.request_id)""",
        select=f"""SELECT request_id, refusal, coalesce(matched, 0) AS matched_rows, {rounded("value", 4)} AS aggregate_value
FROM requests LEFT JOIN answers USING (request_id)""",
    ),
    "metrics_snapshot": query(*_DAILY, *_snapshots(), select="SELECT station_id, snapshot, rows_shown, rows_total FROM snapshots"),
    "metrics_snapshot_rows": query(
        *_DAILY,
        f"""ranked AS (
  SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY window_start DESC, {_SNAPSHOT}) AS newest,
    count(*) OVER (PARTITION BY station_id) AS n FROM metrics),
placed AS (
  SELECT *, CASE WHEN n > 200 THEN newest ELSE row_number() OVER (PARTITION BY station_id ORDER BY {_SNAPSHOT}) END AS place
  FROM ranked WHERE newest <= 200)""",
        select=f"""SELECT station_id, CAST(place AS INT) AS position, device_id, metric_name,
  {_half_even("metric_value")} AS metric_value, unit, window_start, window_end FROM placed""",
    ),
    "station_health_input": query(
        *_DAILY,
        _ASKED,
        *_snapshots(f"WHERE {_WINDOW}"),
        select=f"""SELECT station_id, snapshot IS NOT NULL AS found,
  '{QUERY_FROM.isoformat()} to {QUERY_TO.isoformat()}' AS period, snapshot,
  coalesce(rows_shown, 0) AS rows_shown, coalesce(rows_total, 0) AS rows_total
FROM asked LEFT JOIN snapshots USING (station_id)""",
    ),
}
# The store ends with the same rows.
ORACLES["metrics_stored"] = ORACLES["metrics_upsert"]
