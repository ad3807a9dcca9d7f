"""One batch run over any number of stations: quality, cleaning, resampling, metrics, summary."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.config import MetricThresholds, ProcessingOptions
from gaugeworks.contract import Contract, default_contract
from gaugeworks.operators.clean import apply_strategy, slice_readings
from gaugeworks.operators.metrics import METRIC_UNITS, device_metrics_wide, metric_rows
from gaugeworks.operators.normalize import (
    DEVICE,
    DEVICE_KEYS,
    MALFORMED,
    OUT_OF_RANGE,
    STATION,
    TIME,
    counted_columns,
    malformed_counts,
    missing_percentages,
    normalize,
    out_of_range_counts,
    rolled_up,
    station_counts,
    sum_of,
)
from gaugeworks.operators.quality import (
    detect_flatlines,
    detect_gaps,
    flatline_thresholds,
    warning_texts,
)
from gaugeworks.operators.resample import resample_mean
from gaugeworks.operators.slices import SLICE, calendar_slice, gather
from gaugeworks.session import prepare_session, write_down
from gaugeworks.sources.metric_store import MetricStore
from gaugeworks.sources.readings import scan_readings, with_station_metadata

# How a station's run ended.
RUN_STATES = ("ok", "no_data", "timestamps_unreadable", "empty_after_cleaning", "empty_after_resampling")


class StationRunError(RuntimeError):
    """At least one station has no result; the message lists its state."""


@dataclass(frozen=True)
class ProcessedStations:
    """Results of a run, computed and written down in the shared folder.

    Gaps and flatlines stay tables of one row per finding: a single station may have more of them than
    fit into one record.
    """

    options: ProcessingOptions
    counts: DataFrame
    gaps: DataFrame
    flatlines: DataFrame
    resampled: DataFrame
    metrics: DataFrame
    quality_report: DataFrame
    cleaning_summary: DataFrame
    time_range: DataFrame
    devices: DataFrame
    summary: DataFrame

    def save(self, store: MetricStore, batch_seq: int | None = None) -> DataFrame:
        """Upsert the metrics and return the summary."""
        store.save(self.metrics, batch_seq)
        return self.summary

    def raise_for_failures(self) -> ProcessedStations:
        """Turn station states other than ``ok`` into an error: their number, and the first twenty by name."""
        failed = self.summary.filter(F.col("run_status") != "ok").select(STATION, "run_status")
        if total := failed.count():
            first = failed.orderBy(STATION).limit(20).collect()
            named = ", ".join(f"{station}: {state}" for station, state in first)
            shown = "" if total == len(first) else f" (the first {len(first)}; ``summary`` has all)"
            raise StationRunError(f"{total} failed: {named}{shown}")
        return self


def process_stations(
    readings: DataFrame,
    options: ProcessingOptions | None = None,
    *,
    contract: Contract | None = None,
    thresholds: MetricThresholds | None = None,
    metadata: DataFrame | None = None,
) -> ProcessedStations:
    """Run every step for all stations asked for, without one bad station stopping the others.

    The readings are read twice: to count, per device and slice, what the reports need and how many rows a slice has, and to lay
    them out by device and slice; gaps, flatlines and cleaning then work on that layout without shuffling them again.
    """
    options = options or ProcessingOptions()
    contract = contract or default_contract()
    spark = prepare_session(readings.sparkSession)
    sensors = contract.numeric_names()
    scanned = scan_readings(
        readings,
        stations=options.stations,
        start=options.start_time,
        end=options.end_time,
        contract=contract,
    )
    normalized = normalize(scanned, contract)
    finer = (DEVICE, SLICE)
    fine = write_down(station_counts(normalized.withColumn(SLICE, calendar_slice(TIME)), contract, finer))
    counts = write_down(rolled_up(fine, finer))
    placed = fine.select(*DEVICE_KEYS, SLICE, F.col("usable_rows").alias("_rows")).where("_rows > 0")
    quality_frame = normalized.drop(MALFORMED, OUT_OF_RANGE)
    sliced = gather(slice_readings(quality_frame, sensors, counted=placed))

    # The results of a run, each read by the summary and by whoever asked for them.
    gaps = write_down(detect_gaps(sliced))
    thresholds_minutes = flatline_thresholds(contract, options.flatline_window_minutes)
    flatlines = write_down(detect_flatlines(sliced, thresholds_minutes))
    cleaned = apply_strategy(sliced.rows, sensors, options.missing_strategy, sliced)
    resampled = write_down(resample_mean(cleaned, options.resample_frequency, sensors))
    per_device = write_down(
        device_metrics_wide(resampled, options.resample_frequency, thresholds)
    )

    stations = _with_findings(_station_rows(spark, options, counts), gaps, flatlines, per_device)
    stations = stations.withColumn("run_status", run_status(options))
    cleaning = _cleaning_columns(options, contract)
    report = _report_columns(options, contract, counts, counted_columns(normalized, contract))
    if metadata is not None:
        stations = with_station_metadata(stations, metadata.select(STATION, "station_name"))
    else:
        stations = stations.withColumn("station_name", F.lit(None).cast("string"))
    return ProcessedStations(
        options=options,
        counts=counts,
        gaps=gaps,
        flatlines=flatlines,
        resampled=resampled,
        metrics=metric_rows(per_device, options.resample_frequency, options.missing_strategy),
        quality_report=stations.select(STATION, "run_status", *report),
        cleaning_summary=stations.select(STATION, *cleaning),
        time_range=stations.select(STATION, "range_start", "range_end"),
        devices=per_device.select(*DEVICE_KEYS).orderBy(*DEVICE_KEYS),
        summary=stations.select(
            STATION,
            "station_name",
            "run_status",
            "rows_read",
            _rows_after_cleaning(options).alias("rows_after_cleaning"),
            "rows_after_resampling",
            "devices_processed",
            (F.col("devices_processed") * len(METRIC_UNITS)).alias("metrics_saved"),
            F.lit(options.resample_frequency).alias("resample_frequency"),
            F.lit(options.missing_strategy).alias("missing_strategy"),
            "range_start",
            "range_end",
            F.struct(*report).alias("quality_report"),
        ),
    )


def _station_rows(spark: SparkSession, options: ProcessingOptions, counts: DataFrame) -> DataFrame:
    """The stations asked for, with zero counts for those without any reading."""
    if options.stations is None:
        return counts
    asked = spark.createDataFrame([(name,) for name in options.stations], f"{STATION} string")
    return asked.distinct().join(counts, STATION, "left").fillna(0)


def _with_findings(
    stations: DataFrame, gaps: DataFrame, flatlines: DataFrame, per_device: DataFrame
) -> DataFrame:
    found = [
        gaps.groupBy(STATION).agg(F.count(F.lit(1)).alias("gap_count")),
        flatlines.groupBy(STATION).agg(F.count(F.lit(1)).alias("flatline_count")),
        per_device.groupBy(STATION).agg(
            F.sum("bins").alias("rows_after_resampling"),
            F.count(F.lit(1)).alias("devices_processed"),
            F.min("window_start").alias("range_start"),
            F.max("window_end").alias("range_end"),
        ),
    ]
    for table in found:
        stations = stations.join(table, STATION, "left")
    return stations.fillna(
        0, ["gap_count", "flatline_count", "rows_after_resampling", "devices_processed"]
    )


def run_status(options: ProcessingOptions) -> Column:
    """How far a station got; the first step without rows names the state."""
    ok, no_data, unreadable, uncleaned, unsampled = RUN_STATES
    return (
        F.when(F.col("rows_read") == 0, no_data)
        .when(F.col("readable_timestamps") == 0, unreadable)
        .when(F.col("rows_after_resampling") > 0, ok)
        .when(_rows_after_cleaning(options) == 0, uncleaned)
        .otherwise(unsampled)
    )


def _rows_after_cleaning(options: ProcessingOptions) -> Column:
    """Filling keeps every usable reading, dropping keeps the complete ones: both are counted already."""
    return F.col("complete_rows" if options.missing_strategy == "drop" else "usable_rows")


def _cleaning_columns(options: ProcessingOptions, contract: Contract) -> list[Column]:
    after = _rows_after_cleaning(options)
    return [
        F.lit(options.missing_strategy).alias("strategy"),
        F.col("rows_read").alias("rows_before_cleaning"),
        after.alias("rows_after_cleaning"),
        (F.col("rows_read") - after).alias("rows_removed"),
        F.col("rows_after_resampling"),
        sum_of("malformed", contract).alias("malformed_values_coerced"),
        sum_of("out_of_range", contract).alias("out_of_range_values_nullified"),
    ]


def _report_columns(
    options: ProcessingOptions, contract: Contract, counts: DataFrame, names: list[str]
) -> list[Column]:
    return [
        F.col("rows_read").alias("total_rows_read"),
        _rows_after_cleaning(options).alias("total_rows_after_cleaning"),
        missing_percentages([TIME, *contract.numeric_names()]).alias("column_missing_pct"),
        out_of_range_counts(counts, names).alias("out_of_range_counts"),
        malformed_counts(counts, names).alias("malformed_value_counts"),
        F.col("gap_count"),
        F.col("flatline_count"),
        warning_texts(
            sum_of("out_of_range", contract), F.col("gap_count"), F.col("flatline_count")
        ).alias("warnings"),
    ]
