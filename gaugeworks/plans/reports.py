"""Report inputs: metric snapshots, quality findings and station health."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.config import MetricQuery
from gaugeworks.functions.text import format_period, iso_text, json_map_text
from gaugeworks.operators.normalize import STATION
from gaugeworks.sources.metric_store import STORED_ORDER, metric_filter

# Fixed value: most rows one snapshot shows.
SNAPSHOT_ROWS = 200
# Pieces a station's metrics are ranked in before its best rows meet.
_SALTS = 64
_TIE_BREAK = (*STORED_ORDER, "window_end", "resample_frequency", "missing_strategy")


def snapshot_rows(metrics: DataFrame, limit: int = SNAPSHOT_ROWS) -> DataFrame:
    """Per station the metrics a snapshot shows, numbered by ``position``.

    Up to ``limit`` rows all are shown in stored order; beyond it the newest by window start, newest
    first. Ranking happens in salted pieces first, so what meets in one task is bounded for any station.
    """
    return _ranked(metrics, limit).drop("rows_total")


def _ranked(metrics: DataFrame, limit: int) -> DataFrame:
    """The rows shown, with the number of all rows of their station."""
    newest_first = [F.desc("window_start"), *_TIE_BREAK]
    salt = F.pmod(F.xxhash64(*_TIE_BREAK), F.lit(_SALTS))
    piece = Window.partitionBy(STATION, "_salt")
    whole = Window.partitionBy(STATION)
    best = metrics.withColumn("_salt", salt).select(
        "*",
        F.row_number().over(piece.orderBy(*newest_first)).alias("_in_piece"),
        F.count(F.lit(1)).over(piece).alias("_piece_rows"),
    )
    # The first row of a piece stands for the size of the piece.
    total = F.sum(F.when(F.col("_in_piece") == 1, F.col("_piece_rows"))).over(whole)
    ranked = (
        best.filter(F.col("_in_piece") <= max(limit, 1))
        .select("*", total.alias("rows_total"), F.row_number().over(whole.orderBy(*newest_first)).alias("_rank"))
        .filter(F.col("_rank") <= limit)
    )
    stored = F.row_number().over(whole.orderBy(*_TIE_BREAK))
    position = F.when(F.col("rows_total") > limit, F.col("_rank")).otherwise(stored)
    return ranked.withColumn("position", position).select(
        STATION,
        "position",
        "device_id",
        "metric_name",
        F.bround("metric_value", 4).alias("metric_value"),
        "unit",
        "window_start",
        "window_end",
        "rows_total",
    )


def metrics_snapshot(metrics: DataFrame, limit: int = SNAPSHOT_ROWS) -> DataFrame:
    """The snapshot as JSON text, one row per station; ``limit`` bounds what a row collects.

    ``rows_total`` says how many metrics there are, next to the ``rows_shown`` of them.
    """
    entry = F.struct(
        "position",
        "device_id",
        "metric_name",
        "metric_value",
        "unit",
        iso_text(F.col("window_start")).alias("window_start"),
        iso_text(F.col("window_end")).alias("window_end"),
    )
    entries = F.array_sort(F.collect_list(entry))
    shown = F.transform(entries, lambda item: item.dropFields("position"))
    return (
        _ranked(metrics, limit)
        .groupBy(STATION)
        .agg(
            F.to_json(shown).alias("snapshot"),
            F.count(F.lit(1)).alias("rows_shown"),
            F.max("rows_total").alias("rows_total"),
        )
    )


def quality_findings_text(report: DataFrame) -> DataFrame:
    """Seven fixed lines per station, and the warnings if there are any."""
    fields = [
        ("total_rows_read", F.col("total_rows_read").cast("string")),
        ("total_rows_after_cleaning", F.col("total_rows_after_cleaning").cast("string")),
        ("column_missing_pct", json_map_text(F.col("column_missing_pct"))),
        ("out_of_range_counts", json_map_text(F.col("out_of_range_counts"))),
        ("malformed_value_counts", json_map_text(F.col("malformed_value_counts"))),
        ("timestamp_gaps", F.concat(F.col("gap_count").cast("string"), F.lit(" detected"))),
        ("flatline_periods", F.concat(F.col("flatline_count").cast("string"), F.lit(" detected"))),
    ]
    lines = [F.concat(F.lit(f"{name}: "), value) for name, value in fields]
    warnings = F.when(
        F.size("warnings") > 0, F.concat(F.lit("warnings: "), F.array_join("warnings", "; "))
    )
    return report.select(STATION, F.concat_ws("\n", *lines, warnings).alias("findings"))


def station_summary_input(
    metrics: DataFrame,
    stations: Iterable[str],
    start: datetime | None = None,
    end: datetime | None = None,
    limit: int = SNAPSHOT_ROWS,
) -> DataFrame:
    """What a health summary of each station starts from; ``found`` is false without stored metrics.

    A snapshot shows at most ``limit`` metrics, the newest; ``rows_shown`` of ``rows_total``.
    """
    query = MetricQuery(start_time=start, end_time=end)
    asked = metrics.sparkSession.createDataFrame([(name,) for name in stations], f"{STATION} string")
    wanted = metrics.filter(metric_filter(query)).join(asked, STATION, "left_semi")
    snapshots = metrics_snapshot(wanted, limit)
    return asked.join(snapshots, STATION, "left").select(
        STATION,
        F.col("snapshot").isNotNull().alias("found"),
        F.lit(format_period(start, end)).alias("period"),
        "snapshot",
        F.coalesce("rows_shown", F.lit(0)).alias("rows_shown"),
        F.coalesce("rows_total", F.lit(0)).alias("rows_total"),
    )
