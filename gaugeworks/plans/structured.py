"""Structured metric questions: answered exactly, or refused with a reason."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks.config import AGGREGATIONS, MetricQuery, StructuredQuery
from gaugeworks.functions.coerce import timestamp_from_text
from gaugeworks.functions.timegrid import as_utc, micros
from gaugeworks.operators.metrics import METRIC_UNITS
from gaugeworks.plans.interval_index import IntervalIndex, blocks_between, build_index, day_of, merged, partials
from gaugeworks.sources.metric_store import STORED_ORDER, metric_filter

# Reasons a question is refused, in the order they are checked.
REFUSALS = {
    "needs_clarification": "The question needs clarification.",
    "station_missing": "Please name a station.",
    "metric_missing": "Please name a metric, for example average_pressure_bar or cycle_count.",
    "metric_unsupported": "This metric is not computed.",
    "aggregation_unsupported": "The aggregation must be mean, max, sum or latest.",
    "start_time_unreadable": "start_time is not an ISO-8601 time such as 2024-01-01T00:00:00.",
    "end_time_unreadable": "end_time is not an ISO-8601 time such as 2024-01-01T00:00:00.",
    "window_inverted": "start_time must be before end_time.",
}
REQUEST_SCHEMA = (
    "request_id string, station_id string, device_id string, metric_name string, aggregation string, "
    "start_time string, end_time string, needs_clarification boolean"
)
# Up to this many questions are sent to every task; more are joined by shuffle.
_BROADCAST_REQUESTS = 100_000
# Pieces the metrics of one station and name are split into for that shuffle.
_SALTS = 32


@dataclass(frozen=True)
class StructuredAnswer:
    """Either a refusal with its message, or the matching rows and their aggregate."""

    refusal: str | None
    message: str | None
    rows: DataFrame | None = None
    aggregate: DataFrame | None = None


def run_structured_query(metrics: DataFrame, query: StructuredQuery) -> StructuredAnswer:
    """Check the question first; an unclear one never widens into a broader read."""
    refusal, start, end = _check(query)
    if refusal is not None:
        clarification = query.clarification_message if refusal == "needs_clarification" else None
        return StructuredAnswer(refusal, clarification or REFUSALS[refusal])
    rows = metrics.filter(
        metric_filter(
            MetricQuery(query.station_id, query.device_id, query.metric_name, start, end)
        )
    )
    return StructuredAnswer(
        None, None, rows.orderBy(*STORED_ORDER), aggregate_metrics(rows, query.aggregation)
    )


def _check(query: StructuredQuery) -> tuple[str | None, datetime | None, datetime | None]:
    if query.needs_clarification:
        return "needs_clarification", None, None
    if query.station_id is None:
        return "station_missing", None, None
    if query.metric_name is None:
        return "metric_missing", None, None
    bounds: list[datetime | None] = []
    for name in ("start_time", "end_time"):
        try:
            bounds.append(_strict_time(getattr(query, name)))
        except ValueError:
            return f"{name}_unreadable", None, None
    start, end = bounds
    if start is not None and end is not None and start >= end:
        return "window_inverted", None, None
    return None, start, end


def _strict_time(text: str | None) -> datetime | None:
    return None if text is None else as_utc(datetime.fromisoformat(text))


def _latest_first() -> Column:
    """Sorts the latest window first, equal ends by stored order; the value comes last."""
    return F.struct(
        (-micros("window_end")).alias("end"),
        "station_id",
        "device_id",
        "metric_name",
        "window_start",
        "resample_frequency",
        "missing_strategy",
        "metric_value",
    )


def aggregate_metrics(rows: DataFrame, aggregation: str) -> DataFrame:
    """One row with ``aggregate_value``; null if nothing matched."""
    if aggregation not in AGGREGATIONS:
        raise ValueError(f"aggregation must be one of {', '.join(AGGREGATIONS)}")
    return rows.agg(_aggregates()[aggregation].alias("aggregate_value"))


def _aggregates() -> dict[str, Column]:
    return {
        "mean": F.avg("metric_value"),
        "max": F.max("metric_value"),
        "sum": F.sum("metric_value"),
        "latest": F.min(_latest_first())["metric_value"],
    }


def refusal(requests: DataFrame) -> Column:
    """The first reason against each question, null if it can be answered."""
    start, end = timestamp_from_text(F.col("start_time")), timestamp_from_text(F.col("end_time"))
    return (
        F.when(F.col("needs_clarification"), "needs_clarification")
        .when(F.col("station_id").isNull(), "station_missing")
        .when(F.col("metric_name").isNull(), "metric_missing")
        .when(~F.col("metric_name").isin(*METRIC_UNITS), "metric_unsupported")
        .when(~F.col("aggregation").isin(*AGGREGATIONS), "aggregation_unsupported")
        .when(F.col("start_time").isNotNull() & start.isNull(), "start_time_unreadable")
        .when(F.col("end_time").isNotNull() & end.isNull(), "end_time_unreadable")
        .when(start >= end, "window_inverted")
    )


def run_structured_queries(
    metrics: DataFrame,
    requests: DataFrame,
    *,
    index: IntervalIndex | None = None,
    broadcast_limit: int = _BROADCAST_REQUESTS,
) -> DataFrame:
    """Answer a table of questions in one job: ``request_id, refusal, matched_rows, aggregate_value``.

    The days between a question's bounds come from blocks of ``index``, two per level at most, so what is joined follows the
    questions and not the length of their windows. Rows are compared only on the days of the bounds, and where a metric's window
    is over several days. Without an index one is made of ``metrics``, which is read several times and should be stored.
    """
    index = index or build_index(metrics, _latest_first())
    asked = requests.withColumn("refusal", refusal(requests)).withColumn(
        "aggregation", F.coalesce("aggregation", F.lit("mean"))
    )
    valid = asked.filter(F.col("refusal").isNull()).select(
        "request_id",
        "aggregation",
        F.col("station_id").alias("_station"),
        F.col("metric_name").alias("_metric"),
        F.col("device_id").alias("_device"),
        timestamp_from_text(F.col("start_time")).alias("_start"),
        timestamp_from_text(F.col("end_time")).alias("_end"),
    )
    few = valid.limit(broadcast_limit + 1).count() <= broadcast_limit
    parts = [_whole_days(index, valid, few), _edge_days(index, valid, few)]
    if not index.long.isEmpty():
        parts.append(_long_windows(index, valid, few))
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    answers = found.groupBy("request_id").agg(*merged())
    values = {
        "mean": F.try_divide(F.col("total"), F.col("known")),
        "max": F.col("peak"),
        "sum": F.col("total"),
        "latest": F.col("latest")["metric_value"],
    }
    chosen = F.coalesce(*[F.when(F.col("aggregation") == name, values[name]) for name in AGGREGATIONS])
    return asked.join(answers, "request_id", "left").select(
        "request_id",
        "refusal",
        F.coalesce("matched", F.lit(0).cast("bigint")).alias("matched_rows"),
        chosen.alias("aggregate_value"),
    )


def _asked_only(name: str, column: Column) -> Column:
    """A partial, where the question's aggregation needs it."""
    return F.when(F.col("aggregation") == name, column)


def _overlap() -> Column:
    return (
        (F.col("_device").isNull() | (F.col("device_id") == F.col("_device")))
        & (F.col("_start").isNull() | (F.col("window_end") >= F.col("_start")))
        & (F.col("_end").isNull() | (F.col("window_start") <= F.col("_end")))
    )


def _of_rows(joined: DataFrame) -> DataFrame:
    return joined.groupBy("request_id").agg(*partials(_asked_only("latest", _latest_first())))


def _whole_days(index: IntervalIndex, valid: DataFrame, few: bool) -> DataFrame:
    """Partials of the days strictly between the bounds."""
    first = F.coalesce(day_of("_start") + 1 - index.first_day, F.lit(0))
    last = F.coalesce(day_of("_end") - 1 - index.first_day, F.lit(index.last_day - index.first_day))
    inside = F.greatest(first, F.lit(0)), F.least(last, F.lit(index.last_day - index.first_day))
    blocks = valid.select("*", F.inline(blocks_between(*inside, index.levels)).alias("_level", "_block"))
    same = (
        (F.col("station_id") == F.col("_station"))
        & (F.col("metric_name") == F.col("_metric"))
        & F.col("device_id").eqNullSafe(F.col("_device"))
        & (F.col("level") == F.col("_level"))
        & (F.col("block") == F.col("_block"))
    )
    joined = index.blocks.join(F.broadcast(blocks) if few else blocks, same)
    return joined.withColumn("latest", _asked_only("latest", F.col("latest"))).groupBy("request_id").agg(*merged())


def _edge_days(index: IntervalIndex, valid: DataFrame, few: bool) -> DataFrame:
    """Partials of the rows that match on the days of the bounds."""
    days = F.array_distinct(F.array(day_of("_start"), day_of("_end")))
    edges = valid.select("*", F.explode(days).alias("_edge")).where("_edge IS NOT NULL")
    edges = edges.withColumn("_edge", F.col("_edge") - index.first_day)
    same = (
        (F.col("station_id") == F.col("_station"))
        & (F.col("metric_name") == F.col("_metric"))
        & (F.col("_day") == F.col("_edge"))
    )
    return _of_rows(index.short.join(F.broadcast(edges) if few else edges, same & _overlap()))


def _long_windows(index: IntervalIndex, valid: DataFrame, few: bool) -> DataFrame:
    """Partials of matching rows whose window is over several days."""
    rows = index.long
    same = (F.col("station_id") == F.col("_station")) & (F.col("metric_name") == F.col("_metric"))
    if not few:
        pieces = F.array(*[F.lit(piece) for piece in range(_SALTS)])
        valid = valid.withColumn("_piece", F.explode(pieces))
        spread = F.pmod(F.xxhash64("device_id", "window_start", "window_end"), F.lit(_SALTS))
        rows = rows.withColumn("_salt", spread.cast("int"))
        same = same & (F.col("_salt") == F.col("_piece"))
    return _of_rows(rows.join(F.broadcast(valid) if few else valid, same & _overlap()))
