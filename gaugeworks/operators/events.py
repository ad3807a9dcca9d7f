"""Raw JSON events to readings, outcomes, dead letters and bucket aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from gaugeworks.contract import ColumnRule, Contract
from gaugeworks.functions.coerce import timestamp_from_text
from gaugeworks.functions.timegrid import as_utc, floor_to_bucket, timestamp_literal
from gaugeworks.operators.normalize import DEVICE_KEYS
from gaugeworks.operators.select import first_rows, newest_rows
from gaugeworks.sources.events import ARRIVAL, PAYLOAD
from gaugeworks.sources.metric_store import equals_where_given

# The accepted event type, required text fields and optional object fields.
EVENT_TYPE = "sensor_reading"
TEXT_FIELDS = ("event_id", "event_type", "timestamp", "station_id", "device_id")
OBJECT_FIELDS = ("readings", "metadata")
# Outcome names, and the error class each rejected outcome is recorded with.
MALFORMED, INVALID, DUPLICATE, OK = "malformed_event", "validation_error", "duplicate", "ok"
ERROR_CLASSES = {MALFORMED: "MalformedEventError", INVALID: "EventValidationError"}

# How far one event got on its own, before looking at other events.
STAGE = "stage"
BROKEN, OTHER_TYPE, NO_TIME, GOOD = "broken", "other_type", "no_time", "good"

AGGREGATE_KEY = ("station_id", "device_id", "metric_type", "bucket", "bucket_start")
AGGREGATE_SCHEMA = (
    "station_id string, device_id string, metric_type string, bucket string, "
    "bucket_start timestamp, count bigint, total double, min_value double, max_value double, "
    "latest_timestamp timestamp"
)
# Pieces a repeated event id is split into when rejected events look up accepted ones.
_SALTS = 64


def parse_events(raw: DataFrame, contract: Contract) -> DataFrame:
    """Structure, type and time checks per event, and its typed sensor values.

    Text fields must be JSON strings and the optional fields JSON objects; a number in a text field is
    a structural error. Sensor values that are not numbers become null and are no error.
    """
    fields = ", ".join(f"{name} variant" for name in (*TEXT_FIELDS, *OBJECT_FIELDS))
    is_object = F.col(PAYLOAD).rlike(r"^\s*\{")
    parsed = F.from_json(F.when(is_object, F.col(PAYLOAD)), fields)
    # Through a one-element array, so that filters on parsed fields do not repeat the parsing.
    suffixed = F.col(PAYLOAD).rlike(r'[0-9.][dDfF]\s*"').alias("_suffixed")
    document = raw.select(*raw.columns, suffixed, F.explode(F.array(parsed)).alias("_doc"))
    typed = document.select(
        *raw.columns,
        *[_field(name).try_cast("string").alias(name) for name in TEXT_FIELDS],
        *[_json_type(name).alias(f"_{name}_type") for name in (*TEXT_FIELDS, *OBJECT_FIELDS)],
        *[_sensor_value(name).alias(name) for name in contract.numeric_names()],
    )
    faults = [
        F.when(~F.coalesce(F.col(f"_{name}_type") == "STRING", F.lit(False)), F.lit(name))
        for name in TEXT_FIELDS
    ] + [
        F.when(~F.coalesce(F.col(f"_{name}_type").startswith("OBJECT"), F.lit(True)), F.lit(name))
        for name in OBJECT_FIELDS
    ]
    has_time = F.col("_timestamp_type") == "STRING"
    checked = typed.select(
        *raw.columns,
        F.concat_ws(", ", *faults).alias("faults"),
        *TEXT_FIELDS,
        F.when(has_time, timestamp_from_text(F.col("timestamp"))).alias("event_time"),
        *contract.numeric_names(),
    )
    stage = (
        F.when(F.col("faults") != "", BROKEN)
        .when(F.col("event_type") != EVENT_TYPE, OTHER_TYPE)
        .when(F.col("event_time").isNull(), NO_TIME)
        .otherwise(GOOD)
    )
    return checked.select(*raw.columns, stage.alias(STAGE), *checked.columns[len(raw.columns) :])


def _field(name: str) -> Column:
    return F.col("_doc")[name]


def _json_type(name: str) -> Column:
    return F.schema_of_variant(_field(name))


def _sensor_value(name: str) -> Column:
    """A number, or text or a truth value that reads as one."""
    path = f"$.{name}"
    number = F.try_variant_get(_field("readings"), path, "double")
    text = F.try_variant_get(_field("readings"), path, "string")
    # Spark reads a Java number suffix, see functions.coerce; the text matters only where one occurs.
    return F.when(F.col("_suffixed") & text.rlike(r"[0-9.][dDfF]\s*$"), None).otherwise(number)


def first_accepted(parsed: DataFrame) -> DataFrame:
    """Per event id the arrival number of the first event that passes all checks."""
    return (
        parsed.filter(F.col(STAGE) == GOOD)
        .groupBy("event_id")
        .agg(F.min(ARRIVAL).alias("first_arrival"))
    )


def accepted_readings(parsed: DataFrame, contract: Contract, seen: DataFrame | None = None) -> DataFrame:
    """One reading per event id, the first good arrival; ids in ``seen`` were accepted earlier.

    The grouped minimum keeps one candidate per id and partition before the shuffle, however often an
    event is repeated.
    """
    kept = ["station_id", "device_id", "event_time", *contract.numeric_names()]
    first = F.min(F.struct(ARRIVAL, *kept)).alias("_first")
    readings = (
        parsed.filter(F.col(STAGE) == GOOD)
        .groupBy("event_id")
        .agg(first)
        .select("event_id", *[F.col("_first")[name].alias(name) for name in (ARRIVAL, *kept)])
    )
    return readings if seen is None else readings.join(seen, "event_id", "left_anti")


def classify_events(parsed: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """Every event with its ``outcome``: malformed_event, validation_error, duplicate or ok.

    An event repeats an earlier one only if that one was accepted, and the check comes before the time
    check: a bad time under an id already accepted is a duplicate, before that it is an error.
    """
    firsts = _first_accepted_ever(parsed, seen)
    # Matching on id and arrival together spreads the copies of one id over all partitions.
    winners = firsts.filter(~F.col("known")).select(
        "event_id", F.col("first_arrival").alias(ARRIVAL), F.lit(True).alias("_first")
    )
    # There is a winner per id: never one for a broadcast, whatever size is guessed before the ids are counted.
    good = (
        parsed.filter(F.col(STAGE) == GOOD)
        .join(winners.hint("merge"), ["event_id", ARRIVAL], "left")
        .withColumn("outcome", F.when(F.col("_first"), OK).otherwise(DUPLICATE))
    )
    columns = [*parsed.columns, "outcome"]
    return (
        _settled(parsed)
        .select(columns)
        .unionByName(good.select(columns))
        .unionByName(_untimed_outcomes(parsed, firsts).select(columns))
    )


def rejected_events(parsed: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """Only the malformed and invalid events; accepted ones are not joined for this."""
    untimed = _untimed_outcomes(parsed, _first_accepted_ever(parsed, seen))
    columns = [*parsed.columns, "outcome"]
    return (
        _settled(parsed)
        .select(columns)
        .unionByName(untimed.filter(F.col("outcome") == INVALID).select(columns))
    )


def _first_accepted_ever(parsed: DataFrame, seen: DataFrame | None) -> DataFrame:
    """First accepted arrivals, and whether the id was ``known`` before all of this data."""
    firsts = first_accepted(parsed).select("event_id", "first_arrival", F.lit(False).alias("known"))
    if seen is None:
        return firsts
    earlier = seen.select("event_id", F.lit(None).cast(firsts.schema["first_arrival"].dataType).alias("first_arrival"), F.lit(True).alias("known"))
    return (
        firsts.unionByName(earlier)
        .groupBy("event_id")
        .agg(F.min("first_arrival").alias("first_arrival"), F.bool_or("known").alias("known"))
    )


def _settled(parsed: DataFrame) -> DataFrame:
    """Events whose outcome does not depend on any other event."""
    return parsed.filter(F.col(STAGE).isin(BROKEN, OTHER_TYPE)).withColumn(
        "outcome", F.when(F.col(STAGE) == BROKEN, MALFORMED).otherwise(INVALID)
    )


def _untimed_outcomes(parsed: DataFrame, firsts: DataFrame) -> DataFrame:
    """Events without a readable time: duplicate if their id was accepted before, else an error.

    Ids may repeat without limit here, so each id is split into salted pieces and the one row it looks
    up is copied to the pieces that exist. Both joins shuffle: neither the ids nor the pieces are few.
    """
    salt = F.pmod(F.xxhash64(ARRIVAL), F.lit(_SALTS)).alias("_salt")
    untimed = parsed.filter(F.col(STAGE) == NO_TIME).select("*", salt)
    pieces = untimed.select("event_id", "_salt").distinct()
    lookup = pieces.join(firsts.hint("merge"), "event_id")
    repeated = F.col("known") | (F.col("first_arrival") < F.col(ARRIVAL))
    return untimed.join(lookup.hint("merge"), ["event_id", "_salt"], "left").withColumn(
        "outcome", F.when(repeated, DUPLICATE).otherwise(INVALID)
    )


def dead_letters(rejected: DataFrame) -> DataFrame:
    """Rejected events as error records.

    The record id is derived from the event, so a repeated task or batch writes the same record again.
    """
    message = (
        F.when(
            F.col(STAGE) == BROKEN,
            F.concat(F.lit("Fields missing or of a wrong kind: "), F.col("faults")),
        )
        .when(
            F.col(STAGE) == OTHER_TYPE,
            F.format_string(f"Event type is '%s', not '{EVENT_TYPE}'", "event_type"),
        )
        .otherwise(F.format_string("No time can be read from '%s'", "timestamp"))
    )
    detail = F.create_map(*[F.lit(text) for pair in ERROR_CLASSES.items() for text in pair])
    return rejected.select(
        ARRIVAL,
        F.sha2(F.concat_ws("|", F.col(ARRIVAL).cast("string"), F.col(PAYLOAD)), 256).alias("error_id"),
        F.col("outcome").alias("error_type"),
        message.alias("message"),
        F.when(F.col("event_id") != "", F.col("event_id")).alias("event_id"),
        F.current_timestamp().alias("occurred_at"),
        detail[F.col("outcome")].alias("detail"),
    )


def recent_errors(errors: DataFrame, limit: int = 50) -> DataFrame:
    """The newest ``limit`` errors, newest last."""
    if not 1 <= limit <= 500:
        raise ValueError("limit must be between 1 and 500")
    newest = errors.orderBy(F.desc("occurred_at"), F.desc(ARRIVAL)).limit(limit)
    return newest.orderBy("occurred_at", ARRIVAL)


def event_status(parsed: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """One row of counters over all events, and the latest event time that could be read.

    Duplicates count as successes. The event time counts for rejected events too.
    """
    rejected = rejected_events(parsed, seen).groupBy().agg(
        F.count_if(F.col("outcome") == MALFORMED).alias("events_malformed"),
        F.count_if(F.col("outcome") == INVALID).alias("events_failed"),
    )
    consumed = parsed.groupBy().agg(
        F.count(F.lit(1)).alias("events_consumed"),
        F.max("event_time").alias("last_event_timestamp"),
    )
    good = F.col("events_consumed") - F.col("events_malformed") - F.col("events_failed")
    # Both sides are one row.
    return consumed.join(F.broadcast(rejected), F.lit(True)).select(
        "events_consumed",
        good.alias("events_processed_successfully"),
        "events_malformed",
        "events_failed",
        "last_event_timestamp",
    )


def bucket_partials(readings: DataFrame, contract: Contract) -> DataFrame:
    """Hour and day aggregates per device and sensor, from readings in range.

    All sensors are aggregated side by side per hour, so readings are not multiplied by sensor and
    bucket first; days are then put together from hours.
    """
    sensors = contract.numeric()
    rows = readings.select(
        *DEVICE_KEYS,
        floor_to_bucket(F.col("event_time"), "hour").alias("bucket_start"),
        "event_time",
        *[in_range(rule).alias(rule.name) for rule in sensors],
    )
    parts = []
    for rule in sensors:
        value = F.col(rule.name)
        parts += [
            F.count(value).alias(f"{rule.name}_count"),
            F.sum(value).alias(f"{rule.name}_total"),
            F.min(value).alias(f"{rule.name}_min"),
            F.max(value).alias(f"{rule.name}_max"),
            F.max(F.when(value.isNotNull(), F.col("event_time"))).alias(f"{rule.name}_latest"),
        ]
    wide = rows.groupBy(*DEVICE_KEYS, "bucket_start").agg(*parts)
    entries = [
        F.struct(
            F.lit(rule.name).alias("metric_type"),
            F.col(f"{rule.name}_count").alias("count"),
            F.col(f"{rule.name}_total").alias("total"),
            F.col(f"{rule.name}_min").alias("min_value"),
            F.col(f"{rule.name}_max").alias("max_value"),
            F.col(f"{rule.name}_latest").alias("latest_timestamp"),
        )
        for rule in sensors
    ]
    hours = (
        wide.select(*DEVICE_KEYS, "bucket_start", F.inline(F.array(*entries)))
        .filter(F.col("count") > 0)
        .withColumn("bucket", F.lit("hour"))
    )
    return with_days(hours)


def with_days(hours: DataFrame) -> DataFrame:
    columns = [part.split()[0] for part in AGGREGATE_SCHEMA.split(", ")]
    days = hours.withColumn("bucket", F.lit("day")).withColumn(
        "bucket_start", floor_to_bucket(F.col("bucket_start"), "day")
    )
    return hours.select(columns).unionByName(_merged(days).select(columns))


def in_range(rule: ColumnRule) -> Column:
    # A NaN compares as greater than any bound in Spark, so it is out of range here as well.
    return F.when(~rule.out_of_range(F.col(rule.name)), F.col(rule.name))


def _merged(partials: DataFrame) -> DataFrame:
    return partials.groupBy(*AGGREGATE_KEY).agg(
        F.sum("count").alias("count"),
        F.sum("total").alias("total"),
        F.min("min_value").alias("min_value"),
        F.max("max_value").alias("max_value"),
        F.max("latest_timestamp").alias("latest_timestamp"),
    )


def merge_aggregates(partials: DataFrame) -> DataFrame:
    """Partial aggregates of any number of batches as one row per bucket, with the average."""
    merged = _merged(partials)
    return merged.withColumn("avg", F.col("total") / F.col("count"))


def query_stream_aggregates(
    aggregates: DataFrame,
    station_id: str,
    *,
    device_id: str | None = None,
    metric_type: str | None = None,
    bucket: str | None = None,
    start=None,
    end=None,
) -> DataFrame:
    """Buckets of one station that start in ``[start, end)``, ordered by device, metric and time."""
    condition = equals_where_given(
        station_id=station_id, device_id=device_id, metric_type=metric_type, bucket=bucket
    )
    if start is not None:
        condition = condition & (F.col("bucket_start") >= timestamp_literal(as_utc(start)))
    if end is not None:
        condition = condition & (F.col("bucket_start") < timestamp_literal(as_utc(end)))
    return aggregates.filter(condition).orderBy("device_id", "metric_type", "bucket", "bucket_start")


def retain_latest_buckets(aggregates: DataFrame, max_buckets: int) -> DataFrame:
    """The newest buckets by start; which of the oldest start stay is decided by the key.

    ``aggregates`` is read several times, so it should be stored.
    """
    others = [F.col(name) for name in AGGREGATE_KEY if name != "bucket_start"]
    return newest_rows(aggregates, "bucket_start", others, max_buckets)


def retain_latest_ids(seen: DataFrame, max_ids: int) -> DataFrame:
    """The ids accepted last, in order of batch and arrival. ``seen`` is read several times, so it should be stored."""
    if max_ids < 1:
        raise ValueError(f"at least one row has to stay, got {max_ids}")
    if "batch_id" in seen.columns:
        return newest_rows(seen, "batch_id", [F.desc(ARRIVAL)], max_ids)
    if isinstance(seen.schema[ARRIVAL].dataType, IntegralType):
        return newest_rows(seen, ARRIVAL, [F.col("event_id")], max_ids)
    return first_rows(seen, [F.desc(ARRIVAL)], max_ids)
