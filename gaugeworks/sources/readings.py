"""Readers of sensor readings and station metadata."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeworks.config import validate_window
from gaugeworks.contract import Contract, default_contract
from gaugeworks.functions.coerce import to_timestamp
from gaugeworks.functions.timegrid import timestamp_literal
from gaugeworks.operators.normalize import DEVICE_KEYS, STATION, TIME
from gaugeworks.session import prepare_session

METADATA_COLUMNS = (
    "station_id",
    "station_name",
    "location",
    "commissioned_date",
    "num_compressors",
)


def read_table(spark: SparkSession, path: str, file_format: str, schema: T.StructType) -> DataFrame:
    """Typed formats keep their types; CSV and JSON come as text and are coerced later."""
    reader = prepare_session(spark).read
    if file_format == "csv":
        return reader.option("header", True).csv(path)
    if file_format == "json":
        return reader.schema(schema).json(path)
    return reader.format(file_format).load(path)


def read_sensor_readings(
    spark: SparkSession,
    path: str,
    *,
    file_format: str = "parquet",
    stations: Iterable[str] | None = None,
    start: datetime | None = None,
    end: datetime | None = None,
    contract: Contract | None = None,
) -> DataFrame:
    """Readings of the given stations (all if ``None``) between two inclusive bounds."""
    contract = contract or default_contract()
    frame = read_table(spark, path, file_format, contract.text_schema())
    return scan_readings(frame, stations=stations, start=start, end=end, contract=contract)


def scan_readings(
    frame: DataFrame,
    *,
    stations: Iterable[str] | None = None,
    start: datetime | None = None,
    end: datetime | None = None,
    contract: Contract | None = None,
) -> DataFrame:
    """Contract columns (and an event id, if any) of the readings asked for.

    The filters compare plain columns with constants wherever the time column is typed, so they reach
    the parquet scan. Order is left to the writer.
    """
    contract = contract or default_contract()
    validate_window(start, end)
    contract.check_required_columns(frame)
    wanted = [name for name in (*contract.columns(), "event_id") if name in frame.columns]
    rows = frame.select(*wanted).filter(F.col(STATION).isNotNull())
    if stations is not None:
        rows = rows.filter(F.col(STATION).isin(*stations))
    return rows.filter(_between(frame.schema[TIME].dataType, start, end))


def _between(time_type: T.DataType, start: datetime | None, end: datetime | None) -> Column:
    condition = F.lit(True)
    if isinstance(time_type, T.TimestampNTZType):
        moment, bound = F.col(TIME), lambda at: timestamp_literal(at).cast("timestamp_ntz")
    else:
        moment, bound = to_timestamp(F.col(TIME), time_type), timestamp_literal
    if start is not None:
        condition = condition & (moment >= bound(start))
    if end is not None:
        condition = condition & (moment <= bound(end))
    return condition


def read_station_metadata(
    spark: SparkSession, path: str, *, file_format: str = "parquet", contract: Contract | None = None
) -> DataFrame:
    contract = contract or default_contract()
    frame = read_table(spark, path, file_format, contract.text_schema("station_metadata"))
    return station_metadata(frame)


def station_metadata(frame: DataFrame) -> DataFrame:
    return frame.select(
        *[F.col(name).cast("string").alias(name) for name in METADATA_COLUMNS[:-1]],
        F.col("num_compressors").try_cast("int").alias("num_compressors"),
    )


def with_station_metadata(frame: DataFrame, metadata: DataFrame) -> DataFrame:
    """Left join: stations without metadata keep nulls.

    No broadcast hint: metadata grows with the fleet, Spark broadcasts it while its size allows.
    """
    return frame.join(metadata, STATION, "left")


def sorted_readings(frame: DataFrame) -> DataFrame:
    """The reading order of reports: station, device, time, and the event where several have one time; missing ones first."""
    ties = ["event_id"] if "event_id" in frame.columns else []
    return frame.orderBy(*[F.col(name).asc_nulls_first() for name in (*DEVICE_KEYS, TIME, *ties)])
