"""Small frames the tests build their cases from."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession

SENSORS = (
    "discharge_pressure",
    "air_flow_rate",
    "power_consumption",
    "motor_speed",
    "discharge_temp",
)
START = datetime(2024, 2, 1)


def at(minutes: float) -> datetime:
    return START + timedelta(minutes=minutes)


def raw(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """Untyped readings: every value as text, absent ones null."""
    columns = ("timestamp", "station_id", "device_id", *SENSORS)
    schema = ", ".join(f"{name} string" for name in columns)
    full = [{"station_id": "S", "device_id": "D", "timestamp": "2024-02-01T00:00:00"} | row for row in rows]
    return spark.createDataFrame(
        [tuple(None if row.get(n) is None else str(row[n]) for n in columns) for row in full], schema
    )


def typed(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """Typed readings; ``minute`` is the time, ``seq`` the tie break, default sensor is the pressure."""
    schema = "event_id bigint, timestamp timestamp, station_id string, device_id string, " + ", ".join(
        f"{name} double" for name in SENSORS
    )
    out = []
    for position, row in enumerate(rows):
        out.append(
            (
                row.get("seq", position),
                at(row["minute"]),
                row.get("station", "S"),
                row.get("device", "D"),
                *[None if row.get(name) is None else float(row[name]) for name in SENSORS],
            )
        )
    return spark.createDataFrame(out, schema)


def series(spark: SparkSession, minutes: list[float], values: list[float | None], **more) -> DataFrame:
    return typed(
        spark,
        [
            {"minute": minute, "discharge_pressure": value, **more}
            for minute, value in zip(minutes, values, strict=True)
        ],
    )


def rows(frame: DataFrame, *columns: str) -> list[tuple]:
    found = [tuple(row) for row in frame.select(*columns).collect()]
    return sorted(found, key=lambda row: [(v is not None, v if v is not None else 0) for v in row])
