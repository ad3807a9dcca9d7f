"""Sensor readings and raw JSON events as views over the driver's ``events`` table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeworks.session import prepare_session

METADATA = [
    ("S0", "North plant", "Hall 1", "2015-04-01", 2),
    ("S1", "South plant", "Hall 2", "2018-09-15", 2),
]


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = prepare_session(spark).read.parquet(f"{sf_dir}/events.parquet")
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withColumn(
        "k", F.get_json_object("props", "$.k").cast("int")
    )


def sensor_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly readings as text, with missing, malformed and out-of-range values."""
    hour = F.date_trunc("hour", "ts")
    k, value, kind = F.col("k"), F.col("value"), F.col("event_type")
    return _events(spark, sf_dir).select(
        "event_id",
        hour.alias("timestamp"),
        F.concat(F.lit("S"), F.col("user_id") % 3).alias("station_id"),
        F.concat(F.lit("D"), F.col("user_id") % 6).alias("device_id"),
        F.when(k < 3, None)
        .when(k < 5, "bad")
        .otherwise((value / 8.0).cast("string"))
        .alias("discharge_pressure"),
        F.when(kind == "signup", "0.0").otherwise((value * 4.0).cast("string")).alias("air_flow_rate"),
        (value * 2.0 + 5.0).cast("string").alias("power_consumption"),
        F.when(kind.isin("error", "signup"), "0")
        .when(k % 2 == 0, "1500")
        .otherwise((k * 41).cast("string"))
        .alias("motor_speed"),
        (F.lit(20) + F.expr("unix_seconds(date_trunc('HOUR', ts)) div 21600") % 90).cast("string").alias("discharge_temp"),
    )


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON events in arrival order, with every kind of broken event and repeated ids."""
    time = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    kind = F.col("event_id") % 50
    own_id = F.concat(F.lit("e"), F.col("event_id").cast("string"))
    previous_id = F.concat(F.lit("e"), (F.col("event_id") - 1).cast("string"))
    station = F.concat(F.lit("S"), F.col("user_id") % 3)
    device = F.concat(F.lit("D"), F.col("user_id") % 6)

    def placed(moment, identity, kind_name: str, rest) -> Column:
        return F.concat(
            F.lit('{"event_id":'), identity, F.lit(f',"event_type":"{kind_name}","timestamp":"'), moment,
            F.lit('","station_id":"'), station, F.lit('","device_id":"'), device, F.lit('"'), rest,
            F.lit("}"),
        )

    def quoted(text: Column) -> Column:
        return F.concat(F.lit('"'), text, F.lit('"'))

    values = F.concat(
        F.lit(',"readings":{"discharge_pressure":'), (F.col("value") / 8.0).cast("string"),
        F.lit(',"air_flow_rate":'), (F.col("value") * 4.0).cast("string"),
        F.lit(',"motor_speed":'), (F.col("k") * 40).cast("string"), F.lit("}"),
    )
    text_values = F.lit(',"readings":{"discharge_pressure":"not_a_number","air_flow_rate":[1,2,3]}')
    payload = (
        F.when(
            kind == 0,
            F.concat(
                F.lit('{"event_id":'), quoted(own_id),
                F.lit(',"event_type":"sensor_reading","readings":{"discharge_pressure":1.0}}'),
            ),
        )
        .when(kind == 1, placed(time, quoted(own_id), "sensor_reading", text_values))
        .when(kind == 2, F.concat(F.lit('{"event_id":'), quoted(own_id), F.lit(',"garbage":"x"}')))
        .when(kind == 3, placed(F.lit("not-a-date"), quoted(own_id), "sensor_reading", F.lit(',"readings":{}')))
        .when(kind == 4, placed(time, quoted(own_id), "alarm", F.lit("")))
        .when(kind == 5, placed(time, F.col("event_id").cast("string"), "sensor_reading", F.lit("")))
        .when(kind == 7, placed(time, quoted(previous_id), "sensor_reading", values))
        .otherwise(placed(time, quoted(own_id), "sensor_reading", values))
    )
    return _events(spark, sf_dir).select(
        F.col("event_id").alias("arrival_seq"), payload.alias("payload")
    )


def station_metadata(spark: SparkSession) -> DataFrame:
    """Two of the three stations, so that one stays without metadata."""
    return spark.createDataFrame(
        METADATA,
        "station_id string, station_name string, location string, "
        "commissioned_date string, num_compressors int",
    )


def comparable(frame: DataFrame, digits: int = 6, **more: int) -> DataFrame:
    """Doubles rounded off the half and timestamps without zone, as the SQL side returns them."""
    columns = []
    for field in frame.schema.fields:
        column = F.col(field.name)
        if isinstance(field.dataType, T.DoubleType):
            places = more.get(field.name, digits)
            column = F.round(column + F.lit(3.0 * 10.0 ** -(places + 2)), places)
        elif isinstance(field.dataType, T.TimestampType):
            column = column.cast("timestamp_ntz")
        columns.append(column.alias(field.name))
    return frame.select(*columns)
