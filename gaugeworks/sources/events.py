"""Raw event sources: one JSON document per row, with the order of arrival."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.session import prepare_session

ARRIVAL, PAYLOAD = "arrival_seq", "payload"
# Where a line of a text file comes from; the rest of its arrival is its place among the lines read.
_FILE = "_arrival_file"
EVENT_SCHEMA = f"{ARRIVAL} bigint, {PAYLOAD} string"


def read_event_stream(
    spark: SparkSession,
    path: str | None = None,
    *,
    source: str = "text",
    max_per_trigger: int | None = None,
    options: dict[str, str] | None = None,
) -> DataFrame:
    """A stream of ``payload`` rows and the order in which they arrived.

    ``parquet`` and ``json`` files have both columns, numbers that grow with arrival. The arrival of the others is a
    struct that compares in their order and names one event only: for ``text``, JSON lines, the file's time and path, the
    block and the place in it (``with_arrival`` adds the last); for ``kafka``, a topic given in ``options``, the record's
    time, partition and offset. ``max_per_trigger`` bounds how much one micro-batch takes: files, or Kafka offsets.
    """
    reader = prepare_session(spark).readStream.options(**(options or {}))
    if source == "kafka":
        if max_per_trigger is not None:
            reader = reader.option("maxOffsetsPerTrigger", max_per_trigger)
        return kafka_events(reader.format("kafka").load())
    if max_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", max_per_trigger)
    if source == "text":
        return text_events(reader.text(path))
    return reader.schema(EVENT_SCHEMA).format(source).load(path)


def kafka_events(records: DataFrame) -> DataFrame:
    """Arrival and payload of Kafka records: offsets count within a partition only."""
    arrival = F.struct(
        F.col("timestamp").alias("time"),
        F.col("partition").cast("string").alias("origin"),
        F.lit(0).cast("bigint").alias("block"),
        F.col("offset").alias("place"),
    )
    return records.select(arrival.alias(ARRIVAL), F.col("value").cast("string").alias(PAYLOAD))


def text_events(lines: DataFrame) -> DataFrame:
    """Lines with the file they are in; ``with_arrival`` completes their order."""
    file = F.struct(
        F.col("_metadata.file_modification_time").alias("time"),
        F.col("_metadata.file_path").alias("origin"),
        F.col("_metadata.file_block_start").alias("block"),
    )
    return lines.select(F.col("value").alias(PAYLOAD), file.alias(_FILE))


def with_arrival(batch: DataFrame) -> DataFrame:
    """Add ``arrival_seq`` where it is not there or not complete.

    Lines of one block of a file are read one after the other, so their row numbers order them, whatever the order in
    which Spark reads blocks and files. Rows without any origin are numbered as they are read.
    """
    if ARRIVAL in batch.columns:
        return batch
    place = F.monotonically_increasing_id()
    if _FILE not in batch.columns:
        return batch.select(place.alias(ARRIVAL), *batch.columns)
    numbered = batch.withColumn("_place", place)
    arrival = F.struct(*[F.col(_FILE)[name].alias(name) for name in ("time", "origin", "block")], F.col("_place").alias("place"))
    return numbered.select(arrival.alias(ARRIVAL), *[name for name in batch.columns if name != _FILE])
