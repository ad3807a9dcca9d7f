"""Exact event processing: any lateness, every event counted once, restarts included.

Each micro-batch writes its own folder of partial aggregates, accepted ids, errors and counters. The
folder name carries the batch number, so a repeated batch overwrites what it wrote before; reading adds
the partials up. Nothing is ever read, changed and written back.

``fold`` puts the batches finished so far together and costs what they touch, not what is stored: buckets lie in a folder
per day, and only days with new buckets are written anew; ids and errors become sets of their own, and a set takes up
older ones only when it has grown to their size. A manifest, one file per fold, says which folders count; it is written last.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import date

from pyspark import StorageLevel
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gaugeworks.contract import Contract
from gaugeworks.operators.events import (
    AGGREGATE_KEY,
    AGGREGATE_SCHEMA,
    accepted_readings,
    bucket_partials,
    dead_letters,
    event_status,
    merge_aggregates,
    parse_events,
    recent_errors,
    rejected_events,
)
from gaugeworks.operators.select import newest_rows
from gaugeworks.sources.events import ARRIVAL, with_arrival
from gaugeworks.sources.metric_store import read_or_empty
from gaugeworks.streaming.accepted import IdSet, read_sets, seen_in, write_ids
from gaugeworks.streaming.progress import backlog

BATCH, DAY = "batch_id", "day"
# Arrivals are numbers or structs, as the source has them; these types are for tables without rows.
_SEEN_SCHEMA = f"event_id string, {ARRIVAL} bigint, {BATCH} bigint"
_ERROR_SCHEMA = (
    f"{ARRIVAL} bigint, error_id string, error_type string, message string, event_id string, "
    f"occurred_at timestamp, detail string, {BATCH} bigint"
)
_STATUS_SCHEMA = (
    "events_consumed bigint, events_processed_successfully bigint, events_malformed bigint, "
    "events_failed bigint, last_event_timestamp timestamp, last_success_timestamp timestamp, "
    f"last_error_timestamp timestamp, accepted bigint, pieces bigint, blocks bigint, {BATCH} bigint"
)
_PARTIAL_SCHEMA = f"{AGGREGATE_SCHEMA}, {BATCH} bigint, {DAY} date"
#: A row per folder that counts: of ids and errors a set, of buckets a day.
_MANIFEST_SCHEMA = f"name string, folder string, {DAY} date, rows bigint, pieces bigint, blocks bigint, up_to bigint"
_LATEST = ("last_event_timestamp", "last_success_timestamp", "last_error_timestamp")
_COUNTERS = ("events_consumed", "events_processed_successfully", "events_malformed", "events_failed")


@dataclass(frozen=True)
class EventTables:
    """Where the stream keeps its results; ``root`` must be shared storage."""

    spark: SparkSession
    root: str

    def write(self, name: str, batch_id: int, frame: DataFrame) -> None:
        writer = frame.write.mode("overwrite")
        if name == "partials":
            # Days are of any size: rows are laid out by day and device, so a large one has several files.
            day = F.to_date("bucket_start").alias(DAY)
            writer = frame.select("*", day).repartitionByRange(DAY, *AGGREGATE_KEY[:2]).write.mode("overwrite").partitionBy(DAY)
        writer.parquet(self._of(name, batch_id))

    def write_accepted(self, batch_id: int, ids: DataFrame) -> IdSet:
        """Write the ids that a batch accepted, and their filter. ``ids`` is read more than once."""
        return write_ids(ids, f"batch {batch_id}", self._of("accepted", batch_id), self._of("filters", batch_id), ids.count())

    def accepted_ids(self) -> DataFrame:
        sets = self.id_sets()
        return read_sets(self.spark, sets).select("event_id", ARRIVAL, BATCH) if sets else self.spark.createDataFrame([], _SEEN_SCHEMA)

    def id_sets(self, before: int | None = None, since: int | None = None) -> list[IdSet]:
        """Sets with accepted ids: those of folds, and those of batches after the newest and ``before`` a batch. Single
        batches older than ``since`` are left out."""
        folded = self.manifest()
        up_to = folded[0].up_to if folded else -1
        sets = [self._id_set(row) for row in folded if row.name == "accepted"]
        return sets + self._batch_sets(max(up_to, (since or 0) - 1), before)

    def aggregates(self, first: date | None = None, last: date | None = None) -> DataFrame:
        """Hour and day aggregates over everything processed so far, or of some days: only their folders are read."""
        return merge_aggregates(self._partials(first, last))

    def errors(self) -> DataFrame:
        folded = self.manifest()
        later = _stored(self.spark, f"{self.root}/errors", _ERROR_SCHEMA)
        if not folded:
            return later
        later = later.filter(F.col(BATCH) > folded[0].up_to)
        sets = [row.folder for row in folded if row.name == "errors"]
        if not sets:
            return later
        stored = self.spark.read.parquet(*sets)
        # Before the first error of the later batches, their arrivals have the type of no rows.
        if later.schema[ARRIVAL] != stored.schema[ARRIVAL]:
            return stored.select(later.columns)
        return later.unionByName(stored)

    def recent_errors(self, limit: int = 50) -> DataFrame:
        return recent_errors(self.errors(), limit)

    def status(self, query: StreamingQuery | None = None) -> DataFrame:
        """Counters over all batches; with ``query`` also whether it runs and what it has waiting."""
        sums = [F.coalesce(F.sum(name), F.lit(0)).alias(name) for name in _COUNTERS]
        return self._counters().agg(*sums, *[F.max(name).alias(name) for name in _LATEST]).select(
            F.lit(query is not None and query.isActive).alias("consumer_running"),
            "*",
            F.lit(queue_depth(query)).cast("bigint").alias("queue_depth"),
        )

    def manifest(self) -> list[Row]:
        """The rows of the newest fold's manifest: one per day and set."""
        finished = [_number(path.getParent()) for path in self._folders("folds/up_to=*/_SUCCESS")]
        return self.spark.read.schema(_MANIFEST_SCHEMA).parquet(self._manifest(max(finished))).collect() if finished else []

    def fold(self, max_buckets: int | None = None, max_ids: int | None = None, max_errors: int | None = None) -> None:
        """Put all batches finished so far together.

        A batch counts as finished once its counters, written last, are there; one that lands meanwhile stays as it is.
        A limit keeps only the newest buckets, ids or errors, for good: buckets and errors beyond it are gone from every
        later read, and events whose id is forgotten count again if they are repeated.

        The manifest makes the fold visible and is written last, so a fold that fails half way changes nothing, and
        without a new batch there is nothing to do. What the fold before this one replaced is deleted; a read that
        began before that fold and still runs has to be repeated.
        """
        done = read_or_empty(self.spark, f"{self.root}/status", _STATUS_SCHEMA).agg(F.max(BATCH)).first()[0]
        before = self.manifest()
        last = before[0].up_to if before else -1
        if done is None or done == last:
            return
        rows = [
            *self._folded_days(before, last, done, max_buckets),
            *self._folded_ids(before, last, done, max_ids),
            *self._folded_errors(before, last, done, max_errors),
            self._folded_status(done),
        ]
        made = self.spark.createDataFrame([(*row, done) for row in rows], _MANIFEST_SCHEMA)
        made.coalesce(1).write.mode("overwrite").parquet(self._manifest(done))
        if before:
            self._delete(last, {row[1] for row in rows})

    def _folded_days(self, before: list[Row], last: int, done: int, limit: int | None) -> list[tuple]:
        """Days with new buckets are merged with what they had; the others stay where they are."""
        new = self._later_partials(last).filter(F.col(BATCH) <= done)
        touched = {row[DAY] for row in new.select(DAY).distinct().collect()}
        days = {row.day: row for row in before if row.name == "partials"}
        old = self._days([row for day, row in days.items() if day in touched])
        columns = [*AGGREGATE_KEY, "count", "total", "min_value", "max_value", "latest_timestamp"]
        merged = merge_aggregates(new.select(columns).unionByName(old.select(columns))).drop("avg")
        folder = f"{self.root}/folded/partials/up_to={done}"
        by_day = merged.withColumn(DAY, F.to_date("bucket_start"))
        by_day.repartitionByRange(DAY, *AGGREGATE_KEY[:2]).write.mode("overwrite").partitionBy(DAY).parquet(folder)
        written = read_or_empty(self.spark, folder, f"{AGGREGATE_SCHEMA}, {DAY} date")
        counts = {row[DAY]: row["count"] for row in written.groupBy(DAY).count().collect()}
        found = {day: ("partials", row.folder, day, row.rows, None, None) for day, row in days.items()}
        found |= {day: ("partials", f"{folder}/{DAY}={day}", day, n, None, None) for day, n in counts.items()}
        if limit is None or sum(row[3] for row in found.values()) <= limit:
            return list(found.values())
        # Whole days stay, newest first; the one in which the limit lies is written again.
        kept, left = [], limit
        for day in sorted(found, reverse=True):
            if found[day][3] > left:
                break
            kept.append(found[day])
            left -= found[day][3]
        if left:
            stored = self.spark.read.schema(AGGREGATE_SCHEMA).parquet(found[day][1])
            ties = [F.col(name) for name in AGGREGATE_KEY if name != "bucket_start"]
            rest = f"{self.root}/folded/partials/cut={done}/{DAY}={day}"
            newest_rows(stored, "bucket_start", ties, left).write.mode("overwrite").parquet(rest)
            kept.append(("partials", rest, day, left, None, None))
        return kept

    def _folded_ids(self, before: list[Row], last: int, done: int, limit: int | None) -> list[tuple]:
        """The batches' ids become a set, which takes up older ones that are not much larger than it."""
        stored = [self._id_set(row) for row in before if row.name == "accepted"]
        taken = [s for s in self._batch_sets(last, done + 1) if s.rows]
        size, total = sum(s.rows for s in taken), sum(s.rows for s in [*taken, *stored])
        forget = limit is not None and total > limit
        rest = []
        for one in sorted(stored, key=lambda s: s.rows):
            if forget or one.rows <= 2 * size:
                taken.append(one)
                size += one.rows
            else:
                rest.append(one)
        made = []
        if taken:
            ids = read_sets(self.spark, taken).select("event_id", ARRIVAL, BATCH)
            if forget:
                ids, size = newest_rows(ids, BATCH, [F.desc(ARRIVAL)], limit), limit
            folder = f"{self.root}/folded/{{}}/up_to={done}"
            made = [write_ids(ids, f"fold {done}", folder.format("accepted"), folder.format("filters"), size)]
        return [("accepted", s.ids, None, s.rows, s.pieces, s.blocks) for s in [*rest, *made]]

    def _folded_errors(self, before: list[Row], last: int, done: int, limit: int | None) -> list[tuple]:
        stored = sorted((row for row in before if row.name == "errors"), key=lambda row: row.rows)
        new = _stored(self.spark, f"{self.root}/errors", _ERROR_SCHEMA).filter((F.col(BATCH) > last) & (F.col(BATCH) <= done))
        size = new.count()
        forget = limit is not None and size + sum(row.rows for row in stored) > limit
        taken = []
        for row in stored:
            if forget or row.rows <= 2 * size:
                taken.append(row)
                size += row.rows
        rest = [("errors", row.folder, None, row.rows, None, None) for row in stored if row not in taken]
        if not size:
            return rest
        if taken:
            old = self.spark.read.parquet(*[row.folder for row in taken])
            new = old.select(new.columns) if new.isEmpty() else new.unionByName(old)
        if forget:
            new, size = newest_rows(new, "occurred_at", [F.desc(ARRIVAL)], limit), limit
        folder = f"{self.root}/folded/errors/up_to={done}"
        new.write.mode("overwrite").parquet(folder)
        return [*rest, ("errors", folder, None, size, None, None)]

    def _folded_status(self, done: int) -> tuple:
        counters = self._counters().filter(F.col(BATCH) <= done)
        sums = [F.sum(name).alias(name) for name in _COUNTERS]
        latest = [F.max(name).alias(name) for name in (*_LATEST, BATCH)]
        folder = f"{self.root}/folded/status/up_to={done}"
        counters.agg(*sums, *latest).write.mode("overwrite").parquet(folder)
        return ("status", folder, None, 1, None, None)

    def _delete(self, up_to: int, needed: set[str]) -> None:
        """Remove the batches until ``up_to`` and the folders of folds until then that are not ``needed``."""
        files, folders = self._files(), self._folders
        for name in ("partials", "accepted", "filters", "errors", "status"):
            for folder in folders(f"{name}/{BATCH}=*"):
                if _number(folder) <= up_to:
                    files.delete(folder, True)
        for folder in folders("folds/up_to=*"):
            if _number(folder) <= up_to:
                files.delete(folder, True)
        kept = {folder.removeprefix(f"{self.root}/folded/") for folder in needed}
        kept |= {folder.replace("accepted/", "filters/", 1) for folder in kept if folder.startswith("accepted/")}
        for name in ("accepted", "filters", "errors", "status", "partials"):
            for folder in folders(f"folded/{name}/*=*"):
                if _number(folder) > up_to or f"{name}/{folder.getName()}" in kept:
                    continue
                if name != "partials":
                    files.delete(folder, True)
                    continue
                for day in folders(f"folded/partials/{folder.getName()}/{DAY}=*"):
                    if f"partials/{folder.getName()}/{day.getName()}" not in kept:
                        files.delete(day, True)

    def _files(self):
        settings = self.spark._jsparkSession.sessionState().newHadoopConf()
        return self.spark._jvm.org.apache.hadoop.fs.Path(self.root).getFileSystem(settings)

    def _folders(self, pattern: str) -> list:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{pattern}")
        return [found.getPath() for found in self._files().globStatus(path) or []]

    def _manifest(self, up_to: int) -> str:
        return f"{self.root}/folds/up_to={up_to}"

    def _of(self, name: str, batch_id: int) -> str:
        return f"{self.root}/{name}/{BATCH}={batch_id}"

    def _id_set(self, row: Row) -> IdSet:
        number = row.folder.rsplit("=", 1)[1]
        filters = row.folder.replace("/folded/accepted/", "/folded/filters/")
        return IdSet(f"fold {number}", row.folder, filters, row.rows, row.pieces, row.blocks)

    def _batch_sets(self, after: int, before: int | None) -> list[IdSet]:
        """The sets of finished batches in between."""
        batches = read_or_empty(self.spark, f"{self.root}/status", _STATUS_SCHEMA).filter(F.col(BATCH) > after)
        if before is not None:
            batches = batches.filter(F.col(BATCH) < before)
        rows = batches.select(BATCH, "accepted", "pieces", "blocks").where("accepted > 0").collect()
        return [IdSet(f"batch {n}", self._of("accepted", n), self._of("filters", n), *shape) for n, *shape in rows]

    def _counters(self) -> DataFrame:
        folded = self.manifest()
        later = read_or_empty(self.spark, f"{self.root}/status", _STATUS_SCHEMA).select(*_COUNTERS, *_LATEST, BATCH)
        if not folded:
            return later
        stored = [row.folder for row in folded if row.name == "status"]
        return later.filter(F.col(BATCH) > folded[0].up_to).unionByName(self.spark.read.parquet(*stored))

    def _later_partials(self, up_to: int) -> DataFrame:
        return read_or_empty(self.spark, f"{self.root}/partials", _PARTIAL_SCHEMA).filter(F.col(BATCH) > up_to)

    def _days(self, rows: list[Row]) -> DataFrame:
        """The buckets of some days of a manifest."""
        if not rows:
            return self.spark.createDataFrame([], AGGREGATE_SCHEMA)
        return self.spark.read.schema(AGGREGATE_SCHEMA).parquet(*sorted(row.folder for row in rows))

    def _partials(self, first: date | None = None, last: date | None = None) -> DataFrame:
        """The newest fold and the partials after it."""

        def asked(day: date) -> bool:
            return (first is None or day >= first) and (last is None or day <= last)

        folded = self.manifest()
        later = self._later_partials(folded[0].up_to if folded else -1)
        if first is not None:
            later = later.filter(F.col(DAY) >= F.lit(first))
        if last is not None:
            later = later.filter(F.col(DAY) <= F.lit(last))
        later = later.drop(BATCH, DAY)
        days = [row for row in folded if row.name == "partials" and asked(row.day)]
        return later.unionByName(self._days(days)) if days else later


def _number(folder) -> int:
    """The number in a folder's name."""
    return int(folder.getName().split("=")[1])


def _stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A parquet table with the types that it was written with, or no rows while there is no file."""
    try:
        found = spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return spark.createDataFrame([], schema)
    columns = spark.createDataFrame([], schema).schema
    return found.select(*[F.col(f.name) if f.name == ARRIVAL else F.col(f.name).cast(f.dataType).alias(f.name) for f in columns])


def queue_depth(query: StreamingQuery | None) -> int | None:
    """Rows the source knows about but the query has not read, where the source reports them."""
    progress = query.lastProgress if query is not None else None
    return backlog(progress.sources) if progress else None


def process_batch(
    batch: DataFrame,
    batch_id: int,
    tables: EventTables,
    contract: Contract,
    remembered_batches: int | None = None,
) -> None:
    """All writes of one micro-batch; running it again for the same number changes nothing.

    ``remembered_batches`` limits how far back repeated ids are looked for; ``None`` looks at all.
    """
    kept = []

    def keep(frame: DataFrame) -> DataFrame:
        kept.append(frame.persist(StorageLevel.MEMORY_AND_DISK))
        return frame

    try:
        parsed = keep(parse_events(with_arrival(batch), contract))
        # Looked up once for all four tables.
        seen = _seen_before(parsed, batch_id, tables, remembered_batches)
        if seen is not None:
            seen = keep(seen)
        readings = keep(accepted_readings(parsed, contract, seen))
        tables.write("partials", batch_id, bucket_partials(readings, contract))
        made = tables.write_accepted(batch_id, readings.select("event_id", ARRIVAL, F.lit(batch_id).cast("bigint").alias(BATCH)))
        tables.write("errors", batch_id, dead_letters(rejected_events(parsed, seen)))
        # Last: a batch with counters is complete.
        numbers = [F.lit(value).cast("bigint").alias(name) for name, value in (("accepted", made.rows), ("pieces", made.pieces), ("blocks", made.blocks))]
        tables.write("status", batch_id, _batch_status(parsed, seen).select("*", *numbers))
    finally:
        for frame in kept:
            frame.unpersist()


def _seen_before(parsed: DataFrame, batch_id: int, tables: EventTables, remembered_batches: int | None) -> DataFrame | None:
    """Which ids of this batch were accepted earlier, or ``None`` if surely none was."""
    since = None if remembered_batches is None else batch_id - remembered_batches
    sets = tables.id_sets(batch_id, since)
    if not sets:
        return None
    ids = parsed.filter(F.col("event_id").isNotNull()).select("event_id").distinct().persist(StorageLevel.MEMORY_AND_DISK)
    try:
        condition: Column = F.col(BATCH) < batch_id
        if since is not None:
            condition = condition & (F.col(BATCH) >= since)
        return seen_in(tables.spark, ids, ids.count(), sets, condition)
    finally:
        ids.unpersist()


def _batch_status(parsed: DataFrame, seen: DataFrame) -> DataFrame:
    now = F.current_timestamp()
    return event_status(parsed, seen).select(
        "*",
        F.when(F.col("events_processed_successfully") > 0, now).alias("last_success_timestamp"),
        F.when(F.col("events_malformed") + F.col("events_failed") > 0, now).alias("last_error_timestamp"),
    )


def start_exact(
    events: DataFrame,
    tables: EventTables,
    contract: Contract,
    checkpoint: str,
    *,
    drain: bool = False,
    interval: str = "10 seconds",
    remembered_batches: int | None = None,
) -> StreamingQuery:
    """Process a stream of raw events; ``drain`` stops once everything present is processed."""

    def write(batch: DataFrame, batch_id: int) -> None:
        process_batch(batch, batch_id, tables, contract, remembered_batches)

    return _writer(events, write, checkpoint, drain, interval).start()


def _writer(
    events: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, drain: bool, interval: str
):
    writer = events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True) if drain else writer.trigger(processingTime=interval)
