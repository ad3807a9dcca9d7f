"""Stored metrics: keyed upserts and filtered reads."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import dataclass
from uuid import uuid4

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.config import MetricQuery
from gaugeworks.functions.timegrid import timestamp_literal

METRIC_KEY = (
    "station_id",
    "device_id",
    "metric_name",
    "window_start",
    "window_end",
    "resample_frequency",
    "missing_strategy",
)
METRIC_VALUES = ("metric_value", "unit", "computed_at")
METRIC_SCHEMA = (
    "station_id string, device_id string, metric_name string, metric_value double, unit string, "
    "window_start timestamp, window_end timestamp, computed_at timestamp, "
    "resample_frequency string, missing_strategy string"
)
METRIC_COLUMNS = tuple(part.split()[0] for part in METRIC_SCHEMA.split(", "))
STORED_ORDER = ("station_id", "device_id", "metric_name", "window_start")
BATCH, RUN, ROW = "batch_seq", "run_id", "row_seq"
# Begins the folder of a batch that is stored under a number of the caller's own.
NUMBERED = "numbered"
# Every so many entries of the log one has all live folders; a claimed number is waited for so many tenths of a second.
SNAPSHOT, PATIENCE = 20, 300


def newest_per_key(rows: DataFrame) -> DataFrame:
    """One row per metric key: the one of the latest batch, within a batch the latest run's latest row.

    A grouped maximum keeps one candidate per key and partition before the shuffle, so a key written
    over and over does not gather its copies in one task.
    """
    newest = F.max(F.struct(BATCH, RUN, ROW, *METRIC_VALUES)).alias("_newest")
    return (
        rows.groupBy(*METRIC_KEY)
        .agg(newest)
        .select(*METRIC_KEY, *[F.col("_newest")[name].alias(name) for name in METRIC_VALUES])
        .select(*METRIC_COLUMNS)
    )


def upsert_metrics(existing: DataFrame, new: DataFrame) -> DataFrame:
    """``new`` wins over ``existing``; inside ``new`` the row with the greatest ``row_seq`` wins."""
    row = F.col(ROW) if ROW in new.columns else F.lit(0).cast("bigint")
    run = F.lit(0).cast("bigint").alias(RUN)
    return newest_per_key(
        existing.select(
            *METRIC_COLUMNS, F.lit(0).cast("bigint").alias(BATCH), run, F.lit(0).cast("bigint").alias(ROW)
        ).unionByName(
            new.select(*METRIC_COLUMNS, F.lit(1).cast("bigint").alias(BATCH), run, row.alias(ROW))
        )
    )


class ConflictError(RuntimeError):
    """What a commit takes out of the store was taken out by another one before."""


@dataclass(frozen=True)
class Commit:
    """One entry of the log: folders that come in, each with the place of its rows in the order of batches, and those that go."""

    number: int
    added: dict[str, int]
    removed: tuple[str, ...]


class CommitLog:
    """An append-only log of numbered JSON files next to the data.

    A number belongs to who creates its file first; the file appears whole, by a rename that does not replace. Who comes second reads
    the entries before and takes the next number. What folders a store has is told by its log alone: folders of writers that
    failed are in no entry. Every ``SNAPSHOT`` entries one repeats all live folders, and reading begins there.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self._jvm = spark._jvm
        self._folder = f"{path}/_log"
        self._path = self._jvm.org.apache.hadoop.fs.Path
        self._files = self._path(path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def live(self) -> tuple[int, dict[str, tuple[int, int]]]:
        """(number of the last entry, folder to (place in the order of batches, number of its entry)); -1 without entries."""
        names = sorted(found.getPath().getName() for found in self._files.globStatus(self._path(f"{self._folder}/*.json")) or [])
        whole = [n for n, name in enumerate(names) if name.endswith(".all.json")]
        last, folders = -1, {}
        for name in names[whole[-1] if whole else 0 :]:
            last = int(name.split(".")[0])
            entry = json.loads(self._read(name))
            if "all" in entry:
                folders = {folder: tuple(order) for folder, order in entry["all"].items()}
            for folder in entry["removed"]:
                folders.pop(folder, None)
            folders |= {folder: (place, last) for folder, place in entry["added"].items()}
        return last, folders

    def commit(self, make: Callable[[int, dict[str, tuple[int, int]]], Commit]) -> Commit:
        """Append what ``make`` gives for the next number and the live folders; asked again when another writer was first."""
        while True:
            last, folders = self.live()
            entry = make(last + 1, folders)
            if not folders.keys() >= set(entry.removed):
                raise ConflictError(f"not in the store any more: {sorted(set(entry.removed) - folders.keys())}")
            body = {"added": entry.added, "removed": list(entry.removed)}
            snapshot = entry.number % SNAPSHOT == SNAPSHOT - 1
            if snapshot:
                body["all"] = folders
            if self._create(f"{entry.number:020d}{'.all' if snapshot else ''}.json", json.dumps(body)):
                return entry

    def removed(self) -> set[str]:
        """Folders that some entry took out."""
        names = [found.getPath().getName() for found in self._files.globStatus(self._path(f"{self._folder}/*.json")) or []]
        return {folder for name in names for folder in json.loads(self._read(name))["removed"]}

    def _read(self, name: str) -> str:
        stream = self._files.open(self._path(f"{self._folder}/{name}"))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _create(self, name: str, text: str) -> bool:
        """Whether the file was made by this call. It is written under a name of its own, then renamed."""
        target, own = self._path(f"{self._folder}/{name}"), self._path(f"{self._folder}/.{uuid4().hex}")
        stream = self._files.create(own, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        # A local file system replaces on rename; a lock file made exclusively stands for the number there and elsewhere.
        lock = self._path(f"{self._folder}/.{name}.lock")
        try:
            self._files.create(lock, False).close()
        except Py4JJavaError as error:
            self._files.delete(own, False)
            if "AlreadyExists" not in str(error.java_exception):
                raise
            return self._taken(target)
        return self._files.rename(own, target)

    def _taken(self, target) -> bool:
        """Wait until the one who was first has put its entry there; a writer that died in between leaves its number to be cleared by hand."""
        for _ in range(PATIENCE):
            if self._files.exists(target):
                return False
            time.sleep(0.1)
        raise TimeoutError(f"{target} was claimed and never written; remove its lock if no writer is alive")


class MetricStore:
    """Metrics as folders of parquet that a log lists; reading resolves keys.

    An upsert costs what the batch holds, never a rewrite of what is stored. ``compact`` folds all there is into one
    folder, in place, while others read and write. Readers take their files from the log; they list nothing.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self._spark = spark
        self._path = path
        self._log = CommitLog(spark, path)

    def save(self, metrics: DataFrame, batch_seq: int | None = None) -> None:
        """Store one batch. With a number of the caller's own, the same number again replaces it.

        Without one the batch comes after all that are committed before it; of two runs that save at the same
        time both are kept, and where they have a key in common the later commit wins.
        """
        run = uuid4().hex if batch_seq is None else f"{NUMBERED}-{batch_seq}-{uuid4().hex}"
        row = F.col(ROW) if ROW in metrics.columns else F.lit(0).cast("bigint")
        self._write(metrics.select(*METRIC_COLUMNS, row.alias(ROW)), run)

        def entry(number: int, folders: dict) -> Commit:
            if batch_seq is None:
                return Commit(number, {run: _after(folders)}, ())
            replaced = tuple(name for name in folders if name.startswith(f"{NUMBERED}-{batch_seq}-"))
            return Commit(number, {run: batch_seq}, replaced)

        self._log.commit(entry)

    def load(self) -> DataFrame:
        """All stored metrics, one row per key."""
        return newest_per_key(self._batches())

    def query(self, query: MetricQuery) -> DataFrame:
        """Filters on key columns go in front of the key resolution and reach the scan."""
        rows = newest_per_key(self._batches().filter(metric_filter(query)))
        return rows.orderBy(*STORED_ORDER)

    def next_batch(self) -> int:
        """A number after all that are stored; no data is read for it."""
        return _after(self._log.live()[1])

    def compact(self) -> None:
        """Put what is stored now into one folder. Batches committed meanwhile stay and come after it; if another compaction
        was first, this one changes nothing and raises ``ConflictError``. Replaced folders are left to ``vacuum``."""
        _, folders = self._log.live()
        if len(folders) < 2:
            return
        run, last = f"compacted-{uuid4().hex}", max(place for place, _ in folders.values())
        self._write(newest_per_key(self._read(folders)).withColumn(ROW, F.lit(0).cast("bigint")), run)
        # It takes the place of the last batch it holds, so whatever is committed after that comes later.
        self._log.commit(lambda number, _: Commit(number, {run: last}, tuple(folders)))

    def vacuum(self) -> list[str]:
        """Delete folders that were in the store once and are no more; reads that began before their end fail. Folders in no
        entry yet, of writers at work, stay."""
        names = set()
        for folder in self._log._files.globStatus(self._log._path(f"{self._path}/data/*")) or []:
            names.add(folder.getPath().getName())
        gone = sorted(names & self._log.removed() - self._log.live()[1].keys())
        for name in gone:
            self._log._files.delete(self._log._path(self._folder(name)), True)
        return gone

    def _folder(self, run: str) -> str:
        return f"{self._path}/data/{run}"

    def _write(self, rows: DataFrame, run: str) -> None:
        laid = rows.repartitionByRange(*METRIC_KEY).sortWithinPartitions(*METRIC_KEY)
        laid.write.parquet(self._folder(run))

    def _batches(self) -> DataFrame:
        return self._read(self._log.live()[1])

    def _read(self, folders: dict[str, tuple[int, int]]) -> DataFrame:
        """The rows of some folders with their order: the batch, then the entry of the log."""
        schema = f"{METRIC_SCHEMA}, {ROW} bigint"
        if not folders:
            return self._spark.createDataFrame([], f"{schema}, {BATCH} bigint, {RUN} bigint")
        rows = self._spark.read.schema(schema).parquet(*[self._folder(name) for name in folders])
        # A row per live folder, few between compactions, as a map that goes with the plan.
        order = F.create_map(*[F.lit(item) for name, (place, number) in folders.items() for item in (name, f"{place} {number}")])
        run = F.element_at(F.split("_metadata.file_path", "/"), -2)
        placed = rows.withColumn("_order", F.split(order[run], " "))
        return placed.select(*METRIC_COLUMNS, ROW, F.col("_order")[0].cast("bigint").alias(BATCH), F.col("_order")[1].cast("bigint").alias(RUN))


def _after(folders: dict[str, tuple[int, int]]) -> int:
    return max((place for place, _ in folders.values()), default=-1) + 1


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A parquet table, or no rows while nothing was written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def equals_where_given(**values: str | None) -> Column:
    """Equality on every column whose value is not ``None``."""
    condition = F.lit(True)
    for name, value in values.items():
        if value is not None:
            condition = condition & (F.col(name) == F.lit(value))
    return condition


def metric_filter(query: MetricQuery) -> Column:
    """Equality filters, and windows that overlap the asked one; touching bounds overlap."""
    condition = equals_where_given(
        station_id=query.station_id, device_id=query.device_id, metric_name=query.metric_name
    )
    if query.start_time is not None:
        condition = condition & (F.col("window_end") >= timestamp_literal(query.start_time))
    if query.end_time is not None:
        condition = condition & (F.col("window_start") <= timestamp_literal(query.end_time))
    return condition


def query_metrics(metrics: DataFrame, query: MetricQuery) -> DataFrame:
    """A filtered read of resolved metrics in stored order."""
    return metrics.filter(metric_filter(query)).orderBy(*STORED_ORDER)
