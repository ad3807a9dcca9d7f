"""What streams are doing: a listener that keeps running state and backlog as a table."""

from __future__ import annotations

import json
import threading
from collections import deque
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

# How sources name what they know about and have not given out yet: files, or records behind the newest.
BACKLOG = ("numFilesOutstanding", "maxOffsetsBehindLatest")
SCHEMA = "query_id string, seen_at timestamp, batch_id bigint, running boolean, queue_depth bigint, events bigint"
# Entries kept of all queries together; older ones go.
KEPT = 10_000


def backlog(sources) -> int | None:
    """What the sources of one progress report have waiting, or ``None`` where none of them says."""
    waiting = [int(source.metrics[name]) for source in sources for name in BACKLOG if name in (source.metrics or {})]
    return sum(waiting) if waiting else None


def file_backlog(spark: SparkSession, path: str, checkpoint: str) -> Callable:
    """For a stream over the files of a folder, whose source reports no backlog: how many of them no batch until the
    reported one has taken. The source's own log in the checkpoint names those taken.
    """
    jvm, settings = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
    folder = jvm.org.apache.hadoop.fs.Path
    files = folder(path).getFileSystem(settings)

    def taken(last: int) -> int:
        """Entries of the log until batch ``last``: the newest compacted file of it, and the plain ones after that."""
        logs = {}
        for found in files.globStatus(folder(f"{checkpoint}/sources/0/[0-9]*")) or []:
            number, _, compacted = found.getPath().getName().partition(".")
            if int(number) <= last and compacted in ("", "compact"):
                logs[int(number), bool(compacted)] = found.getPath()
        first = max((number for number, compacted in logs if compacted), default=-1)
        total = 0
        for (number, compacted), log in logs.items():
            if number > first or compacted and number == first:
                stream = files.open(log)
                text = jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
                stream.close()
                total += sum(line.startswith("{") for line in text.splitlines())
        return total

    def waiting(progress) -> int | None:
        known = [name for found in files.listStatus(folder(path)) if not (name := found.getPath().getName()).startswith(("_", "."))]
        offset = json.loads(progress.sources[0].endOffset)
        return max(0, len(known) - taken(int(offset["logOffset"])))

    return waiting


class StreamProgress(StreamingQueryListener):
    """Notes the start, every micro-batch and the end of all queries of a session.

    ``watch`` registers one; ``waiting`` tells the backlog of a progress report, by default what the sources say. Reports arrive
    a little after what they report on; ``settle`` waits for those under way.
    """

    def __init__(self, spark: SparkSession, waiting: Callable | None = None, kept: int = KEPT) -> None:
        self._spark = spark
        self._waiting = waiting or (lambda progress: backlog(progress.sources))
        self._entries: deque = deque(maxlen=kept)
        self._lock = threading.Lock()

    @classmethod
    def watch(cls, spark: SparkSession, waiting: Callable | None = None) -> StreamProgress:
        made = cls(spark, waiting)
        spark.streams.addListener(made)
        return made

    def stop(self) -> None:
        self._spark.streams.removeListener(self)

    def settle(self) -> None:
        self._spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()

    def _note(self, query_id, batch_id: int | None, running: bool, depth: int | None, events: int | None) -> None:
        with self._lock:
            self._entries.append((str(query_id), datetime.now(timezone.utc), batch_id, running, depth, events))

    def onQueryStarted(self, event) -> None:
        self._note(event.id, None, True, None, None)

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        self._note(progress.id, progress.batchId, True, self._waiting(progress), progress.numInputRows)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self._note(event.id, None, False, None, None)

    def table(self) -> DataFrame:
        """One row per start, micro-batch and end, in the order of their report."""
        with self._lock:
            entries = list(self._entries)
        return self._spark.createDataFrame([(n, *row) for n, row in enumerate(entries)], f"seq bigint, {SCHEMA}")

    def latest(self) -> DataFrame:
        """One row per query: whether it runs, its last batch, and the backlog after it."""

        def last(name: str):
            return F.max_by(name, F.when(F.col(name).isNotNull(), F.col("seq"))).alias(name)

        sums = F.coalesce(F.sum("events"), F.lit(0)).alias("events")
        return self.table().groupBy("query_id").agg(last("running"), last("batch_id"), last("queue_depth"), sums)
