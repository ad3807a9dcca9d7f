import json
from uuid import uuid4

from pyspark.sql import functions as F
from test_events import event

from gaugeworks.session import shared_folder
from gaugeworks.sources.events import read_event_stream
from gaugeworks.streaming.exact import EventTables
from gaugeworks.streaming.progress import StreamProgress, backlog, file_backlog


def test_backlog_and_running_state_are_seen_while_a_stream_runs(spark, contract, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    for number in range(12):  # more batches than the source's log has plain files
        (source / f"{number:02d}.jsonl").write_text(json.dumps(event(f"e{number}")))
    root = f"{shared_folder(spark)}/progress-{uuid4().hex}"
    seen = []

    def write(batch, number):
        seen.append((number, batch.count()))
        if number == 3:  # reports of earlier batches are there while the query runs
            progress.settle()
            seen.append(tuple(progress.latest().select("running", "queue_depth").first()))

    progress = StreamProgress.watch(spark, file_backlog(spark, f"file://{source}", f"{root}/checkpoint"))
    try:
        events = read_event_stream(spark, f"file://{source}", max_per_trigger=1)
        query = events.writeStream.foreachBatch(write).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
        progress.settle()
        found = progress.table().filter(F.col("query_id") == str(query.id)).orderBy("seq").collect()
        last = progress.latest().filter(F.col("query_id") == str(query.id)).first()
    finally:
        progress.stop()
    assert (True, 9) in seen or (True, 10) in seen  # the report of batch 2, or of the one before if it is late
    reported = {row.batch_id: row.queue_depth for row in found if row.events}
    assert reported == {number: 11 - number for number in range(12)}
    assert [row.running for row in found][0] is True and [row.running for row in found][-1] is False
    assert (last.running, last.queue_depth, last.events) == (False, 0, 12)


def test_what_sources_say_is_added_up(spark, contract):
    class Source:
        def __init__(self, metrics):
            self.metrics = metrics

    assert backlog([Source({"maxOffsetsBehindLatest": "7"}), Source({"numFilesOutstanding": "2"}), Source(None)]) == 9
    assert backlog([Source({}), Source(None)]) is None
    status = EventTables(spark, f"{shared_folder(spark)}/none-{uuid4().hex}").status().first()
    assert status.queue_depth is None and not status.consumer_running
