import json
import os
import re
from uuid import uuid4

import pyarrow.parquet
from frames import rows
from pyspark.sql import functions as F
from test_events import event, raw_events

from gaugeworks.operators.events import (
    accepted_readings,
    bucket_partials,
    classify_events,
    dead_letters,
    merge_aggregates,
    parse_events,
    rejected_events,
    retain_latest_ids,
)
from gaugeworks.session import shared_folder
from gaugeworks.sources.events import kafka_events, read_event_stream
from gaugeworks.streaming import accepted
from gaugeworks.streaming.accepted import may_hold, seen_in, shape, write_ids
from gaugeworks.streaming.exact import EventTables, process_batch, start_exact
from gaugeworks.streaming.windowed import windowed_aggregates
from registered.events import MOST_FILES, batch_files, write_dealt, write_in_order

COLUMNS = ("station_id", "device_id", "metric_type", "bucket", "bucket_start", "count", "total", "avg")


def payloads():
    return [
        event("a"),
        event("b", timestamp="2024-02-09T10:05:00"),
        event("a"),
        event("c", timestamp="2024-02-01T09:00:00+00:00", readings={"discharge_pressure": 4}),
        {"garbage": 1},
        event("d", event_type="alarm"),
    ]


def expected(spark, contract, events):
    readings = accepted_readings(parse_events(raw_events(spark, events), contract), contract)
    return rows(merge_aggregates(bucket_partials(readings, contract)), *COLUMNS)


def folder(spark):
    return f"{shared_folder(spark)}/test-{uuid4().hex}"


def test_stream_equals_batch_and_drains(spark, contract, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    for number, part in enumerate([payloads()[:3], payloads()[3:]]):
        (source / f"{number}.jsonl").write_text("\n".join(json.dumps(p) for p in part))
    tables = EventTables(spark, folder(spark))
    checkpoint = folder(spark)
    for _ in range(2):  # the second run finds nothing new
        events = read_event_stream(spark, str(source), max_per_trigger=1)
        query = start_exact(events, tables, contract, checkpoint, drain=True)
        query.awaitTermination()
        assert rows(tables.aggregates(), *COLUMNS) == expected(spark, contract, payloads())
    status = tables.status(query).first()
    assert not status.consumer_running
    assert (status.events_consumed, status.events_processed_successfully) == (6, 4)
    assert (status.events_malformed, status.events_failed) == (1, 1)
    assert status.last_success_timestamp is not None
    assert tables.recent_errors(10).count() == 2


def test_repeated_batches_and_replays_change_nothing(spark, contract):
    tables = EventTables(spark, folder(spark))
    batch = raw_events(spark, payloads())
    process_batch(batch, 0, tables, contract)
    process_batch(batch, 0, tables, contract)
    once = rows(tables.aggregates(), *COLUMNS)
    process_batch(batch, 1, tables, contract)
    assert rows(tables.aggregates(), *COLUMNS) == once == expected(spark, contract, payloads())
    tables.fold()
    tables.fold()  # nothing new: nothing is written again
    assert rows(tables.aggregates(), *COLUMNS) == once
    process_batch(raw_events(spark, [event("z")]), 2, tables, contract)
    assert rows(tables.aggregates(), *COLUMNS) == expected(spark, contract, [*payloads(), event("z")])


def test_a_fold_holds_the_batches_finished_before_it(spark, contract):
    tables = EventTables(spark, folder(spark))
    for number, name in enumerate("ab"):
        process_batch(raw_events(spark, [event(name), {"garbage": number}]), number, tables, contract)
    # A third batch has written its partials, and not yet its counters, when the fold runs.
    late = accepted_readings(parse_events(raw_events(spark, [event("c")]), contract), contract)
    tables.write("partials", 2, bucket_partials(late, contract))
    tables.write_accepted(2, late.select("event_id", "arrival_seq", F.lit(2).cast("bigint").alias("batch_id")))
    tables.fold()
    process_batch(raw_events(spark, [event("c"), event("a")]), 2, tables, contract)
    assert rows(tables.aggregates(), *COLUMNS) == expected(spark, contract, [event(n) for n in "abc"])
    assert tables.status().first().events_consumed == 6 and tables.errors().count() == 2
    for number in (3, 4):
        process_batch(raw_events(spark, [event(f"x{number}"), event("b")]), number, tables, contract)
        tables.fold()
    names = {row.event_id for row in tables.accepted_ids().collect()}
    assert names == {"a", "b", "c", "x3", "x4"}
    assert rows(tables.aggregates(), *COLUMNS) == expected(spark, contract, [event(n) for n in ("a", "b", "c", "x3", "x4")])
    # What older folds replaced is gone, whatever the number of batches.
    raw = spark.read.parquet(f"{tables.root}/status").select("batch_id").distinct()
    assert sorted(row.batch_id for row in raw.collect()) == [4]


def test_a_fold_may_forget(spark, contract):
    tables = EventTables(spark, folder(spark))
    for number, name in enumerate("abc"):
        process_batch(raw_events(spark, [event(name), {"garbage": number}]), number, tables, contract)
    tables.fold(max_ids=2, max_errors=1, max_buckets=1)
    assert {row.event_id for row in tables.accepted_ids().collect()} == {"b", "c"}
    assert tables.errors().count() == tables.aggregates().count() == 1
    assert tables.status().first().events_consumed == 6


def id_frame(spark, names):
    return spark.createDataFrame([(name, 1, 0) for name in names], "event_id string, arrival_seq long, batch_id long").persist()


def test_a_batch_opens_only_files_that_may_hold_its_ids(spark, contract):
    tables = EventTables(spark, folder(spark))
    for number in range(4):
        process_batch(raw_events(spark, [event(f"{number}-{n}") for n in range(40)]), number, tables, contract)
    sets = tables.id_sets()
    ids = id_frame(spark, ["1-7", "new", "3-3"])
    found = seen_in(spark, ids, 3, sets)
    assert sorted(row.event_id for row in found.collect()) == ["1-7", "3-3"]
    assert sorted(re.findall(r"accepted/batch_id=(\d)/piece=0/", " ".join(found.inputFiles()))) == ["1", "3"]
    assert seen_in(spark, id_frame(spark, ["new", "newer"]), 2, sets) is None
    tables.fold()
    found = seen_in(spark, ids, 3, tables.id_sets())
    assert sorted(row.event_id for row in found.collect()) == ["1-7", "3-3"]


def test_filters_know_every_id_and_few_others(spark):
    root, names = folder(spark), [f"id{n}" for n in range(5000)]
    made = write_ids(id_frame(spark, names), "s", f"{root}/ids", f"{root}/filters", 5000, piece_ids=400)
    assert (made.pieces, made.blocks) == shape(5000, 400) == (16, 1) and shape(0) == (1, 1)
    assert shape(10_000_000) == (16, 512)
    asked = id_frame(spark, [*names[:700], *[f"other{n}" for n in range(700)]])
    hits = [row.event_id for row in may_hold(spark, asked, 1400, [made]).collect()]
    assert set(names[:700]) <= set(hits) and len(hits) < 730
    assert {row.event_id for row in seen_in(spark, asked, 1400, [made]).collect()} == set(names[:700])
    # As many pieces as hold the ids asked for, no more.
    assert len(seen_in(spark, id_frame(spark, names[:3]), 3, [made]).inputFiles()) <= 3


def test_a_fold_rewrites_the_days_it_touches(spark, contract):
    tables = EventTables(spark, folder(spark))
    days = [f"2024-03-{day:02d}T10:00:00" for day in range(1, 6)]
    process_batch(raw_events(spark, [event(f"a{n}", timestamp=at) for n, at in enumerate(days)]), 0, tables, contract)
    tables.fold()
    before = {row.day: row.folder for row in tables.manifest() if row.name == "partials"}
    process_batch(raw_events(spark, [event("b", timestamp=days[2])]), 1, tables, contract)
    tables.fold()
    after = {row.day: row.folder for row in tables.manifest() if row.name == "partials"}
    changed = [day for day in after if after[day] != before[day]]
    assert len(after) == 5 and [day.day for day in changed] == [3]
    assert rows(tables.aggregates(), *COLUMNS) == expected(spark, contract, [*[event(f"a{n}", timestamp=at) for n, at in enumerate(days)], event("b", timestamp=days[2])])
    # A read of one day scans its folder only, before and after later batches are folded.
    one = tables.aggregates(changed[0], changed[0])
    assert {name.rsplit("/", 1)[0].rsplit("/", 1)[1] for name in one.inputFiles()} <= {"day=2024-03-03"} | set()
    assert one.filter("bucket = 'day' AND metric_type = 'discharge_pressure'").first()["count"] == 2
    # What the first fold wrote for that day is gone, other days' folders are not.
    assert not spark.sparkContext._jvm.java.io.File(before[changed[0]].removeprefix("file:")).exists()
    assert tables._folders("folded/partials/up_to=0/day=2024-03-01")


def test_sets_of_ids_grow_by_size(spark, contract):
    tables, sizes = EventTables(spark, folder(spark)), []
    for number in range(9):
        process_batch(raw_events(spark, [event(f"{number}-{n}") for n in range(30 if number == 0 else 2)]), number, tables, contract)
        tables.fold()
        sizes.append(sorted(s.rows for s in tables.id_sets()))
    assert sizes[0] == [30] and sizes[1] == [2, 30] and sizes[2] == [4, 30]
    assert max(map(len, sizes)) <= 3 and sum(sizes[-1]) == 46
    assert tables.accepted_ids().count() == 46
    process_batch(raw_events(spark, [event("0-5"), event("8-1"), event("x")]), 9, tables, contract)
    assert tables.accepted_ids().count() == 47


def test_forgetting_has_no_stage_of_one_partition(spark):
    frame = spark.range(0, 4000, 1, 8).selectExpr("concat('e', id) AS event_id", "id AS arrival_seq", "id div 1000 AS batch_id")
    newest = retain_latest_ids(frame, 1500)
    assert {row.event_id for row in newest.collect()} == {f"e{n}" for n in range(2500, 4000)}
    plan = newest._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "TakeOrdered" not in plan and "GlobalLimit" not in plan
    for limit in (1, 999, 1000, 1001, 3999, 4000, 5000):
        assert {row.arrival_seq for row in retain_latest_ids(frame, limit).collect()} == set(range(max(0, 4000 - limit), 4000))


def test_the_first_line_written_wins_whatever_the_size_of_files(spark, contract, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    first, second = source / "b.jsonl", source / "a.jsonl"
    first.write_text(json.dumps(event("a", readings={"discharge_pressure": 1})))
    filler = [json.dumps(event(f"f{n}", timestamp="2024-03-01T00:00:00")) for n in range(2000)]
    lines = [json.dumps(event("a", readings={"discharge_pressure": 2}))]
    second.write_text("\n".join(filler + lines + ["\n\t " + json.dumps(event("a"))]))
    os.utime(first, (1_700_000_000, 1_700_000_000))
    os.utime(second, (1_700_000_100, 1_700_000_100))
    tables = EventTables(spark, folder(spark))
    start_exact(read_event_stream(spark, str(source)), tables, contract, folder(spark), drain=True).awaitTermination()
    found = tables.aggregates().filter("metric_type = 'discharge_pressure' AND bucket = 'hour' AND bucket_start < '2024-02-15'")
    assert [tuple(row) for row in found.select("count", "total").collect()] == [(1, 1.0)]


def test_kafka_offsets_count_within_a_partition(spark, contract):
    records = [
        (json.dumps(event("a")).encode(), "2024-02-01T00:00:02", 0, 5),
        (json.dumps(event("a")).encode(), "2024-02-01T00:00:01", 1, 5),
        (b"{", "2024-02-01T00:00:03", 0, 9),
        (b"{", "2024-02-01T00:00:03", 1, 9),
    ]
    frame = spark.createDataFrame(records, "value binary, at string, partition int, offset bigint")
    events = kafka_events(frame.withColumn("timestamp", F.to_timestamp("at")))
    parsed = parse_events(events, contract)
    outcomes = {(row.arrival_seq.origin, row.arrival_seq.place): row.outcome for row in classify_events(parsed).collect()}
    assert outcomes == {("0", 5): "duplicate", ("1", 5): "ok", ("0", 9): "malformed_event", ("1", 9): "malformed_event"}
    assert len({row.error_id for row in dead_letters(rejected_events(parsed)).collect()}) == 2
    tables = EventTables(spark, folder(spark))
    process_batch(events, 0, tables, contract)
    process_batch(events, 1, tables, contract)
    tables.fold()
    assert tables.status().first().events_processed_successfully == 4
    assert tables.recent_errors(3).count() == 3


def test_status_and_errors_before_any_event(spark):
    tables = EventTables(spark, folder(spark))
    assert tables.status().first().events_consumed == 0
    assert tables.errors().count() == tables.aggregates().count() == 0


def test_windowed_mode_finishes_buckets_behind_the_watermark(spark, contract, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    late = event("late", timestamp="2024-02-20T00:00:00")
    lines = [event("a"), event("a"), event("b", timestamp="2024-02-01T10:45:00"), late]
    (source / "0.jsonl").write_text("\n".join(json.dumps(p) for p in lines))
    stream = windowed_aggregates(read_event_stream(spark, str(source)), contract, "hour", "1 hour")
    out = folder(spark)
    (
        stream.writeStream.outputMode("append")
        .format("parquet")
        .option("path", out)
        .option("checkpointLocation", folder(spark))
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )
    found = rows(spark.read.parquet(out).filter("metric_type = 'discharge_pressure'"), "bucket_start", "count")
    assert [(start.day, start.hour, count) for start, count in found] == [(1, 10, 2)]


def test_a_task_writes_one_piece_and_some_filters(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(accepted, "FILTER_IDS", 1000)
    names = [f"e{n}" for n in range(5000)]
    made = write_ids(id_frame(spark, names), "s", f"{tmp_path}/ids", f"{tmp_path}/filters", 5000, piece_ids=400)
    tasks = [file.name.split("-")[1] for file in tmp_path.glob("ids/piece=*/part-*.parquet")]
    assert len(tasks) == len(set(tasks)) == made.pieces == 16
    blocks = spark.read.parquet(f"{tmp_path}/filters")
    assert len(list(tmp_path.glob("filters/part-*.parquet"))) > 1
    assert blocks.count() == blocks.select("piece", "block").distinct().count() == 16
    assert {row.event_id for row in may_hold(spark, id_frame(spark, names), 5000, [made]).collect()} == set(names)


def test_stream_input_is_written_batch_by_batch(spark, tmp_path):
    raw = spark.range(1, 1001).selectExpr("if(id = 7, null, id) AS arrival_seq", "cast(id AS string) AS payload")
    write_in_order(raw, f"{tmp_path}/in", 2, batch_rows=200)
    files = sorted(tmp_path.glob("in/part-*.parquet"), key=lambda file: file.stat().st_mtime_ns)
    assert len(files) == 10
    read = [[row.arrival_seq for file in files[n : n + 2] for row in spark.read.parquet(str(file)).collect()] for n in range(0, 10, 2)]
    assert all(100 <= len(batch) <= 300 for batch in read) and None in read[0]
    known = [sorted(n for n in batch if n is not None) for batch in read]
    assert [n for batch in known for n in batch] == [n for n in range(1, 1001) if n != 7]
    write_in_order(raw.limit(0), f"{tmp_path}/none", 2)
    assert spark.read.parquet(f"{tmp_path}/none").count() == 0


def test_tasks_can_share_a_dealt_file(spark, tmp_path):
    raw = spark.range(60_000).selectExpr("id AS arrival_seq", "sha2(cast(id AS string), 256) AS payload")
    write_dealt(raw, f"{tmp_path}/in", 2, group_bytes=64 << 10)
    groups = [pyarrow.parquet.ParquetFile(file).metadata.num_row_groups for file in tmp_path.glob("in/part-*.parquet")]
    assert len(groups) == 2 and min(groups) > 3


def test_look_ups_keep_only_the_ids_asked_for(spark, tmp_path, monkeypatch):
    sizes = {"a": 400, "b": 400, "c": 400, "d": 900}
    sets = []
    for name, rows in sizes.items():
        ids = id_frame(spark, [f"{name}{n}" for n in range(rows)])
        sets.append(write_ids(ids, name, f"{tmp_path}/{name}/ids", f"{tmp_path}/{name}/filters", rows, piece_ids=500))
    assert [one.pieces for one in sets] == [1, 1, 1, 2]
    held = {"a7", "b399", "c0", "d1", "d888"}
    asked = id_frame(spark, [*held, *[f"new{n}" for n in range(60)]])
    # Two shapes: ids are sent twice, not four times, where so many may be sent.
    for most, join in ((65 * 2, "BroadcastHashJoin"), (0, "ShuffledHashJoin")):
        monkeypatch.setattr(accepted, "BROADCAST_IDS", most)
        hits = may_hold(spark, asked, 65, sets)
        found = seen_in(spark, asked, 65, sets)
        assert held <= {row.event_id for row in hits.collect()}
        assert {(row["set"], row.event_id) for row in hits.collect()} >= {(one[0], one) for one in held}
        assert sorted(row.event_id for row in found.collect()) == sorted(held)
        for frame in (hits, found):
            plan = frame._jdf.queryExecution().executedPlan().toString()
            assert join in plan and "SortMergeJoin" not in plan


def test_stream_input_is_dealt_without_a_sort(spark, tmp_path, monkeypatch):
    raw = spark.range(1000).selectExpr("if(id < 300, null, id) AS arrival_seq", "cast(id AS string) AS payload")
    plans, frame = [], type(raw)
    repartition = frame.repartition

    def dealt(self, *how):
        made = repartition(self, *how)
        plans.append(made._jdf.queryExecution().executedPlan().toString())
        return made

    monkeypatch.setattr(frame, "repartition", dealt)
    write_in_order(raw, f"{tmp_path}/in", 4, batch_rows=500)
    assert len(plans) == 2 and not any("RoundRobin" in plan for plan in plans)
    assert len(list(tmp_path.glob("in/part-*.parquet"))) == 8
    assert sorted(int(row.payload) for row in spark.read.parquet(f"{tmp_path}/in").collect()) == list(range(1000))


def test_a_batch_has_no_more_files_than_a_task_writes_side_by_side(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        found = []
        for partitions in (2, 100, 1000):
            spark.conf.set("spark.sql.shuffle.partitions", partitions)
            found.append(batch_files(spark))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found == [2, 50, MOST_FILES]
