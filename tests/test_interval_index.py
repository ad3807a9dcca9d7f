import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from gaugeworks.plans.interval_index import blocks_between, build_index
from gaugeworks.plans.structured import REQUEST_SCHEMA, _latest_first, run_structured_queries
from gaugeworks.sources.metric_store import METRIC_SCHEMA

START = datetime(2024, 1, 1)


def test_blocks_cover_each_day_once(spark):
    pairs = [(a, b) for a in range(0, 40) for b in range(a - 1, 40)]
    frame = spark.createDataFrame(pairs, "a int, b int")
    for row in frame.select("a", "b", blocks_between(F.col("a"), F.col("b"), 6).alias("found")).collect():
        days = [day for level, block in row.found for day in range(block << level, (block + 1) << level)]
        assert sorted(days) == list(range(row.a, row.b + 1))
        assert len(row.found) <= 2 * 6


@pytest.fixture(scope="module")
def stored(spark):
    chance = random.Random(3)
    rows = []
    for n in range(900):
        begin = START + timedelta(minutes=chance.randint(0, 60 * 24 * 50))
        length = chance.choice([0, 30, 300, 60 * 24 * 3]) if n % 3 else 0
        value = chance.choice([None, round(chance.uniform(-5, 5), 3)])
        metric = chance.choice(["average_pressure_bar", "cycle_count"])
        rows.append((chance.choice("AB"), chance.choice("xyz"), metric, value, "bar", begin, begin + timedelta(minutes=length), START, "1h", str(n)))
    return spark.createDataFrame(rows, METRIC_SCHEMA).persist()


@pytest.mark.parametrize("limit", [1000, 0])
def test_answers_are_those_of_a_scan(spark, stored, limit):
    chance, requests, want = random.Random(4), [], {}
    rows = [row.asDict() for row in stored.collect()]
    for n in range(60):
        start, end = (START + timedelta(minutes=chance.randint(-3000, 60 * 24 * 53)) for _ in range(2))
        start, end = min(start, end), max(start, end) + timedelta(seconds=1)
        start, end = chance.choice([(start, end), (None, end), (start, None), (None, None), (start, start + timedelta(hours=5))])
        device, how = chance.choice([None, "x", "q"]), chance.choice(["mean", "max", "sum", "latest"])
        requests.append((str(n), chance.choice("ABC"), device, "cycle_count", how, start and start.isoformat(), end and end.isoformat(), False))
        matching = [
            row for row in rows
            if row["station_id"] == requests[-1][1] and row["metric_name"] == "cycle_count" and device in (None, row["device_id"])
            and (start is None or row["window_end"] >= start) and (end is None or row["window_start"] <= end)
        ]
        values = [row["metric_value"] for row in matching if row["metric_value"] is not None]
        latest = min(matching, key=lambda r: (-r["window_end"].timestamp(), r["station_id"], r["device_id"], r["window_start"], r["missing_strategy"]), default=None)
        value = {
            "mean": sum(values) / len(values) if values else None,
            "max": max(values, default=None),
            "sum": sum(values) if values else None,
            "latest": latest and latest["metric_value"],
        }[how]
        want[str(n)] = (len(matching), value)
    asked = spark.createDataFrame(requests, REQUEST_SCHEMA)
    for row in run_structured_queries(stored, asked, broadcast_limit=limit).collect():
        count, value = want[row.request_id]
        assert row.refusal is None and row.matched_rows == count, row
        assert row.aggregate_value == (pytest.approx(value, abs=1e-9) if value is not None else None)


def test_an_index_serves_many_questions_with_few_rows(spark, stored):
    index = build_index(stored, _latest_first())
    blocks = index.blocks.persist()
    assert index.levels == 6 and blocks.where("level = 5").count() <= 2 * 2 * 4 * 2
    whole = blocks.where("device_id IS NULL AND level = 5").agg(F.sum("matched")).first()[0]
    assert whole == index.short.count() and index.short.count() + index.long.count() == 900
    empty = run_structured_queries(stored.limit(0), spark.createDataFrame([("a", "A", None, "cycle_count", "sum", None, None, False)], REQUEST_SCHEMA))
    assert tuple(empty.first()) == ("a", None, 0, None)
