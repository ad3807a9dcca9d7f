import random

import pytest
from frames import SENSORS, at, rows, typed
from pyspark.sql import functions as F

from gaugeworks.operators.clean import forward_fill, interpolate, slice_readings
from gaugeworks.operators.metrics import device_metrics_wide
from gaugeworks.operators.quality import detect_flatlines, detect_gaps
from gaugeworks.operators.resample import resample_mean
from gaugeworks.operators.slices import SLICE, gather, slice_rows


@pytest.fixture(scope="module")
def crowded(spark):
    """One device with most rows, many of them copies of a few times, and a quiet one."""
    chance = random.Random(7)
    readings = []
    for position in range(600):
        minute = chance.choice([0, 0, 0, 5, 10, 15, 60, 65, 2000, 2005, 2010, 2040])
        value = chance.choice([None, None, 1.0, 2.0])
        device = "hot" if position % 10 else "quiet"
        readings.append({"minute": minute, "device": device, "discharge_pressure": value, "seq": position})
    return typed(spark, readings)


def test_crowded_pieces_are_split_and_ordered(spark, crowded):
    sliced = slice_readings(crowded, SENSORS, max_rows=50)
    sizes = sliced.rows.groupBy(*sliced.within).count()
    assert sliced.row_count == 600
    assert sizes.agg(F.max("count")).first()[0] < 400
    overlap = (
        sliced.rows.groupBy(*sliced.within)
        .agg(F.min(F.struct(*sliced.order)).alias("lo"), F.max(F.struct(*sliced.order)).alias("hi"))
        .selectExpr("*", "lag(hi) OVER (PARTITION BY device_id ORDER BY _slice) AS before")
        .filter("before >= lo")
    )
    assert overlap.count() == 0


@pytest.mark.parametrize("operator", ["fill", "interpolate", "gaps", "flatlines"])
def test_results_do_not_depend_on_slices(spark, crowded, operator):
    def run(sliced):
        if operator == "fill":
            return rows(forward_fill(sliced, SENSORS), "event_id", "discharge_pressure")
        if operator == "interpolate":
            frame = interpolate(sliced, SENSORS).withColumn("v", F.round("discharge_pressure", 9))
            return rows(frame, "event_id", "v")
        if operator == "gaps":
            return rows(detect_gaps(sliced), "device_id", "gap_start", "gap_end", "missing_intervals")
        found = detect_flatlines(sliced, {"discharge_pressure": 1})
        return rows(found, "device_id", "start_time", "end_time", "value")

    whole = run(slice_readings(crowded, SENSORS, width_us=10**15))
    assert whole
    assert run(slice_readings(crowded, SENSORS, width_us=7 * 60_000_000)) == whole
    assert run(slice_readings(crowded, SENSORS, max_rows=40)) == whole
    assert run(gather(slice_readings(crowded, SENSORS, max_rows=40))) == whole


def test_exact_copies_are_split_too(spark):
    copies = typed(spark, [{"minute": 0, "seq": 1, "discharge_pressure": 3}] * 400)
    sliced = slice_rows(copies.drop("event_id"), ("station_id", "device_id"), ("timestamp",), max_rows=10)
    assert sliced.rows.count() == 400
    assert sliced.rows.select(SLICE).distinct().count() > 1
    assert at(0) is not None


def test_gathered_rows_need_no_further_shuffle(spark, crowded):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        gathered = gather(slice_readings(crowded, SENSORS))
        plan = forward_fill(gathered, SENSORS)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    # The only exchanges left carry one row per slice.
    assert "timestamp" not in "".join(line for line in plan.splitlines() if "Exchange" in line)
    assert plan.count("Exchange hashpartitioning") <= 2


def scans(frame):
    """How often the final plan reads files, after all runtime changes."""
    frame.collect()
    plan = frame._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    return plan.count("FileScan"), plan.count("ReusedExchange")


def test_rows_and_their_edges_are_evaluated_once(spark, crowded, tmp_path):
    crowded.write.parquet(f"{tmp_path}/rows")
    stored = spark.read.parquet(f"{tmp_path}/rows")
    bins = resample_mean(stored, "15min", SENSORS).withColumn("day", F.to_date("timestamp"))
    assert scans(device_metrics_wide(bins, "15min", runs=["day"])) == (1, 1)
    assert scans(forward_fill(slice_readings(stored, SENSORS), SENSORS))[0] == 1
    # Looked at twice, so written down: no file is read again.
    assert scans(detect_flatlines(slice_readings(stored, SENSORS), {"discharge_pressure": 1}))[0] == 0
