import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from gaugeworks.operators.select import find_cut, first_rows, newest_rows


def test_newest_rows_are_those_of_a_sort(spark):
    random.seed(1)
    start = datetime(2024, 1, 1)
    data = [(random.choice([None, *[start + timedelta(minutes=random.randint(0, 10**6)) for _ in range(3)]]) if n % 9 else start, n) for n in range(400)]
    frame = spark.createDataFrame(data, "at timestamp, n int").repartition(3)
    ordered = sorted(data, key=lambda row: (row[0] is None, -(row[0] or start).timestamp(), row[1]))
    for limit in (1, 7, 150, 290, 350, 399, 400, 900):
        got = [tuple(row) for row in newest_rows(frame, "at", [F.col("n")], limit).collect()]
        assert sorted(got, key=repr) == sorted(ordered[:limit], key=repr), limit
    with pytest.raises(ValueError):
        newest_rows(frame, "at", [F.col("n")], 0)
    assert newest_rows(frame.limit(0), "at", [F.col("n")], 5).count() == 0


def test_the_cut_is_found_by_few_counts(spark):
    frame = spark.createDataFrame([(7,)] * 50 + [(n,) for n in range(0, 10**12, 10**10)], "k long")
    for limit, value in ((1, 99 * 10**10), (99, 10**10), (100, 7), (149, 7), (150, None)):
        cut = find_cut(frame, F.col("k"), limit, steps=10)
        assert (cut and cut.value) == value
        assert cut is None or cut.above < limit <= cut.above + cut.equal


def test_first_rows_by_range(spark):
    frame = spark.createDataFrame([(n % 17, str(n)) for n in range(200)], "a int, b string").repartition(4)
    for limit in (0, 1, 100, 200, 300):
        got = [tuple(row) for row in first_rows(frame, [F.desc("a"), F.col("b")], limit).collect()]
        assert sorted(got) == sorted(sorted([(n % 17, str(n)) for n in range(200)], key=lambda row: (-row[0], row[1]))[:limit])
