import random

import pytest
from pyspark.sql import functions as F

from lograil.operators.ordered import active_intervals, count_within, nearest, nearest_within


@pytest.fixture(scope="module")
def points(spark):
    rng = random.Random(1)
    make = lambda n: [(rng.choice("ab"), rng.randrange(-200, 400), i) for i in range(n)]
    return make(150), make(150)


def tables(spark, points):
    probes = spark.createDataFrame(points[0], "key string, at bigint, probe int")
    marks = spark.createDataFrame(points[1], "key string, at bigint, mark int").withColumn("hit", F.struct("at", "mark"))
    return probes, marks


@pytest.mark.parametrize("inclusive", [False, True])
@pytest.mark.parametrize("forward", [False, True])
def test_nearest_equals_brute_force(spark, points, forward, inclusive):
    probes, marks = tables(spark, points)
    for cell in (7, 1000):
        rows = nearest(probes, marks, ["key"], "at", ["hit"], forward=forward, inclusive=inclusive, cell=cell).collect()
        assert len(rows) == len(points[0])
        for row in rows:
            if forward:
                good = [(a, m) for k, a, m in points[1] if k == row.key and (a > row["at"] or (inclusive and a == row["at"]))]
                expected = min(good, default=None)
            else:
                good = [(a, m) for k, a, m in points[1] if k == row.key and (a < row["at"] or (inclusive and a == row["at"]))]
                expected = max(good, default=None)
            assert (tuple(row.hit) if row.hit else None) == expected


@pytest.mark.parametrize("forward", [False, True])
def test_nearest_within_sees_everything_inside_its_horizon(spark, points, forward):
    probes, marks = tables(spark, points)
    for row in nearest_within(probes, marks, ["key"], "at", ["hit"], 9, forward=forward).collect():
        inside = [(a, m) for k, a, m in points[1] if k == row.key and (0 < a - row["at"] <= 9 if forward else 0 < row["at"] - a <= 9)]
        hit = tuple(row.hit) if row.hit and abs(row.hit["at"] - row["at"]) <= 9 else None
        assert hit == (min(inside, default=None) if forward else max(inside, default=None))


def test_count_within(spark, points):
    probes, marks = tables(spark, points)
    counted = {r.probe: r.n for r in count_within(probes, marks, ["key"], "probe", "at", 25, "n").collect()}
    for key, at, probe in points[0]:
        assert counted[probe] == sum(k == key and at < a <= at + 25 for k, a, _ in points[1])


def test_active_intervals(spark, points):
    probes, _ = tables(spark, points)
    intervals = [(k, a, a + m % 40) if m % 5 else (k, a, None) for k, a, m in points[1]]
    table = spark.createDataFrame(intervals, "key string, from_us bigint, until_us bigint")
    for row in active_intervals(probes, table, ["key"], "at", "n").collect():
        assert row.n == sum(k == row.key and f <= row["at"] and (u is None or row["at"] < u) for k, f, u in intervals)


def test_null_keys_meet_nothing(spark):
    probes = spark.createDataFrame([(None, 5, 1), ("a", 5, 2)], "key string, at bigint, probe int")
    marks = spark.createDataFrame([(None, 4), ("a", 4)], "key string, at bigint").withColumn("hit", F.struct("at"))
    for found in (nearest(probes, marks, ["key"], "at", ["hit"]), nearest_within(probes, marks, ["key"], "at", ["hit"], 10)):
        assert {r.probe: r.hit is None for r in found.collect()} == {1: True, 2: False}
