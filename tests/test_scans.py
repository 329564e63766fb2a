"""Scans in two levels against plain loops over whole series, with buckets of all sizes."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from wattmill.operators import hourly, scans

T0 = dt.datetime(2024, 1, 1)
BUCKETS = [3_600, 7 * 3_600, 10**9]


def series(spark, holes=0.4, n=60, keys=("a", "b")):
    random.seed(9)
    rows = [(k, T0 + dt.timedelta(hours=h), None if random.random() < holes else float(random.randint(-3, 4))) for k in keys for h in sorted(random.sample(range(3 * n), n))]
    return rows, spark.createDataFrame(rows, "k string, at timestamp, v double").repartition(5)


@pytest.mark.parametrize("bucket", BUCKETS)
@pytest.mark.parametrize("holes", [0.0, 0.5])
def test_cusums(spark, bucket, holes):
    rows, frame = series(spark, holes)
    got = {(r.k, r.at): r.s_x for r in scans.cusums(frame, ["k"], "at", {"x": F.col("v") - 0.5}, bucket).collect()}
    expected = {}
    for k in ("a", "b"):
        s, seen = 0.0, False
        for _, at, v in (r for r in rows if r[0] == k):
            seen, s = seen or v is not None, max(0.0, s + (v - 0.5 if v is not None else 0.0))
            expected[k, at] = s if seen else None
    assert got.keys() == expected.keys() and all((got[x] is None and y is None) or abs(got[x] - y) < 1e-9 for x, y in expected.items())


@pytest.mark.parametrize("bucket", BUCKETS)
def test_neighbours(spark, bucket):
    rows, frame = series(spark, 0.6)
    got = {(r.k, r.at): r for r in scans.neighbours(frame, ["k"], "at", ["v"], bucket).collect()}
    for k in ("a", "b"):
        own = [r for r in rows if r[0] == k]
        for i, (_, at, _) in enumerate(own):
            r = got[k, at]
            back = next(((j + 1, own[j][2]) for j in range(i, -1, -1) if own[j][2] is not None), None)
            on = next(((j + 1, own[j][2]) for j in range(i, len(own)) if own[j][2] is not None), None)
            assert (r._place, r._places) == (i + 1, len(own)) and (r.v_prev and tuple(r.v_prev)) == back and (r.v_next and tuple(r.v_next)) == on


@pytest.mark.parametrize("bucket", BUCKETS)
def test_stretches(spark, bucket):
    rows, frame = series(spark)
    got = {(r.k, r.at): r.episode for r in scans.stretches(frame, ["k"], "at", 3_600, bucket).collect()}
    for k in ("a", "b"):
        episode, last = 0, None
        for _, at, _ in (r for r in rows if r[0] == k):
            episode += last is None or at - last != dt.timedelta(hours=1)
            last = at
            assert got[k, at] == episode


def test_repeated_times_begin_stretches(spark):
    rows = spark.createDataFrame([("a", T0, 1.0), ("a", T0, 2.0), ("a", T0 + dt.timedelta(minutes=15), 1.0), ("a", T0 + dt.timedelta(minutes=29), 1.0)], "k string, at timestamp, v double")
    assert sorted(r.n for r in hourly.episodes(rows, "k", "at", 900).collect()) == [1, 1, 2]


@pytest.mark.parametrize("bucket", BUCKETS)
def test_covered(spark, bucket):
    """Overlapping, nested, touching, repeated, empty and long intervals, readings at starts and ends, keys without intervals, nulls."""
    random.seed(3)
    hour = lambda h: T0 + dt.timedelta(hours=h)
    intervals = [("a", hour(s), hour(s + random.choice([0, 1, 2, 5, 40]))) for s in random.sample(range(300), 25)] + [("a", hour(10), hour(20)), ("a", hour(20), hour(22)), ("a", hour(10), hour(20)), ("a", hour(9), None), ("a", None, hour(900)), (None, hour(0), hour(900)), ("b", hour(100), hour(400))]
    points = [(i, k, hour(h)) for i, (k, h) in enumerate((k, h) for k in ("a", "b", "c", None) for h in range(0, 420, 1))] + [(9_999, "a", None)]
    frame = spark.createDataFrame(points, "id long, k string, at timestamp").repartition(3)
    spans = spark.createDataFrame(intervals, "k string, s timestamp, e timestamp")
    result = scans.covered(frame, spans, "k", "at", "s", "e", bucket)
    got = {r.id: r.covered for r in result.collect()}
    held = lambda k, at: at is not None and any(x == k and x is not None and s and e and s <= at < e for x, s, e in intervals)
    assert got == {i: held(k, at) for i, k, at in points}
    plan = result._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and result.columns == ["id", "k", "at", "covered"]


def test_no_points_or_intervals(spark):
    points = spark.createDataFrame([("a", T0)], "k string, at timestamp")
    none = spark.createDataFrame([], "k string, s timestamp, e timestamp")
    assert [r.covered for r in scans.covered(points, none, "k", "at", "s", "e").collect()] == [False]
    assert scans.covered(points.limit(0), none, "k", "at", "s", "e").count() == 0


def test_peaks_need_a_spread(spark):
    rows = spark.createDataFrame([("c", 1.0)] * 9 + [("c", 50.0)] + [("d", float(i % 4)) for i in range(9)] + [("d", 60.0)] + [("e", 1.0), ("e", 99.0), ("f", None)], "city_id string, pm10 double")
    found = lambda scope: sorted(r.pm10 for r in hourly.peaks(rows, "pm10", scope=scope).filter("pm10_peak").collect())
    assert found("city") == [60.0] and found("all") == [50.0, 60.0, 99.0]
    assert hourly.peaks(rows, "pm10").count() == rows.count()
