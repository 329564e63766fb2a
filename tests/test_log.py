"""The offset log: exact ranges, frozen ends, refusals, streams with restarts."""

import pytest
from pyspark.sql import functions as F

from wattmill.sources import log


def rows(spark, n=100, first=0, partition=0):
    return spark.range(first, n).select(F.lit(partition).alias("partition"), F.col("id").alias("offset"), F.when(F.col("id") % 7 != 3, F.concat(F.lit("vä"), "id").cast("binary")).alias("value"))


def offsets(frame, partition=0):
    return sorted(r.offset for r in frame.filter(F.col("partition") == partition).collect())


def test_exact_ranges(spark, tmp_path):
    path = str(tmp_path / "log")
    log.write_segments(rows(spark).unionByName(rows(spark, 35, partition=4)), path, 30)
    every = log.read_log(spark, path)
    assert offsets(every) == list(range(100)) and offsets(every, 4) == list(range(35)) and every.rdd.getNumPartitions() == 6
    assert {r.offset: r.value for r in every.filter("partition = 4").collect()} == {i: None if i % 7 == 3 else f"vä{i}".encode() for i in range(35)}
    some = log.read_log(spark, path, startingOffsets='{"0": 25, "4": 35}', endingOffsets='{"0": 61, "4": 35}')
    assert offsets(some) == list(range(25, 61)) and offsets(some, 4) == []
    assert offsets(log.read_log(spark, path, endingOffsets='{"0": 5}')) == list(range(5))


def test_an_end_is_fixed_when_a_read_is_planned(spark, tmp_path):
    path = str(tmp_path / "log")
    log.write_segments(rows(spark, 40), path, 30)
    planned = log.read_log(spark, path, endingOffsets='{"0": 40}')
    log.write_segments(rows(spark, 70, 40), path, 30)
    assert offsets(planned) == list(range(40)) and offsets(log.read_log(spark, path)) == list(range(70))


@pytest.mark.parametrize("keep, options, said", [("offset <> 17", {}, "aren't whole"), ("offset >= 30", {}, "above offset 0"), ("offset < 30 OR offset >= 60", {}, "aren't whole"), ("true", {"endingOffsets": '{"0": 101}'}, "isn't there"), ("offset >= 30", {"startingOffsets": '{"0": 10}'}, "isn't there any more")])
def test_refusals(spark, tmp_path, keep, options, said):
    path = str(tmp_path / "log")
    log.write_segments(rows(spark).filter(keep), path, 30)
    with pytest.raises(Exception, match=said):
        log.read_log(spark, path, **options).count()


def test_repeated_offsets_are_refused_and_late_starts_can_be_asked_for(spark, tmp_path):
    path = str(tmp_path / "log")
    log.write_segments(rows(spark, 60, 30), path, 30)
    assert offsets(log.read_log(spark, path, startingOffsets='{"0": 30}')) == list(range(30, 60))
    log.write_segments(rows(spark, 41, 40), path, 30)
    with pytest.raises(Exception, match="aren't whole"):
        log.read_log(spark, path, startingOffsets='{"0": 30}').count()


def test_stream_goes_on_after_a_restart(spark, tmp_path):
    path, out, state = (str(tmp_path / x) for x in ("log", "out", "state"))
    run = lambda: log.stream_log(spark, path).writeStream.format("parquet").option("checkpointLocation", state).trigger(availableNow=True).start(out).awaitTermination()
    for first, n in ((0, 45), (45, 100), (100, 100)):
        if n > first:
            log.write_segments(rows(spark, n, first), path, 30)
        run()
        assert offsets(spark.read.parquet(out)) == list(range(n))
