"""Keyed state: repeats in later batches, late rows, expiry and restarts."""

import datetime as dt
import json

import pytest

from wattmill.streaming import state

T0 = dt.datetime(2026, 1, 1)


@pytest.fixture
def stream(spark, tmp_path):
    """Adds a file a batch and runs the stream to its end, as after a restart."""
    (tmp_path / "in").mkdir()

    def run(name: str, *rows: tuple[str, str, int, float]) -> list[tuple]:
        lines = [json.dumps({"device_id": d, "event_id": e, "ts": (T0 + dt.timedelta(seconds=s)).isoformat(), "value": v}) for d, e, s, v in rows]
        (tmp_path / "in" / f"{name}.json").write_text("\n".join(lines))
        source = spark.readStream.schema("device_id string, event_id string, ts timestamp, value double").json(str(tmp_path / "in"))
        routed = state.routed_once(source, "30 seconds", 60)
        routed.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
        return [(r.device_id, r.event_id, r.at_ms // 1000 - int(T0.replace(tzinfo=dt.timezone.utc).timestamp()), r.route) for r in spark.read.parquet(str(tmp_path / "out")).collect()]

    return run


def test_repeats_and_late_rows_across_restarts(stream):
    first = stream("a", ("d1", "e1", 100, 1.0), ("d1", "e1", 100, 1.0), ("d1", "e2", 110, 1.0), ("d2", "e1", 100, 2.0))
    assert sorted(r[3] for r in first) == ["on_time", "on_time", "on_time", "repeat"]
    second = stream("b", ("d1", "e1", 100, 1.0), ("d1", "e3", 79, 1.0), ("d1", "e4", 80, 1.0), ("d2", "e9", 90, 1.0), ("d3", "e1", 81, 1.0))
    new = sorted((r[0], r[1], r[3]) for r in second)
    # the watermark of the second batch is 110 less 30 seconds
    assert [x for x in new if x[1] in ("e3", "e4", "e9") or x[0] == "d3"] == [("d1", "e3", "late"), ("d1", "e4", "late"), ("d2", "e9", "on_time"), ("d3", "e1", "on_time")]
    assert [x for x in new if x[:2] == ("d1", "e1")] == [("d1", "e1", "on_time"), ("d1", "e1", "repeat"), ("d1", "e1", "repeat")]


def test_state_goes_when_the_watermark_has_passed(stream):
    stream("a", ("d1", "e1", 100, 1.0))
    stream("b", ("d9", "x", 400, 1.0))
    stream("c", ("d9", "y", 401, 1.0))
    last = stream("d", ("d1", "e1", 100, 1.0), ("d1", "e1", 500, 1.0))
    assert sorted(r[2:] for r in last if r[0] == "d1") == [(100, "late"), (100, "on_time"), (500, "on_time")]
