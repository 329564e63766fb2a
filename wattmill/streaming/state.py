"""Keyed state across micro-batches: repeats are dropped, late rows are routed, and state is forgotten by timers.

The watermark is defined on a column that the operator itself doesn't see, so Spark doesn't drop late rows before it: it meets every row, together with the watermark that
the row's batch met. State lies in the store that Spark checkpoints (RocksDB), is dealt by device, and goes when the watermark passes the horizon, so it is bounded by the
devices' samples in that time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Spark's store for state with timers.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ROUTED = "device_id string, event_id string, at_ms long, value double, route string"


def _first_only(horizon_ms: int):
    """The processor of a device; made in a function so that executors get it whole."""
    import pandas as pd
    from pyspark.sql.streaming.stateful_processor import StatefulProcessor

    class FirstOnly(StatefulProcessor):
        """`on_time` for the first row of an event, `repeat` for those after it (in this or a later batch), `late` for rows at or before the watermark."""

        def init(self, handle) -> None:
            self.handle = handle
            # one value a device: it is read and written once a batch, not once a row
            self.seen = handle.getValueState("seen", "events array<string>, at_ms array<long>")

        def known(self) -> dict[str, int]:
            events, times = self.seen.get() or ((), ())
            return dict(zip(events, times))

        def keep(self, seen: dict[str, int]) -> None:
            if seen:
                self.seen.update((list(seen), list(seen.values())))
            else:
                self.seen.clear()

        def handleInputRows(self, key, rows, timerValues):
            watermark, seen, due = timerValues.getCurrentWatermarkInMs(), self.known(), set()
            before = len(seen)
            for part in rows:
                routes = []
                for event, at in zip(part["event_id"], part["at_ms"]):
                    if watermark > 0 and at <= watermark:
                        routes.append("late")
                    elif event in seen:
                        routes.append("repeat")
                    else:
                        seen[event] = int(at)
                        # one timer a slice of the horizon: rows of a device share timers
                        due.add((int(at) // horizon_ms + 2) * horizon_ms)
                        routes.append("on_time")
                yield part[["device_id", "event_id", "at_ms", "value"]].assign(route=routes)
            if len(seen) > before:
                self.keep(seen)
            for time in due:
                self.handle.registerTimer(time)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            """Forgets what is older than the horizon: whatever comes of it would be late."""
            gone = expiredTimerInfo.getExpiryTimeInMs() - horizon_ms
            self.keep({event: at for event, at in self.known().items() if at >= gone})
            yield pd.DataFrame(columns=["device_id", "event_id", "at_ms", "value", "route"]).astype({"at_ms": "int64", "value": "float64"})

        def close(self) -> None:
            pass

    return FirstOnly()


def routed_once(samples: DataFrame, bound: str = "30 seconds", horizon_s: int = 3_600) -> DataFrame:
    """A stream of samples (device_id, event_id, ts, value) with `route`: each event is `on_time` once, whatever batch or restart repeats it; rows at or before the watermark are `late`.

    `bound` is how far rows may lag the largest time seen; `horizon_s` must be longer than it. Streams that the session starts from then on keep
    their state in the store that `STORE` names.
    """
    samples.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    seen = samples.withColumn("_ts", F.col("ts").cast("timestamp")).withWatermark("_ts", bound)
    rows = seen.select(F.col("device_id").cast("string").alias("device_id"), F.col("event_id").cast("string").alias("event_id"), F.unix_millis("_ts").alias("at_ms"), F.col("value").cast("double").alias("value"))
    return rows.groupBy("device_id").transformWithStateInPandas(_first_only(horizon_s * 1000), ROUTED, "Append", "EventTime")
