"""Registered queries of the stream operators: the events table as a bounded stream, replayed as a batch and through the file source."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wattmill.operators.views import Plant
from wattmill.plans.catalog import query
from wattmill.sources import log
from wattmill.staging import new_path, written
from wattmill.streaming import power, state


def samples(p: Plant) -> DataFrame:
    e = p.table("events").filter("value >= 0")
    return e.select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.concat(F.lit("W0"), F.col("user_id") % 8 + 1).alias("workshop_code"), F.col("user_id").alias("device_id"), F.col("value").alias("power_kw"), F.lit(30).alias("interval_seconds"))


_S = "WITH s AS (SELECT event_id, ts, 'W0' || (user_id % 8 + 1) AS workshop_code, user_id AS device_id, value AS power_kw FROM events WHERE value >= 0)\n"


@query("t02_cost_windows", _S + "SELECT time_bucket(INTERVAL 10 SECONDS, ts) AS window_start, workshop_code, count(*) AS n, round(sum(round(power_kw, 2)), 2) AS total_cost FROM s GROUP BY ALL HAVING sum(round(power_kw, 2)) >= 20", "")
def t_cost(p: Plant) -> DataFrame:
    events = samples(p).withColumn("cost", F.round("power_kw", 2))
    return power.cost_alarms(events, 20).select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "workshop_code", "n", F.round("total_cost", 2).alias("total_cost"))


@query("t03_power_alarms", _S + """SELECT w AS window_start, workshop_code, count(*) AS n, round(avg(power_kw), 6) AS mean_kw, round(regr_slope(power_kw, epoch_ms(ts) / 60000e0 - 28401120e0), 4) AS slope FROM (SELECT *, unnest(range(time_bucket(INTERVAL 60 MINUTES, ts) - INTERVAL 360 MINUTES, time_bucket(INTERVAL 60 MINUTES, ts) + INTERVAL 1 MINUTE, INTERVAL 60 MINUTES)) AS w FROM s) WHERE ts < w + INTERVAL 6 HOURS GROUP BY ALL HAVING count(*) >= 12 AND avg(power_kw) > 14""", "")
def t_power(p: Plant) -> DataFrame:
    rows = power.power_alarms(samples(p), 10.0, 2.0, 12, "6 hours", "1 hour")
    return rows.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "workshop_code", "n", "mean_kw", F.round("slope", 4).alias("slope"))


@query("t09_replay_alarms", _S + """SELECT event_id, n, round(mean_kw, 6) AS mean_kw, round(slope, 4) AS slope FROM (SELECT *, count(*) OVER w AS n, avg(power_kw) OVER w AS mean_kw, regr_slope(power_kw, ms / 60000e0 - 28401120e0) OVER w AS slope FROM (SELECT *, epoch_ms(ts) AS ms FROM s) WINDOW w AS (PARTITION BY workshop_code ORDER BY ms RANGE BETWEEN 21599999 PRECEDING AND CURRENT ROW)) WHERE n >= 10 AND mean_kw > 14""", "")
def t_replay(p: Plant) -> DataFrame:
    return power.replay_alarms(samples(p), 10.0, 2.0, 10, 21_600_000).select("event_id", "n", F.round("mean_kw", 6).alias("mean_kw"), F.round("slope", 4).alias("slope"))


@query("t10_t13_minutes", _S + """, d AS (SELECT workshop_code, device_id, date_trunc('hour', ts) AS m, count(*) AS n, avg(power_kw) AS mean_kw, sum(power_kw * 30 / 3600) AS kwh FROM s GROUP BY ALL) SELECT workshop_code, m AS minute, round(sum(mean_kw), 6) AS total_kw, sum(n)::BIGINT AS n, round(sum(kwh), 8) AS kwh, string_agg(device_id::VARCHAR, ',' ORDER BY device_id) AS devices FROM d GROUP BY ALL""", "")
def t_minutes(p: Plant) -> DataFrame:
    rows = samples(p).withColumn("ts", F.date_trunc("hour", "ts"))
    total = power.workshop_minutes(power.device_minutes(rows))
    return total.select("workshop_code", F.col("minute").cast("timestamp_ntz").alias("minute"), F.round("total_kw", 6).alias("total_kw"), "n", F.round("kwh", 8).alias("kwh"), F.array_join(F.transform("devices", lambda d: d.cast("string")), ",").alias("devices"))


def payloads(p: Plant) -> DataFrame:
    """Events as raw JSON payloads with faults at fixed places."""
    e = p.table("events")
    m = lambda n: F.col("event_id") % n == 0
    at = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    fields = F.struct(
        F.when(m(31), 2).otherwise(1).alias("schema_version"), F.when(m(37), "").otherwise(F.col("event_id").cast("string")).alias("event_id"), F.when(m(41), "2024-13-01T00:00:00Z").otherwise(at).alias("event_time"), F.when(m(43), "2024-02-30T00:00:00Z").otherwise(at).alias("updated_at"),
        F.when(m(47), "MERGE").when(m(10), "DELETE").otherwise("UPSERT").alias("op"), F.when(m(53), "2024-02-30").otherwise(F.date_format("ts", "yyyy-MM-dd")).alias("record_date"), F.when(m(59), "WXX").otherwise("W04").alias("workshop_code"), F.lit("E01").alias("energy_code"),
        F.lit(1.5).alias("consumption"), F.when(m(61), "").otherwise("kWh").alias("unit"), F.lit(0.68).alias("unit_price"), F.when(m(67), -1.0).otherwise(F.coalesce("value", F.lit(1.0))).alias("cost"), F.lit("正常").alias("record_status"), F.lit(1).alias("is_production_day"),
    )
    value = F.when(m(71), F.unhex(F.lit("7BFF7D"))).when(m(73), F.lit("{broken").cast("binary")).otherwise(F.to_json(fields).cast("binary"))
    return e.select("event_id", F.lit(0).alias("partition"), F.col("event_id").alias("offset"), value.alias("value")).withColumnRenamed("event_id", "seq")


_MALFORMED = """CASE WHEN event_id % 71 = 0 THEN 'invalid_utf8' WHEN event_id % 73 = 0 THEN 'invalid_json' WHEN event_id % 31 = 0 THEN 'unsupported_schema_version' WHEN event_id % 47 = 0 THEN 'invalid_op' WHEN event_id % 37 = 0 THEN 'invalid_event_id' WHEN event_id % 10 <> 0 AND event_id % 61 = 0 THEN 'invalid_unit'
WHEN event_id % 41 = 0 THEN 'invalid_event_time' WHEN event_id % 43 = 0 THEN 'invalid_updated_at' WHEN event_id % 53 = 0 THEN 'invalid_record_date' WHEN event_id % 59 = 0 THEN 'invalid_business_key' END"""
_INVALID = """CASE WHEN event_id % 71 = 0 OR event_id % 73 = 0 OR event_id % 31 = 0 THEN 'unsupported_schema_version' WHEN event_id % 47 = 0 THEN 'invalid_op' WHEN event_id % 10 <> 0 AND (event_id % 67 = 0 OR value < 0) THEN 'invalid_cost' WHEN event_id % 10 <> 0 AND event_id % 61 = 0 THEN 'invalid_unit'
WHEN event_id % 53 = 0 THEN 'missing_business_date' WHEN event_id % 59 = 0 THEN 'invalid_business_key' WHEN event_id % 37 = 0 OR event_id % 41 = 0 OR event_id % 43 = 0 THEN 'missing_event_metadata' END"""


@query("t06_t07_quarantine", f"SELECT event_id AS seq, {_MALFORMED} AS reason, {_INVALID} AS quality_error, CASE WHEN event_id % 71 = 0 THEN 'e/99' END AS payload FROM events", "")
def t_quarantine(p: Plant) -> DataFrame:
    return power.parsed_events(payloads(p)).select("seq", "reason", "quality_error", F.when(F.col("reason") == "invalid_utf8", F.col("payload_base64")).alias("payload"))


@query("t05_deletes", f"SELECT event_id AS seq FROM events WHERE ({_MALFORMED}) IS NULL AND ({_INVALID}) IS NULL AND event_id % 10 = 0", "")
def t_deletes(p: Plant) -> DataFrame:
    return power.deletes(power.parsed_events(payloads(p)).filter("reason IS NULL")).select("seq")


@query("t04_late_rows", _S + """, b AS (SELECT *, device_id % 2 AS batch FROM s), m AS (SELECT max(epoch_ms(ts)) AS largest FROM b WHERE batch = 0)
SELECT batch, batch = 1 AND epoch_ms(ts) <= largest - 86400000 AS late, count(*) AS n FROM b, m GROUP BY ALL""", "")
def t_late(p: Plant) -> DataFrame:
    """Two batches: rows of the second that are a day older than the newest of the first are late. The first is replayed after the second."""
    router, out = power.LateRouter(p.spark, new_path(p.spark, "late"), 86_400), None
    rows = samples(p).withColumn("batch", F.col("device_id") % 2)
    for batch in (0, 1, 0):
        parts = router.split(rows.filter(F.col("batch") == batch), batch)
        both = parts[0].withColumn("late", F.lit(False)).unionByName(parts[1].withColumn("late", F.lit(True)))
        out = both if out is None else out.unionByName(both) if batch == 1 else out
    return out.groupBy("batch", "late").agg(F.count("*").alias("n"))


@query("t09_replay_rejects", """SELECT event_id, CASE WHEN value IS NULL OR value < 0 THEN 'bad_power' ELSE 'repeated_id' END AS reason, count(*) AS n FROM (SELECT event_id, value FROM events UNION ALL SELECT event_id, value FROM events WHERE event_id % 50 = 0) WHERE value IS NULL OR value < 0 OR event_id % 50 = 0 GROUP BY ALL""", "")
def t_refused(p: Plant) -> DataFrame:
    e = p.table("events").select("event_id", F.col("value").alias("power_kw"))
    return power.replay_rejects(e.unionByName(e.filter("event_id % 50 = 0"))).groupBy("event_id", "reason").agg(F.count("*").alias("n"))


@query("t13_energy_of_minutes", _S + """, d AS (SELECT workshop_code, device_id, date_trunc('minute', ts) AS m, avg(power_kw) AS mean_kw, sum(power_kw * 30 / 3600) AS kwh FROM s GROUP BY ALL), w AS (SELECT workshop_code, m, sum(mean_kw) AS kw, sum(kwh) AS kwh FROM d GROUP BY ALL)
SELECT workshop_code, round(sum(CASE WHEN minute(m) % 5 = 0 THEN kw * 60 / 3600 ELSE kwh END), 6) AS kwh FROM w GROUP BY 1""", "")
def t_energy(p: Plant) -> DataFrame:
    """Every fifth minute has lost its energy and counts by its power."""
    minutes = power.workshop_minutes(power.device_minutes(samples(p)))
    return power.energy_of(minutes.withColumn("kwh", F.when(F.minute("minute") % 5 != 0, F.col("kwh")))).withColumn("kwh", F.round("kwh", 6))


@query("t14_poison_conflicts", "SELECT 'alerts/0/' || event_id AS locator, 2::BIGINT AS contents FROM events WHERE event_id % 142 = 0", "")
def t_conflicts(p: Plant) -> DataFrame:
    """A part of the broken messages comes again with other bytes, another part with the same ones."""
    m = payloads(p).withColumn("topic", F.lit("alerts")).filter("seq % 71 = 0")
    other = m.filter("seq % 142 = 0").withColumn("value", F.unhex(F.lit("7BFEFE7D")))
    _, poison = power.poison_split(m.unionByName(m).unionByName(other))
    return power.poison_conflicts(poison)


@query("t15_alerts_once", _S + """, a AS (SELECT workshop_code, CAST(ts AS DATE) AS day, count(*) AS n FROM s GROUP BY ALL HAVING sum(power_kw) > 100) SELECT workshop_code, day, n FROM a""", "")
def t_once(p: Plant) -> DataFrame:
    """Alerts of days through the idempotent sink in overlapping batches, each written twice."""
    days = samples(p).groupBy("workshop_code", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.sum("power_kw").alias("kw")).filter("kw > 100").drop("kw")
    alerts = written(days.withColumn("alert_id", power.alert_id(days)), "alerts")
    sink = power.IdempotentSink(p.spark, new_path(p.spark, "sink"), part="day")
    for n, some in enumerate((F.dayofmonth("day") < 20, F.dayofmonth("day") > 10)):
        sink.append(alerts.filter(some), n)
        sink.append(alerts.filter(some), n)
    return sink.read().select("workshop_code", "day", "n")


@query("t14_poison_split", "SELECT count(CASE WHEN event_id % 71 <> 0 AND event_id % 73 <> 0 THEN 1 END) AS alerts, count(CASE WHEN event_id % 71 = 0 OR event_id % 73 = 0 THEN 1 END) AS poison FROM events", "")
def t_poison(p: Plant) -> DataFrame:
    alerts, poison = power.poison_split(payloads(p).withColumn("topic", F.lit("alerts")))
    kinds = alerts.select(F.lit("a").alias("k")).unionByName(poison.select(F.lit("p").alias("k")))
    return kinds.agg(F.count(F.when(F.col("k") == "a", 1)).alias("alerts"), F.count(F.when(F.col("k") == "p", 1)).alias("poison"))


@query("t08_streamed_totals", _S + "SELECT workshop_code, count(*) AS n, round(sum(power_kw), 4) AS total FROM s GROUP BY 1", "")
def t_stream(p: Plant) -> DataFrame:
    """The samples through a file stream with a checkpoint into an idempotent sink; each batch is aggregated before it is written."""
    spark = p.spark
    folder = new_path(spark, "stream")
    path = f"{p.sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    sink = power.LatestSink(spark, f"{folder}/out", ("workshop_code", "part"))
    # a stream source takes a folder or a pattern; the pattern also fits a single file
    source = spark.readStream.schema(schema).parquet(f"{p.sf_dir}/[e]vents.parquet")
    rows = source.filter("value >= 0").select(F.concat(F.lit("W0"), F.col("user_id") % 8 + 1).alias("workshop_code"), F.col("value").alias("power_kw"))

    def write(batch: DataFrame, batch_id: int) -> None:
        sink.append(batch.groupBy("workshop_code").agg(F.count("*").alias("n"), F.sum("power_kw").alias("total")).withColumn("part", F.lit(batch_id)), batch_id)

    rows.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return sink.read().groupBy("workshop_code").agg(F.sum("n").alias("n"), F.round(F.sum("total"), 4).alias("total"))


#: Numbers of a bucket in which offsets are counted.
OFFSET_BUCKET = 30_000


def numbered(rows: DataFrame, bucket: int = OFFSET_BUCKET) -> DataFrame:
    """Rows (partition, seq) with `offset` from 0 on in the order of `seq`, a whole number that is unique in its partition. Rows are ordered within buckets of `seq`; what lies in the buckets before is counted, so a partition isn't one task."""
    rows = rows.withColumn("_b", F.floor(F.col("seq") / bucket))
    before = Window.partitionBy("partition").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # a row a bucket
    starts = rows.groupBy("partition", "_b").agg(F.count("*").alias("_c")).select("partition", "_b", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_start"))
    own = F.row_number().over(Window.partitionBy("partition", "_b").orderBy("seq")) - 1
    return rows.join(written(starts, "starts"), ["partition", "_b"]).withColumn("offset", (F.col("_start") + own).cast("long")).drop("_b", "_start")


def logged(p: Plant) -> tuple[DataFrame, str]:
    """The payloads in three partitions with offsets from 0 on, and the log that holds them."""
    rows, path = written(numbered(payloads(p).drop("offset").withColumn("partition", (F.col("seq") % 3).cast("int"))), "payloads"), new_path(p.spark, "log")
    log.write_segments(rows, path)
    return rows, path


_LOG = "WITH l AS (SELECT *, (event_id % 3)::INTEGER AS part, row_number() OVER (PARTITION BY event_id % 3 ORDER BY event_id) - 1 AS o FROM events)\n"


@query("s08_s09_log_stream", _LOG + f"""SELECT part AS "partition", o AS "offset", {_MALFORMED} AS reason, {_INVALID} AS quality_error FROM l""", "")
def t_log_stream(p: Plant) -> DataFrame:
    """The log as a stream with a checkpoint, in two runs, parsed and routed."""
    _, path = logged(p)
    out, state = new_path(p.spark, "parsed"), new_path(p.spark, "checkpoint")
    for _ in range(2):
        parsed = power.parsed_events(log.stream_log(p.spark, path)).select("partition", "offset", "reason", "quality_error")
        parsed.writeStream.format("parquet").option("checkpointLocation", state).trigger(availableNow=True).start(out).awaitTermination()
    return p.spark.read.parquet(out)


@query("s11_log_snapshot", _LOG + """, n AS (SELECT part, count(*) // 2 AS ends FROM l GROUP BY 1) SELECT part AS "partition", min(o) AS "first", max(o) AS "last", count(*) AS n, true AS contiguous FROM l JOIN n USING (part) WHERE o < ends GROUP BY ALL""", "")
def t_log_snapshot(p: Plant) -> DataFrame:
    """Exactly the offsets from 0 to frozen ends, half of each partition."""
    rows, path = logged(p)
    ends = {str(r.partition): r.n // 2 for r in rows.groupBy("partition").agg(F.count("*").alias("n")).collect()}  # a number a partition
    found = log.read_log(p.spark, path, endingOffsets=json.dumps(ends)).groupBy("partition").agg(F.min("offset").alias("first"), F.max("offset").alias("last"), F.count("*").alias("n"), F.count_distinct("offset").alias("d"))
    return found.withColumn("contiguous", (F.col("first") == 0) & (F.col("last") + 1 == F.col("d"))).drop("d")


@query("t04_t11_routed_once", _S + """, b AS (SELECT device_id, event_id, 0 AS batch, epoch_ms(ts) AS ms FROM s UNION ALL SELECT device_id, event_id, 1, epoch_ms(ts) FROM s WHERE event_id % 10 = 0), m AS (SELECT max(ms) - 864000000 AS watermark FROM b)
SELECT device_id::VARCHAR AS device_id, CASE WHEN batch = 0 THEN 'on_time' WHEN ms <= watermark THEN 'late' ELSE 'repeat' END AS route, count(*) AS n FROM b, m GROUP BY ALL""", "")
def t_routed_once(p: Plant) -> DataFrame:
    """All samples, then, after a restart, a tenth of them again: what is ten days older than the newest is late, the rest repeats."""
    rows = samples(p).select(F.col("device_id").cast("string").alias("device_id"), F.col("event_id").cast("string").alias("event_id"), "ts", F.col("power_kw").alias("value"))
    source, out, kept = (new_path(p.spark, n) for n in ("samples", "routed", "checkpoint"))
    for some in (F.lit(True), F.col("event_id").cast("long") % 10 == 0):
        rows.filter(some).write.mode("append").parquet(source)
        routed = state.routed_once(p.spark.readStream.schema(rows.schema).parquet(source), "10 days", 11 * 86_400)
        routed.writeStream.format("parquet").option("checkpointLocation", kept).trigger(availableNow=True).start(out).awaitTermination()
    return p.spark.read.parquet(out).groupBy("device_id", "route").agg(F.count("*").alias("n"))
