"""Registered queries of the sources and sinks: what they write into the shared folder and read back from it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattmill.operators import cleaning, hourly
from wattmill.operators.views import Plant
from wattmill.plans.catalog import query
from wattmill.sources import files
from wattmill.sources.adapter import ORACLE
from wattmill.staging import new_path, written
from wattmill.streaming import power
from wattmill.streaming.queries import payloads


@query("s01_raw_csv", "SELECT record_date, workshop_code, energy_code, count(*) AS n, round(sum(q), 3) AS consumption FROM typed GROUP BY ALL", cleaning._CHAIN)
def s_csv(p: Plant) -> DataFrame:
    """The dirty export through CSV files with a header: texts with ideographic spaces and empty fields come back, and are typed."""
    raw = cleaning.dirty(p).withColumn("data_source", F.col("input_seq").cast("string")).drop("input_seq")
    path = new_path(p.spark, "raw-csv")
    raw.select(*files.RAW_COLUMNS).write.option("header", True).csv(path)
    back = files.read_raw_csv(p.spark, path).withColumn("input_seq", F.col("data_source").cast("long"))
    return cleaning.typed(back).groupBy("record_date", "workshop_code", "energy_code").agg(F.count("*").alias("n"), F.round(F.sum("consumption"), 3).alias("consumption"))


@query("s02_written_window", "SELECT record_date, workshop_code, energy_code, cost::DOUBLE AS cost FROM energy WHERE record_date BETWEEN DATE '2024-06-01' AND DATE '2024-06-30'", ORACLE)
def s_written(p: Plant) -> DataFrame:
    path = new_path(p.spark, "window")
    files.write_window(p.energy.select("record_date", "workshop_code", "energy_code", "cost"), path, "2024-06-01", "2024-06-30")
    return p.spark.read.schema("record_date date, workshop_code string, energy_code string, cost double").option("header", True).csv(path)


@query("s04_incremental_window", "SELECT source_id, cost::DOUBLE AS cost FROM records WHERE updated_at >= TIMESTAMP '1995-01-01' AND updated_at < TIMESTAMP '1995-02-01'")
def s_window(p: Plant) -> DataFrame:
    at = lambda d: F.lit(d).cast("timestamp")
    return files.updated_between(p.records, at("1995-01-01"), at("1995-02-01")).select("source_id", F.col("cost").cast("double").alias("cost"))


@query("s05_landed_partitions", "SELECT CASE WHEN source_id % 2 = 0 THEN '2026-09-27' ELSE '2026-09-28' END AS dt, count(*) AS n, sum(source_id::HUGEINT)::DOUBLE AS ids FROM records WHERE source_id % 2 = 1 OR source_id % 3 = 0 GROUP BY 1", ORACLE)
def s_landed(p: Plant) -> DataFrame:
    """Two sync partitions; the first is landed again with fewer rows, the second stays."""
    path = new_path(p.spark, "landing")
    part = lambda n: p.records.filter(F.col("source_id") % 2 == n)
    for rows, dt in ((part(0), "2026-09-27"), (part(1), "2026-09-28"), (part(0).filter("source_id % 3 = 0"), "2026-09-27")):
        files.land_partition(rows, path, dt)
    return p.spark.read.parquet(path).groupBy(F.col("dt").cast("string").alias("dt")).agg(F.count("*").alias("n"), F.sum(F.col("source_id").cast("decimal(38,0)")).cast("double").alias("ids"))


@query("s06_first_existing_path", "SELECT user_id % 5 AS city_id, ts AS ts_local, CASE WHEN event_id % 7 <> 3 THEN value END AS temperature_2m FROM events", "")
def s_hourly(p: Plant) -> DataFrame:
    """Values as texts, a part of them no numbers; the first path doesn't exist."""
    e = p.table("events").select((F.col("user_id") % 5).alias("city_id"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("ts_local"), F.when(F.col("event_id") % 7 == 3, "n/a").otherwise(F.col("value").cast("string")).alias("temperature_2m"))
    path = new_path(p.spark, "hourly")
    e.write.parquet(path)
    return files.read_hourly(p.spark, [f"{path}-missing", path], ["temperature_2m"]).withColumn("ts_local", F.col("ts_local").cast("timestamp_ntz"))


@query("s07_hourly_documents", "SELECT user_id AS city_id, ts AS ts_local, value AS pm10, CASE WHEN n < c THEN value * 2 END AS ozone FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, count(*) OVER (PARTITION BY user_id) AS c FROM events)", "")
def s_documents(p: Plant) -> DataFrame:
    """One document per city with parallel arrays, of which one lacks its last value."""
    e = p.table("events").groupBy(F.col("user_id").alias("city_id")).agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "value"))).alias("h"))  # a city's events, as a document holds them
    hours = F.struct(F.transform("h", lambda x: F.date_format(x["ts"], "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")).alias("time"), F.transform("h", lambda x: x["value"]).alias("pm10"), F.slice(F.transform("h", lambda x: x["value"] * 2), 1, F.size("h") - 1).alias("ozone"))
    return hourly.flattened(e.select("city_id", hours.alias("hourly")), ["pm10", "ozone"]).withColumn("ts_local", F.col("ts_local").cast("timestamp_ntz"))


_REASONS = """CASE WHEN event_id % 71 = 0 THEN 'invalid_utf8' WHEN event_id % 73 = 0 THEN 'invalid_json' WHEN event_id % 31 = 0 THEN 'unsupported_schema_version' WHEN event_id % 47 = 0 THEN 'invalid_op' WHEN event_id % 37 = 0 THEN 'invalid_event_id' WHEN event_id % 10 <> 0 AND event_id % 61 = 0 THEN 'invalid_unit'
WHEN event_id % 41 = 0 THEN 'invalid_event_time' WHEN event_id % 43 = 0 THEN 'invalid_updated_at' WHEN event_id % 53 = 0 THEN 'invalid_record_date' WHEN event_id % 59 = 0 THEN 'invalid_business_key' WHEN event_id % 10 <> 0 AND (event_id % 67 = 0 OR value < 0) THEN 'invalid_cost' END"""


@query("s12_event_log", "SELECT count(CASE WHEN event_id % 5 <> 0 THEN 1 END) AS accepted, count(CASE WHEN event_id % 5 = 0 THEN 1 END) AS rejected FROM events", "")
def s_log(p: Plant) -> DataFrame:
    at = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    e = F.struct(F.lit(1).alias("schema_version"), F.col("event_id").cast("string").alias("event_id"), at.alias("event_time"), at.alias("updated_at"), F.lit("DELETE").alias("op"), F.date_format("ts", "yyyy-MM-dd").alias("record_date"), F.lit("W01").alias("workshop_code"), F.lit("E01").alias("energy_code"))
    lines = p.table("events").select(F.when(F.col("event_id") % 5 == 0, "{not json").otherwise(F.to_json(e)).alias("value"))
    good, bad = files.read_event_log(lines, power.parsed_events)
    both = good.select(F.lit(1).alias("ok")).unionByName(bad.select(F.lit(0).alias("ok")))
    return both.agg(F.count(F.when(F.col("ok") == 1, 1)).alias("accepted"), F.count(F.when(F.col("ok") == 0, 1)).alias("rejected"))


@query("s12_reject_reasons", f"SELECT event_id AS seq, {_REASONS} AS reason FROM events", "")
def s_reasons(p: Plant) -> DataFrame:
    """Each line of a log with every kind of fault, and why it is refused (null: it isn't)."""
    good, bad = files.read_event_log(payloads(p), power.parsed_events)
    return good.select("seq", "reason").unionByName(bad.select("seq", "reason"))


@query("s13_document_ingest", "SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'not_finite' WHEN event_id % 11 = 0 THEN 'invalid_json' END AS problem, CASE WHEN event_id % 7 <> 0 AND event_id % 11 <> 0 THEN CAST(json_extract_string(props, '$.k') AS DOUBLE) END AS k FROM events", "")
def s_ingest(p: Plant) -> DataFrame:
    text = F.when(F.col("event_id") % 7 == 0, '{"k": NaN}').when(F.col("event_id") % 11 == 0, '{"k": ').otherwise(F.col("props"))
    return files.ingest(p.table("events").select("event_id", text.alias("text")), "json").select("event_id", "problem", F.try_variant_get("document", "$.k", "double").alias("k"))


@query("s13_csv_and_xml_ingest", """SELECT event_id, kind, CASE WHEN kind = 'csv' THEN CASE event_id % 5 WHEN 0 THEN 'empty_header' WHEN 1 THEN 'repeated_header' WHEN 2 THEN 'ragged' WHEN 3 THEN 'empty' END ELSE CASE event_id % 3 WHEN 0 THEN 'dtd' WHEN 1 THEN 'invalid_xml' END END AS problem FROM events, (VALUES ('csv'), ('xml')) k(kind)""", "")
def s_texts(p: Plant) -> DataFrame:
    e, n = p.table("events"), F.col("event_id")
    row = F.concat_ws(",", n.cast("string"), "event_type")
    csv = F.when(n % 5 == 0, F.concat(F.lit("id,\n"), row)).when(n % 5 == 1, F.concat(F.lit("id,id\n"), row)).when(n % 5 == 2, F.concat(F.lit("id,kind\n"), row, F.lit(",more"))).when(n % 5 == 3, "").otherwise(F.concat(F.lit("id,kind\r\n"), row, F.lit("\r\n")))
    body = F.concat(F.lit("<e id='"), n.cast("string"), F.lit("'>"), F.col("event_type"))
    xml = F.when(n % 3 == 0, F.concat(F.lit("<!DOCTYPE e>"), body, F.lit("</e>"))).when(n % 3 == 1, F.concat(body, F.lit("</f>"))).otherwise(F.concat(F.lit("<?xml version='1.0'?>\n"), body, F.lit("</e>")))
    part = lambda kind, text: files.ingest(e.select("event_id", text.alias("text")), kind).select("event_id", F.lit(kind).alias("kind"), "problem")
    return part("csv", csv).unionByName(part("xml", xml))


@query("s14_star_views", "SELECT n_name AS nation, count(*) AS n, sum(l_quantity)::DOUBLE AS quantity FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey GROUP BY 1", "")
def s_star(p: Plant) -> DataFrame:
    """The folder's tables as views, asked in SQL."""
    files.star_views(p.spark, p.sf_dir, ("lineitem", "supplier", "nation"))
    return p.spark.sql("SELECT n_name AS nation, count(*) AS n, CAST(sum(l_quantity) AS DOUBLE) AS quantity FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey GROUP BY n_name")


@query("s15_workbook_sheets", "SELECT s_suppkey AS id, CASE WHEN s_suppkey % 10 <> 0 THEN s_acctbal::DOUBLE END AS usage_kwh, count(l_orderkey) AS recommendations FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey GROUP BY ALL", "")
def s_sheets(p: Plant) -> DataFrame:
    """Two sheets as CSV; a tenth of one's numbers are none."""
    folder = new_path(p.spark, "workbook")
    usage = F.when(F.col("s_suppkey") % 10 == 0, "n/a").otherwise(F.col("s_acctbal").cast("string"))
    p.table("supplier").select(F.col("s_suppkey").alias("ID"), usage.alias("EC_plant_usage")).write.option("header", True).csv(f"{folder}/ASSESS")
    p.table("lineitem").select(F.col("l_suppkey").alias("ID"), F.col("l_orderkey").alias("SUPERID")).write.option("header", True).csv(f"{folder}/RECC")
    sheets = files.read_sheets(p.spark, folder, {"ASSESS": "id long, usage_kwh double", "RECC": "id long, superid long"})
    return sheets["ASSESS"].join(sheets["RECC"], "id", "left").groupBy("id", "usage_kwh").agg(F.count("superid").alias("recommendations"))


@query("s16_changed_files", "SELECT 'E0' || n || '.txt' AS name, CASE WHEN n <> 5 THEN sha256(n || ':' || (SELECT count(*) FROM lineitem)) END AS sha256, CASE n WHEN 3 THEN sha256('other') WHEN 4 THEN NULL WHEN 5 THEN sha256('5') END AS found FROM (VALUES (3), (4), (5)) t(n)", "")
def s_files(p: Plant) -> DataFrame:
    """Five files that the manifest tells of: one has other bytes, one is missing, one isn't in the manifest. Contents depend on the table."""
    folder = new_path(p.spark, "files")
    n_rows = p.table("lineitem").agg(F.count("*").alias("c"))
    names = p.spark.range(1, 5).join(n_rows)  # one row
    text = F.concat_ws(":", F.col("id").cast("string"), F.col("c").cast("string"))
    name = F.concat(F.lit("E0"), F.col("id").cast("string"), F.lit(".txt"))
    manifest = names.select(name.alias("name"), F.sha2(text.cast("binary"), 256).alias("sha256"))
    fs = p.spark._jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(p.spark._jsc.hadoopConfiguration())
    for n, content in ((1, None), (2, None), (3, "other"), (5, "5")):
        content = content or names.filter(F.col("id") == n).select(text).first()[0]
        out = fs.create(p.spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/E0{n}.txt"))
        out.write(content.encode())
        out.close()
    return files.changed_files(p.spark, folder, manifest).select("name", "sha256", "found")


@query("s18_cleaned_files", "WITH " + hourly._HOURS + "SELECT city_id, CAST(ts_local AS DATE) AS day, count(*) AS hours, round(max(t), 4) AS highest, (SELECT count(CASE WHEN tf THEN 1 END) FROM h6) AS filled FROM h6 GROUP BY ALL", "")
def s_cleaned(p: Plant) -> DataFrame:
    """Cleaned hours, their days and statistics as files; days and statistics are read back from CSV."""
    columns = ["temperature_2m", "relative_humidity_2m"]
    rows = written(hourly.cleaned(hourly.weather_hours(p).drop("event_id"), columns), "hours")
    path = new_path(p.spark, "cleaned")
    files.write_cleaned(rows, hourly.city_days(rows, "temperature_2m"), hourly.cleaning_stats(rows, columns), path)
    days = p.spark.read.schema("city_id long, day date, hours long, mean double, highest double, total double, peak_hours long").option("header", True).csv(f"{path}/days-csv")
    stats = p.spark.read.option("header", True).csv(f"{path}/stats").filter("column = 'temperature_2m'").select(F.col("filled").cast("long").alias("filled"))
    return days.select("city_id", "day", "hours", "highest").join(F.broadcast(stats))  # one row


@query("s20_timed_jobs", "SELECT 'energy' AS job, count(*) AS n_rows, true AS timed FROM energy UNION ALL SELECT 'production', count(*), true FROM production", ORACLE)
def s_timed(p: Plant) -> DataFrame:
    log = new_path(p.spark, "timings")
    for name, frame in (("energy", p.energy), ("production", p.production)):
        files.timed(lambda: frame, p.spark, name, log)  # noqa: B023  (run at once)
    return p.spark.read.schema("job string, seconds double, n_rows long").json(log).select("job", "n_rows", (F.col("seconds") > 0).alias("timed"))
