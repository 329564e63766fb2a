"""Hourly weather and air series: physical bounds, gap lengths, short-gap fill, peaks, city days; and interval joins on meter series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattmill.operators.scans import DAY_S, covered, neighbours, stretches
from wattmill.operators.views import Plant
from wattmill.plans.catalog import query

# Lowest and highest possible value of each column; humidity and cloud cover are clipped, others nulled.
BOUNDS = {
    "temperature_2m": (-50.0, 55.0), "relative_humidity_2m": (0.0, 100.0), "wind_speed_10m": (0.0, 250.0), "shortwave_radiation": (0.0, 1300.0), "precipitation": (0.0, 200.0), "cloud_cover": (0.0, 100.0),
    "pm2_5": (0.0, 1000.0), "pm10": (0.0, 2000.0), "nitrogen_dioxide": (0.0, 1000.0), "european_aqi": (0.0, 500.0), "ozone": (0.0, 800.0), "carbon_monoxide": (0.0, 30000.0),
}
CLIPPED, RAIN, LONGEST_GAP = ("relative_humidity_2m", "cloud_cover"), "precipitation", 3


def seconds(at: str) -> Column:
    return F.unix_seconds(F.col(at).cast("timestamp"))


def flattened(docs: DataFrame, metrics: list[str]) -> DataFrame:
    """Documents with parallel arrays as one row an hour; missing tails are null."""
    arrays = F.arrays_zip(F.col("hourly.time").alias("time"), *(F.col(f"hourly.{m}").alias(m) for m in metrics))
    return docs.select("city_id", F.explode(arrays).alias("h")).select("city_id", F.to_timestamp("h.time").alias("ts_local"), *(F.col(f"h.{m}").cast("double").alias(m) for m in metrics))


def bounded(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Values out of bounds are clipped or nulled, and flagged `<column>_out`; `<column>_null` is what was missing before."""
    new = {}
    for c in columns:
        low, high = BOUNDS[c]
        out = F.coalesce((F.col(c) < low) | (F.col(c) > high), F.lit(False))
        new[f"{c}_out"] = out
        new[f"{c}_null"] = F.col(c).isNull()
        new[c] = F.least(F.greatest(F.col(c), F.lit(low)), F.lit(high)) if c in CLIPPED else F.when(~out, F.col(c))
    # null stays null: greatest and least skip it
    new |= {c: F.when(F.col(c).isNotNull(), new[c]) for c in columns if c in CLIPPED}
    return rows.withColumns(new)


def gaps_filled(rows: DataFrame, columns: Sequence[str], city: str = "city_id", at: str = "ts_local", longest: int = LONGEST_GAP, method: str = "neighbour_mean", bucket_s: int = 30 * DAY_S) -> DataFrame:
    """For every column `<column>_gap` (length of the null run), and short runs filled: rain with 0, others from the valid neighbours. All columns in one scan.

    neighbour_mean: their mean, one of them at an edge. linear: on the line between them, edges stay null.
    """
    if method not in ("neighbour_mean", "linear"):
        raise ValueError(f"unknown method {method}")
    rows, new = neighbours(rows, [city], at, columns, bucket_s), {}
    for c in columns:
        prev, nxt = F.col(f"{c}_prev"), F.col(f"{c}_next")
        first = F.coalesce(prev.place, F.lit(0))
        gap = F.when(F.col(c).isNull(), F.coalesce(nxt.place, F.col("_places") + 1) - first - 1).otherwise(0)
        if c == RAIN:
            value = F.lit(0.0)
        elif method == "linear":
            value = prev.value + (nxt.value - prev.value) * (F.col("_place") - first) / (gap + 1)
        else:
            value = (F.coalesce(prev.value, nxt.value) + F.coalesce(nxt.value, prev.value)) / 2
        filled = F.when(F.col(c).isNull() & (gap <= longest), value).otherwise(F.col(c))
        new |= {f"{c}_gap": gap, f"{c}_filled": F.col(c).isNull() & filled.isNotNull(), c: filled}
    return rows.withColumns(new).drop("_place", "_places", *(f"{c}_{s}" for c in columns for s in ("prev", "next")))


def gap_filled(rows: DataFrame, column: str, city: str = "city_id", at: str = "ts_local", longest: int = LONGEST_GAP, method: str = "neighbour_mean") -> DataFrame:
    """W3, W4 for one column."""
    return gaps_filled(rows, [column], city, at, longest, method)


def all_peaks(rows: DataFrame, columns: Sequence[str], city: str = "city_id", least: int = 8, scope: str = "city") -> DataFrame:
    """For every column `<column>_peak`: beyond 1.5 interquartile ranges, which must not be 0; per city (with at least `least` values) or over all. One aggregate for all columns."""
    stats = rows.groupBy(*([city] if scope == "city" else [])).agg(*(F.percentile(c, F.lit([0.25, 0.75])).alias(f"_q_{c}") for c in columns), *(F.count(c).alias(f"_n_{c}") for c in columns))
    joined = rows.join(stats, city, "left") if scope == "city" else rows.join(F.broadcast(stats))  # a row per city, which Spark may broadcast once it knows their size; or one row
    new = {}
    for c in columns:
        low, high = F.col(f"_q_{c}")[0], F.col(f"_q_{c}")[1]
        beyond = (F.col(c) < low - 1.5 * (high - low)) | (F.col(c) > high + 1.5 * (high - low))
        enough = F.col(f"_n_{c}") >= least if scope == "city" else F.lit(True)
        new[f"{c}_peak"] = F.coalesce(beyond & (high > low) & enough, F.lit(False))
    return joined.withColumns(new).drop(*(f"{s}_{c}" for c in columns for s in ("_q", "_n")))


def peaks(rows: DataFrame, column: str, city: str = "city_id", least: int = 8, scope: str = "city") -> DataFrame:
    """W5 for one column."""
    return all_peaks(rows, [column], city, least, scope)


def cleaned(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One row per city and hour (smallest values first on ties), bounds, gaps, fills, peaks and any-peak."""
    first = Window.partitionBy("city_id", "ts_local").orderBy(*columns)
    rows = bounded(rows.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n"), columns)
    rows = all_peaks(gaps_filled(rows, columns), columns)
    return rows.withColumn("any_peak", F.greatest(*(F.col(f"{c}_peak") for c in columns)) if len(columns) > 1 else F.col(f"{columns[0]}_peak"))


def cleaning_stats(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Counts by column, from one aggregate. Values out of bounds are clips in the columns that are clipped, else violations."""
    n = lambda c: F.count(F.when(c, 1))
    none = F.lit(0).cast("long")
    parts = [
        F.struct(
            F.lit(c).alias("column"), n(F.col(f"{c}_null")).alias("nulls_before"), n(F.col(c).isNull()).alias("nulls_after"), n(F.col(f"{c}_filled")).alias("filled"), n(F.col(f"{c}_gap") > LONGEST_GAP).alias("in_long_gaps"),
            (none if c in CLIPPED else n(F.col(f"{c}_out"))).alias("violations"), (n(F.col(f"{c}_out")) if c in CLIPPED else none).alias("clips"), n(F.col(f"{c}_peak")).alias("peaks"),
        )
        for c in columns
    ]
    return rows.agg(F.array(*parts).alias("s")).select(F.explode("s").alias("s")).select("s.*")


def city_days(rows: DataFrame, column: str) -> DataFrame:
    """W8. Values are added as decimals and divided once, so means don't depend on the order of rows."""
    total = F.sum(F.col(column).cast("decimal(20,6)")).cast("double")
    return rows.groupBy("city_id", F.to_date("ts_local").alias("day")).agg(F.count("*").alias("hours"), (total / F.nullif(F.count(column), F.lit(0))).alias("mean"), F.max(column).alias("highest"), total.alias("total"), F.count(F.when(F.col(f"{column}_peak"), 1)).alias("peak_hours"))


def downsampled(rows: DataFrame, key: str, at: str, points: int = 96) -> DataFrame:
    """Every k-th row of a series, k such that about `points` stay."""
    by = Window.partitionBy(key)
    k = F.greatest(F.lit(1), F.floor(F.count("*").over(by) / points))
    return rows.withColumns({"_n": F.row_number().over(by.orderBy(at)) - 1, "_k": k}).filter(F.col("_n") % F.col("_k") == 0).drop("_n", "_k")


def weather_hours(p: Plant) -> DataFrame:
    """An hourly series per city from the events: temperature with faults and holes; hours are spread over users."""
    e = p.table("events")
    hour = F.date_trunc("hour", "ts")
    t = F.when(F.col("event_id") % 41 == 0, 99.0).when(F.col("event_id") % 7 == 3, None).otherwise(F.col("value"))
    return e.select((F.col("user_id") % 5).alias("city_id"), hour.alias("ts_local"), "event_id", t.alias("temperature_2m"), F.when(F.col("event_id") % 9 == 1, None).otherwise(F.round(F.col("value") * 3, 3)).alias("relative_humidity_2m"))


_HOURS = """h0 AS (SELECT user_id % 5 AS city_id, date_trunc('hour', ts) AS ts_local, CASE WHEN event_id % 41 = 0 THEN 99e0 WHEN event_id % 7 = 3 THEN NULL ELSE value END AS t, CASE WHEN event_id % 9 = 1 THEN NULL ELSE round(value * 3, 3) END AS h FROM events),
h1 AS (SELECT * FROM h0 QUALIFY row_number() OVER (PARTITION BY city_id, ts_local ORDER BY t NULLS FIRST, h NULLS FIRST) = 1), h2 AS (SELECT city_id, ts_local, coalesce(t < -50 OR t > 55, false) AS t_out, t IS NULL AS t_null, h IS NULL AS h_null, CASE WHEN t BETWEEN -50 AND 55 THEN t END AS t, coalesce(h < 0 OR h > 100, false) AS h_out, CASE WHEN h IS NOT NULL THEN least(greatest(h, 0), 100) END AS h FROM h1),
h3 AS (SELECT *, count(t) OVER o AS tr, count(h) OVER o AS hr FROM h2 WINDOW o AS (PARTITION BY city_id ORDER BY ts_local ROWS UNBOUNDED PRECEDING)), h4 AS (SELECT *, CASE WHEN t IS NULL THEN count(CASE WHEN t IS NULL THEN 1 END) OVER (PARTITION BY city_id, tr) ELSE 0 END AS tg, CASE WHEN h IS NULL THEN count(CASE WHEN h IS NULL THEN 1 END) OVER (PARTITION BY city_id, hr) ELSE 0 END AS hg,
last_value(t IGNORE NULLS) OVER b AS tp, first_value(t IGNORE NULLS) OVER a AS tn, last_value(h IGNORE NULLS) OVER b AS hp, first_value(h IGNORE NULLS) OVER a AS hn FROM h3 WINDOW b AS (PARTITION BY city_id ORDER BY ts_local ROWS UNBOUNDED PRECEDING), a AS (PARTITION BY city_id ORDER BY ts_local ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
h5 AS (SELECT city_id, ts_local, t_out, h_out, t_null, h_null, tg, hg, CASE WHEN t IS NULL AND tg <= 3 THEN (coalesce(tp, tn) + coalesce(tn, tp)) / 2 ELSE t END AS t, t IS NULL AND tg <= 3 AND coalesce(tp, tn) IS NOT NULL AS tf, CASE WHEN h IS NULL AND hg <= 3 THEN (coalesce(hp, hn) + coalesce(hn, hp)) / 2 ELSE h END AS h, h IS NULL AND hg <= 3 AND coalesce(hp, hn) IS NOT NULL AS hf FROM h4),
h6 AS (SELECT *, coalesce(n >= 8 AND q3 > q1 AND (t < q1 - 1.5 * (q3 - q1) OR t > q3 + 1.5 * (q3 - q1)), false) AS tk, coalesce(hn >= 8 AND h3 > h1 AND (h < h1 - 1.5 * (h3 - h1) OR h > h3 + 1.5 * (h3 - h1)), false) AS hk
    FROM h5 JOIN (SELECT city_id, quantile_cont(t, 0.25) AS q1, quantile_cont(t, 0.75) AS q3, count(t) AS n, quantile_cont(h, 0.25) AS h1, quantile_cont(h, 0.75) AS h3, count(h) AS hn FROM h5 GROUP BY 1) USING (city_id))
"""
_COLUMNS = ["temperature_2m", "relative_humidity_2m"]


@query("w01_w06_hourly_cleaning", "WITH " + _HOURS + "SELECT city_id, ts_local, round(t, 5) AS t, round(h, 5) AS h, tg::BIGINT AS t_gap, hg::BIGINT AS h_gap, tf AS t_filled, tk AS t_peak, t_out, tk OR hk AS any_peak FROM h6", "")
def w_clean(p: Plant) -> DataFrame:
    c = cleaned(weather_hours(p).drop("event_id"), _COLUMNS)
    return c.select("city_id", "ts_local", F.round("temperature_2m", 5).alias("t"), F.round("relative_humidity_2m", 5).alias("h"), F.col("temperature_2m_gap").cast("long").alias("t_gap"), F.col("relative_humidity_2m_gap").cast("long").alias("h_gap"), F.col("temperature_2m_filled").alias("t_filled"), F.col("temperature_2m_peak").alias("t_peak"), F.col("temperature_2m_out").alias("t_out"), "any_peak")


@query("w04_w05_linear_and_global", "WITH " + _HOURS + """, p AS (SELECT *, row_number() OVER (PARTITION BY city_id ORDER BY ts_local) AS i FROM h2), q AS (SELECT *, max(CASE WHEN t IS NOT NULL THEN i END) OVER b AS pi, min(CASE WHEN t IS NOT NULL THEN i END) OVER f AS ni FROM p WINDOW b AS (PARTITION BY city_id ORDER BY i), f AS (PARTITION BY city_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
l AS (SELECT q.city_id, q.ts_local, CASE WHEN q.t IS NULL AND ni - pi - 1 <= 3 THEN a.t + (b.t - a.t) * (q.i - pi) / (ni - pi) ELSE q.t END AS t FROM q LEFT JOIN p a ON a.city_id = q.city_id AND a.i = q.pi LEFT JOIN p b ON b.city_id = q.city_id AND b.i = q.ni), g AS (SELECT quantile_cont(t, 0.25) AS q1, quantile_cont(t, 0.75) AS q3 FROM l)
SELECT city_id, ts_local, round(t, 6) AS t, coalesce(q3 > q1 AND (t < q1 - 1.5 * (q3 - q1) OR t > q3 + 1.5 * (q3 - q1)), false) AS is_peak FROM l, g""", "")
def w_linear(p: Plant) -> DataFrame:
    """Gaps on the line between neighbours, and peaks over all cities together."""
    c = "temperature_2m"
    first = Window.partitionBy("city_id", "ts_local").orderBy(*_COLUMNS)
    hours = weather_hours(p).drop("event_id").withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")
    rows = peaks(gap_filled(bounded(hours, _COLUMNS), c, method="linear"), c, scope="all")
    return rows.select("city_id", "ts_local", F.round(c, 6).alias("t"), F.col(f"{c}_peak").alias("is_peak"))


@query("w07_cleaning_stats", "WITH " + _HOURS + """SELECT 'temperature_2m' AS "column", count(CASE WHEN t_null THEN 1 END) AS nulls_before, count(CASE WHEN t IS NULL THEN 1 END) AS nulls_after, count(CASE WHEN tf THEN 1 END) AS filled, count(CASE WHEN tg > 3 THEN 1 END) AS in_long_gaps, count(CASE WHEN t_out THEN 1 END) AS violations, 0::BIGINT AS clips, count(CASE WHEN tk THEN 1 END) AS peaks FROM h6
UNION ALL SELECT 'relative_humidity_2m', count(CASE WHEN h_null THEN 1 END), count(CASE WHEN h IS NULL THEN 1 END), count(CASE WHEN hf THEN 1 END), count(CASE WHEN hg > 3 THEN 1 END), 0, count(CASE WHEN h_out THEN 1 END), count(CASE WHEN hk THEN 1 END) FROM h6""", "")
def w_stats(p: Plant) -> DataFrame:
    return cleaning_stats(cleaned(weather_hours(p).drop("event_id"), _COLUMNS), _COLUMNS)


@query("w08_city_days", "WITH " + _HOURS + "SELECT city_id, CAST(ts_local AS DATE) AS day, count(*) AS hours, sum(t::DECIMAL(20,6))::DOUBLE / nullif(count(t), 0) AS mean, max(t) AS highest, sum(t::DECIMAL(20,6))::DOUBLE AS total, count(CASE WHEN tk THEN 1 END) AS peak_hours FROM h6 GROUP BY ALL", "")
def w_days(p: Plant) -> DataFrame:
    return city_days(cleaned(weather_hours(p).drop("event_id"), _COLUMNS), "temperature_2m")


@query("w09_downsample", "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS n, count(*) OVER (PARTITION BY user_id) AS c FROM events) WHERE n % greatest(1, c // 20) = 0", "")
def w_down(p: Plant) -> DataFrame:
    return downsampled(p.table("events").select("user_id", "event_id"), "user_id", "event_id", 20)


@query("w10_weather_air", """a AS (SELECT user_id % 5 AS city_id, date_trunc('hour', ts) AS ts_local, max(value) AS v FROM events WHERE event_type = 'view' GROUP BY ALL), b AS (SELECT user_id % 5 AS city_id, date_trunc('hour', ts) AS ts_local, max(value) AS v FROM events WHERE event_type = 'click' GROUP BY ALL)
SELECT city_id, ts_local, a.v AS weather, b.v AS air FROM a FULL JOIN b USING (city_id, ts_local)""".replace("a AS", "WITH a AS", 1), "")
def w_join(p: Plant) -> DataFrame:
    part = lambda kind, name: p.table("events").filter(F.col("event_type") == kind).groupBy((F.col("user_id") % 5).alias("city_id"), F.date_trunc("hour", "ts").alias("ts_local")).agg(F.max("value").alias(name))
    return part("view", "weather").join(part("click", "air"), ["city_id", "ts_local"], "full")


# --- studies on meter series ---


def peer_screen(rows: DataFrame, peers: list[str], usage: str, baseline: Column, least: int = 20, quantile: float = 0.95) -> DataFrame:
    """Rows outside the baseline period against the quantile of their matched peers in it: `excess` over it (not below 0; null without peers), and whether a row is a
    candidate: above it, with at least `least` peers."""
    stats = rows.filter(baseline).groupBy(*peers).agg(F.count("*").alias("n"), F.median(usage).alias("median"), F.percentile(usage, F.lit(quantile)).alias("p95"))
    late = rows.filter(~baseline).join(stats, peers, "left")
    candidate = F.coalesce((F.col("n") >= least) & (F.col(usage) > F.col("p95")), F.lit(False))
    return late.withColumns({"n": F.coalesce("n", F.lit(0)), "candidate": candidate, "excess": F.when(F.col("p95").isNotNull(), F.greatest(F.lit(0.0), F.col(usage) - F.col("p95")))})


def episodes(rows: DataFrame, key: str, at: str, step_s: int, first: Sequence[str] = (), sums: Sequence[str] = (), least: Sequence[str] = (), means: Sequence[str] = (), bucket_s: int = 30 * DAY_S) -> DataFrame:
    """Rows that follow each other by exactly `step_s` as one episode with its first and last time and size; the first row's values of `first`, and sums, smallest values and means of columns."""
    of = lambda f, names, prefix: [f(c).alias(f"{prefix}{c}") for c in names]
    evidence = [*of(lambda c: F.min_by(c, at), first, ""), *of(F.sum, sums, "sum_"), *of(F.min, least, "least_"), *of(F.avg, means, "mean_")]
    return stretches(rows, [key], at, step_s, bucket_s).groupBy(key, "episode").agg(F.min(at).alias("first_at"), F.max(at).alias("last_at"), F.count("*").alias("n"), *evidence)


_PEERS = """r AS (SELECT user_id % 5 AS meter, date_trunc('hour', ts) AS ts, CASE WHEN isodow(any_value(ts)) >= 6 THEN 'weekend' ELSE 'weekday' END AS day_type, hour(any_value(ts)) // 6 AS part, min(event_type) AS load_type, sum(value::DECIMAL(18,6))::DOUBLE AS usage, sum(CAST(json_extract_string(props, '$.k') AS DECIMAL(18,6)))::DOUBLE AS reactive FROM events WHERE value > 0 GROUP BY ALL),
f AS (SELECT *, 100 * usage / sqrt(usage * usage + reactive * reactive) AS factor FROM r), s AS (SELECT load_type, day_type, part, count(*) AS n, median(usage) AS median, quantile_cont(usage, 0.8) AS p95 FROM f WHERE day(ts) <= 12 GROUP BY ALL),
c AS (SELECT f.*, coalesce(s.n, 0) AS n, p95, coalesce(s.n >= 20 AND usage > p95, false) AS candidate, CASE WHEN p95 IS NOT NULL THEN greatest(0, usage - p95) END AS excess FROM f LEFT JOIN s USING (load_type, day_type, part) WHERE day(ts) > 12)
"""


def usage_hours(p: Plant) -> DataFrame:
    """Hourly readings of five meters: usage, and reactive energy, which the number in `props` plays; the power factor (percent) follows from both."""
    e = p.table("events").filter("value > 0").select((F.col("user_id") % 5).alias("meter"), F.date_trunc("hour", "ts").alias("ts"), "event_type", "value", F.get_json_object("props", "$.k").alias("k"))
    number = lambda c: F.sum(F.col(c).cast("decimal(18,6)")).cast("double")
    r = e.groupBy("meter", "ts").agg(F.min("event_type").alias("load_type"), number("value").alias("usage"), number("k").alias("reactive"))
    usage, reactive = F.col("usage"), F.col("reactive")
    return r.withColumns({"day_type": F.when(F.weekday("ts") >= 5, "weekend").otherwise("weekday"), "part": F.floor(F.hour("ts") / 6), "factor": 100 * usage / F.sqrt(usage * usage + reactive * reactive)})


def screened_hours(p: Plant) -> DataFrame:
    """Twelve days are the baseline; the quantile is lower than the default, as the series is short."""
    return peer_screen(usage_hours(p), ["load_type", "day_type", "part"], "usage", F.dayofmonth("ts") <= 12, quantile=0.8)


@query("p04_peer_screen", "WITH " + _PEERS + "SELECT meter, ts, n, candidate, excess FROM c", "")
def p_screen(p: Plant) -> DataFrame:
    return screened_hours(p).select("meter", "ts", "n", "candidate", "excess")


@query("p05_episodes", "WITH " + _PEERS + """, k AS (SELECT *, CASE WHEN coalesce(ts - lag(ts) OVER w <> INTERVAL 1 HOUR, true) THEN 1 ELSE 0 END AS nw FROM c WHERE candidate WINDOW w AS (PARTITION BY meter ORDER BY ts)), e AS (SELECT *, sum(nw) OVER (PARTITION BY meter ORDER BY ts ROWS UNBOUNDED PRECEDING) AS ep FROM k)
SELECT meter, ep::BIGINT AS episode, min(ts) AS first_at, max(ts) AS last_at, count(*) AS n, arg_min(load_type, ts) AS load_type, arg_min(day_type, ts) AS day_type, sum(usage) AS sum_usage, sum(p95) AS sum_p95, sum(excess) AS sum_excess, sum(reactive) AS sum_reactive, min(e.n) AS least_peers, avg(factor) AS mean_factor FROM e GROUP BY ALL""", "")
def p_episodes(p: Plant) -> DataFrame:
    """Episodes with their evidence, largest excess first."""
    rows = screened_hours(p).filter("candidate").withColumnRenamed("n", "peers")
    return episodes(rows, "meter", "ts", 3_600, ("load_type", "day_type"), ("usage", "p95", "excess", "reactive"), ("peers",), ("factor",)).orderBy(F.desc("sum_excess"))


@query("p01_p02_annual_baseline", """y AS (SELECT d.workshop_code, left(year_month, 4) AS y, sum(tce)::DOUBLE AS e, sum(output_qty)::DOUBLE AS q FROM days d JOIN production p USING (record_date, workshop_code) GROUP BY ALL) SELECT workshop_code, round(1000 * a.e / a.q, 4) AS ue_2024, round(1000 * b.e / b.q, 4) AS ue_2025, round(a.e / a.q * b.q, 3) AS due_tce, round(b.e - a.e / a.q * b.q, 3) AS gap_tce FROM (SELECT * FROM y WHERE y = '2024') a JOIN (SELECT * FROM y WHERE y = '2025') b USING (workshop_code)""")
def p_annual(p: Plant) -> DataFrame:
    d = p.days.join(p.production, ["record_date", "workshop_code"])
    of = lambda c, y: F.sum(F.when(F.left("year_month", F.lit(4)) == y, F.col(c).cast("double")))
    g = d.groupBy("workshop_code").agg(*(of(c, y).alias(f"{n}_{y}") for c, n in (("tce", "e"), ("output_qty", "q")) for y in ("2024", "2025"))).dropna()
    due = F.try_divide("e_2024", "q_2024") * F.col("q_2025")
    return g.select("workshop_code", F.round(1000 * F.try_divide("e_2024", "q_2024"), 4).alias("ue_2024"), F.round(1000 * F.try_divide("e_2025", "q_2025"), 4).alias("ue_2025"), F.round(due, 3).alias("due_tce"), F.round(F.col("e_2025") - due, 3).alias("gap_tce"))


def annual_baseline(days: DataFrame, production: DataFrame) -> DataFrame:
    """Per year and workshop energy, cost, carbon, output, days and intensity. Keys of one side only are counted: both must be 0 for a sound baseline."""
    d = days.select("record_date", "workshop_code", "tce", "cost_yuan", "co2_t", F.lit(1).alias("_d"))
    both = d.join(production.select("record_date", "workshop_code", "output_qty", F.lit(1).alias("_p")), ["record_date", "workshop_code"], "full")
    total = lambda c: F.sum(c).cast("double")
    rows = both.groupBy(F.year("record_date").alias("year"), "workshop_code").agg(
        total("tce").alias("tce"), total("cost_yuan").alias("cost_yuan"), total("co2_t").alias("co2_t"), total("output_qty").alias("output_qty"), F.count(F.when(F.col("_d") + F.col("_p") == 2, 1)).alias("days"),
        F.count(F.when(F.col("_p").isNull(), 1)).alias("without_output"), F.count(F.when(F.col("_d").isNull(), 1)).alias("without_energy"),
    )
    return rows.withColumn("kgce_per_unit", F.try_divide(F.col("tce") * 1000, F.col("output_qty")))


@query("p01_annual_totals", """b AS (SELECT coalesce(d.record_date, p.record_date) AS record_date, coalesce(d.workshop_code, p.workshop_code) AS workshop_code, tce, cost_yuan, co2_t, output_qty, d.record_date IS NOT NULL AS e, p.record_date IS NOT NULL AS o FROM days d FULL JOIN production p ON d.record_date = p.record_date AND d.workshop_code = p.workshop_code)
SELECT year(record_date) AS year, workshop_code, sum(tce)::DOUBLE AS tce, sum(cost_yuan)::DOUBLE AS cost_yuan, sum(co2_t)::DOUBLE AS co2_t, sum(output_qty)::DOUBLE AS output_qty, count(CASE WHEN e AND o THEN 1 END) AS days, count(CASE WHEN NOT o THEN 1 END) AS without_output, count(CASE WHEN NOT e THEN 1 END) AS without_energy, round(sum(tce)::DOUBLE * 1000 / sum(output_qty)::DOUBLE, 6) AS kgce_per_unit FROM b GROUP BY ALL""")
def p_totals(p: Plant) -> DataFrame:
    return annual_baseline(p.days, p.production).withColumn("kgce_per_unit", F.round("kgce_per_unit", 6))


def savings_scenarios(rows: DataFrame, rates: tuple[int, ...] = (3, 5, 10)) -> DataFrame:
    """What some percent less would save per workshop and energy."""
    sums = rows.groupBy("workshop_code", "energy_code").agg(*(F.sum(c).cast("double").alias(c) for c in ("std_coal_kgce", "co2_kg", "cost")))
    saved = lambda c, k: F.col(c) * F.col("rate_pct") / (100.0 * k)
    return sums.withColumn("rate_pct", F.explode(F.array(*(F.lit(r) for r in rates)))).select("workshop_code", "energy_code", "rate_pct", saved("std_coal_kgce", 1000).alias("saved_tce"), saved("co2_kg", 1000).alias("saved_co2_t"), saved("cost", 1).alias("saved_yuan"))


@query("p03_savings_scenarios", "t AS (SELECT workshop_code, energy_code, sum(std_coal_kgce)::DOUBLE AS e, sum(co2_kg)::DOUBLE AS c, sum(cost)::DOUBLE AS y FROM v WHERE year(record_date) = 2025 GROUP BY ALL) SELECT workshop_code, energy_code, rate AS rate_pct, round(e * rate / 100000, 8) AS saved_tce, round(c * rate / 100000, 8) AS saved_co2_t, round(y * rate / 100, 6) AS saved_yuan FROM t, (VALUES (3), (5), (10)) g(rate)")
def p_scenarios(p: Plant) -> DataFrame:
    rows = savings_scenarios(p.enriched.filter(F.year("record_date") == 2025))
    return rows.withColumns({c: F.round(c, n) for c, n in (("saved_tce", 8), ("saved_co2_t", 8), ("saved_yuan", 6))})


def sensitivity(excess: DataFrame, column: str = "excess", shares: tuple[float, ...] = (10.0, 25.0, 50.0), tariff: float | None = None) -> DataFrame:
    """What a share of the candidates' excess would save, and cost at a tariff, which must not be negative (without one the cost is null)."""
    if tariff is not None and tariff < 0:
        raise ValueError("a tariff must not be negative")
    total = excess.agg(F.coalesce(F.sum(column), F.lit(0.0)).alias("x"))
    rows = total.withColumn("share_pct", F.explode(F.array(*map(F.lit, shares)))).select("share_pct", (F.col("x") * F.col("share_pct") / 100).alias("saved_kwh"))
    return rows.withColumns({"saved_cost": F.col("saved_kwh") * F.lit(tariff).cast("double"), "tariff": F.lit(tariff).cast("double")})


@query("p07_sensitivity", "WITH " + _PEERS + "SELECT share::DOUBLE AS share_pct, coalesce(sum(excess), 0) * share / 100 AS saved_kwh, coalesce(sum(excess), 0) * share / 100 * 0.68 AS saved_cost, 0.68::DOUBLE AS tariff FROM (VALUES (10), (25), (50)) g(share) LEFT JOIN c ON candidate GROUP BY share", "")
def p_sensitivity(p: Plant) -> DataFrame:
    return sensitivity(screened_hours(p).filter("candidate"), tariff=0.68)


def power_factor_queue(rows: DataFrame, factor: str, reactive: str, *ties: str, below: float = 90.0, top: int = 250) -> DataFrame:
    """The review queue: rows with a power factor below `below` and reactive energy, lowest factor and then most reactive energy first, the first `top` as in the reference."""
    return rows.filter((F.col(factor) < below) & (F.col(reactive) > 0)).orderBy(F.asc(factor), F.desc(reactive), *ties).limit(top)


@query("p06_power_factor_queue", "WITH " + _PEERS + "SELECT meter, ts, load_type, day_type, usage, round(factor, 6) AS factor, reactive FROM c WHERE round(factor, 6) < 90 AND reactive > 0 ORDER BY round(factor, 6), reactive DESC, meter, ts LIMIT 250", "")
def p_factor(p: Plant) -> DataFrame:
    rows = screened_hours(p).withColumn("factor", F.round("factor", 6))
    return power_factor_queue(rows, "factor", "reactive", "meter", "ts").select("meter", "ts", "load_type", "day_type", "usage", "factor", "reactive")


@query("p08_series_integrity", "SELECT meter, count(*) AS n, count(*) - count(DISTINCT ts) AS repeated, count(CASE WHEN gap > 14400 THEN 1 END) AS gaps FROM (SELECT user_id % 20 AS meter, ts, (epoch_ms(date_trunc('second', ts)) - epoch_ms(date_trunc('second', lag(ts) OVER (PARTITION BY user_id % 20 ORDER BY ts)))) / 1000 AS gap FROM events) GROUP BY 1", "")
def p_integrity(p: Plant) -> DataFrame:
    w = Window.partitionBy("meter").orderBy("ts")
    rows = p.table("events").select((F.col("user_id") % 20).alias("meter"), "ts").withColumn("gap", seconds("ts") - F.lag(seconds("ts")).over(w))
    return rows.groupBy("meter").agg(F.count("*").alias("n"), (F.count("*") - F.count_distinct("ts")).alias("repeated"), F.count(F.when(F.col("gap") > 14_400, 1)).alias("gaps"))


def with_issues(readings: DataFrame, issues: DataFrame) -> DataFrame:
    """Readings with `flagged`: whether a quality interval of their asset covers them; an open interval runs to the stream's end, ends are exclusive."""
    intervals = issues.select("asset_id", "issue_start", F.coalesce("issue_end", "stream_end").alias("issue_end"))
    return covered(readings, intervals, "asset_id", "time", "issue_start", "issue_end").withColumnRenamed("covered", "flagged")


def without_issues(readings: DataFrame, issues: DataFrame) -> DataFrame:
    """Readings that no quality interval of their asset covers."""
    return with_issues(readings, issues).filter(~F.col("flagged")).drop("flagged")


def gated(readings: DataFrame, signals: DataFrame, windows: DataFrame, issues: DataFrame) -> DataFrame:
    """Readings of all phases with `flagged` and `usable`: in a reliable window, in no quality interval, finite and not negative.

    Readings have asset_id, time, signal_id, value and observation_window_id; signals and windows are small dimensions, so Spark may broadcast them.
    """
    phases = readings.join(signals.filter("phase = 'all'").select("signal_id"), "signal_id", "left_semi").join(windows.select("observation_window_id", "is_reliable_window"), "observation_window_id")
    finite = F.col("value").isNotNull() & ~F.isnan("value") & (F.col("value") >= 0) & (F.col("value") != float("inf"))
    return with_issues(phases, issues).withColumn("usable", F.coalesce(F.col("is_reliable_window"), F.lit(False)) & ~F.col("flagged") & finite)


def asset_summary(readings: DataFrame, signals: DataFrame, windows: DataFrame, issues: DataFrame, assets: DataFrame) -> DataFrame:
    """Per asset its type, whether it is a submeter, all quarter hours of all phases, the usable, flagged and negative ones, first and last time, and energy and mean power of the usable ones."""
    good = lambda c: F.when(F.col("usable"), F.col(c).cast("decimal(20,6)"))
    kwh = F.sum(good("value")).cast("double")
    rows = gated(readings, signals, windows, issues).join(assets.select("asset_id", "asset_type", "is_submeter"), "asset_id")
    return rows.groupBy("asset_id", "asset_type", "is_submeter").agg(
        F.count("*").alias("windows"), F.count_if("usable").alias("usable_windows"), F.count_if("flagged").alias("flagged_windows"), F.count_if(F.col("value") < 0).alias("negative_windows"),
        F.min("time").alias("first_at"), F.max("time").alias("last_at"), kwh.alias("kwh"), (4 * kwh / F.nullif(F.count_if("usable"), F.lit(0))).alias("mean_kw"),
    )


def asset_issues(p: Plant) -> DataFrame:
    day = F.date_trunc("day", "ts")
    return p.table("events").filter("event_id % 97 = 0").select((F.col("user_id") % 20).alias("asset_id"), day.alias("issue_start"), F.when(F.col("event_id") % 3 != 0, day + F.expr("INTERVAL 6 HOURS")).alias("issue_end"), F.lit("2024-01-20").cast("timestamp").alias("stream_end"))


_ASSETS = """i AS (SELECT user_id % 20 AS asset_id, date_trunc('day', ts) AS a, CASE WHEN event_id % 3 = 0 THEN TIMESTAMP '2024-01-20 00:00:00' ELSE date_trunc('day', ts) + INTERVAL 6 HOURS END AS b FROM events WHERE event_id % 97 = 0),
r AS (SELECT user_id % 20 AS asset_id, ts AS "time", CASE WHEN event_id % 29 = 0 THEN 'NaN'::DOUBLE WHEN event_id % 31 = 0 THEN -value ELSE value END AS value, user_id % 50 % 7 <> 3 AS reliable FROM events WHERE event_type IN ('view', 'click')),
q AS (SELECT *, EXISTS (SELECT 1 FROM i WHERE i.asset_id = r.asset_id AND r."time" >= i.a AND r."time" < i.b) AS flagged FROM r), g AS (SELECT *, reliable AND NOT flagged AND coalesce(value >= 0 AND isfinite(value), false) AS usable, CASE WHEN asset_id % 9 = 4 THEN 'network' ELSE 'machine' END AS asset_type, asset_id % 2 = 0 AS is_submeter FROM q)
"""


def asset_readings(p: Plant) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """Readings, signals, windows, issues and assets: event types play signals, of which two are of all phases; some values aren't numbers, some are negative."""
    e = p.table("events")
    value = F.when(F.col("event_id") % 29 == 0, float("nan")).when(F.col("event_id") % 31 == 0, -F.col("value")).otherwise(F.col("value"))
    readings = e.select((F.col("user_id") % 20).alias("asset_id"), F.col("ts").alias("time"), F.col("event_type").alias("signal_id"), (F.col("user_id") % 50).alias("observation_window_id"), value.alias("value"))
    signals = e.select(F.col("event_type").alias("signal_id"), F.when(F.col("event_type").isin("view", "click"), "all").otherwise("L1").alias("phase")).distinct()
    windows = e.select((F.col("user_id") % 50).alias("observation_window_id")).distinct().withColumn("is_reliable_window", F.col("observation_window_id") % 7 != 3)
    assets = e.select((F.col("user_id") % 20).alias("asset_id")).distinct().withColumns({"asset_type": F.when(F.col("asset_id") % 9 == 4, "network").otherwise("machine"), "is_submeter": F.col("asset_id") % 2 == 0})
    return readings, signals, windows, asset_issues(p), assets


@query("p09_j07_asset_summary", "WITH " + _ASSETS + """SELECT asset_id, asset_type, is_submeter, count(*) AS windows, count(*) FILTER (usable) AS usable_windows, count(*) FILTER (flagged) AS flagged_windows, count(*) FILTER (value < 0) AS negative_windows, min("time") AS first_at, max("time") AS last_at, sum((CASE WHEN usable THEN value END)::DECIMAL(20,6))::DOUBLE AS kwh, 4 * sum((CASE WHEN usable THEN value END)::DECIMAL(20,6))::DOUBLE / nullif(count(*) FILTER (usable), 0) AS mean_kw FROM g GROUP BY ALL""", "")
def p_assets(p: Plant) -> DataFrame:
    return asset_summary(*asset_readings(p))


@query("p09_sound_readings", "WITH " + _ASSETS + """SELECT asset_id, "time", value FROM g WHERE usable""", "")
def p_sound(p: Plant) -> DataFrame:
    """The readings that pass all gates."""
    return gated(*asset_readings(p)[:4]).filter("usable").select("asset_id", "time", "value")


def asset_days(usable: DataFrame, assets: DataFrame) -> DataFrame:
    """P10: usable quarter hours as days of an asset: windows, energy and mean power."""
    kwh = F.sum(F.col("value").cast("decimal(20,6)")).cast("double")
    days = usable.groupBy("asset_id", F.to_date("time").alias("day")).agg(F.count("*").alias("windows"), kwh.alias("kwh"), (4 * kwh / F.count("*")).alias("mean_kw"))
    return days.withColumn("day_type", F.when(F.weekday("day") >= 5, "weekend").otherwise("weekday")).join(assets.select("asset_id", "asset_type"), "asset_id")


def asset_day_queue(days: DataFrame, cutoff: str, usable: int = 80, least: int = 20, factor: float = 1.25, more_kw: float = 2.0, network: tuple = ()) -> DataFrame:
    """P10: the days from the cutoff on with at least `usable` windows, against the asset's days of that type before it (at least `least` of them): candidates have a mean power
    above max(factor x P95, P95 + more_kw) and aren't of a network meter (asset types in `network`), as those sum up others. `excess_kwh` is the power over P95 times the windows' hours."""
    sound = days.filter(F.col("windows") >= usable)
    cut = F.to_date(F.lit(cutoff))
    keys = ["asset_id", "asset_type", "day_type"]
    base = sound.filter(F.col("day") < cut).groupBy(*keys).agg(F.count("*").alias("base_days"), F.median("mean_kw").alias("median_kw"), F.percentile("mean_kw", F.lit(0.95)).alias("p95_kw"))
    rows = sound.filter(F.col("day") >= cut).join(base.filter(F.col("base_days") >= least), keys)
    rows = rows.withColumn("threshold_kw", F.greatest(F.lit(factor) * F.col("p95_kw"), F.col("p95_kw") + more_kw))
    member = F.coalesce(F.col("asset_type").isin(*network), F.lit(False)) if network else F.lit(False)
    over = F.greatest(F.col("mean_kw") - F.col("p95_kw"), F.lit(0.0))
    return rows.withColumns({"candidate": (F.col("mean_kw") > F.col("threshold_kw")) & ~member, "excess_kwh": over * F.col("windows") / 4})


_ASSET_DAYS = "WITH " + _ASSETS + """, d AS (SELECT asset_id, asset_type, CAST("time" AS DATE) AS day, CASE WHEN isodow("time") >= 6 THEN 'weekend' ELSE 'weekday' END AS day_type, count(*) AS windows, sum(value::DECIMAL(20,6))::DOUBLE AS kwh, 4 * sum(value::DECIMAL(20,6))::DOUBLE / count(*) AS mean_kw FROM g WHERE usable GROUP BY ALL), u AS (SELECT * FROM d WHERE windows >= 2),
b AS (SELECT asset_id, asset_type, day_type, count(*) AS base_days, median(mean_kw) AS median_kw, quantile_cont(mean_kw, 0.95) AS p95_kw FROM u WHERE day < DATE '2024-01-22' GROUP BY ALL HAVING count(*) >= 2),
o AS (SELECT u.*, base_days, median_kw, p95_kw, greatest(1.1 * p95_kw, p95_kw + 2) AS threshold_kw, mean_kw > greatest(1.1 * p95_kw, p95_kw + 2) AND asset_type <> 'network' AS candidate, greatest(mean_kw - p95_kw, 0) * windows / 4 AS excess_kwh FROM u JOIN b USING (asset_id, asset_type, day_type) WHERE day >= DATE '2024-01-22')
"""


def review_days(p: Plant) -> DataFrame:
    """Days need two windows, baselines two days: the series is short."""
    readings, signals, windows, issues, assets = asset_readings(p)
    return asset_day_queue(asset_days(gated(readings, signals, windows, issues).filter("usable"), assets), "2024-01-22", 2, 2, 1.1, network=("network",))


@query("p10_asset_day_review", _ASSET_DAYS + "SELECT asset_id, asset_type, day, day_type, windows, kwh, mean_kw, base_days, median_kw, p95_kw, threshold_kw, candidate, excess_kwh FROM o", "")
def p_review(p: Plant) -> DataFrame:
    """All days that are judged."""
    return review_days(p)


@query("p10_asset_day_queue", _ASSET_DAYS + "SELECT asset_id, day, day_type, mean_kw, threshold_kw, excess_kwh FROM o WHERE candidate", "")
def p_queue(p: Plant) -> DataFrame:
    """Candidates, largest excess first."""
    return review_days(p).filter("candidate").orderBy(F.desc("excess_kwh")).select("asset_id", "day", "day_type", "mean_kw", "threshold_kw", "excess_kwh")


def assessments(plants: DataFrame, recommendations: DataFrame) -> DataFrame:
    """Per assessment (id, declared, usage_kwh, production) its recommendations (id, four savings, cost, status): counts, whether they are as declared, savings of
    all and of implemented ones (status I; I and N are known), cost and payback of implemented ones, energy per unit. Assessments without recommendations stay."""
    saved = F.coalesce("psaved", F.lit(0)) + F.coalesce("ssaved", F.lit(0)) + F.coalesce("tsaved", F.lit(0)) + F.coalesce("qsaved", F.lit(0))
    done = F.col("status") == "I"
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0))
    sums = recommendations.withColumn("_s", saved).groupBy("id").agg(
        F.count("*").alias("n"), F.count(F.when(F.col("status").isin("I", "N"), 1)).alias("known"), F.count(F.when(done, 1)).alias("implemented"), zero("_s").alias("saved"), zero(F.when(done, F.col("_s"))).alias("saved_implemented"), zero(F.when(done, F.col("cost"))).alias("cost_implemented")
    )
    rows = plants.join(sums, "id", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n", "known", "implemented", "saved", "saved_implemented", "cost_implemented")})
    return rows.select(
        "id", "n", (F.col("n") == F.col("declared")).alias("as_declared"), "known", "implemented", "saved", "saved_implemented", "cost_implemented",
        F.when(F.col("saved_implemented") > 0, F.try_divide(F.col("cost_implemented").cast("double"), F.col("saved_implemented").cast("double"))).alias("payback_years"), F.when(F.col("production") > 0, F.try_divide(F.col("usage_kwh").cast("double"), F.col("production").cast("double"))).alias("kwh_per_unit"),
    )


@query("p11_assessments", """WITH r AS (SELECT l_suppkey AS id, CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(l_discount AS DECIMAL(4,2)) + CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(l_tax AS DECIMAL(4,2)) + coalesce(CASE WHEN l_linenumber % 2 = 0 THEN CAST(l_quantity AS DECIMAL(12,2)) END, 0) + CAST(l_linenumber AS DECIMAL(12,2)) AS saved, CAST(l_extendedprice AS DECIMAL(12,2)) AS cost, CASE WHEN l_linenumber = 5 THEN NULL WHEN l_linestatus = 'F' THEN 'I' ELSE 'N' END AS status FROM lineitem WHERE l_suppkey % 10 <> 3),
c AS (SELECT l_suppkey AS id, count(*) AS n FROM lineitem GROUP BY 1), s AS (SELECT id, count(*) AS n, count(status) AS known, count(CASE WHEN status = 'I' THEN 1 END) AS implemented, sum(saved) AS saved, sum(CASE WHEN status = 'I' THEN saved END) AS si, sum(CASE WHEN status = 'I' THEN cost END) AS ci FROM r GROUP BY 1)
SELECT s_suppkey AS id, coalesce(s.n, 0) AS n, coalesce(s.n, 0) = coalesce(c.n, 0) AS as_declared, coalesce(known, 0) AS known, coalesce(implemented, 0) AS implemented, coalesce(saved, 0)::DOUBLE AS saved, coalesce(si, 0)::DOUBLE AS saved_implemented, coalesce(ci, 0)::DOUBLE AS cost_implemented, CASE WHEN si > 0 THEN round(ci::DOUBLE / si::DOUBLE, 8) END AS payback_years, CASE WHEN s_suppkey % 4 > 0 THEN round(s_acctbal::DOUBLE / (s_suppkey % 4), 8) END AS kwh_per_unit FROM supplier LEFT JOIN c ON c.id = s_suppkey LEFT JOIN s ON s.id = s_suppkey""", "")
def p_cases(p: Plant) -> DataFrame:
    """Suppliers play assessments, their order lines recommendations; a tenth of the assessments has lost them."""
    line = p.table("lineitem")
    price = F.col("l_extendedprice").cast("decimal(12,2)")
    r = line.filter("l_suppkey % 10 <> 3").select(
        F.col("l_suppkey").alias("id"), (price * F.col("l_discount").cast("decimal(4,2)")).alias("psaved"), (price * F.col("l_tax").cast("decimal(4,2)")).alias("ssaved"), F.when(F.col("l_linenumber") % 2 == 0, F.col("l_quantity").cast("decimal(12,2)")).alias("tsaved"), F.col("l_linenumber").cast("decimal(12,2)").alias("qsaved"),
        price.alias("cost"), F.when(F.col("l_linenumber") == 5, None).when(F.col("l_linestatus") == "F", "I").otherwise("N").alias("status"),
    )
    declared = line.groupBy(F.col("l_suppkey").alias("id")).agg(F.count("*").alias("declared"))
    plants = p.table("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("usage_kwh"), (F.col("s_suppkey") % 4).alias("production")).join(declared, "id", "left").fillna(0, ["declared"])
    rows = assessments(plants, r)
    return rows.withColumns({c: F.col(c).cast("double") for c in ("saved", "saved_implemented", "cost_implemented")} | {c: F.round(c, 8) for c in ("payback_years", "kwh_per_unit")})
