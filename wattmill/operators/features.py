"""Features, rolling-origin back-tests, bootstrap, sequences, forecasts, load shifting and evidence search."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression, LinearRegressionModel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattmill.operators.boosting import TREES, Model, fit, predict
from wattmill.operators.views import Plant
from wattmill.plans.catalog import query
from wattmill.staging import written

WARM_UP, TRAIN_DAYS, TEST_DAYS, STEP_DAYS = 28, 365, 30, 30
NUMBERS = ("tce_lag_1", "tce_lag_7", "tce_lag_14", "tce_mean_7", "tce_mean_28", "qty_lag_1", "qty_mean_7", "temperature_lag_1", "idle_lag_1", "weekday", "is_weekend", "month", "season_sin", "season_cos")
#: Workshops that are columns of boosted models.
MOST_SHOPS = 200
#: Ablation: features without one of these groups.
GROUPS = {"lags": ("tce_lag_1", "tce_lag_7", "tce_lag_14"), "means": ("tce_mean_7", "tce_mean_28"), "plant": ("qty_lag_1", "qty_mean_7", "idle_lag_1", "temperature_lag_1"), "calendar": ("weekday", "is_weekend", "month", "season_sin", "season_cos")}


def daily_series(p: Plant) -> DataFrame:
    """Energy, output, temperature and idleness per workshop and day."""
    d = p.days.join(p.production, ["record_date", "workshop_code"], "left")
    return d.select(F.col("record_date").alias("date"), F.col("workshop_code").alias("workshop"), F.col("tce").cast("double").alias("tce"), F.coalesce(F.col("output_qty").cast("double"), F.lit(0.0)).alias("qty"), F.col("avg_temperature").alias("temperature"), F.col("has_shutdown").alias("idle"))


def series_faults(rows: DataFrame) -> DataFrame:
    """M1's refusals: repeated keys, negative measures and calendar gaps; an empty result is sound."""
    w = Window.partitionBy("workshop").orderBy("date")
    gap = F.datediff("date", F.lag("date").over(w))
    fault = F.when(gap == 0, "repeated_key").when(gap > 1, "calendar_gap").when((F.col("tce") < 0) | (F.col("qty") < 0), "negative")
    return rows.withColumn("fault", fault).filter("fault IS NOT NULL").select("workshop", "date", "fault")


def checked(rows: DataFrame) -> DataFrame:
    """`rows`, or an error that names the first faults (M1)."""
    if found := series_faults(rows).limit(5).collect():
        raise ValueError(f"series refused: {found}")
    return rows


def features(rows: DataFrame) -> DataFrame:
    """M1: what is known on the day before: lags, means of the shifted series with full windows, calendar."""
    w = Window.partitionBy("workshop").orderBy("date")
    mean = lambda c, n: F.when(F.count(c).over(w.rowsBetween(-n, -1)) == n, F.avg(c).over(w.rowsBetween(-n, -1)))
    angle = 2 * F.pi() * F.dayofyear("date") / 365.25
    return rows.select(
        "date", "workshop", "tce", *(F.lag("tce", k).over(w).alias(f"tce_lag_{k}") for k in (1, 7, 14)), mean("tce", 7).alias("tce_mean_7"), mean("tce", 28).alias("tce_mean_28"), F.lag("qty", 1).over(w).alias("qty_lag_1"), mean("qty", 7).alias("qty_mean_7"),
        F.lag("temperature", 1).over(w).alias("temperature_lag_1"), F.lag("idle", 1).over(w).cast("double").alias("idle_lag_1"), F.weekday("date").cast("double").alias("weekday"), (F.weekday("date") >= 5).cast("double").alias("is_weekend"),
        F.month("date").cast("double").alias("month"), F.sin(angle).alias("season_sin"), F.cos(angle).alias("season_cos"),
    )


_DAILY = """s AS (SELECT d.record_date AS date, d.workshop_code AS workshop, d.tce::DOUBLE AS tce, coalesce(p.output_qty::DOUBLE, 0) AS qty, avg_temperature AS temperature, has_shutdown AS idle FROM days d LEFT JOIN production p USING (record_date, workshop_code)),
x AS (SELECT *, lag(tce, 1) OVER w AS l1, lag(tce, 7) OVER w AS l7, lag(tce, 14) OVER w AS l14, CASE WHEN count(tce) OVER a = 7 THEN avg(tce) OVER a END AS m7, CASE WHEN count(tce) OVER b = 28 THEN avg(tce) OVER b END AS m28, lag(qty) OVER w AS q1, lag(temperature) OVER w AS t1 FROM s WINDOW w AS (PARTITION BY workshop ORDER BY date), a AS (PARTITION BY workshop ORDER BY date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING), b AS (PARTITION BY workshop ORDER BY date ROWS BETWEEN 28 PRECEDING AND 1 PRECEDING)),
e AS (SELECT * FROM x WHERE l1 IS NOT NULL AND l14 IS NOT NULL AND m28 IS NOT NULL AND t1 IS NOT NULL),
folds AS (SELECT range AS fold, DATE '2024-01-29' + CAST(365 + 30 * range AS INTEGER) AS first_test FROM range(20) WHERE DATE '2024-01-29' + CAST(365 + 30 * range + 29 AS INTEGER) <= DATE '2025-12-31')
"""


@query("m01_daily_features", _DAILY + "SELECT date, workshop, round(l1, 4) AS tce_lag_1, round(l7, 4) AS tce_lag_7, round(m7, 8) AS tce_mean_7, round(m28, 8) AS tce_mean_28, round(q1, 3) AS qty_lag_1 FROM x")
def m_features(p: Plant) -> DataFrame:
    return features(daily_series(p)).select("date", "workshop", F.round("tce_lag_1", 4).alias("tce_lag_1"), F.round("tce_lag_7", 4).alias("tce_lag_7"), F.round("tce_mean_7", 8).alias("tce_mean_7"), F.round("tce_mean_28", 8).alias("tce_mean_28"), F.round("qty_lag_1", 3).alias("qty_lag_1"))


@query("m01_all_features", _DAILY + "SELECT date, workshop, round(l14, 4) AS tce_lag_14, round(q7, 8) AS qty_mean_7, round(t1, 4) AS temperature_lag_1, i1::DOUBLE AS idle_lag_1, (isodow(date) - 1)::DOUBLE AS weekday, CASE WHEN isodow(date) >= 6 THEN 1e0 ELSE 0e0 END AS is_weekend, month(date)::DOUBLE AS month, round(sin(2 * pi() * dayofyear(date) / 365.25e0), 9) AS season_sin, round(cos(2 * pi() * dayofyear(date) / 365.25e0), 9) AS season_cos FROM (SELECT *, CASE WHEN count(qty) OVER a = 7 THEN avg(qty) OVER a END AS q7, lag(idle) OVER w AS i1 FROM x WINDOW w AS (PARTITION BY workshop ORDER BY date), a AS (PARTITION BY workshop ORDER BY date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING))")
def m_all_features(p: Plant) -> DataFrame:
    """The features that `m01_daily_features` doesn't show."""
    digits = {"tce_lag_14": 4, "qty_mean_7": 8, "temperature_lag_1": 4, "season_sin": 9, "season_cos": 9}
    return features(daily_series(p)).select("date", "workshop", *(F.round(c, n).alias(c) for c, n in digits.items()), *(F.col(c).cast("double").alias(c) for c in ("idle_lag_1", "weekday", "is_weekend", "month")))


@query("m01_refused_series", _DAILY + """, y AS (SELECT workshop, date, CASE WHEN day(date) = 9 THEN -tce ELSE tce END AS tce, qty FROM s WHERE day(date) <> 20 UNION ALL SELECT workshop, date, tce, qty FROM s WHERE day(date) = 5), z AS (SELECT *, date_diff('day', lag(date) OVER (PARTITION BY workshop ORDER BY date), date) AS gap FROM y)
SELECT workshop, date, CASE WHEN gap = 0 THEN 'repeated_key' WHEN gap > 1 THEN 'calendar_gap' ELSE 'negative' END AS fault FROM z WHERE gap = 0 OR gap > 1 OR tce < 0 OR qty < 0""")
def m_faults(p: Plant) -> DataFrame:
    """A day of each month twice, one missing, one negative."""
    s = daily_series(p)
    rows = s.filter(F.dayofmonth("date") != 20).withColumn("tce", F.when(F.dayofmonth("date") == 9, -F.col("tce")).otherwise(F.col("tce"))).unionByName(s.filter(F.dayofmonth("date") == 5))
    return series_faults(rows)


def rolling_folds(rows: DataFrame, train_days: int = TRAIN_DAYS, test_days: int = TEST_DAYS, step_days: int = STEP_DAYS, warm_up: int = WARM_UP) -> DataFrame:
    """M2: whole folds of an expanding window: fold, first and last test day, first training day."""
    span = rows.agg(F.date_add(F.min("date"), warm_up).alias("first_train"), F.max("date").alias("last"))
    n = F.floor((F.datediff("last", "first_train") + 1 - train_days - test_days) / step_days)
    numbered = span.filter(n >= 0).withColumn("fold", F.explode(F.sequence(F.lit(0).cast("long"), n)))
    first = F.date_add("first_train", (train_days + F.col("fold") * step_days).cast("int"))
    return numbered.select("fold", "first_train", first.alias("first_test"), F.date_add(first, test_days - 1).alias("last_test"))


def eligible(rows: DataFrame) -> DataFrame:
    """M3: rows with every feature."""
    return rows.dropna(subset=list(NUMBERS))


def in_folds(rows: DataFrame, folds: DataFrame) -> DataFrame:
    """Rows with their fold and split; a row is in the training part of every later fold. Folds are a short table."""
    joined = rows.join(F.broadcast(folds), (F.col("date") >= F.col("first_train")) & (F.col("date") <= F.col("last_test")))
    return joined.withColumn("split", F.when(F.col("date") < F.col("first_test"), "train").otherwise("test"))


@query("m02_m04_seasonal_naive", _DAILY + "SELECT fold, count(*) AS n, round(avg(abs(tce - l7)), 8) AS mae, round(sqrt(avg((tce - l7) * (tce - l7))), 8) AS rmse FROM e JOIN folds ON date BETWEEN first_test AND first_test + 29 GROUP BY 1")
def m_naive(p: Plant) -> DataFrame:
    f = features(daily_series(p))
    test = in_folds(eligible(f), rolling_folds(f)).filter("split = 'test'")
    return fold_metrics(test.withColumn("prediction", F.col("tce_lag_7")))


def fold_metrics(predicted: DataFrame, actual: str = "tce") -> DataFrame:
    """M5: rows, MAE and RMSE by fold."""
    e = F.col(actual) - F.col("prediction")
    return predicted.groupBy("fold").agg(F.count("*").alias("n"), F.round(F.avg(F.abs(e)), 8).alias("mae"), F.round(F.sqrt(F.avg(e * e)), 8).alias("rmse"))


@query("m03_key_fingerprint", _DAILY + "SELECT fold, count(*) AS n, sha256(string_agg(strftime(date, '%Y-%m-%d') || '|' || workshop, chr(10) ORDER BY strftime(date, '%Y-%m-%d') || '|' || workshop)) AS fingerprint FROM e JOIN folds ON date BETWEEN first_test AND first_test + 29 GROUP BY 1")
def m_fingerprint(p: Plant) -> DataFrame:
    """One hash per fold's test keys (30 days of workshops: small groups)."""
    f = features(daily_series(p))
    test = in_folds(eligible(f), rolling_folds(f)).filter("split = 'test'").withColumn("key", F.concat_ws("|", F.date_format("date", "yyyy-MM-dd"), "workshop"))
    return test.groupBy("fold").agg(F.count("*").alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list("key")), "\n").cast("binary"), 256).alias("fingerprint"))


def fold_models(folds: DataFrame, without: dict[str, tuple[str, ...]], columns: tuple[str, ...]) -> list[Model]:
    """A model for every fold and every set of features left out. Folds are a short table."""
    seen = {name: tuple(i for i, c in enumerate(columns) if c not in gone) for name, gone in without.items()}
    return [Model(name, f.fold, f.first_train, f.first_test, f.last_test, own) for f in folds.orderBy("fold").collect() for name, own in seen.items()]


def boosted_folds(rows: DataFrame, folds: DataFrame, without: dict[str, tuple[str, ...]], trees: int = TREES, **fitting) -> DataFrame:
    """M6: date, workshop, tce, without, fold, prediction: boosted trees over the features and the workshops as columns of 0 and 1, all folds and all sets in step."""
    rows = written(eligible(rows), "fold-rows")
    shops = [r.workshop for r in rows.select("workshop").distinct().orderBy("workshop").limit(MOST_SHOPS + 1).collect()]
    if len(shops) > MOST_SHOPS:
        raise ValueError(f"over {MOST_SHOPS} workshops: give them as features of their own")
    columns = (*NUMBERS, *(f"shop_{i}" for i in range(len(shops))))
    models = fold_models(folds, without, columns)
    wide = rows.withColumns({f"shop_{i}": (F.col("workshop") == s).cast("double") for i, s in enumerate(shops)})
    if not models:
        return rows.select("date", "workshop", "tce", F.lit("").alias("without"), F.lit(0).cast("long").alias("fold"), F.lit(None).cast("double").alias("prediction")).limit(0)
    fitted = fit(wide.select("date", "tce", *columns), models, columns, "tce", trees=trees, **fitting)
    return predict(wide, fitted, models, columns, ("date", "workshop", "tce")).withColumnRenamed("model", "without")


def ablation(rows: DataFrame, folds: DataFrame, trees: int = TREES, **fitting) -> DataFrame:
    """M7: every fold's metrics with all features (`without` none) and without each group of them."""
    predicted = boosted_folds(rows, folds, {"none": (), **GROUPS}, trees, **fitting)
    e = F.col("tce") - F.col("prediction")
    return predicted.groupBy("without", "fold").agg(F.count("*").alias("n"), F.round(F.avg(F.abs(e)), 8).alias("mae"), F.round(F.sqrt(F.avg(e * e)), 8).alias("rmse"))


@query("m06_boosted_trees")
def m_boosted(p: Plant) -> DataFrame:
    f = written(features(daily_series(p)), "features")
    return boosted_folds(f, rolling_folds(f), {"none": ()}).select("date", "workshop", "fold", "tce", "prediction")


@query("m07_group_ablation")
def m_ablation(p: Plant) -> DataFrame:
    f = written(features(daily_series(p)), "features")
    return ablation(f, rolling_folds(f))


def paired_deltas(a: DataFrame, b: DataFrame, actual: str = "tce") -> DataFrame:
    """M8: per date the mean absolute error of `a` less that of `b`."""
    loss = lambda f, n: f.groupBy("date").agg(F.avg(F.abs(F.col(actual) - F.col("prediction"))).alias(n))
    return loss(a, "_a").join(loss(b, "_b"), "date").select("date", (F.col("_a") - F.col("_b")).alias("delta"))


@query("m08_paired_deltas", _DAILY + "SELECT date, round(avg(abs(tce - l7)) - avg(abs(tce - m7)), 8) AS delta FROM e GROUP BY 1")
def m_deltas(p: Plant) -> DataFrame:
    f = eligible(features(daily_series(p)))
    d = paired_deltas(f.withColumn("prediction", F.col("tce_lag_7")), f.withColumn("prediction", F.col("tce_mean_7")))
    return d.select("date", F.round("delta", 8).alias("delta"))


def drawn(seed: int, *parts: Column) -> Column:
    """A number in [0, 1) by MD5 of the seed and the parts: the same wherever a row lies and however often it is computed."""
    digits = F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *(x.cast("string") for x in parts)).cast("binary")), 1, 13)
    return F.conv(digits, 16, 10).cast("bigint").cast("double") / float(16**13)


def block_bootstrap(values: DataFrame, block: int, replicates: int = 20_000, seed: int = 7) -> DataFrame:
    """M9: mean and 95 % interval of `delta` (ordered by `position` 0..n-1) by moving blocks without wrapping.

    A block's sum is a window sum, so a replicate draws block starts and adds their sums: replicates times n / block rows, spread by range().
    A replicate has n values, so its last block is cut short. The draw of a replicate's k-th block is by MD5.
    """
    spark = values.sparkSession
    n = values.count()
    blocks = max(1, -(-n // block))
    length = min(block, n)
    w = Window.orderBy("position")  # a series of days
    of = lambda k: F.sum("delta").over(w.rowsBetween(0, k - 1))
    sums = values.select(F.col("position").cast("long").alias("start"), of(length).alias("s"), of(n - (blocks - 1) * length).alias("last")).filter(F.col("start") <= n - length)
    replicate, k = F.col("id") % replicates, F.floor(F.col("id") / replicates)
    draws = spark.range(replicates * blocks).select(replicate.alias("replicate"), (k == blocks - 1).alias("is_last"), F.floor(drawn(seed, F.lit(block), replicate, k) * (n - length + 1)).alias("start"))
    means = draws.join(F.broadcast(sums), "start").groupBy("replicate").agg((F.sum(F.when(F.col("is_last"), F.col("last")).otherwise(F.col("s"))) / n).alias("m"))
    bounds = means.agg(F.percentile("m", F.lit(0.025)).alias("low"), F.percentile("m", F.lit(0.975)).alias("high"))
    return values.agg(F.avg("delta").alias("mean")).join(bounds).withColumn("block", F.lit(block))  # one row each


@query("m09_block_bootstrap", _DAILY + """, dl AS (SELECT row_number() OVER (ORDER BY date) - 1 AS position, delta FROM (SELECT date, avg(abs(tce - l7)) - avg(abs(tce - m7)) AS delta FROM e GROUP BY 1)), n AS (SELECT count(*) AS n FROM dl),
b AS (SELECT block, (n + block - 1) // block AS blocks, n FROM n, (VALUES (7), (14), (30)) g(block)),
sums AS (SELECT block, x.position AS start, sum(y.delta) AS s, sum(y.delta) FILTER (y.position < x.position + n - (blocks - 1) * block) AS "last" FROM b, dl x, dl y WHERE y.position BETWEEN x.position AND x.position + block - 1 AND x.position <= n - block GROUP BY ALL),
draws AS (SELECT block, n, r, k = blocks - 1 AS is_last, CAST(floor(CAST('0x' || left(md5('7:' || block || ':' || r || ':' || k), 13) AS BIGINT) / 4503599627370496e0 * (n - block + 1)) AS BIGINT) AS start FROM b, range(20000) a(r), unnest(range(0, blocks)) c(k)),
means AS (SELECT block, r, sum(CASE WHEN is_last THEN "last" ELSE s END) / any_value(n) AS m FROM draws JOIN sums USING (block, start) GROUP BY ALL)
SELECT block::INTEGER AS block, round((SELECT avg(delta) FROM dl), 9) AS mean, round(quantile_cont(m, 0.025), 9) AS low, round(quantile_cont(m, 0.975), 9) AS high FROM means GROUP BY 1""")
def m_bootstrap(p: Plant) -> DataFrame:
    f = eligible(features(daily_series(p)))
    d = paired_deltas(f.withColumn("prediction", F.col("tce_lag_7")), f.withColumn("prediction", F.col("tce_mean_7")))
    d = written(d.withColumn("position", F.row_number().over(Window.orderBy("date")) - 1), "deltas")
    out = reduce(lambda a, b: a.unionByName(b), (block_bootstrap(d, block) for block in (7, 14, 30)))
    return out.withColumns({c: F.round(c, 9) for c in ("mean", "low", "high")})


def interval_faults(rows: DataFrame, step_s: int, per_day: int) -> DataFrame:
    """M10's refusals of a meter's interval series (meter, at): repeated stamps, steps of another length, days with another number of intervals."""
    w = Window.partitionBy("meter").orderBy("at")
    gap = F.unix_seconds(F.col("at").cast("timestamp")) - F.lag(F.unix_seconds(F.col("at").cast("timestamp"))).over(w)
    steps = rows.withColumn("fault", F.when(gap == 0, "repeated_stamp").when(gap != step_s, "other_step")).filter("fault IS NOT NULL").select("meter", F.to_date("at").alias("date"), "fault")
    days = rows.groupBy("meter", F.to_date("at").alias("date")).agg(F.count("*").alias("n")).filter(F.col("n") != per_day)
    return steps.unionByName(days.select("meter", "date", F.lit("incomplete_day").alias("fault")))


def day_features(rows: DataFrame, per_day: int = 96) -> DataFrame:
    """Intervals (meter, at, kwh) as days: sum, whether the day is complete, season and week as angles, lags of 1, 4, 7 and 28 days, means of 7 and 28 days before."""
    d = rows.groupBy("meter", F.to_date("at").alias("date")).agg(F.count("*").alias("n"), F.sum("kwh").alias("kwh"))
    w = Window.partitionBy("meter").orderBy("date")
    mean = lambda k: F.when(F.count("kwh").over(w.rowsBetween(-k, -1)) == k, F.avg("kwh").over(w.rowsBetween(-k, -1)))
    season, week = 2 * F.pi() * F.dayofyear("date") / 365.25, 2 * F.pi() * F.weekday("date") / 7.0
    return d.select(
        "meter", "date", "kwh", (F.col("n") == per_day).alias("complete"), F.sin(season).alias("day_sin"), F.cos(season).alias("day_cos"), F.sin(week).alias("dow_sin"), F.cos(week).alias("dow_cos"), (F.weekday("date") >= 5).cast("int").alias("weekend"),
        *(F.lag("kwh", k).over(w).alias(f"lag_{k}") for k in (1, 4, 7, 28)), mean(7).alias("mean_7"), mean(28).alias("mean_28"),
    )


@query("m10_all_features", """WITH d AS (SELECT user_id % 3 AS meter, CAST(ts AS DATE) AS date, count(*) AS n, sum(value) AS kwh FROM events WHERE value >= 0 GROUP BY ALL)
SELECT meter, date, round(kwh, 6) AS kwh, n = 96 AS complete, round(sin(2 * pi() * dayofyear(date) / 365.25e0), 9) AS day_sin, round(cos(2 * pi() * (isodow(date) - 1) / 7e0), 9) AS dow_cos, CASE WHEN isodow(date) >= 6 THEN 1 ELSE 0 END AS weekend, round(lag(kwh, 1) OVER w, 6) AS lag_1, round(lag(kwh, 4) OVER w, 6) AS lag_4, round(lag(kwh, 7) OVER w, 6) AS lag_7, round(lag(kwh, 28) OVER w, 6) AS lag_28,
CASE WHEN count(kwh) OVER a = 7 THEN round(avg(kwh) OVER a, 7) END AS mean_7, CASE WHEN count(kwh) OVER b = 28 THEN round(avg(kwh) OVER b, 7) END AS mean_28 FROM d WINDOW w AS (PARTITION BY meter ORDER BY date), a AS (PARTITION BY meter ORDER BY date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING), b AS (PARTITION BY meter ORDER BY date ROWS BETWEEN 28 PRECEDING AND 1 PRECEDING)""", "")
def m_all_days(p: Plant) -> DataFrame:
    rows = day_features(p.table("events").filter("value >= 0").select((F.col("user_id") % 3).alias("meter"), F.col("ts").alias("at"), F.col("value").alias("kwh")))
    digits = {"kwh": 6, "day_sin": 9, "dow_cos": 9, "lag_1": 6, "lag_4": 6, "lag_7": 6, "lag_28": 6, "mean_7": 7, "mean_28": 7}
    return rows.select("meter", "date", "complete", "weekend", *(F.round(c, n).alias(c) for c, n in digits.items()))


@query("m10_refused_intervals", """WITH h AS (SELECT user_id % 3 AS meter, date_trunc('hour', ts) AS hr, event_id FROM events WHERE value >= 0), g AS (SELECT *, (epoch_ms(hr) - epoch_ms(lag(hr) OVER (PARTITION BY meter ORDER BY hr))) // 1000 AS gap FROM h),
f AS (SELECT meter, CAST(hr AS DATE) AS date, CASE WHEN gap = 0 THEN 'repeated_stamp' WHEN gap <> 3600 THEN 'other_step' END AS fault FROM g UNION ALL SELECT meter, CAST(hr AS DATE), 'incomplete_day' FROM h GROUP BY 1, 2 HAVING count(*) <> 24) SELECT meter, date, fault, count(*) AS n FROM f WHERE fault IS NOT NULL GROUP BY ALL""", "")
def m_refused(p: Plant) -> DataFrame:
    rows = p.table("events").filter("value >= 0").select((F.col("user_id") % 3).alias("meter"), F.date_trunc("hour", "ts").alias("at"))
    return interval_faults(rows, 3600, 24).groupBy("meter", "date", "fault").agg(F.count("*").alias("n"))


@query("m10_day_features", """WITH d AS (SELECT user_id % 10 AS meter, CAST(ts AS DATE) AS date, count(*) AS n, sum(value) AS kwh FROM events WHERE value >= 0 GROUP BY ALL) SELECT meter, date, round(lag(kwh, 1) OVER w, 6) AS lag_1, round(lag(kwh, 7) OVER w, 6) AS lag_7, CASE WHEN count(kwh) OVER a = 7 THEN round(avg(kwh) OVER a, 8) END AS mean_7, n >= 20 AS complete FROM d
WINDOW w AS (PARTITION BY meter ORDER BY date), a AS (PARTITION BY meter ORDER BY date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)""", "")
def m_days(p: Plant) -> DataFrame:
    """Short intervals as days (with a completeness check) and their lags."""
    d = p.table("events").filter("value >= 0").groupBy((F.col("user_id") % 10).alias("meter"), F.to_date("ts").alias("date")).agg(F.count("*").alias("n"), F.sum("value").alias("kwh"))
    w = Window.partitionBy("meter").orderBy("date")
    a = w.rowsBetween(-7, -1)
    return d.select("meter", "date", F.round(F.lag("kwh", 1).over(w), 6).alias("lag_1"), F.round(F.lag("kwh", 7).over(w), 6).alias("lag_7"), F.when(F.count("kwh").over(a) == 7, F.round(F.avg("kwh").over(a), 8)).alias("mean_7"), (F.col("n") >= 20).alias("complete"))


def sequences(rows: DataFrame, columns: tuple[str, ...], length: int = 28) -> DataFrame:
    """For each target the features of the last `length` rows, as nested arrays; shorter histories are left out."""
    w = Window.partitionBy("workshop").orderBy("date").rowsBetween(-(length - 1), 0)
    return rows.withColumn("sequence", F.collect_list(F.array(*columns)).over(w)).filter(F.size("sequence") == length)


@query("m11_sequences", _DAILY + "SELECT date, workshop, n, round(total, 6) AS total FROM (SELECT date, workshop, count(*) OVER w AS n, sum(tce) OVER w AS total FROM s WINDOW w AS (PARTITION BY workshop ORDER BY date ROWS BETWEEN 27 PRECEDING AND CURRENT ROW)) WHERE n = 28")
def m_sequences(p: Plant) -> DataFrame:
    s = sequences(daily_series(p), ("tce", "qty"))
    total = F.aggregate("sequence", F.lit(0.0), lambda a, x: a + x[0])
    return s.select("date", "workshop", F.size("sequence").cast("long").alias("n"), F.round(total, 6).alias("total"))


def ridge_rows(hours: DataFrame) -> DataFrame:
    """M12's inputs: the load a week before, the clock as an angle, and the hour's distance from the series' end."""
    w = Window.partitionBy("series").orderBy("hour")
    angle = 2 * F.pi() * (F.col("hour") % 24) / 24.0
    rows = hours.withColumns({"lag_168": F.lag("load", 168).over(w), "s": F.sin(angle), "c": F.cos(angle), "ahead": F.max("hour").over(Window.partitionBy("series")) - F.col("hour")}).filter("lag_168 IS NOT NULL")
    return VectorAssembler(inputCols=["lag_168", "s", "c"], outputCol="_x").transform(rows)


def ridge(rows: DataFrame, alpha: float) -> LinearRegressionModel:
    """Least squares with the penalty alpha times the squared weights; the intercept is free. Spark's loss is a mean over rows of labels in units of their own spread, so the penalty is put in these."""
    size = rows.agg(F.count("*").alias("n"), F.stddev_pop("load").alias("spread")).first()
    return LinearRegression(featuresCol="_x", labelCol="load", regParam=alpha * (size.spread or 0.0) / max(1, size.n), elasticNetParam=0.0, standardization=False, solver="normal").fit(rows)


def ridge_forecast(hours: DataFrame, horizon: int = 72, alpha: float = 1.0, validation: int = 336) -> DataFrame:
    """The last `horizon` hours of each series, by a model fitted on all hours before (the refit), beside the weekly naive."""
    ready = written(ridge_rows(hours), "hours")
    return ridge(ready.filter(F.col("ahead") >= horizon), alpha).transform(ready.filter(F.col("ahead") < horizon)).drop("_x", "s", "c", "ahead")


def ridge_backtest(hours: DataFrame, horizon: int = 72, alpha: float = 1.0, validation: int = 336) -> DataFrame:
    """Per series the mean absolute errors of the model and of the weekly naive over the `validation` hours before the horizon, fitted on what lies before."""
    ready = written(ridge_rows(hours), "hours")
    tested = ridge(ready.filter(F.col("ahead") >= horizon + validation), alpha).transform(ready.filter(F.col("ahead").between(horizon, horizon + validation - 1)))
    error = lambda c: F.avg(F.abs(F.col("load") - F.col(c)))
    return tested.groupBy("series").agg(F.count("*").alias("n"), error("prediction").alias("mae"), error("lag_168").alias("naive_mae"))


def every_hour(hours: DataFrame) -> DataFrame:
    """All hours of each series between its first and last: without a reading the load is 0, so lags are hours."""
    spine = hours.groupBy("series").agg(F.min("hour").alias("a"), F.max("hour").alias("b")).select("series", F.explode(F.sequence("a", "b")).alias("hour"))
    return spine.join(hours, ["series", "hour"], "left").fillna(0.0, ["load"])


def hourly_load(p: Plant) -> DataFrame:
    hours = p.table("events").filter("value >= 0").select((F.col("user_id") % 3).alias("series"), F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 3600).alias("hour"), "value").groupBy("series", "hour").agg(F.sum("value").alias("load"))
    return every_hour(hours)


def _ridge_sql(horizon: int) -> str:
    """Ridge by the normal equations of centred sums, alpha 1: fitted on hours at least `horizon` before each series' end, with predictions for all."""
    return f"""WITH e AS (SELECT user_id % 3 AS series, epoch_ms(ts) // 3600000 AS hour, sum(value) AS load FROM events WHERE value >= 0 GROUP BY ALL), h AS (SELECT series, unnest(range(min(hour), max(hour) + 1)) AS hour FROM e GROUP BY series),
x AS (SELECT series, hour, coalesce(load, 0) AS load, lag(coalesce(load, 0), 168) OVER w AS lag_168, sin(2 * pi() * (hour % 24) / 24e0) AS s, cos(2 * pi() * (hour % 24) / 24e0) AS c, max(hour) OVER (PARTITION BY series) - hour AS ahead FROM h LEFT JOIN e USING (series, hour) WINDOW w AS (PARTITION BY series ORDER BY hour)),
r AS (SELECT * FROM x WHERE lag_168 IS NOT NULL), m AS (SELECT count(*) AS n, avg(lag_168) AS ml, avg(s) AS ms, avg(c) AS mc, avg(load) AS my, n * var_pop(lag_168) + 1 AS ll, n * var_pop(s) + 1 AS ss, n * var_pop(c) + 1 AS cc, n * covar_pop(lag_168, s) AS ls, n * covar_pop(lag_168, c) AS lc, n * covar_pop(s, c) AS sc,
n * covar_pop(lag_168, load) AS ly, n * covar_pop(s, load) AS sy, n * covar_pop(c, load) AS cy FROM r WHERE ahead >= {horizon}), d AS (SELECT *, ll * (ss * cc - sc * sc) - ls * (ls * cc - sc * lc) + lc * (ls * sc - ss * lc) AS det FROM m),
k AS (SELECT *, (ly * (ss * cc - sc * sc) - ls * (sy * cc - sc * cy) + lc * (sy * sc - ss * cy)) / det AS w1, (ll * (sy * cc - cy * sc) - ly * (ls * cc - sc * lc) + lc * (ls * cy - sy * lc)) / det AS w2, (ll * (ss * cy - sc * sy) - ls * (ls * cy - lc * sy) + ly * (ls * sc - ss * lc)) / det AS w3 FROM d),
f AS (SELECT r.*, my + w1 * (lag_168 - ml) + w2 * (s - ms) + w3 * (c - mc) AS prediction FROM r, k)
"""


@query("m12_ridge_forecast", _ridge_sql(72) + "SELECT series, hour, load, lag_168, round(prediction, 6) AS prediction FROM f WHERE ahead < 72", "")
def m_ridge(p: Plant) -> DataFrame:
    return ridge_forecast(hourly_load(p)).withColumn("prediction", F.round("prediction", 6))


@query("m12_ridge_backtest", _ridge_sql(408) + "SELECT series, count(*) AS n, round(avg(abs(load - prediction)), 6) AS mae, round(avg(abs(load - lag_168)), 6) AS naive_mae FROM f WHERE ahead BETWEEN 72 AND 407 GROUP BY 1", "")
def m_ridge_test(p: Plant) -> DataFrame:
    return ridge_backtest(hourly_load(p)).withColumns({c: F.round(c, 6) for c in ("mae", "naive_mae")})


#: Null series of M13 at least, and the workshops they were meant for: each has its share of them or more.
NULL_SERIES, NULL_KEYS = 5_000, 8


def cusum_calibration(residuals: DataFrame, replicates: int, slack: float = 0.5, limit: float = 5.0, seed: int = 7) -> DataFrame:
    """The 99th percentile of the largest CUSUM of series without a shift, and the share of false alarms at `limit`.

    Null series are the standardised residuals `z` (with a `position`) of each `key` in an order by MD5, `replicates` times.
    """
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("key").cast("string"), F.col("replicate").cast("string"), F.col("position").cast("string")).cast("binary"))
    rows = residuals.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates)))).withColumn("_o", order)
    w = Window.partitionBy("key", "replicate").orderBy("_o").rowsBetween(Window.unboundedPreceding, 0)
    c = rows.withColumns({"hi": F.sum(F.col("z") - slack).over(w), "lo": F.sum(-F.col("z") - slack).over(w)})
    s = c.withColumn("s", F.greatest(F.col("hi") - F.least(F.lit(0.0), F.min("hi").over(w)), F.col("lo") - F.least(F.lit(0.0), F.min("lo").over(w))))
    top = s.groupBy("key", "replicate").agg(F.max("s").alias("s"))
    return top.agg(F.percentile("s", F.lit(0.99)).alias("limit_99"), F.avg((F.col("s") > limit).cast("double")).alias("false_alarms"))


@query("m13_cusum_calibration", """z AS (SELECT workshop_code AS key, record_date, z_w AS z FROM base WHERE z_w IS NOT NULL), k AS (SELECT greatest(625, CAST(ceil(5000 / count(DISTINCT key)) AS BIGINT)) AS r FROM z),
o AS (SELECT key, g.r, z, md5('7:' || key || ':' || g.r || ':' || record_date) AS o FROM z, k, unnest(range(1, k.r + 1)) g(r)), c AS (SELECT key, r, o, sum(z - 0.5e0) OVER w AS hi, sum(-z - 0.5e0) OVER w AS lo FROM o WINDOW w AS (PARTITION BY key, r ORDER BY o ROWS UNBOUNDED PRECEDING)),
t AS (SELECT key, r, max(s) AS s FROM (SELECT key, r, greatest(hi - least(0, min(hi) OVER w), lo - least(0, min(lo) OVER w)) AS s FROM c WINDOW w AS (PARTITION BY key, r ORDER BY o ROWS UNBOUNDED PRECEDING)) GROUP BY ALL) SELECT round(quantile_cont(s, 0.99), 6) AS limit_99, round(avg(CASE WHEN s > 5 THEN 1e0 ELSE 0e0 END), 4) AS false_alarms FROM t""")
def m_calibration(p: Plant) -> DataFrame:
    rows = written(p.baseline.filter("z_w IS NOT NULL").select(F.col("workshop_code").alias("key"), F.col("record_date").alias("position"), F.col("z_w").alias("z")), "residuals")
    keys = max(1, rows.select("key").distinct().count())
    return cusum_calibration(rows, max(NULL_SERIES // NULL_KEYS, -(-NULL_SERIES // keys))).select(F.round("limit_99", 6).alias("limit_99"), F.round("false_alarms", 4).alias("false_alarms"))


def retrieved(questions: DataFrame, evidence: DataFrame, top: int = 8, aliases: DataFrame | None = None) -> DataFrame:
    """Evidence by weighted keyword hits: 4 for a keyword, 1 for a word of the text, 6 if the file is named; ties by id.

    Equal questions are searched once. Of the evidence only tokens that are asked for count, and evidence with the same tokens and weights has the same score for every question, so each such
    signature goes on with its first `top` ids only: a common word costs different questions times signatures. `aliases` (code, alias) add to a question that has the code the alias as a further word.
    """
    words = lambda c: F.array_distinct(F.split(F.lower(c), r"[^\p{L}\p{N}_]+"))
    asked = questions.select("question_id", F.lower("question").alias("asked"))
    ask = asked.select("asked").distinct().select("asked", F.explode(words("asked")).alias("token")).filter("token <> ''")
    if aliases is not None:
        named = aliases.select(F.lower("code").alias("token"), F.lower("alias").alias("alias"))
        ask = ask.unionByName(ask.join(named, "token").select("asked", F.col("alias").alias("token"))).distinct()
    ask = written(ask, "asked")
    weighed = lambda tokens, weight: F.transform(tokens, lambda k: F.struct(F.lower(k).alias("token"), F.lit(weight).alias("weight")))
    hay = evidence.select("evidence_id", F.explode(F.concat(weighed(F.col("keywords"), 4), weighed(words("text"), 1), weighed(F.array("file"), 6))).alias("h")).select("evidence_id", "h.*")
    hay = hay.join(ask.select("token").distinct(), "token", "left_semi").groupBy("evidence_id", "token").agg(F.sum("weight").alias("weight"))
    signed = hay.groupBy("evidence_id").agg(F.sort_array(F.collect_list(F.struct("token", "weight"))).alias("sign"))  # tokens of one piece of evidence
    order = Window.partitionBy("sign").orderBy("evidence_id")
    members = written(signed.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= top), "members")
    signs = members.filter("_n = 1").select("sign", F.col("evidence_id").alias("sign_id"), F.explode("sign").alias("h")).select("sign_id", "h.*")
    members = members.select(F.first("evidence_id").over(order).alias("sign_id"), "evidence_id")
    scored = ask.join(signs, "token").groupBy("asked", "sign_id").agg(F.sum("weight").alias("score")).join(members, "sign_id")
    best = Window.partitionBy("asked").orderBy(F.desc("score"), "evidence_id")
    found = written(scored.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top).select("asked", "evidence_id", "score", "rank"), "found")
    return asked.join(found, "asked").select("question_id", "evidence_id", "score", "rank")


def grounded(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """Claims whose citation (type, path, key, value) exists and whose statement stands in the cited text."""
    e = evidence.select("type", "path", "key", "value", F.col("text").alias("_text"))
    ok = claims.join(e, ["type", "path", "key", "value"]).filter(F.contains("_text", "statement"))
    return claims.join(ok.select("claim_id").distinct().withColumn("grounded", F.lit(True)), "claim_id", "left").fillna(False, ["grounded"])


_RETRIEVE_ALL = """WITH q AS (SELECT p_partkey AS question_id, lower(p_name) AS question FROM part), e AS (SELECT p_partkey AS evidence_id, lower(p_brand) AS kw, lower(p_name) AS text, lower(p_type) AS file FROM part),
a AS (SELECT DISTINCT question_id, unnest(regexp_split_to_array(question, '[^\\p{L}\\p{N}_]+')) AS token FROM q), h AS (SELECT evidence_id, kw AS token, 4 AS weight FROM e UNION ALL SELECT DISTINCT evidence_id, unnest(regexp_split_to_array(text, '[^\\p{L}\\p{N}_]+')), 1 FROM e UNION ALL SELECT evidence_id, file, 6 FROM e)
SELECT question_id, evidence_id, sum(weight)::BIGINT AS score FROM a JOIN h USING (token) WHERE token <> '' GROUP BY question_id, evidence_id QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY sum(weight) DESC, evidence_id) <= 8"""


@query("m14_retrieval_all", _RETRIEVE_ALL, "")
def m_retrieval_all(p: Plant) -> DataFrame:
    """Every row of `part` as a question over every row as evidence."""
    part = p.table("part")
    e = part.select(F.col("p_partkey").alias("evidence_id"), F.array("p_brand").alias("keywords"), F.col("p_name").alias("text"), F.col("p_type").alias("file"))
    return retrieved(part.select(F.col("p_partkey").alias("question_id"), F.col("p_name").alias("question")), e).select("question_id", "evidence_id", "score")


@query("m14_alias_retrieval", """WITH al AS (SELECT 'w0' || s_suppkey % 8 + 1 AS code, lower(n_name) AS alias FROM supplier JOIN nation ON n_nationkey = s_suppkey % 8 GROUP BY ALL), q AS (SELECT o_orderkey AS question_id, 'w0' || (o_custkey % 8 + 1) AS code, lower(o_orderpriority) AS prio FROM orders WHERE o_orderkey % 20 = 0),
a AS (SELECT question_id, unnest(regexp_split_to_array('energy of ' || code || ' ' || prio, '[^\\p{L}\\p{N}_]+')) AS token FROM q UNION SELECT question_id, alias FROM q JOIN al USING (code)), e AS (SELECT s_suppkey AS evidence_id, lower(n_name) AS kw, lower(s_name) AS file FROM supplier JOIN nation ON n_nationkey = s_nationkey),
h AS (SELECT evidence_id, kw AS token, 4 AS weight FROM e UNION ALL SELECT DISTINCT evidence_id, unnest(regexp_split_to_array(kw || ' energy', '[^\\p{L}\\p{N}_]+')), 1 FROM e UNION ALL SELECT evidence_id, file, 6 FROM e)
SELECT question_id, evidence_id, sum(weight)::BIGINT AS score FROM (SELECT DISTINCT * FROM a WHERE token <> '') a JOIN h USING (token) GROUP BY question_id, evidence_id QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY sum(weight) DESC, evidence_id) <= 8""", "")
def m_aliases(p: Plant) -> DataFrame:
    """Questions name a code; evidence knows only the name behind it."""
    nation = p.table("nation").select("n_nationkey", "n_name")
    code = lambda k: F.concat(F.lit("W0"), (F.col(k) % 8 + 1).cast("string"))
    aliases = p.table("supplier").join(nation, F.col("n_nationkey") == F.col("s_suppkey") % 8).select(code("s_suppkey").alias("code"), F.col("n_name").alias("alias")).distinct()
    questions = p.table("orders").filter("o_orderkey % 20 = 0").select(F.col("o_orderkey").alias("question_id"), F.concat_ws(" ", F.lit("energy of"), code("o_custkey"), "o_orderpriority").alias("question"))
    evidence = p.table("supplier").join(nation, F.col("n_nationkey") == F.col("s_nationkey")).select(F.col("s_suppkey").alias("evidence_id"), F.array("n_name").alias("keywords"), F.concat_ws(" ", "n_name", F.lit("energy")).alias("text"), F.col("s_name").alias("file"))
    return retrieved(questions, evidence, aliases=aliases).select("question_id", "evidence_id", "score")


def evaluated(cases: DataFrame, claims: DataFrame) -> DataFrame:
    """Per case (case_id, expect_insufficient, expected_source, expected_parts) whether its claims (case_id, statement, source_path) pass.

    No claim is a refusal, and has to be one if expected; else there is a claim, one cites the expected source, and one has all expected parts.
    """
    cited = F.max(F.coalesce(F.contains("source_path", "expected_source"), F.col("expected_source").isNull()).cast("int"))
    stated = F.max(F.forall("expected_parts", lambda x: F.contains("statement", x)).cast("int"))
    rows = cases.join(claims, "case_id", "left").groupBy("case_id").agg(F.any_value("expect_insufficient").alias("_e"), F.count("statement").alias("n_claims"), cited.alias("_c"), stated.alias("_s"))
    answered = (F.col("n_claims") > 0) & (F.coalesce("_c", F.lit(0)) == 1) & (F.coalesce("_s", F.lit(0)) == 1)
    return rows.select("case_id", "n_claims", F.when(F.col("_e"), F.col("n_claims") == 0).otherwise(answered).alias("passed"))


def pass_rate(results: DataFrame) -> DataFrame:
    """Cases, passed ones and their share; no cases give 0."""
    passed = F.count(F.when(F.col("passed"), 1))
    return results.agg(F.count("*").alias("total"), passed.alias("passed"), F.round(F.coalesce(F.try_divide(passed.cast("double"), F.count("*")), F.lit(0.0)), 4).alias("pass_rate"))


_CASES = """WITH k AS (SELECT p_partkey AS case_id, p_partkey % 5 = 0 AS expect_insufficient, p_partkey % 7 <> 0 AS claimed, p_partkey % 11 <> 0 AS right_source, p_partkey % 3 <> 0 AS right_parts FROM part),
r AS (SELECT case_id, CASE WHEN claimed THEN 2 ELSE 0 END::BIGINT AS n_claims, CASE WHEN expect_insufficient THEN NOT claimed ELSE claimed AND right_source AND right_parts END AS passed FROM k) """


def judged(p: Plant) -> DataFrame:
    """Parts as cases: some have no claims, some cite another source, some miss a part of the statement; each has a claim beside that passes in neither."""
    part, n = p.table("part"), F.col("p_partkey")
    cases = part.select(n.alias("case_id"), (n % 5 == 0).alias("expect_insufficient"), F.col("p_brand").alias("expected_source"), F.split("p_type", " ").alias("expected_parts"))
    claim = part.filter(n % 7 != 0).select(n.alias("case_id"), F.when(n % 3 == 0, F.lit("something")).otherwise(F.concat(F.lit("of "), "p_type")).alias("statement"), F.when(n % 11 == 0, F.lit("elsewhere")).otherwise(F.concat(F.lit("rows/"), "p_brand")).alias("source_path"))
    return evaluated(cases, claim.unionByName(claim.withColumns({"statement": F.lit(""), "source_path": F.lit("")})))


@query("m15b_evaluated_cases", _CASES + "SELECT * FROM r", "")
def m_cases(p: Plant) -> DataFrame:
    return judged(p)


@query("m15b_pass_rate", _CASES + "SELECT count(*) AS total, count(CASE WHEN passed THEN 1 END) AS passed, round(avg(CASE WHEN passed THEN 1e0 ELSE 0e0 END), 4) AS pass_rate FROM r", "")
def m_rate(p: Plant) -> DataFrame:
    return pass_rate(judged(p))


@query("m15_grounding", "SELECT p_partkey AS claim_id, p_partkey % 3 = 0 AS grounded FROM part", "")
def m_grounding(p: Plant) -> DataFrame:
    part = p.table("part")
    cite = [F.lit("row").alias("type"), F.lit("part").alias("path"), F.col("p_partkey").cast("string").alias("key")]
    evidence = part.select(*cite, F.col("p_brand").alias("value"), F.concat_ws(" ", "p_name", "p_type").alias("text"))
    claims = part.select(F.col("p_partkey").alias("claim_id"), *cite, F.when(F.col("p_partkey") % 3 == 1, "other").otherwise(F.col("p_brand")).alias("value"), F.when(F.col("p_partkey") % 3 == 2, "not in the text").otherwise(F.col("p_type")).alias("statement"))
    return grounded(claims, evidence).select("claim_id", "grounded")


def load_shifted(hours: DataFrame) -> DataFrame:
    """Cheapest placement of each site-day's units: hours by price, each filled up to min(capacity, (limit - base) / kWh per unit).

    With a linear cost and one sum to keep, filling the cheapest hours first is optimal.
    """
    top = F.greatest(F.lit(0.0), F.least("capacity", F.try_divide(F.col("limit_kw") - F.col("base_kw"), F.col("kwh_per_unit"))))
    w = Window.partitionBy("site", "day")
    order = w.orderBy("price", "hour").rowsBetween(Window.unboundedPreceding, -1)
    rows = hours.withColumns({"_top": top, "_total": F.sum("units").over(w)}).withColumn("_before", F.coalesce(F.sum("_top").over(order), F.lit(0.0)))
    rows = rows.withColumn("planned", F.least(F.col("_top"), F.greatest(F.lit(0.0), F.col("_total") - F.col("_before"))))
    money = lambda u: F.sum(F.col("price") * F.col(u) * F.col("kwh_per_unit"))
    return rows.groupBy("site", "day").agg(F.round(money("units"), 4).alias("cost_before"), F.round(money("planned"), 4).alias("cost_after"), F.round(F.sum("units") - F.sum("planned"), 6).alias("unplaced"))


@query("m16_load_shifting", """WITH h AS (SELECT user_id % 6 AS site, CAST(ts AS DATE) AS day, hour(ts) AS hour, sum(value) AS units FROM events WHERE value >= 0 GROUP BY ALL), x AS (SELECT *, CASE WHEN hour < 8 THEN 0.3e0 WHEN hour < 17 THEN 0.7e0 ELSE 1.1e0 END AS price, least(60e0, (200e0 - 20) / 2) AS top, sum(units) OVER (PARTITION BY site, day) AS total FROM h),
y AS (SELECT *, coalesce(sum(top) OVER (PARTITION BY site, day ORDER BY price, hour ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bef FROM x) SELECT site, day, round(sum(price * units * 2), 4) AS cost_before, round(sum(price * 2 * least(top, greatest(0, total - bef))), 4) AS cost_after, round(sum(units) - sum(least(top, greatest(0, total - bef))), 6) + 0e0 AS unplaced FROM y GROUP BY ALL""", "")
def m_shift(p: Plant) -> DataFrame:
    hours = p.table("events").filter("value >= 0").groupBy((F.col("user_id") % 6).alias("site"), F.to_date("ts").alias("day"), F.hour("ts").alias("hour")).agg(F.sum("value").alias("units"))
    price = F.when(F.col("hour") < 8, 0.3).when(F.col("hour") < 17, 0.7).otherwise(1.1)
    full = hours.withColumns({"price": price, "capacity": F.lit(60.0), "limit_kw": F.lit(200.0), "base_kw": F.lit(20.0), "kwh_per_unit": F.lit(2.0)})
    return load_shifted(full).withColumn("unplaced", F.col("unplaced") + 0.0)
