"""Report-level derivations and the semantic layer over the views."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattmill.operators.analyses import _CUBE, _SIGMA, day_type, month_surges, two_sigma, workshop_day_cube
from wattmill.operators.views import Plant, ratio, thousandth
from wattmill.plans.catalog import QUERIES, query
from wattmill.sources.adapter import UTILITY
from wattmill.staging import written

#: Scenario: year, workshop left out, rates in percent.
SCENARIO_YEAR, SCENARIO_WITHOUT, RATES = 2025, "W07", (3.0, 5.0, 10.0)


def yearly(p: Plant) -> DataFrame:
    """Output, energy and mean monthly unit energy of product workshops by year."""
    m = p.months.filter(F.col("process_type") != UTILITY)
    of = lambda c, y: F.when(F.left("year_month", F.lit(4)) == y, F.col(c))
    return m.groupBy("workshop_code", "workshop_name").agg(
        *(F.sum(of("output_qty", y)).cast("double").alias(f"qty_{y}") for y in ("2024", "2025")), *(F.avg(of("unit_energy_kgce", y)).alias(f"ue_{y}") for y in ("2024", "2025")), F.sum(of("tce", "2025")).cast("double").alias("tce_2025")
    )


_YEARLY = """y AS (SELECT workshop_code, workshop_name, sum(CASE WHEN left(year_month, 4) = '2024' THEN output_qty END)::DOUBLE AS q4, sum(CASE WHEN left(year_month, 4) = '2025' THEN output_qty END)::DOUBLE AS q5, avg(CASE WHEN left(year_month, 4) = '2024' THEN unit_energy_kgce END) AS u4, avg(CASE WHEN left(year_month, 4) = '2025' THEN unit_energy_kgce END) AS u5,
sum(CASE WHEN left(year_month, 4) = '2025' THEN tce END)::DOUBLE AS e5 FROM months WHERE process_type <> '公用工程' GROUP BY ALL)
"""


@query("r01_r02_growth_and_saving", _YEARLY + "SELECT workshop_name, round(100 * (q5 - q4) / q4, 2) AS growth_pct, round(100 * (u5 - u4) / u4, 2) AS intensity_pct, round(q5 * (u4 - u5) / 1000, 3) AS saved_tce, round(100 * q5 * (u4 - u5) / 1000 / e5, 2) AS saved_pct FROM y")
def r_growth(p: Plant) -> DataFrame:
    saved = F.col("qty_2025") * (F.col("ue_2024") - F.col("ue_2025")) / 1000
    pct = lambda a, b: F.round(100 * F.try_divide(a, b), 2)
    return yearly(p).select("workshop_name", pct(F.col("qty_2025") - F.col("qty_2024"), F.col("qty_2024")).alias("growth_pct"), pct(F.col("ue_2025") - F.col("ue_2024"), F.col("ue_2024")).alias("intensity_pct"), F.round(saved, 3).alias("saved_tce"), pct(saved, F.col("tce_2025")).alias("saved_pct"))


@query("r02_saving_totals", _YEARLY + """, s AS (SELECT q5 * (u4 - u5) / 1000 AS saved FROM y WHERE q5 > 0), n AS (SELECT saved, row_number() OVER (ORDER BY saved DESC) AS n FROM s), t AS (SELECT sum(tce)::DOUBLE AS e FROM days WHERE year(record_date) = 2025)
SELECT round(sum(saved), 3) AS saved_tce, round(100 * sum(saved) / max(e), 3) AS pct_of_year, round(100 * sum(saved) FILTER (n <= 2) / sum(saved), 2) AS top2_pct FROM n, t""")
def r_totals_saved(p: Plant) -> DataFrame:
    """R2: all workshops' saving against the year before, its share of the plant's energy in 2025, and that of the two largest savers."""
    saved = yearly(p).filter("qty_2025 > 0").select("workshop_code", (F.col("qty_2025") * (F.col("ue_2024") - F.col("ue_2025")) / 1000).alias("saved"))
    ranked = saved.withColumn("n", F.row_number().over(Window.orderBy(F.desc("saved"), "workshop_code")))  # one row a workshop
    energy = p.days.filter(F.year("record_date") == 2025).agg(F.sum("tce").cast("double").alias("e"))
    total = F.sum("saved")
    return ranked.join(energy).agg(F.round(total, 3).alias("saved_tce"), F.round(100 * F.try_divide(total, F.max("e")), 3).alias("pct_of_year"), F.round(100 * F.try_divide(F.sum(F.when(F.col("n") <= 2, F.col("saved"))), total), 2).alias("top2_pct"))  # `energy` has one row


@query("r03_converted_saving", _YEARLY + """, t AS (SELECT sum(std_coal_kgce)::DOUBLE / 1000 AS e, sum(co2_kg)::DOUBLE / 1000 AS k, sum(cost)::DOUBLE AS c FROM v) SELECT round(sum(q5 * (u4 - u5) / 1000), 3) AS saved_tce, round(sum(q5 * (u4 - u5) / 1000) * max(k / e), 3) AS saved_co2_t, round(sum(q5 * (u4 - u5) / 1000) * max(c / e), 1) AS saved_cost FROM y, t""")
def r_converted(p: Plant) -> DataFrame:
    """A difference in tce as carbon and money at the full period's ratios; null if nothing was used."""
    totals = p.enriched.agg(*((F.sum(c).cast("double") / k).alias(n) for c, k, n in (("std_coal_kgce", 1000, "e"), ("co2_kg", 1000, "k"), ("cost", 1, "c"))))
    saved = yearly(p).agg(F.sum(F.col("qty_2025") * (F.col("ue_2024") - F.col("ue_2025")) / 1000).alias("d"))
    d = F.col("d")
    return saved.join(totals).select(F.round(d, 3).alias("saved_tce"), F.round(d * F.try_divide("k", "e"), 3).alias("saved_co2_t"), F.round(d * F.try_divide("c", "e"), 1).alias("saved_cost"))  # one row each


def dispersion(mean: Column, sigma: Column) -> list[Column]:
    """The band of two sigmas, not below 0, and the coefficient of variation."""
    return [F.greatest(F.lit(0.0), mean - 2 * sigma).alias("low"), (mean + 2 * sigma).alias("high"), (100 * F.try_divide(sigma, mean)).alias("cv_pct")]


@query("r04_r05_bands", """SELECT workshop_code, round(greatest(0, avg(ue) - 2 * stddev_samp(ue)), 4) AS low, round(avg(ue) + 2 * stddev_samp(ue), 4) AS high, round(100 * stddev_samp(ue) / avg(ue), 2) AS cv_pct, round(-2 * stddev_samp(r), 3) AS residual_low, round(2 * stddev_samp(r), 3) AS residual_high FROM base GROUP BY 1""")
def r_bands(p: Plant) -> DataFrame:
    g = p.baseline.groupBy("workshop_code").agg(F.avg("ue").alias("mu"), F.stddev_samp("ue").alias("sd"), F.avg("r").alias("mr"), F.stddev_samp("r").alias("sr"))
    g = g.select("workshop_code", *dispersion(F.col("mu"), F.col("sd")), (F.col("mr") - 2 * F.col("sr")).alias("residual_low"), (F.col("mr") + 2 * F.col("sr")).alias("residual_high"))
    return g.select("workshop_code", F.round("low", 4).alias("low"), F.round("high", 4).alias("high"), F.round("cv_pct", 2).alias("cv_pct"), F.round("residual_low", 3).alias("residual_low"), F.round("residual_high", 3).alias("residual_high"))


@query("r06_cusum_summary", """s AS (SELECT *, CASE WHEN is_alarm = 1 AND coalesce(lag(is_alarm) OVER (PARTITION BY workshop_code ORDER BY record_date), 0) = 0 THEN 1 ELSE 0 END AS seg FROM cus)
SELECT workshop_code, sum(is_alarm)::BIGINT AS alarm_days, count(CASE WHEN alarm_side = '偏高' THEN 1 END) AS high_days, count(CASE WHEN alarm_side = '偏低' THEN 1 END) AS low_days, sum(seg)::BIGINT AS segments, round(max(greatest(s_hi, s_lo)), 3) AS max_s, CASE WHEN max(s_hi) >= max(s_lo) THEN 'high' ELSE 'low' END AS side FROM s GROUP BY 1""")
def r_cusum(p: Plant) -> DataFrame:
    before = F.coalesce(F.lag("is_alarm").over(Window.partitionBy("workshop_code").orderBy("record_date")), F.lit(0))
    n = lambda c: F.count(F.when(c, 1))
    return p.cusum.withColumn("seg", (F.col("is_alarm") == 1) & (before == 0)).groupBy("workshop_code").agg(
        F.sum("is_alarm").alias("alarm_days"), n(F.col("alarm_side") == "偏高").alias("high_days"), n(F.col("alarm_side") == "偏低").alias("low_days"), n(F.col("seg")).alias("segments"), F.round(F.max(F.greatest("s_hi", "s_lo")), 3).alias("max_s"),
        F.when(F.max("s_hi") >= F.max("s_lo"), "high").otherwise("low").alias("side"),
    )


def scenario(rows: DataFrame, rates=RATES) -> DataFrame:
    """A rate of each record's energy, cost and carbon, then summed."""
    rated = rows.withColumn("rate_pct", F.explode(F.array(*(F.lit(r) for r in rates))))
    part = lambda c, k: F.round(F.sum(F.col(c).cast("double") * F.col("rate_pct") / 100 / k), 3)
    return rated.groupBy("rate_pct").agg(part("std_coal_kgce", 1000).alias("saved_tce"), part("cost", 1).alias("saved_cost"), part("co2_kg", 1000).alias("saved_co2_t"))


@query("r07_scenario", """SELECT rate_pct::DOUBLE AS rate_pct, round(sum(std_coal_kgce::DOUBLE * rate_pct / 100 / 1000), 3) AS saved_tce, round(sum(cost::DOUBLE * rate_pct / 100), 3) AS saved_cost, round(sum(co2_kg::DOUBLE * rate_pct / 100 / 1000), 3) AS saved_co2_t FROM v, (VALUES (3), (5), (10)) r(rate_pct) WHERE year = 2025 AND workshop_code <> 'W07' GROUP BY 1""")
def r_scenario(p: Plant) -> DataFrame:
    return scenario(p.enriched.filter((F.col("year") == SCENARIO_YEAR) & (F.col("workshop_code") != SCENARIO_WITHOUT)))


@query("r08_adjacent_months", """m AS (SELECT workshop_code, year_month, sum(tce)::DOUBLE AS e, CAST(left(year_month, 4) AS INTEGER) * 12 + CAST(right(year_month, 2) AS INTEGER) AS n FROM days WHERE NOT (workshop_code = 'W02' AND year_month = '2024-05') GROUP BY ALL)
SELECT workshop_code, year_month, round(e, 4) AS tce, CASE WHEN n - lag(n) OVER w = 1 AND lag(e) OVER w > 0 THEN round(100 * (e - lag(e) OVER w) / lag(e) OVER w, 2) END AS change_pct FROM m WINDOW w AS (PARTITION BY workshop_code ORDER BY n)""")
def r_months(p: Plant) -> DataFrame:
    """Change to the month before only if that month is there."""
    m = p.days.filter("NOT (workshop_code = 'W02' AND year_month = '2024-05')").groupBy("workshop_code", "year_month").agg(F.sum("tce").cast("double").alias("e"))
    m = m.withColumn("n", F.left("year_month", F.lit(4)).cast("int") * 12 + F.right("year_month", F.lit(2)).cast("int"))
    w = Window.partitionBy("workshop_code").orderBy("n")
    before, gap = F.lag("e").over(w), F.col("n") - F.lag("n").over(w)
    return m.select("workshop_code", "year_month", F.round("e", 4).alias("tce"), F.when((gap == 1) & (before > 0), F.round(100 * (F.col("e") - before) / before, 2)).alias("change_pct"))


@query("r09_trailing_calendar_mean", """SELECT workshop_code, record_date, round(avg(output_qty::DOUBLE) OVER (PARTITION BY workshop_code ORDER BY record_date RANGE BETWEEN INTERVAL 6 DAYS PRECEDING AND CURRENT ROW), 6) AS mean_7 FROM production""")
def r_trailing(p: Plant) -> DataFrame:
    """The mean over seven dates; missing days are left out."""
    w = Window.partitionBy("workshop_code").orderBy(F.unix_date("record_date")).rangeBetween(-6, 0)
    return p.production.select("workshop_code", "record_date", F.round(F.avg(F.col("output_qty").cast("double")).over(w), 6).alias("mean_7"))


@query("r10_pareto_threshold", """c AS (SELECT workshop_code, sum(cost)::DOUBLE AS c FROM v GROUP BY 1), r AS (SELECT *, least(100, 100 * sum(c) OVER (ORDER BY c DESC, workshop_code ROWS UNBOUNDED PRECEDING) / sum(c) OVER ()) AS run FROM c) SELECT workshop_code, round(run, 2) AS running_pct, coalesce(run >= 80 AND coalesce(lag(run) OVER (ORDER BY c DESC, workshop_code), 0) < 80, false) AS reaches FROM r""")
def r_pareto(p: Plant) -> DataFrame:
    c = p.enriched.groupBy("workshop_code").agg(F.sum("cost").cast("double").alias("c"))
    w = Window.orderBy(F.desc("c"), "workshop_code")  # one row a workshop
    c = c.withColumn("run", F.least(F.lit(100.0), 100 * F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, 0)) / F.sum("c").over(Window.partitionBy())))
    return c.select("workshop_code", F.round("run", 2).alias("running_pct"), ((F.col("run") >= 80) & (F.coalesce(F.lag("run").over(w), F.lit(0.0)) < 80)).alias("reaches"))


def filtered_cube(rows: DataFrame, first: str, last: str, workshops: tuple[str, ...], day_types: tuple[str, ...]) -> DataFrame:
    """Totals by energy, workshop, month, day type and over all, from one pass with grouping sets.

    Rows of left-out day types keep their place in the day-type grouping, with 0 as their sums.
    """
    kept = rows.filter(F.col("record_date").between(F.to_date(F.lit(first)), F.to_date(F.lit(last))) & F.col("workshop_code").isin(*workshops)).withColumn("day_type", day_type("holiday", "weekend", "workday"))
    inside = F.col("day_type").isin(*day_types)
    marked = kept.withColumn("e", F.when(inside, F.col("std_coal_kgce")).otherwise(F.lit(0).cast("decimal(18,3)"))).withColumn("c", F.when(inside, F.col("cost")).otherwise(F.lit(0).cast("decimal(16,2)")))
    sets = [[], [F.col("energy_code")], [F.col("workshop_code")], [F.col("year_month")], [F.col("day_type")]]
    cols = [F.col(c) for c in ("energy_code", "workshop_code", "year_month", "day_type")]
    return marked.groupingSets(sets, *cols).agg(F.count("*").alias("n"), F.sum("e").cast("double").alias("kgce"), F.sum("c").cast("double").alias("cost"))


@query("r11_filtered_cube", """f AS (SELECT *, CASE WHEN is_holiday = 1 THEN 'holiday' WHEN is_weekend = 1 THEN 'weekend' ELSE 'workday' END AS day_type FROM v WHERE record_date BETWEEN DATE '2024-03-01' AND DATE '2024-05-31' AND workshop_code IN ('W01', 'W04')),
m AS (SELECT *, CASE WHEN day_type <> 'weekend' THEN std_coal_kgce ELSE 0 END AS e, CASE WHEN day_type <> 'weekend' THEN cost ELSE 0 END AS c FROM f) SELECT energy_code, workshop_code, year_month, day_type, count(*) AS n, sum(e)::DOUBLE AS kgce, sum(c)::DOUBLE AS cost FROM m GROUP BY GROUPING SETS ((), (energy_code), (workshop_code), (year_month), (day_type))""")
def r_cube(p: Plant) -> DataFrame:
    return filtered_cube(p.enriched, "2024-03-01", "2024-05-31", ("W01", "W04"), ("workday", "holiday"))


#: Metric id -> (kind, numerator, denominator, per). Ratios of sums are for one workshop that makes products.
#: (kind, column, denominator, divisor, kind of workshop left out); of a result its query.
METRICS = {
    "total_tce": ("sum", "std_coal_kgce", None, 1000, None), "total_cost": ("sum", "cost", None, 1, None), "total_co2": ("sum", "co2_kg", None, 1000, None), "product_tce": ("sum", "std_coal_kgce", None, 1000, UTILITY),
    "unit_energy": ("ratio_of_sums", "std_coal_kgce", "output_qty", 1, None), "workshop_ranking": ("sql_result", "q03_workshop_ranking", None, 1, None),
}


def metric(p: Plant, name: str, first: str | None = None, last: str | None = None, workshop: str | None = None) -> DataFrame:
    """A metric of the catalogue with date and workshop filters: a sum, a ratio of sums of one workshop, or a query's whole result, which takes no filter."""
    if name not in METRICS:
        raise KeyError(name)
    kind, up, down, per, without = METRICS[name]
    if kind == "sql_result":
        if first or last or workshop:
            raise ValueError(f"{name} is a query's result and takes no filter")
        return QUERIES[up](p.spark, p.sf_dir)
    inside = lambda f: f.filter(F.col("record_date").between(F.to_date(F.lit(first or "1900-01-01")), F.to_date(F.lit(last or "2999-12-31"))) & (F.lit(workshop is None) | (F.col("workshop_code") == workshop)))
    rows = inside(p.enriched)
    total = (rows.filter(F.col("process_type") != without) if without else rows).agg(F.sum(up).cast("double").alias("a"))
    if kind == "sum":
        return total.select(F.lit(name).alias("metric"), F.round(F.col("a") / per, 3).alias("value"))
    if workshop is None:
        raise ValueError(f"{name} is a ratio and needs one workshop")
    made = inside(p.production).agg(F.sum(down).cast("double").alias("b"))
    return total.join(made).select(F.lit(name).alias("metric"), F.round(F.try_divide("a", "b"), 4).alias("value"))  # one row each


@query("r12_metric_sums", """SELECT 'total_tce' AS metric, round(sum(std_coal_kgce)::DOUBLE / 1000, 3) AS value FROM v UNION ALL SELECT 'product_tce', round(sum(std_coal_kgce)::DOUBLE / 1000, 3) FROM v WHERE process_type <> '公用工程' AND record_date <= DATE '2024-12-31' UNION ALL SELECT 'total_cost', round(sum(cost)::DOUBLE, 3) FROM v WHERE workshop_code = 'W05' UNION ALL SELECT 'total_co2', round(sum(co2_kg)::DOUBLE / 1000, 3) FROM v WHERE record_date >= DATE '2025-03-01'""")
def r_sums(p: Plant) -> DataFrame:
    asked = (metric(p, "total_tce"), metric(p, "product_tce", last="2024-12-31"), metric(p, "total_cost", workshop="W05"), metric(p, "total_co2", first="2025-03-01"))
    return reduce(lambda a, b: a.unionByName(b), asked)


@query("r12_metric_lookup", """SELECT 'unit_energy' AS metric, round((SELECT sum(std_coal_kgce)::DOUBLE FROM v WHERE workshop_code = 'W02' AND record_date >= DATE '2024-06-01') / (SELECT sum(output_qty)::DOUBLE FROM production WHERE workshop_code = 'W02' AND record_date >= DATE '2024-06-01'), 4) AS value""")
def r_metric(p: Plant) -> DataFrame:
    return metric(p, "unit_energy", first="2024-06-01", workshop="W02")


@query("r13_daily_totals", "SELECT count(DISTINCT record_date) AS days, count(DISTINCT workshop_code) AS workshops, sum(tce)::DOUBLE AS tce, sum(cost_yuan)::DOUBLE AS cost, sum(co2_t)::DOUBLE AS co2_t FROM days WHERE workshop_code IN ('W01', 'W03') AND record_date < DATE '2024-07-01'")
def r_totals(p: Plant) -> DataFrame:
    d = p.days.filter(F.col("workshop_code").isin("W01", "W03") & (F.col("record_date") < F.to_date(F.lit("2024-07-01"))))
    return d.agg(F.count_distinct("record_date").alias("days"), F.count_distinct("workshop_code").alias("workshops"), *(F.sum(c).cast("double").alias(n) for c, n in (("tce", "tce"), ("cost_yuan", "cost"), ("co2_t", "co2_t"))))


def anomaly_feed(p: Plant) -> DataFrame:
    """Unit-energy days and month surges in one shape, with content id, severity and direction."""
    days = two_sigma(p.unit_days).filter("ue > mu + 2 * sd").select("record_date", "workshop_code", F.lit("unit_energy").alias("kind"), F.round("z", 2).alias("score"), F.round(100 * (F.col("ue") - F.col("mu")) / F.col("mu"), 2).alias("deviation_pct"))
    months = month_surges(p.enriched).select(F.to_date(F.concat("year_month", F.lit("-01"))).alias("record_date"), "workshop_code", F.lit("month_surge").alias("kind"), F.col("change_pct").alias("score"), F.col("change_pct").alias("deviation_pct"))
    severe = F.when(F.col("kind") == "unit_energy", F.abs("score") >= 3).otherwise(F.col("score") >= 50)
    return days.unionByName(months).select(
        F.substring(F.sha2(F.concat_ws("|", "kind", F.date_format("record_date", "yyyy-MM-dd"), "workshop_code").cast("binary"), 256), 1, 24).alias("incident_id"), "*", F.when(severe, "high").otherwise("medium").alias("severity")
    )


_FEED = _SIGMA + """, feed0 AS (SELECT record_date, workshop_code, 'unit_energy' AS kind, round(z, 2) AS score, round(100 * (ue - mu) / mu, 2) AS deviation_pct FROM sig WHERE ue > mu + 2 * sd UNION ALL SELECT CAST(year_month || '-01' AS DATE), workshop_code, 'month_surge', round(100 * (e::DOUBLE - p::DOUBLE) / p::DOUBLE, 2), round(100 * (e::DOUBLE - p::DOUBLE) / p::DOUBLE, 2)
FROM (SELECT *, lag(e) OVER (PARTITION BY workshop_code ORDER BY year_month) AS p FROM (SELECT year_month, workshop_code, sum(std_coal_kgce) AS e FROM v GROUP BY ALL)) WHERE (e::DOUBLE - p::DOUBLE) / p::DOUBLE > 0.25),
feed AS (SELECT substr(sha256(kind || '|' || strftime(record_date, '%Y-%m-%d') || '|' || workshop_code), 1, 24) AS incident_id, *, CASE WHEN (kind = 'unit_energy' AND abs(score) >= 3) OR (kind = 'month_surge' AND score >= 50) THEN 'high' ELSE 'medium' END AS severity FROM feed0)
"""


@query("r14_r15_anomaly_feed", _FEED + "SELECT * FROM feed")
def r_feed(p: Plant) -> DataFrame:
    return anomaly_feed(p)


@query("r14_feed_page", _FEED + "SELECT incident_id, record_date, score FROM feed ORDER BY record_date DESC, incident_id LIMIT 10 OFFSET 20")
def r_page(p: Plant) -> DataFrame:
    return anomaly_feed(p).select("incident_id", "record_date", "score").orderBy(F.desc("record_date"), "incident_id").offset(20).limit(10)


@query("r16_incident_context", _FEED + "SELECT incident_id, count(*) AS days, round(avg(d.tce::DOUBLE), 8) AS mean_tce FROM feed f JOIN days d ON d.workshop_code = f.workshop_code AND d.record_date BETWEEN f.record_date - 13 AND f.record_date WHERE severity = 'high' GROUP BY 1")
def r_context(p: Plant) -> DataFrame:
    """The 14 days up to each severe incident: an equal workshop and a range of dates."""
    f = anomaly_feed(p).filter("severity = 'high'").select("incident_id", F.col("workshop_code").alias("w"), F.col("record_date").alias("at"))
    d = p.days.select("workshop_code", "record_date", F.col("tce").cast("double").alias("tce"))
    near = f.join(d, (F.col("w") == F.col("workshop_code")) & F.col("record_date").between(F.date_sub("at", 13), F.col("at")))
    return near.groupBy("incident_id").agg(F.count("*").alias("days"), F.round(F.avg("tce"), 8).alias("mean_tce"))


@query("r16_incident_evidence", _FEED + """SELECT incident_id, 'evidence' AS part, record_date AS date, score::DOUBLE AS value FROM feed UNION ALL SELECT incident_id, 'context', d.record_date, d.tce::DOUBLE FROM feed f JOIN days d ON d.workshop_code = f.workshop_code AND CASE WHEN kind = 'unit_energy' THEN d.record_date = f.record_date ELSE d.year_month = strftime(f.record_date, '%Y-%m') END
UNION ALL SELECT incident_id, 'trend', d.record_date, d.tce::DOUBLE FROM feed f JOIN days d ON d.workshop_code = f.workshop_code AND CASE WHEN kind = 'unit_energy' THEN d.record_date BETWEEN f.record_date - 13 AND f.record_date ELSE d.year_month = strftime(f.record_date, '%Y-%m') END""")
def r_evidence(p: Plant) -> DataFrame:
    """Of each incident the row that shows it, the days it is of (a month's incident has the month's) and the trend: the 14 days up to it, or its month."""
    f = anomaly_feed(p).select("incident_id", "kind", "record_date", "workshop_code", "score")
    d = p.days.select(F.col("workshop_code").alias("w"), F.col("record_date").alias("date"), "year_month", F.col("tce").cast("double").alias("value"))
    near = f.join(d, F.col("w") == F.col("workshop_code"))  # days of the incident's workshop
    month = F.col("year_month") == F.date_format("record_date", "yyyy-MM")
    day = F.col("kind") == "unit_energy"
    part = lambda name, when: near.filter(when).select("incident_id", F.lit(name).alias("part"), "date", "value")
    own = f.select("incident_id", F.lit("evidence").alias("part"), F.col("record_date").alias("date"), F.col("score").cast("double").alias("value"))
    context, trend = F.when(day, F.col("date") == F.col("record_date")).otherwise(month), F.when(day, F.col("date").between(F.date_sub("record_date", 13), F.col("record_date"))).otherwise(month)
    return own.unionByName(part("context", context)).unionByName(part("trend", trend))


@query("r17_latest_feedback", "SELECT user_id AS incident, max(event_id) AS id, arg_max(event_type, event_id) AS status FROM events GROUP BY 1", "")
def r_feedback(p: Plant) -> DataFrame:
    """Feedback is append-only: the largest id of an incident holds."""
    return p.table("events").groupBy(F.col("user_id").alias("incident")).agg(F.max("event_id").alias("id"), F.max_by("event_type", "event_id").alias("status"))


@query("r18_month_length", """m AS (SELECT year_month, sum(tce)::DOUBLE AS e, day(last_day(min(record_date))) AS n FROM days GROUP BY 1) SELECT year_month, round(100 * (e - lag(e) OVER w) / lag(e) OVER w, 2) AS raw_pct, round(100 * (e / n - lag(e / n) OVER w) / lag(e / n) OVER w, 2) AS per_day_pct,
round(100 * (e - lag(e) OVER w) / lag(e) OVER w - 100 * (e / n - lag(e / n) OVER w) / lag(e / n) OVER w, 2) AS gap_pp FROM m WINDOW w AS (ORDER BY year_month)""")
def r_length(p: Plant) -> DataFrame:
    m = p.days.groupBy("year_month").agg(F.sum("tce").cast("double").alias("e"), F.dayofmonth(F.last_day(F.min("record_date"))).alias("n"))
    w = Window.orderBy("year_month")  # one row a month
    rise = lambda x: 100 * F.try_divide(x - F.lag(x).over(w), F.lag(x).over(w))
    e, per_day = F.col("e"), F.col("e") / F.col("n")
    return m.select("year_month", F.round(rise(e), 2).alias("raw_pct"), F.round(rise(per_day), 2).alias("per_day_pct"), F.round(rise(e) - rise(per_day), 2).alias("gap_pp"))


@query("r19_headlines", """w AS (SELECT workshop_code, process_type, sum(tce)::DOUBLE AS e FROM days GROUP BY ALL), m AS (SELECT year_month, sum(tce)::DOUBLE AS e FROM days GROUP BY 1)
SELECT round(100 * (SELECT sum(e) FROM w WHERE process_type = '公用工程') / (SELECT sum(e) FROM w), 2) AS utility_pct, round(100 * (SELECT sum(e) FROM (SELECT e FROM w ORDER BY e DESC LIMIT 4)) / (SELECT sum(e) FROM w), 2) AS top4_pct, (SELECT arg_max(year_month, e) FROM m) AS peak_month, (SELECT arg_min(year_month, e) FROM m) AS trough_month""")
def r_headlines(p: Plant) -> DataFrame:
    w = p.days.groupBy("workshop_code", "process_type").agg(F.sum("tce").cast("double").alias("e"))
    w = w.withColumn("n", F.row_number().over(Window.orderBy(F.desc("e"), "workshop_code")))  # one row a workshop
    pct = lambda c: F.round(100 * F.try_divide(F.sum(F.when(c, F.col("e"))), F.sum("e")), 2)
    months = p.days.groupBy("year_month").agg(F.sum("tce").cast("double").alias("e")).agg(F.max_by("year_month", "e").alias("peak_month"), F.min_by("year_month", "e").alias("trough_month"))
    return w.agg(pct(F.col("process_type") == UTILITY).alias("utility_pct"), pct(F.col("n") <= 4).alias("top4_pct")).join(months)  # one row each


@query("r19_day_and_carbon_headlines", """m AS (SELECT year_month, sum(tce)::DOUBLE AS e, sum(co2_t)::DOUBLE / sum(tce)::DOUBLE AS ci FROM days GROUP BY 1), t AS (SELECT CASE WHEN is_holiday = 1 THEN 'h' WHEN is_weekend = 1 THEN 'w' ELSE 'd' END AS kind, sum(std_coal_kgce)::DOUBLE / 1000 / count(DISTINCT record_date) AS e FROM v GROUP BY 1)
SELECT round((SELECT max(e) FROM m), 3) AS peak_tce, round((SELECT min(e) FROM m), 3) AS trough_tce, round((SELECT max(ci) FROM m), 6) AS ci_max, round((SELECT min(ci) FROM m), 6) AS ci_min, round(100 * (SELECT e FROM t WHERE kind = 'w') / (SELECT e FROM t WHERE kind = 'd'), 2) AS weekend_pct, round(100 * (SELECT e FROM t WHERE kind = 'h') / (SELECT e FROM t WHERE kind = 'd'), 2) AS holiday_pct""")
def r_days(p: Plant) -> DataFrame:
    """Highest and lowest month, extremes of carbon per energy, energy per day of weekends and holidays against work days."""
    total = lambda c: F.sum(c).cast("double")
    m = p.days.groupBy("year_month").agg(total("tce").alias("e"), (total("co2_t") / total("tce")).alias("ci"))
    months = m.agg(*(F.round(f(c), n).alias(a) for f, c, n, a in ((F.max, "e", 3, "peak_tce"), (F.min, "e", 3, "trough_tce"), (F.max, "ci", 6, "ci_max"), (F.min, "ci", 6, "ci_min"))))
    t = p.enriched.groupBy(day_type("h", "w", "d").alias("kind")).agg((total("std_coal_kgce") / 1000 / F.count_distinct("record_date")).alias("e"))
    of = lambda k: F.max(F.when(F.col("kind") == k, F.col("e")))
    return months.join(t.agg(F.round(100 * F.try_divide(of("w"), of("d")), 2).alias("weekend_pct"), F.round(100 * F.try_divide(of("h"), of("d")), 2).alias("holiday_pct")))  # one row each


@query("r19_method_headlines", """k AS (SELECT c.*, CASE WHEN d.is_holiday = 1 THEN 1 ELSE 0 END AS hol, CASE WHEN ue > mu_u + 2 * sd_u THEN 1 ELSE 0 END AS f, CASE WHEN r > mu_r + 2 * sd_r THEN 1 ELSE 0 END AS b, CASE WHEN is_alarm = 1 AND coalesce(lag(is_alarm) OVER (PARTITION BY workshop_code ORDER BY record_date), 0) = 0 THEN 1 ELSE 0 END AS seg FROM cus c JOIN dim_calendar d ON d.calendar_date = c.record_date),
w AS (SELECT workshop_code, sum(f) AS f, sum(b) AS b, sum(f * b) AS fb, sum(f * hol) AS fh, sum(b * hol) AS bh, sum(is_alarm) AS a, sum(seg) AS seg, sum(is_alarm * hol) AS ah, round(max(sd_r) / nullif(max(sd_u), 0), 4) AS noise, count(CASE WHEN alarm_side = '偏高' THEN 1 END) AS hi, count(CASE WHEN alarm_side = '偏低' THEN 1 END) AS lo, round(max(greatest(s_hi_raw, s_lo_raw)), 2) AS raw, round(max(greatest(s_hi, s_lo)), 2) AS s FROM k GROUP BY 1),
z AS (SELECT min(abs(z_w)) AS lo, max(abs(z_w)) AS hi FROM cus WHERE alarm_side = '偏低'), cuts AS (SELECT 1 - s / raw AS cut FROM w WHERE s < raw * 0.6 ORDER BY cut DESC, workshop_code LIMIT 2)
SELECT sum(f)::BIGINT AS fixed_hits, sum(b)::BIGINT AS baseline_hits, sum(fb)::BIGINT AS both_hits, round(100 * avg(noise), 2) AS noise_pct, round(100 * (sum(f) - sum(fb)) / greatest(1, sum(f)), 2) AS rejected_pct, round(100 * sum(fh) / greatest(1, sum(f)), 2) AS fixed_holiday_pct, round(100 * sum(bh) / greatest(1, sum(b)), 2) AS baseline_holiday_pct, sum(a)::BIGINT AS cusum_days, sum(seg)::BIGINT AS segments,
round(sum(a) / greatest(1, sum(seg)), 3) AS days_per_segment, round(sum(f) / greatest(1, sum(a)), 3) AS compression, round(100 * sum(ah) / greatest(1, sum(a)), 2) AS cusum_holiday_pct, count(CASE WHEN lo > hi THEN 1 END) AS low_workshops, count(CASE WHEN hi > lo THEN 1 END) AS high_workshops, (SELECT round(lo, 4) FROM z) AS low_side_least_z, (SELECT round(hi, 4) FROM z) AS low_side_largest_z, (SELECT round(100 * avg(cut), 2) FROM cuts) AS whitening_cut_pct FROM w""")
def r_methods(p: Plant) -> DataFrame:
    """The three methods side by side: hits, what the baseline rejects, holidays among hits, how far days become segments, sides of alarms, the range of |z| on
    the low side, and the two largest cuts of the peak by whitening."""
    q = written(QUERIES["q26_three_methods"](p.spark, p.sf_dir), "methods")  # a row a workshop
    n = lambda c: F.sum(c).cast("long")
    share = lambda a, b, k=100, digits=2: F.round(k * F.sum(a) / F.greatest(F.lit(1), F.sum(b)), digits)
    totals = q.agg(
        n("fixed_hits").alias("fixed_hits"), n("baseline_hits").alias("baseline_hits"), n("both_hits").alias("both_hits"), F.round(100 * F.avg("noise_ratio"), 2).alias("noise_pct"), share("fixed_only", "fixed_hits").alias("rejected_pct"), share("fixed_holiday", "fixed_hits").alias("fixed_holiday_pct"),
        share("baseline_holiday", "baseline_hits").alias("baseline_holiday_pct"), n("cusum_days").alias("cusum_days"), n("cusum_segments").alias("segments"), share("cusum_days", "cusum_segments", 1, 3).alias("days_per_segment"), share("fixed_hits", "cusum_days", 1, 3).alias("compression"),
        share("cusum_holiday", "cusum_days").alias("cusum_holiday_pct"), F.count(F.when(F.col("cusum_low") > F.col("cusum_high"), 1)).alias("low_workshops"), F.count(F.when(F.col("cusum_high") > F.col("cusum_low"), 1)).alias("high_workshops"),
    )
    z = p.cusum.filter("alarm_side = '偏低'").agg(F.round(F.min(F.abs("z_w")), 4).alias("low_side_least_z"), F.round(F.max(F.abs("z_w")), 4).alias("low_side_largest_z"))
    cuts = q.filter("max_s < max_s_raw * 0.6").select("workshop_code", (1 - F.col("max_s") / F.col("max_s_raw")).alias("cut"))
    cuts = cuts.withColumn("n", F.row_number().over(Window.orderBy(F.desc("cut"), "workshop_code"))).filter("n <= 2").agg(F.round(100 * F.avg("cut"), 2).alias("whitening_cut_pct"))
    return totals.join(z).join(cuts)  # one row each


@query("r20_report_summary", _FEED + """, w AS (SELECT workshop_name, sum(tce)::DOUBLE AS e FROM days GROUP BY 1) SELECT round((SELECT sum(e) FROM w), 3) AS tce, (SELECT string_agg(workshop_name, ',' ORDER BY e DESC, workshop_name) FROM (SELECT * FROM w ORDER BY e DESC, workshop_name LIMIT 5)) AS top_workshops, (SELECT count(*) FROM feed) AS anomalies""")
def r_summary(p: Plant) -> DataFrame:
    w = p.days.groupBy("workshop_name").agg(F.sum("tce").cast("double").alias("e"))
    total = w.agg(F.round(F.sum("e"), 3).alias("tce"))
    top = w.orderBy(F.desc("e"), "workshop_name").limit(5).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("e")).alias("k"), "workshop_name"))), lambda x: x["workshop_name"]), ",").alias("top_workshops"))
    return total.join(top).join(anomaly_feed(p).agg(F.count("*").alias("anomalies")))  # one row each


def contract_violations(frame: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Names and order must be equal (else it raises); then rows with numbers that aren't finite are counted by column."""
    if tuple(frame.columns) != columns:
        raise ValueError(f"columns are {frame.columns}, not {list(columns)}")
    numbers = [c for c, t in frame.dtypes if t in ("double", "float")]
    bad = lambda c: F.isnan(c) | (F.abs(F.col(c)) == float("inf"))
    return frame.agg(F.count("*").alias("n_rows"), *(F.count(F.when(bad(c), 1)).alias(f"bad_{c}") for c in numbers))


@query("r21_output_contract", _CUBE + "SELECT 'cube' AS frame, count(*) AS n_rows, count(CASE WHEN isnan(tce::DOUBLE) THEN 1 END) AS bad_tce, count(CASE WHEN isinf(cost::DOUBLE) THEN 1 END) AS bad_cost, count(CASE WHEN isnan(unit_energy::DOUBLE) THEN 1 END) AS bad_unit_energy FROM cube UNION ALL SELECT 'broken', count(*), count(CASE WHEN day(record_date) = 3 THEN 1 END), count(CASE WHEN workshop_code = 'W02' THEN 1 END), count(CASE WHEN unit_energy IS NOT NULL AND workshop_code = 'W04' THEN 1 END) FROM cube")
def r_contract(p: Plant) -> DataFrame:
    """The workshop-day cube, and the same with numbers that aren't finite."""
    columns = ("record_date", "workshop_code", "workshop_name", "process_type", "day_type", "is_production_day", "tce", "cost", "co2_t", "output_qty", "unit_energy")
    cube = workshop_day_cube(p)
    nan, endless = F.lit(float("nan")), F.lit(float("inf"))
    broken = cube.withColumns({"tce": F.when(F.dayofmonth("record_date") == 3, nan).otherwise(F.col("tce")), "cost": F.when(F.col("workshop_code") == "W02", -endless).otherwise(F.col("cost")), "unit_energy": F.when((F.col("workshop_code") == "W04") & F.col("unit_energy").isNotNull(), nan).otherwise(F.col("unit_energy"))})
    check = lambda frame, name: contract_violations(frame, columns).select(F.lit(name).alias("frame"), "n_rows", "bad_tce", "bad_cost", "bad_unit_energy")
    return check(cube, "cube").unionByName(check(broken, "broken"))
