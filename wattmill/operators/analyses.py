"""The 29 named analyses of the plant. Each is a lazy DataFrame over the views; ratios of sums are never sums of ratios."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattmill.operators.views import ratio, thousandth
from wattmill.plans.catalog import query
from wattmill.sources.adapter import UTILITY



def makes_products() -> Column:
    return F.col("process_type") != UTILITY


def tce(n: int = 2, when: Column | None = None) -> Column:
    """Tonnes of standard coal."""
    return F.round(thousandth(F.sum(F.when(when, F.col("std_coal_kgce")) if when is not None else F.col("std_coal_kgce"))), n).cast("double")


def co2(n: int = 2) -> Column:
    return F.round(thousandth(F.sum("co2_kg")), n).cast("double")


def cost(n: int = 2, when: Column | None = None) -> Column:
    return F.round(F.sum(F.when(when, F.col("cost")) if when is not None else F.col("cost")), n).cast("double")


def total(x: str, when: Column | None = None) -> Column:
    return F.sum(F.when(when, F.col(x)) if when is not None else F.col(x)).cast("double")


def percent(a: Column, b: Column, n: int = 2) -> Column:
    return F.round(100 * F.try_divide(a, b), n)


def share(x: str) -> Column:
    """Percent of a column's sum over all rows; used on aggregated rows only."""
    return percent(F.col(x), F.sum(x).over(Window.partitionBy()))


def day_type(holiday: str, weekend: str, work: str) -> Column:
    return F.when(F.col("is_holiday") == 1, holiday).when(F.col("is_weekend") == 1, weekend).otherwise(work)


@query("q01_totals", """SELECT count(DISTINCT record_date) AS days, count(DISTINCT workshop_code) AS workshops, count(DISTINCT energy_code) AS energies, round(sum(std_coal_kgce)::DECIMAL(28,3) * 0.001::DECIMAL(4,3), 2)::DOUBLE AS tce, sum(cost)::DOUBLE AS cost,
round(sum(co2_kg)::DECIMAL(28,3) * 0.001::DECIMAL(4,3), 2)::DOUBLE AS co2_t, round(sum(std_coal_kgce)::DOUBLE / 1000 / count(DISTINCT record_date), 3) AS tce_per_day, round(sum(cost)::DOUBLE / count(DISTINCT record_date), 2) AS cost_per_day FROM v""")
def q01(p) -> DataFrame:
    days = F.count_distinct("record_date")
    return p.enriched.agg(
        days.alias("days"), F.count_distinct("workshop_code").alias("workshops"), F.count_distinct("energy_code").alias("energies"), tce().alias("tce"), cost().alias("cost"), co2().alias("co2_t"),
        F.round(total("std_coal_kgce") / 1000 / days, 3).alias("tce_per_day"), F.round(total("cost") / days, 2).alias("cost_per_day"),
    )


@query("q02_totals_without_utility", """SELECT round(sum(std_coal_kgce)::DECIMAL(28,3) * 0.001::DECIMAL(4,3), 2)::DOUBLE AS tce, sum(cost)::DOUBLE AS cost, round(sum(co2_kg)::DECIMAL(28,3) * 0.001::DECIMAL(4,3), 2)::DOUBLE AS co2_t FROM v WHERE process_type <> '公用工程'""")
def q02(p) -> DataFrame:
    return p.enriched.filter(makes_products()).agg(tce().alias("tce"), cost().alias("cost"), co2().alias("co2_t"))


@query("q03_workshop_ranking", """SELECT workshop_code, workshop_name, process_type, round(e::DECIMAL(28,3) * 0.001::DECIMAL(4,3), 2)::DOUBLE AS tce, round(100 * e::DOUBLE / sum(e::DOUBLE) OVER (), 2) AS tce_pct, c::DOUBLE AS cost, round(100 * c::DOUBLE / sum(c::DOUBLE) OVER (), 2) AS cost_pct,
round(k::DECIMAL(28,3) * 0.001::DECIMAL(4,3), 2)::DOUBLE AS co2_t, rank() OVER (ORDER BY e DESC) AS energy_rank FROM (SELECT workshop_code, workshop_name, process_type, sum(std_coal_kgce) AS e, sum(cost) AS c, sum(co2_kg) AS k FROM v GROUP BY ALL)""")
def q03(p) -> DataFrame:
    g = p.enriched.groupBy("workshop_code", "workshop_name", "process_type").agg(tce().alias("tce"), total("std_coal_kgce").alias("e"), cost().alias("cost"), co2().alias("co2_t"))
    ranked = g.select("workshop_code", "workshop_name", "process_type", "tce", share("e").alias("tce_pct"), "cost", share("cost").alias("cost_pct"), "co2_t", F.rank().over(Window.orderBy(F.desc("e"))).alias("energy_rank"))
    return ranked.orderBy(F.desc("tce"), "workshop_code")


@query("q04_energy_mix", """SELECT energy_code, energy_name, unit, q::DOUBLE AS consumption, round(e::DECIMAL(28,3) * 0.001::DECIMAL(4,3), 2)::DOUBLE AS tce, round(100 * e::DOUBLE / sum(e::DOUBLE) OVER (), 2) AS tce_pct, c::DOUBLE AS cost, round(100 * c::DOUBLE / sum(c::DOUBLE) OVER (), 2) AS cost_pct,
round(k::DECIMAL(28,3) * 0.001::DECIMAL(4,3), 2)::DOUBLE AS co2_t, round(c::DOUBLE / nullif(q::DOUBLE, 0), 4) AS mean_price FROM (SELECT energy_code, energy_name, unit, sum(consumption) AS q, sum(std_coal_kgce) AS e, sum(cost) AS c, sum(co2_kg) AS k FROM v GROUP BY ALL)""")
def q04(p) -> DataFrame:
    g = p.enriched.groupBy("energy_code", "energy_name", "unit").agg(
        F.round(F.sum("consumption"), 2).cast("double").alias("consumption"), tce().alias("tce"), total("std_coal_kgce").alias("e"), cost().alias("cost"), co2().alias("co2_t"), F.round(ratio(F.sum("cost"), F.sum("consumption")), 4).alias("mean_price")
    )
    return g.select("energy_code", "energy_name", "unit", "consumption", "tce", share("e").alias("tce_pct"), "cost", share("cost").alias("cost_pct"), "co2_t", "mean_price").orderBy(F.desc("tce"), "energy_code")


@query("q05_monthly_trend", """SELECT year_month, round(e::DECIMAL(28,3) * 0.001::DECIMAL(4,3), 2)::DOUBLE AS tce, c::DOUBLE AS cost, round(k::DECIMAL(28,3) * 0.001::DECIMAL(4,3), 2)::DOUBLE AS co2_t, round(lag(e) OVER w::DECIMAL(28,3) * 0.001::DECIMAL(4,3), 2)::DOUBLE AS tce_before,
round(100 * (e::DOUBLE - lag(e::DOUBLE) OVER w) / lag(e::DOUBLE) OVER w, 2) AS change_pct FROM (SELECT year_month, sum(std_coal_kgce)::DECIMAL(28,3) AS e, sum(cost) AS c, sum(co2_kg) AS k FROM v GROUP BY 1) WINDOW w AS (ORDER BY year_month)""".replace("lag(e) OVER w::DECIMAL(28,3)", "(lag(e) OVER w)"))
def q05(p) -> DataFrame:
    g = p.enriched.groupBy("year_month").agg(tce().alias("tce"), total("std_coal_kgce").alias("e"), cost().alias("cost"), co2().alias("co2_t"))
    w = Window.orderBy("year_month")  # one row a month
    before = F.lag("e").over(w)
    return g.select("year_month", "tce", "cost", "co2_t", F.lag("tce").over(w).alias("tce_before"), percent(F.col("e") - before, before).alias("change_pct")).orderBy("year_month")


@query("q06_yearly_change", """SELECT workshop_code, workshop_name, round(a::DECIMAL(28,3) * 0.001::DECIMAL(4,3), 2)::DOUBLE AS tce_2024, round(b::DECIMAL(28,3) * 0.001::DECIMAL(4,3), 2)::DOUBLE AS tce_2025, round(100 * (b::DOUBLE - a::DOUBLE) / nullif(a::DOUBLE, 0), 2) AS change_pct FROM (
SELECT workshop_code, workshop_name, sum(CASE WHEN year = 2024 THEN std_coal_kgce END) AS a, sum(CASE WHEN year = 2025 THEN std_coal_kgce END) AS b FROM v GROUP BY ALL)""")
def q06(p) -> DataFrame:
    year = lambda y: F.col("year") == y
    a, b = total("std_coal_kgce", year(2024)), total("std_coal_kgce", year(2025))
    g = p.enriched.groupBy("workshop_code", "workshop_name").agg(tce(2, year(2024)).alias("tce_2024"), tce(2, year(2025)).alias("tce_2025"), percent(b - a, a).alias("change_pct"))
    return g.orderBy("change_pct", "workshop_code")


@query("q07_monthly_unit_energy", """SELECT year_month, workshop_name, output_qty::DOUBLE AS output_qty, output_unit, tce::DOUBLE AS tce, unit_energy_kgce FROM months WHERE process_type <> '公用工程'""")
def q07(p) -> DataFrame:
    rows = p.months.filter(makes_products()).orderBy("workshop_code", "year_month")
    return rows.select("year_month", "workshop_name", F.col("output_qty").cast("double").alias("output_qty"), "output_unit", F.col("tce").cast("double").alias("tce"), "unit_energy_kgce")


@query("q08_unit_energy_change", """SELECT workshop_name, round(a, 4) AS unit_2024, round(b, 4) AS unit_2025, round(100 * (b - a) / nullif(a, 0), 2) AS change_pct FROM (SELECT workshop_code, workshop_name, avg(CASE WHEN left(year_month, 4) = '2024' THEN unit_energy_kgce END) AS a,
avg(CASE WHEN left(year_month, 4) = '2025' THEN unit_energy_kgce END) AS b FROM months WHERE process_type <> '公用工程' GROUP BY ALL)""")
def q08(p) -> DataFrame:
    mean = lambda y: F.avg(F.when(F.left("year_month", F.lit(4)) == y, F.col("unit_energy_kgce")))
    a, b = mean("2024"), mean("2025")
    g = p.months.filter(makes_products()).groupBy("workshop_code", "workshop_name").agg(F.round(a, 4).alias("unit_2024"), F.round(b, 4).alias("unit_2025"), percent(b - a, a).alias("change_pct"))
    return g.drop("workshop_code").orderBy("change_pct", "workshop_name")


@query("q09_cost_pareto", """SELECT workshop_name, c::DOUBLE AS cost, round(100 * c::DOUBLE / sum(c::DOUBLE) OVER (), 2) AS cost_pct, round(100 * sum(c::DOUBLE) OVER (ORDER BY c DESC) / sum(c::DOUBLE) OVER (), 2) AS running_pct FROM (SELECT workshop_name, sum(cost) AS c FROM v GROUP BY 1)""")
def q09(p) -> DataFrame:
    g = p.enriched.groupBy("workshop_name").agg(cost().alias("cost"))
    running = F.sum("cost").over(Window.orderBy(F.desc("cost")))  # RANGE: ties share a value
    return g.select("workshop_name", "cost", share("cost").alias("cost_pct"), percent(running, F.sum("cost").over(Window.partitionBy())).alias("running_pct")).orderBy(F.desc("cost"), "workshop_name")


ENERGY_NAMES = {"E01": "electricity", "E02": "gas", "E03": "steam", "E04": "water", "E05": "air", "E06": "diesel"}


@query("q10_workshop_energy_pivot", "SELECT workshop_name, " + ", ".join(f"round(sum(CASE WHEN energy_code = '{c}' THEN std_coal_kgce END)::DECIMAL(28,3) * 0.001::DECIMAL(4,3), 2)::DOUBLE AS {n}_tce" for c, n in ENERGY_NAMES.items())
       + ", round(sum(std_coal_kgce)::DECIMAL(28,3) * 0.001::DECIMAL(4,3), 2)::DOUBLE AS total_tce FROM v GROUP BY workshop_code, workshop_name")
def q10(p) -> DataFrame:
    g = p.enriched.groupBy("workshop_code", "workshop_name").agg(*(tce(2, F.col("energy_code") == c).alias(f"{n}_tce") for c, n in ENERGY_NAMES.items()), tce().alias("total_tce"))
    return g.drop("workshop_code").orderBy(F.desc("total_tce"), "workshop_name")


@query("q11_temperature_bins", """SELECT temperature_bin, count(DISTINCT record_date) AS days, round(avg(avg_temperature), 1) AS mean_temperature, round(sum(CASE WHEN energy_code = 'E01' THEN consumption END)::DOUBLE / count(DISTINCT record_date), 0) AS kwh_per_day,
round(sum(CASE WHEN energy_code = 'E02' THEN consumption END)::DOUBLE / count(DISTINCT record_date), 0) AS gas_per_day, round(sum(CASE WHEN energy_code = 'E03' THEN consumption END)::DOUBLE / count(DISTINCT record_date), 1) AS steam_per_day FROM (
SELECT *, CASE WHEN avg_temperature < 0 THEN '1_零度以下' WHEN avg_temperature < 10 THEN '2_0-10℃' WHEN avg_temperature < 20 THEN '3_10-20℃' WHEN avg_temperature < 28 THEN '4_20-28℃' ELSE '5_28℃以上' END AS temperature_bin FROM v WHERE is_continuous = 1) GROUP BY 1""")
def q11(p) -> DataFrame:
    t = F.col("avg_temperature")
    label = F.when(t < 0, "1_零度以下").when(t < 10, "2_0-10℃").when(t < 20, "3_10-20℃").when(t < 28, "4_20-28℃").otherwise("5_28℃以上")  # no temperature: the last bin
    days = F.count_distinct("record_date")
    per_day = lambda c, n: F.round(total("consumption", F.col("energy_code") == c) / days, n)
    g = p.enriched.filter("is_continuous = 1").groupBy(label.alias("temperature_bin")).agg(
        days.alias("days"), F.round(F.avg(t), 1).alias("mean_temperature"), per_day("E01", 0).alias("kwh_per_day"), per_day("E02", 0).alias("gas_per_day"), per_day("E03", 1).alias("steam_per_day")
    )
    return g.orderBy("temperature_bin")


@query("q12_temperature_correlation", """SELECT count(*) AS days, round(corr(t, kwh), 4) AS electricity_r, round(corr(t, gas), 4) AS gas_r, round(corr(t, steam), 4) AS steam_r FROM (SELECT record_date, avg(avg_temperature) AS t, coalesce(sum(CASE WHEN energy_code = 'E01' THEN consumption END), 0)::DOUBLE AS kwh,
coalesce(sum(CASE WHEN energy_code = 'E02' THEN consumption END), 0)::DOUBLE AS gas, coalesce(sum(CASE WHEN energy_code = 'E03' THEN consumption END), 0)::DOUBLE AS steam FROM v WHERE is_continuous = 1 GROUP BY 1)""")
def q12(p) -> DataFrame:
    used = lambda c: F.coalesce(total("consumption", F.col("energy_code") == c), F.lit(0.0))
    d = p.enriched.filter("is_continuous = 1").groupBy("record_date").agg(F.avg("avg_temperature").alias("t"), used("E01").alias("kwh"), used("E02").alias("gas"), used("E03").alias("steam"))
    return d.agg(F.count("*").alias("days"), *(F.round(F.corr("t", c), 4).alias(n) for c, n in (("kwh", "electricity_r"), ("gas", "gas_r"), ("steam", "steam_r"))))


@query("q13_standby_loss", """SELECT workshop_name, process_type, count(DISTINCT CASE WHEN is_production_day = 0 THEN record_date END) AS stopped_days, round(a::DECIMAL(28,3) * 0.001::DECIMAL(4,3), 2)::DOUBLE AS standby_tce, round(e::DECIMAL(28,3) * 0.001::DECIMAL(4,3), 2)::DOUBLE AS tce,
round(100 * a::DOUBLE / nullif(e::DOUBLE, 0), 2) AS standby_pct, c::DOUBLE AS standby_cost FROM (SELECT *, sum(CASE WHEN is_production_day = 0 THEN std_coal_kgce END) OVER w AS a, sum(std_coal_kgce) OVER w AS e, sum(CASE WHEN is_production_day = 0 THEN cost END) OVER w AS c FROM v WINDOW w AS (PARTITION BY workshop_code))
GROUP BY workshop_code, workshop_name, process_type, a, e, c""")
def q13(p) -> DataFrame:
    idle = F.col("is_production_day") == 0
    g = p.enriched.groupBy("workshop_code", "workshop_name", "process_type").agg(
        F.count_distinct(F.when(idle, F.col("record_date"))).alias("stopped_days"), tce(2, idle).alias("standby_tce"), tce().alias("tce"), percent(total("std_coal_kgce", idle), total("std_coal_kgce")).alias("standby_pct"), cost(2, idle).alias("standby_cost")
    )
    return g.drop("workshop_code").orderBy(F.desc("standby_tce"), "workshop_name")


@query("q14_day_types", """SELECT day_type, count(DISTINCT record_date) AS days, round(sum(std_coal_kgce)::DOUBLE / 1000 / count(DISTINCT record_date), 3) AS tce_per_day, round(sum(cost)::DOUBLE / count(DISTINCT record_date), 2) AS cost_per_day, round(sum(co2_kg)::DOUBLE / 1000 / count(DISTINCT record_date), 3) AS co2_per_day
FROM (SELECT *, CASE WHEN is_holiday = 1 THEN '1_法定节假日' WHEN is_weekend = 1 THEN '2_周末' ELSE '3_工作日' END AS day_type FROM v) GROUP BY 1""")
def q14(p) -> DataFrame:
    days = F.count_distinct("record_date")
    g = p.enriched.groupBy(day_type("1_法定节假日", "2_周末", "3_工作日").alias("day_type")).agg(
        days.alias("days"), F.round(total("std_coal_kgce") / 1000 / days, 3).alias("tce_per_day"), F.round(total("cost") / days, 2).alias("cost_per_day"), F.round(total("co2_kg") / 1000 / days, 3).alias("co2_per_day")
    )
    return g.orderBy("day_type")


@query("q15_holidays", """SELECT year, holiday_name, count(DISTINCT record_date) AS days, round(sum(std_coal_kgce)::DECIMAL(28,3) * 0.001::DECIMAL(4,3), 2)::DOUBLE AS tce, round(sum(std_coal_kgce)::DOUBLE / 1000 / count(DISTINCT record_date), 3) AS tce_per_day, sum(cost)::DOUBLE AS cost FROM v WHERE is_holiday = 1 GROUP BY ALL""")
def q15(p) -> DataFrame:
    days = F.count_distinct("record_date")
    g = p.enriched.filter("is_holiday = 1").groupBy("year", "holiday_name").agg(days.alias("days"), tce().alias("tce"), F.round(total("std_coal_kgce") / 1000 / days, 3).alias("tce_per_day"), cost().alias("cost"))
    return g.orderBy(F.desc("tce_per_day"), "holiday_name")


def two_sigma(unit_days: DataFrame) -> DataFrame:
    """Unit-energy days with their workshop's mean and deviation (joined back from one aggregate)."""
    stats = unit_days.groupBy("workshop_code").agg(F.avg("ue").alias("mu"), F.stddev_samp("ue").alias("sd"))
    return unit_days.join(stats, "workshop_code").withColumn("z", F.try_divide(F.col("ue") - F.col("mu"), F.col("sd")))


_SIGMA = "sig AS (SELECT d.*, mu, sd, (ue - mu) / nullif(sd, 0) AS z FROM unit_days d JOIN (SELECT workshop_code, avg(ue) AS mu, stddev_samp(ue) AS sd FROM unit_days GROUP BY 1) USING (workshop_code))\n"


@query("q16_two_sigma_days", _SIGMA + """SELECT record_date, workshop_name, round(output_qty, 2)::DOUBLE AS output_qty, round(ue, 4) AS unit_energy, round(mu, 4) AS mean, round(sd, 4) AS deviation, round(z, 2) AS z FROM sig WHERE ue > mu + 2 * sd ORDER BY round(z, 2) DESC, record_date, workshop_name LIMIT 50""")
def q16(p) -> DataFrame:
    rows = two_sigma(p.unit_days).filter("ue > mu + 2 * sd").select(
        "record_date", "workshop_name", F.round("output_qty", 2).cast("double").alias("output_qty"), F.round("ue", 4).alias("unit_energy"), F.round("mu", 4).alias("mean"), F.round("sd", 4).alias("deviation"), F.round("z", 2).alias("z")
    )
    return rows.orderBy(F.desc("z"), "record_date", "workshop_name").limit(50)


@query("q17_three_day_rise", """SELECT record_date, workshop_name, round(e, 0)::DOUBLE AS kgce, round(p1, 0)::DOUBLE AS kgce_before, round(p2, 0)::DOUBLE AS kgce_two_before, round(100 * (e::DOUBLE - p1::DOUBLE) / p1::DOUBLE, 2) AS rise_pct FROM (SELECT *, lag(e, 1) OVER w AS p1, lag(e, 2) OVER w AS p2
FROM (SELECT record_date, workshop_code, workshop_name, sum(std_coal_kgce) AS e FROM v GROUP BY ALL) WINDOW w AS (PARTITION BY workshop_code ORDER BY record_date)) WHERE e > p1 AND p1 > p2""")
def q17(p) -> DataFrame:
    d = p.enriched.groupBy("record_date", "workshop_code", "workshop_name").agg(F.sum("std_coal_kgce").alias("e"))
    w = Window.partitionBy("workshop_code").orderBy("record_date")
    d = d.withColumns({"p1": F.lag("e", 1).over(w), "p2": F.lag("e", 2).over(w)}).filter("e > p1 AND p1 > p2")
    whole = lambda c: F.round(c, 0).cast("double")
    rows = d.select("record_date", "workshop_name", whole("e").alias("kgce"), whole("p1").alias("kgce_before"), whole("p2").alias("kgce_two_before"), F.round(100 * ratio(F.col("e") - F.col("p1"), F.col("p1")), 2).alias("rise_pct"))
    return rows.orderBy("record_date", "workshop_name")


@query("q18_seven_day_mean", """SELECT record_date, round(e, 0)::DOUBLE AS kgce, round(avg(e::DOUBLE) OVER w, 0) AS mean_7, round(stddev_samp(e::DOUBLE) OVER w, 0) AS deviation_7 FROM (SELECT record_date, sum(std_coal_kgce) AS e FROM v GROUP BY 1) WINDOW w AS (ORDER BY record_date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)""")
def q18(p) -> DataFrame:
    d = p.enriched.groupBy("record_date").agg(F.sum("std_coal_kgce").alias("e"))
    w = Window.orderBy("record_date").rowsBetween(-6, 0)  # one row a day
    e = F.col("e").cast("double")
    return d.select("record_date", F.round("e", 0).cast("double").alias("kgce"), F.round(F.avg(e).over(w), 0).alias("mean_7"), F.round(F.stddev_samp(e).over(w), 0).alias("deviation_7")).orderBy("record_date")


@query("q19_price_deviation", """SELECT year_month, energy_name, unit, sum(consumption)::DOUBLE AS consumption, round(sum(cost)::DOUBLE / nullif(sum(consumption)::DOUBLE, 0), 4) AS mean_price, max(reference_price)::DOUBLE AS reference_price,
round(100 * (sum(cost)::DOUBLE / nullif(sum(consumption)::DOUBLE, 0) - max(reference_price)::DOUBLE) / max(reference_price)::DOUBLE, 2) AS deviation_pct FROM v GROUP BY year_month, energy_name, unit""")
def q19(p) -> DataFrame:
    price, reference = ratio(F.sum("cost"), F.sum("consumption")), F.max("reference_price").cast("double")
    g = p.enriched.groupBy("year_month", "energy_name", "unit").agg(F.round(F.sum("consumption"), 2).cast("double").alias("consumption"), F.round(price, 4).alias("mean_price"), reference.alias("reference_price"), percent(price - reference, reference).alias("deviation_pct"))
    return g.orderBy("energy_name", "year_month")


@query("q20_electricity_intensity", """SELECT year_month, workshop_name, output_unit, round(kwh::DOUBLE / nullif(qty::DOUBLE, 0), 4) AS kwh_per_unit FROM (SELECT year_month, workshop_code, workshop_name, output_unit, sum(consumption) AS kwh FROM v WHERE energy_code = 'E01' AND process_type <> '公用工程' GROUP BY ALL)
JOIN (SELECT year_month, workshop_code, sum(output_qty) AS qty FROM production JOIN dim_calendar ON calendar_date = record_date GROUP BY ALL) USING (year_month, workshop_code)""")
def q20(p) -> DataFrame:
    used = p.enriched.filter((F.col("energy_code") == "E01") & makes_products()).groupBy("year_month", "workshop_code", "workshop_name", "output_unit").agg(F.sum("consumption").alias("kwh"))
    made = p.production.join(F.broadcast(p.calendar.select(F.col("calendar_date").alias("record_date"), "year_month")), "record_date").groupBy("year_month", "workshop_code").agg(F.sum("output_qty").alias("qty"))
    rows = used.join(made, ["year_month", "workshop_code"]).orderBy("workshop_code", "year_month")
    return rows.select("year_month", "workshop_name", "output_unit", F.round(ratio(F.col("kwh"), F.col("qty")), 4).alias("kwh_per_unit"))


@query("q21_carbon_intensity", """SELECT year_month, round(sum(co2_kg)::DECIMAL(28,3) * 0.001::DECIMAL(4,3), 2)::DOUBLE AS co2_t, round(sum(std_coal_kgce)::DECIMAL(28,3) * 0.001::DECIMAL(4,3), 2)::DOUBLE AS tce, round(sum(co2_kg)::DOUBLE / nullif(sum(std_coal_kgce)::DOUBLE, 0), 4) AS co2_per_tce FROM v GROUP BY 1""")
def q21(p) -> DataFrame:
    return p.enriched.groupBy("year_month").agg(co2().alias("co2_t"), tce().alias("tce"), F.round(ratio(F.sum("co2_kg"), F.sum("std_coal_kgce")), 4).alias("co2_per_tce")).orderBy("year_month")


SURGE = 0.25


def month_surges(rows: DataFrame, least: float = SURGE) -> DataFrame:
    """Months of a workshop that use more than `least` above the month before."""
    m = rows.groupBy("year_month", "workshop_code", "workshop_name").agg(F.sum("std_coal_kgce").alias("e"))
    m = m.withColumn("prev", F.lag("e").over(Window.partitionBy("workshop_code").orderBy("year_month")))
    rise = ratio(F.col("e") - F.col("prev"), F.col("prev"))
    return m.filter(rise > least).select(
        "year_month", "workshop_code", "workshop_name", F.round(thousandth(F.col("e")), 3).cast("double").alias("tce"), F.round(thousandth(F.col("prev")), 3).cast("double").alias("tce_before"), F.round(100 * rise, 2).alias("change_pct")
    )


@query("q22_month_surges", """SELECT year_month, workshop_name, round(e::DECIMAL(28,3) * 0.001::DECIMAL(4,3), 3)::DOUBLE AS tce, round(p::DECIMAL(28,3) * 0.001::DECIMAL(4,3), 3)::DOUBLE AS tce_before, round(100 * (e::DOUBLE - p::DOUBLE) / p::DOUBLE, 2) AS change_pct FROM (SELECT *, lag(e) OVER (PARTITION BY workshop_code ORDER BY year_month) AS p
FROM (SELECT year_month, workshop_code, workshop_name, sum(std_coal_kgce) AS e FROM v GROUP BY ALL)) WHERE (e::DOUBLE - p::DOUBLE) / p::DOUBLE > 0.25""")
def q22(p) -> DataFrame:
    return month_surges(p.enriched).drop("workshop_code").orderBy(F.desc("change_pct"), "year_month", "workshop_name")


@query("q23_top_days", """SELECT record_date, workshop_name, tce::DOUBLE AS tce, co2_t::DOUBLE AS co2_t, cost_yuan::DOUBLE AS cost, round(avg_temperature, 1) AS mean_temperature FROM days ORDER BY tce DESC, record_date, workshop_name LIMIT 20""")
def q23(p) -> DataFrame:
    rows = p.days.orderBy(F.desc("tce"), "record_date", "workshop_name").limit(20)
    return rows.select("record_date", "workshop_name", F.col("tce").cast("double").alias("tce"), F.col("co2_t").cast("double").alias("co2_t"), F.col("cost_yuan").cast("double").alias("cost"), F.round("avg_temperature", 1).alias("mean_temperature"))


@query("q24_unit_energy_band", _SIGMA + """SELECT record_date, workshop_code, workshop_name, output_qty::DOUBLE AS output_qty, round(ue, 4) AS unit_energy, round(mu, 4) AS mean, round(sd, 4) AS deviation, round(z, 2) AS z, CASE WHEN ue > mu + 2 * sd THEN 1 ELSE 0 END AS beyond FROM sig""")
def q24(p) -> DataFrame:
    rows = two_sigma(p.unit_days).select(
        "record_date", "workshop_code", "workshop_name", F.col("output_qty").cast("double").alias("output_qty"), F.round("ue", 4).alias("unit_energy"), F.round("mu", 4).alias("mean"), F.round("sd", 4).alias("deviation"), F.round("z", 2).alias("z"),
        F.when(F.expr("ue > mu + 2 * sd"), 1).otherwise(0).alias("beyond"),
    )
    return rows.orderBy("workshop_code", "record_date")


@query("q25_baseline_residuals", """SELECT record_date, workshop_code, workshop_name, output_qty::DOUBLE AS output_qty, round(ue, 4) AS unit_energy, round(yhat, 4) AS expected, round(r, 4) AS residual, round(mu_r, 4) AS mean_residual, round(sd_r, 4) AS deviation, round(z_r, 2) AS z,
CASE WHEN r > mu_r + 2 * sd_r THEN 1 ELSE 0 END AS beyond, CASE WHEN ue > mu_u + 2 * sd_u THEN 1 ELSE 0 END AS beyond_fixed FROM base""")
def q25(p) -> DataFrame:
    digits = {"unit_energy": ("ue", 4), "expected": ("yhat", 4), "residual": ("r", 4), "mean_residual": ("mu_r", 4), "deviation": ("sd_r", 4), "z": ("z_r", 2)}
    rows = p.baseline.select(
        "record_date", "workshop_code", "workshop_name", F.col("output_qty").cast("double").alias("output_qty"), *((F.round(c, n) + 0.0).alias(a) for a, (c, n) in digits.items()),
        F.when(F.expr("r > mu_r + 2 * sd_r"), 1).otherwise(0).alias("beyond"), F.when(F.expr("ue > mu_u + 2 * sd_u"), 1).otherwise(0).alias("beyond_fixed"),
    )
    return rows.orderBy("workshop_code", "record_date")


@query("q26_three_methods", """k AS (SELECT c.*, CASE WHEN d.is_holiday = 1 THEN 1 ELSE 0 END AS hol, CASE WHEN ue > mu_u + 2 * sd_u THEN 1 ELSE 0 END AS f, CASE WHEN r > mu_r + 2 * sd_r THEN 1 ELSE 0 END AS b,
CASE WHEN is_alarm = 1 AND coalesce(lag(is_alarm) OVER (PARTITION BY workshop_code ORDER BY record_date), 0) = 0 THEN 1 ELSE 0 END AS seg FROM cus c JOIN dim_calendar d ON d.calendar_date = c.record_date)
SELECT workshop_code, max(workshop_name) AS workshop_name, count(*) AS days, sum(f)::BIGINT AS fixed_hits, sum(b)::BIGINT AS baseline_hits, sum(is_alarm)::BIGINT AS cusum_days, sum(seg)::BIGINT AS cusum_segments, count(CASE WHEN alarm_side = '偏高' THEN 1 END) AS cusum_high, count(CASE WHEN alarm_side = '偏低' THEN 1 END) AS cusum_low,
sum(f * b)::BIGINT AS both_hits, sum(f * (1 - b))::BIGINT AS fixed_only, sum((1 - f) * b)::BIGINT AS baseline_only, round(100 * sum(f * (1 - b)) / nullif(sum(f), 0), 1) AS fixed_only_pct, sum(f * hol)::BIGINT AS fixed_holiday, sum(b * hol)::BIGINT AS baseline_holiday, sum(is_alarm * hol)::BIGINT AS cusum_holiday,
round(100 * sum(f * hol) / nullif(sum(f), 0), 1) AS fixed_holiday_pct, round(100 * sum(b * hol) / nullif(sum(b), 0), 1) AS baseline_holiday_pct, round(100 * sum(is_alarm * hol) / nullif(sum(is_alarm), 0), 1) AS cusum_holiday_pct, round(max(sd_u), 4) AS fixed_sigma, round(max(sd_r), 4) AS residual_sigma,
round(max(sd_r) / nullif(max(sd_u), 0), 4) AS noise_ratio, round(max(greatest(s_hi_raw, s_lo_raw)), 2) AS max_s_raw, round(max(greatest(s_hi, s_lo)), 2) AS max_s FROM k GROUP BY 1""")
def q26(p) -> DataFrame:
    k = p.cusum.join(F.broadcast(p.calendar.select(F.col("calendar_date").alias("record_date"), "is_holiday")), "record_date")
    before = F.coalesce(F.lag("is_alarm").over(Window.partitionBy("workshop_code").orderBy("record_date")), F.lit(0))
    k = k.withColumns({
        "f": F.expr("int(ue > mu_u + 2 * sd_u)"), "b": F.expr("int(r > mu_r + 2 * sd_r)"), "hol": F.col("is_holiday"), "seg": ((F.col("is_alarm") == 1) & (before == 0)).cast("int")
    })
    n = lambda e: F.sum(F.expr(e)).cast("long")
    pct = lambda a, b: F.round(100 * ratio(F.sum(F.expr(a)), F.sum(F.expr(b))), 1)
    return k.groupBy("workshop_code").agg(
        F.max("workshop_name").alias("workshop_name"), F.count("*").alias("days"), n("f").alias("fixed_hits"), n("b").alias("baseline_hits"), n("is_alarm").alias("cusum_days"), n("seg").alias("cusum_segments"),
        F.count(F.when(F.col("alarm_side") == "偏高", 1)).alias("cusum_high"), F.count(F.when(F.col("alarm_side") == "偏低", 1)).alias("cusum_low"), n("f * b").alias("both_hits"), n("f * (1 - b)").alias("fixed_only"), n("(1 - f) * b").alias("baseline_only"),
        pct("f * (1 - b)", "f").alias("fixed_only_pct"), n("f * hol").alias("fixed_holiday"), n("b * hol").alias("baseline_holiday"), n("is_alarm * hol").alias("cusum_holiday"), pct("f * hol", "f").alias("fixed_holiday_pct"),
        pct("b * hol", "b").alias("baseline_holiday_pct"), pct("is_alarm * hol", "is_alarm").alias("cusum_holiday_pct"), F.round(F.max("sd_u"), 4).alias("fixed_sigma"), F.round(F.max("sd_r"), 4).alias("residual_sigma"),
        F.round(F.try_divide(F.max("sd_r"), F.max("sd_u")), 4).alias("noise_ratio"), F.round(F.max(F.greatest("s_hi_raw", "s_lo_raw")), 2).alias("max_s_raw"), F.round(F.max(F.greatest("s_hi", "s_lo")), 2).alias("max_s"),
    ).orderBy("workshop_code")


@query("q27_cusum_series", """SELECT record_date, workshop_code, workshop_name, round(z_w, 3) AS z, round(s_hi, 3) AS s_high, round(s_lo, 3) AS s_low, round(s_hi_raw, 3) AS s_high_raw, round(s_lo_raw, 3) AS s_low_raw, h::DOUBLE AS h, is_alarm, alarm_side FROM cus""")
def q27(p) -> DataFrame:
    three = {"z": "z_w", "s_high": "s_hi", "s_low": "s_lo", "s_high_raw": "s_hi_raw", "s_low_raw": "s_lo_raw"}
    return p.cusum.select("record_date", "workshop_code", "workshop_name", *((F.round(c, 3) + 0.0).alias(a) for a, c in three.items()), "h", "is_alarm", "alarm_side").orderBy("workshop_code", "record_date")


def workshop_day_cube(p) -> DataFrame:
    d = p.enriched.groupBy("record_date", "workshop_code", "workshop_name", "process_type", day_type("节假日", "周末", "工作日").alias("day_type")).agg(
        F.min("is_production_day").alias("is_production_day"), F.sum("std_coal_kgce").alias("e"), F.sum("cost").alias("c"), F.sum("co2_kg").alias("k")
    )
    return d.join(p.production, ["record_date", "workshop_code"], "left").select(
        "record_date", "workshop_code", "workshop_name", "process_type", "day_type", "is_production_day", F.round(thousandth(F.col("e")), 6).cast("double").alias("tce"), F.col("c").cast("double").alias("cost"),
        F.round(thousandth(F.col("k")), 6).cast("double").alias("co2_t"), F.col("output_qty").cast("double").alias("output_qty"), F.round(ratio(F.col("e"), F.col("output_qty")), 4).alias("unit_energy"),
    )


_CUBE = """cube AS (SELECT d.record_date, d.workshop_code, d.workshop_name, d.process_type, day_type, prod AS is_production_day, (e::DECIMAL(28,3) * 0.001::DECIMAL(4,3))::DOUBLE AS tce, c::DOUBLE AS cost, (k::DECIMAL(28,3) * 0.001::DECIMAL(4,3))::DOUBLE AS co2_t, output_qty::DOUBLE AS output_qty,
round(e::DOUBLE / nullif(output_qty::DOUBLE, 0), 4) AS unit_energy FROM (SELECT record_date, workshop_code, workshop_name, process_type, CASE WHEN is_holiday = 1 THEN '节假日' WHEN is_weekend = 1 THEN '周末' ELSE '工作日' END AS day_type, min(is_production_day) AS prod, sum(std_coal_kgce) AS e, sum(cost) AS c, sum(co2_kg) AS k FROM v GROUP BY ALL) d
LEFT JOIN production p USING (record_date, workshop_code))
"""


@query("q28_workshop_day_cube", _CUBE + "SELECT * FROM cube")
def q28(p) -> DataFrame:
    return workshop_day_cube(p).orderBy("workshop_code", "record_date")


@query("q29_workshop_energy_day_cube", """SELECT record_date, workshop_code, energy_code, consumption::DOUBLE AS consumption, (std_coal_kgce * 0.001::DECIMAL(4,3))::DOUBLE AS tce, cost::DOUBLE AS cost, (co2_kg * 0.001::DECIMAL(4,3))::DOUBLE AS co2_t FROM v""")
def q29(p) -> DataFrame:
    g = p.enriched.groupBy("record_date", "workshop_code", "energy_code").agg(F.sum("consumption").cast("double").alias("consumption"), tce(6).alias("tce"), cost().alias("cost"), co2(6).alias("co2_t"))
    return g.orderBy("workshop_code", "energy_code", "record_date")
