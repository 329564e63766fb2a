"""The derived views: enriched records, workshop days and months, the unit-energy baseline and its CUSUM."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattmill.operators.scans import cusums
from wattmill.sources.adapter import ORACLE, UTILITY, Star
from wattmill.staging import written

SLACK, LIMIT = 0.5, 9.9


def thousandth(x: Column) -> Column:
    """An exact thousandth of a decimal."""
    return x * F.lit("0.001").cast("decimal(4,3)")


def ratio(a: Column, b: Column) -> Column:
    """a / b as doubles; null where b is 0 or null."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def enriched(energy: DataFrame, workshops: DataFrame, energies: DataFrame, calendar: DataFrame) -> DataFrame:
    """Live records with their dimensions, standard coal and carbon. The dimensions are small tables of fixed size."""
    live = energy.filter("is_deleted = 0")
    joined = live.join(F.broadcast(energies), "energy_code").join(F.broadcast(workshops), "workshop_code").join(F.broadcast(calendar), live.record_date == calendar.calendar_date)
    factor = lambda f: F.round(F.col("consumption") * F.col(f), 3).cast("decimal(18,3)")
    return joined.withColumns({"std_coal_kgce": factor("std_coal_factor"), "co2_kg": factor("co2_factor")}).drop("calendar_date")


def workshop_days(rows: DataFrame, *extra_keys: str) -> DataFrame:
    return rows.groupBy(*extra_keys, "record_date", "year_month", "workshop_code", "workshop_name", "process_type").agg(
        F.round(thousandth(F.sum("std_coal_kgce")), 4).cast("decimal(18,4)").alias("tce"),
        F.round(thousandth(F.sum("co2_kg")), 3).cast("decimal(18,3)").alias("co2_t"),
        F.sum("cost").cast("decimal(18,2)").alias("cost_yuan"),
        F.max((F.col("is_production_day") == 0).cast("int")).alias("has_shutdown"),
        F.avg("avg_temperature").alias("avg_temperature"),
    )


def workshop_months(days: DataFrame, production: DataFrame, workshops: DataFrame) -> DataFrame:
    """Monthly sums; unit energy and cost where something was produced."""
    rows = days.join(production, ["record_date", "workshop_code"], "left").join(F.broadcast(workshops.select("workshop_code", "output_unit")), "workshop_code")
    sums = rows.groupBy("year_month", "workshop_code", "workshop_name", "process_type", "output_unit").agg(
        F.sum("tce").alias("tce"), F.sum("co2_t").alias("co2_t"), F.sum("cost_yuan").alias("cost_yuan"), F.sum("output_qty").alias("output_qty")
    )
    per = lambda x, n, k=1: F.when(F.col("output_qty") > 0, F.round(ratio(F.col(x), F.col("output_qty")) * k, n))
    return sums.withColumns({"unit_energy_kgce": per("tce", 5, 1000), "unit_cost_yuan": per("cost_yuan", 4)})


def unit_energy_days(days: DataFrame, production: DataFrame) -> DataFrame:
    """Days with output of workshops that make products, and their energy per unit `ue`."""
    rows = days.filter(F.col("process_type") != UTILITY).join(production.filter("output_qty > 0"), ["record_date", "workshop_code"])
    return rows.select("record_date", "workshop_code", "workshop_name", "tce", "output_qty", (F.col("tce").cast("double") * 1000 / F.col("output_qty").cast("double")).alias("ue"))


def baseline(unit_days: DataFrame, keys: tuple[str, ...] = ("workshop_code",)) -> DataFrame:
    """Expected unit energy by 1/output and season, per workshop, from one pass of centred moments; residual, whitened residual, their z values.

    The slope on 1/output is fitted alone, those on the season's sine and cosine together; a group whose moments can't be solved has none.
    """
    angle = 2 * F.pi() * F.dayofyear("record_date") / 365.0
    d = unit_days.withColumns({"x": 1.0 / F.col("output_qty").cast("double"), "s": F.sin(angle), "c": F.cos(angle)})
    means = {f"mean_{c}": F.avg(c) for c in ("x", "s", "c", "ue")}
    spread = {"x": F.var_pop("x"), "s": F.var_pop("s"), "c": F.var_pop("c"), "sc": F.covar_pop("s", "c")} | {f"{c}_ue": F.covar_pop(c, "ue") for c in ("x", "s", "c")}
    m = d.groupBy(*keys).agg(*(v.alias(k) for k, v in means.items()), *(v.alias(f"m_{k}") for k, v in spread.items()))
    season = F.expr("m_s * m_c - m_sc * m_sc")
    m = m.withColumns({
        "b": F.when(F.col("m_x") > 0, F.col("m_x_ue") / F.col("m_x")), "g": F.when(season > 0, F.expr("m_s_ue * m_c - m_c_ue * m_sc") / season), "h": F.when(season > 0, F.expr("m_c_ue * m_s - m_s_ue * m_sc") / season),
    })
    m = m.select(*keys, "b", "g", "h", F.expr("mean_ue - b * mean_x - g * mean_s - h * mean_c").alias("a"))
    fitted = d.join(m, list(keys)).withColumn("yhat", F.expr("a + b * x + g * s + h * c"))
    resid = fitted.withColumn("r", F.col("ue") - F.col("yhat"))
    # means and spreads of residuals, of residuals less their month's mean, and of unit energy: from moments by month, a dozen rows a group
    by = Window.partitionBy(*keys)
    month = F.month("record_date")
    stats = resid.groupBy(*keys, month.alias("_month")).agg(*(f(c).alias(f"{name}_{c}") for c in ("r", "ue") for name, f in (("n", F.count), ("m", F.avg), ("v", F.var_pop))))

    total = lambda c: F.sum(f"n_{c}").over(by)
    stats = stats.withColumns({f"middle_{c}": F.try_divide(F.sum(F.col(f"n_{c}") * F.col(f"m_{c}")).over(by), total(c)) for c in ("r", "ue")})
    around = lambda c: F.col(f"v_{c}") + (F.col(f"m_{c}") - F.col(f"middle_{c}")) * (F.col(f"m_{c}") - F.col(f"middle_{c}"))
    spread = lambda c, square: F.sqrt(F.try_divide(F.sum(F.col(f"n_{c}") * square).over(by), F.nullif(total(c) - 1, F.lit(0))))
    found = {"mu_r": F.col("middle_r"), "sd_r": spread("r", around("r")), "mu_w": F.col("middle_r") * 0.0, "sd_w": spread("r", F.col("v_r")), "mu_u": F.col("middle_ue"), "sd_u": spread("ue", around("ue"))}
    table = stats.select(*keys, "_month", F.col("m_r").alias("_mean"), *(v.alias(k) for k, v in found.items()))
    resid = resid.withColumn("_month", month).join(table, [*keys, "_month"]).withColumn("w", F.col("r") - F.col("_mean"))
    z = {f"z_{k}": F.try_divide(F.col(c) - F.col(f"mu_{k}"), F.col(f"sd_{k}")) for c, k in (("r", "r"), ("w", "w"), ("ue", "u"))}
    return resid.withColumns(z).drop("x", "s", "c", "a", "b", "g", "h", "_month", "_mean")


def cusum(base: DataFrame, keys: tuple[str, ...] = ("workshop_code",), slack: float = SLACK, limit: float = LIMIT) -> DataFrame:
    """Two-sided CUSUM in closed form: running sum less its running minimum, at most 0, by a scan in two levels. High side is named first."""
    terms = {"hi": F.col("z_w") - slack, "lo": -F.col("z_w") - slack, "hi_raw": F.col("z_r") - slack, "lo_raw": -F.col("z_r") - slack}
    s = cusums(base, keys, "record_date", terms)
    over = lambda k: F.col(f"s_{k}") > limit
    return s.withColumns({"h": F.lit(limit), "is_alarm": F.when(over("hi") | over("lo"), 1).otherwise(0), "alarm_side": F.when(over("hi"), "偏高").when(over("lo"), "偏低")})


class Plant(Star):
    """The star schema with its views."""

    @cached_property
    def enriched(self) -> DataFrame:
        return enriched(self.energy, self.workshops, self.energies, self.calendar)

    @cached_property
    def days(self) -> DataFrame:
        return workshop_days(self.enriched)

    @cached_property
    def months(self) -> DataFrame:
        return workshop_months(self.days, self.production, self.workshops)

    @cached_property
    def unit_days(self) -> DataFrame:
        """Written once: the baseline reads them several times."""
        return written(unit_energy_days(self.days, self.production), "unit-days")

    @cached_property
    def baseline(self) -> DataFrame:
        return baseline(self.unit_days)

    @cached_property
    def cusum(self) -> DataFrame:
        return cusum(self.baseline)


VIEWS = (
    ORACLE
    + """,
v AS (SELECT e.*, w.workshop_name, w.process_type, w.is_continuous, w.output_unit, t.energy_name, t.unit, t.reference_price, c.year, c.month, c.year_month, c.is_weekend, c.is_holiday, c.holiday_name,
    CAST(round(consumption * std_coal_factor, 3) AS DECIMAL(18,3)) AS std_coal_kgce, CAST(round(consumption * co2_factor, 3) AS DECIMAL(18,3)) AS co2_kg
    FROM energy e JOIN dim_energy t USING (energy_code) JOIN dim_workshop w USING (workshop_code) JOIN dim_calendar c ON c.calendar_date = e.record_date WHERE e.is_deleted = 0),
days AS (SELECT record_date, year_month, workshop_code, workshop_name, process_type, round(CAST(sum(std_coal_kgce) AS DECIMAL(28,3)) * 0.001::DECIMAL(4,3), 4) AS tce,
    round(CAST(sum(co2_kg) AS DECIMAL(28,3)) * 0.001::DECIMAL(4,3), 3) AS co2_t, sum(cost) AS cost_yuan, max(CASE WHEN is_production_day = 0 THEN 1 ELSE 0 END) AS has_shutdown, avg(avg_temperature) AS avg_temperature FROM v GROUP BY ALL),
months AS (SELECT *, CASE WHEN output_qty > 0 THEN round(tce::DOUBLE / output_qty::DOUBLE * 1000, 5) END AS unit_energy_kgce, CASE WHEN output_qty > 0 THEN round(cost_yuan::DOUBLE / output_qty::DOUBLE, 4) END AS unit_cost_yuan FROM (
    SELECT d.year_month, d.workshop_code, d.workshop_name, d.process_type, w.output_unit, sum(d.tce) AS tce, sum(d.co2_t) AS co2_t, sum(d.cost_yuan) AS cost_yuan, sum(p.output_qty) AS output_qty
    FROM days d JOIN dim_workshop w USING (workshop_code) LEFT JOIN production p USING (record_date, workshop_code) GROUP BY ALL)),
unit_days AS (SELECT d.record_date, d.workshop_code, d.workshop_name, d.tce, p.output_qty, d.tce::DOUBLE * 1000 / p.output_qty::DOUBLE AS ue
    FROM days d JOIN production p USING (record_date, workshop_code) WHERE p.output_qty > 0 AND d.process_type <> '公用工程'),
fit_rows AS (SELECT *, 1e0 / output_qty::DOUBLE AS x, sin(2 * pi() * dayofyear(record_date) / 365e0) AS s, cos(2 * pi() * dayofyear(record_date) / 365e0) AS c FROM unit_days),
covs AS (SELECT workshop_code, covar_pop(x, ue) AS xy, var_pop(x) AS xx, var_pop(s) AS ss, var_pop(c) AS cc, covar_pop(s, c) AS sc, covar_pop(s, ue) AS sy, covar_pop(c, ue) AS cy, avg(x) AS mx, avg(s) AS ms, avg(c) AS mc, avg(ue) AS my FROM fit_rows GROUP BY 1),
coef AS (SELECT *, xy / xx AS b, (sy * cc - cy * sc) / (ss * cc - sc * sc) AS g, (cy * ss - sy * sc) / (ss * cc - sc * sc) AS h FROM covs),
resid AS (SELECT r.record_date, workshop_code, workshop_name, tce, output_qty, ue, my - b * mx - g * ms - h * mc + b * x + g * s + h * c AS yhat FROM fit_rows r JOIN coef USING (workshop_code)),
white AS (SELECT *, ue - yhat AS r, ue - yhat - avg(ue - yhat) OVER (PARTITION BY workshop_code, month(record_date)) AS w FROM resid),
base0 AS (SELECT *, avg(r) OVER k AS mu_r, stddev_samp(r) OVER k AS sd_r, avg(w) OVER k AS mu_w, stddev_samp(w) OVER k AS sd_w, avg(ue) OVER k AS mu_u, stddev_samp(ue) OVER k AS sd_u FROM white WINDOW k AS (PARTITION BY workshop_code)),
base AS (SELECT *, (r - mu_r) / nullif(sd_r, 0) AS z_r, (w - mu_w) / nullif(sd_w, 0) AS z_w, (ue - mu_u) / nullif(sd_u, 0) AS z_u FROM base0),
cum AS (SELECT *, sum(z_w - 0.5) OVER k AS c1, sum(-z_w - 0.5) OVER k AS c2, sum(z_r - 0.5) OVER k AS c3, sum(-z_r - 0.5) OVER k AS c4 FROM base WINDOW k AS (PARTITION BY workshop_code ORDER BY record_date ROWS UNBOUNDED PRECEDING)),
cus0 AS (SELECT *, c1 - least(0, min(c1) OVER k) AS s_hi, c2 - least(0, min(c2) OVER k) AS s_lo, c3 - least(0, min(c3) OVER k) AS s_hi_raw, c4 - least(0, min(c4) OVER k) AS s_lo_raw FROM cum
    WINDOW k AS (PARTITION BY workshop_code ORDER BY record_date ROWS UNBOUNDED PRECEDING)),
cus AS (SELECT *, 9.9 AS h, CASE WHEN s_hi > 9.9 OR s_lo > 9.9 THEN 1 ELSE 0 END AS is_alarm, CASE WHEN s_hi > 9.9 THEN '偏高' WHEN s_lo > 9.9 THEN '偏低' END AS alarm_side FROM cus0)"""
)
