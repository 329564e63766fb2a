"""The plant's star schema, read from the driver's order tables.

`lineitem` plays the meter records and `orders` the production reports: ship and order dates fold into the 731 days of 2024 and 2025,
suppliers and customers into eight workshops, parts into six energies. Additive measures are decimals, so sums don't depend on their order.
`ORACLE` says the same in DuckDB SQL, as common table expressions.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the plant: workshops, energies with coal and carbon factors and reference prices, public holidays.
WORKSHOPS = (
    ("W01", "熔炼车间", "熔炼", 1, "吨"),
    ("W02", "轧制车间", "轧制", 1, "吨"),
    ("W03", "热处理车间", "热处理", 1, "吨"),
    ("W04", "机加工车间", "机加工", 0, "件"),
    ("W05", "表面处理车间", "表面处理", 0, "平方米"),
    ("W06", "装配车间", "装配", 0, "台"),
    ("W07", "动力站", "公用工程", 1, "吨蒸汽"),
    ("W08", "包装车间", "包装", 0, "件"),
)
ENERGIES = (
    ("E01", "电力", "kWh", "0.1229", "0.5703", "0.6800"),
    ("E02", "天然气", "m³", "1.3300", "2.1622", "3.4500"),
    ("E03", "蒸汽", "t", "95.7000", "260.0000", "220.0000"),
    ("E04", "工业水", "m³", "0.2429", "0.3440", "4.1000"),
    ("E05", "压缩空气", "m³", "0.0400", "0.0000", "0.2800"),
    ("E06", "柴油", "kg", "1.4571", "3.0959", "7.8500"),
)
HOLIDAYS = (
    ("元旦", "2024-01-01", "2024-01-01"), ("春节", "2024-02-10", "2024-02-17"), ("清明节", "2024-04-04", "2024-04-06"), ("劳动节", "2024-05-01", "2024-05-05"),
    ("端午节", "2024-06-08", "2024-06-10"), ("中秋节", "2024-09-15", "2024-09-17"), ("国庆节", "2024-10-01", "2024-10-07"), ("元旦", "2025-01-01", "2025-01-01"),
    ("春节", "2025-01-28", "2025-02-04"), ("清明节", "2025-04-04", "2025-04-06"), ("劳动节", "2025-05-01", "2025-05-05"), ("端午节", "2025-05-31", "2025-06-02"),
    ("国庆节/中秋节", "2025-10-01", "2025-10-08"),
)
UTILITY = "公用工程"
FIRST_DAY, DAYS = "2024-01-01", 731


def folded(day: Column) -> Column:
    """Any date as one of the plant's days."""
    return F.date_add(F.to_date(F.lit(FIRST_DAY)), F.pmod(F.datediff(F.to_date(day), F.to_date(F.lit("1992-01-01"))), F.lit(DAYS)).cast("int"))


def coded(prefix: str, key: Column, n: int) -> Column:
    return F.concat(F.lit(prefix), (F.pmod(key, F.lit(n)) + 1).cast("string"))


def calendar(spark: SparkSession, covering: DataFrame | None = None, holidays=HOLIDAYS) -> DataFrame:
    """The calendar dimension: one row a day, ISO weekdays, weekends and holidays by range.

    It spans the plant's days and, with `covering` (a frame with one date column), reaches to that column's first and last day, so that no fact
    lies outside. Without dates there it spans the plant's days.
    """
    first, last = F.to_date(F.lit(FIRST_DAY)), F.date_add(F.to_date(F.lit(FIRST_DAY)), DAYS - 1)
    if covering is None:
        limits = spark.range(1).select(first.alias("low"), last.alias("high"))
    else:
        day = F.col(covering.columns[0]).cast("date")
        limits = covering.agg(F.least(F.min(day), first).alias("low"), F.greatest(F.max(day), last).alias("high"))
    days = limits.select(F.explode(F.sequence("low", "high")).alias("calendar_date"))
    name = F.lit(None).cast("string")
    for holiday, low, high in reversed(holidays):
        name = F.when(F.col("calendar_date").between(F.to_date(F.lit(low)), F.to_date(F.lit(high))), holiday).otherwise(name)
    iso = F.weekday("calendar_date") + 1
    return days.select(
        "calendar_date", F.year("calendar_date").alias("year"), F.quarter("calendar_date").alias("quarter"), F.month("calendar_date").alias("month"), F.date_format("calendar_date", "yyyy-MM").alias("year_month"),
        iso.alias("day_of_week"), F.date_format("calendar_date", "EEEE").alias("weekday_name"), (iso >= 6).cast("int").alias("is_weekend"), name.alias("holiday_name"), name.isNotNull().cast("int").alias("is_holiday"),
    )


def day_conditions() -> tuple[Column, Column]:
    """Whether a workshop produces on a day, and the day's temperature, both from `record_date` and `workshop_code`."""
    n, doy = F.substring("workshop_code", 3, 1).cast("int"), F.dayofyear("record_date")
    return F.when((doy + n * 5) % 13 == 0, 0).otherwise(1), F.when(doy % 50 == 0, None).otherwise(F.round(15 - 17 * F.cos(2 * F.pi() * doy / 365.0), 1))


class Star:
    """Facts and dimensions of one folder of tables, each built once."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def workshops(self) -> DataFrame:
        return self.spark.createDataFrame(list(WORKSHOPS), "workshop_code string, workshop_name string, process_type string, is_continuous int, output_unit string")

    @cached_property
    def energies(self) -> DataFrame:
        rows = self.spark.createDataFrame(list(ENERGIES), "energy_code string, energy_name string, unit string, coal string, co2 string, price string")
        return rows.select("energy_code", "energy_name", "unit", *(F.col(c).cast("decimal(10,4)").alias(n) for c, n in (("coal", "std_coal_factor"), ("co2", "co2_factor"), ("price", "reference_price"))))

    @cached_property
    def calendar(self) -> DataFrame:
        return calendar(self.spark)

    @cached_property
    def records(self) -> DataFrame:
        """Meter records before anything is merged: versions of keys with a time stamp and a tombstone flag."""
        return self.table("lineitem").select(
            folded(F.col("l_shipdate")).alias("record_date"),
            coded("W0", F.col("l_suppkey"), 8).alias("workshop_code"),
            coded("E0", F.col("l_partkey"), 6).alias("energy_code"),
            F.col("l_quantity").cast("decimal(16,3)").alias("consumption"),
            F.round(F.col("l_extendedprice").cast("decimal(12,2)") * (1 - F.col("l_discount").cast("decimal(4,2)")), 4).cast("decimal(16,4)").alias("cost"),
            (F.col("l_tax").cast("decimal(4,2)") * 10).cast("decimal(12,4)").alias("unit_price"),
            F.col("l_shipdate").cast("timestamp").alias("updated_at"),
            (F.col("l_returnflag") == "R").cast("int").alias("is_deleted"),
            ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 1009 + (F.col("l_partkey") * 7 + F.col("l_suppkey")) % 1009).alias("source_id"),
        )

    @cached_property
    def energy(self) -> DataFrame:
        """fact_energy_consumption: one clean, live row per day, workshop and energy."""
        rows = self.records.groupBy("record_date", "workshop_code", "energy_code").agg(
            F.sum("consumption").cast("decimal(16,3)").alias("consumption"), F.round(F.sum("cost"), 2).cast("decimal(16,2)").alias("cost"), F.max("updated_at").alias("updated_at")
        )
        production_day, temperature = day_conditions()
        return rows.select("*", production_day.alias("is_production_day"), temperature.alias("avg_temperature"), F.lit(0).alias("is_deleted"))

    @cached_property
    def production(self) -> DataFrame:
        """fact_production; days without orders are missing."""
        qty = F.round(F.sum(F.col("o_totalprice").cast("decimal(14,2)")) * F.lit("0.001").cast("decimal(4,3)"), 3).cast("decimal(16,3)")
        return self.table("orders").groupBy(folded(F.col("o_orderdate")).alias("record_date"), coded("W0", F.col("o_custkey"), 8).alias("workshop_code")).agg(qty.alias("output_qty"))


def _values(rows, names) -> str:
    quoted = ", ".join("(" + ", ".join(str(v) if isinstance(v, int) else f"'{v}'" for v in row) + ")" for row in rows)
    return f"(SELECT * FROM (VALUES {quoted}) v({names}))"


_FOLD = f"(DATE '{FIRST_DAY}' + CAST(date_diff('day', DATE '1992-01-01', CAST({{}} AS DATE)) % {DAYS} AS INTEGER))"
ORACLE = f"""
WITH dim_workshop AS {_values(WORKSHOPS, "workshop_code, workshop_name, process_type, is_continuous, output_unit")},
dim_energy AS (SELECT energy_code, energy_name, unit, CAST(coal AS DECIMAL(10,4)) AS std_coal_factor, CAST(co2 AS DECIMAL(10,4)) AS co2_factor, CAST(price AS DECIMAL(10,4)) AS reference_price
    FROM {_values(ENERGIES, "energy_code, energy_name, unit, coal, co2, price")}),
holiday AS {_values(HOLIDAYS, "holiday_name, low, high")},
dim_calendar AS (SELECT calendar_date, year(calendar_date) AS year, quarter(calendar_date) AS quarter, month(calendar_date) AS month, strftime(calendar_date, '%Y-%m') AS year_month, isodow(calendar_date) AS day_of_week, dayname(calendar_date) AS weekday_name,
    CASE WHEN isodow(calendar_date) >= 6 THEN 1 ELSE 0 END AS is_weekend, holiday_name, CASE WHEN holiday_name IS NULL THEN 0 ELSE 1 END AS is_holiday
    FROM (SELECT CAST(range AS DATE) AS calendar_date FROM range(TIMESTAMP '2024-01-01', TIMESTAMP '2026-01-01', INTERVAL 1 DAY)) LEFT JOIN holiday ON calendar_date BETWEEN CAST(low AS DATE) AND CAST(high AS DATE)),
records AS (SELECT {_FOLD.format("l_shipdate")} AS record_date, 'W0' || (l_suppkey % 8 + 1) AS workshop_code, 'E0' || (l_partkey % 6 + 1) AS energy_code, CAST(l_quantity AS DECIMAL(16,3)) AS consumption,
    CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))) AS DECIMAL(16,4)) AS cost, CAST(CAST(l_tax AS DECIMAL(4,2)) * 10 AS DECIMAL(12,4)) AS unit_price, l_shipdate AS updated_at, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS is_deleted, (l_orderkey * 10 + l_linenumber) * 1009 + (l_partkey * 7 + l_suppkey) % 1009 AS source_id FROM lineitem),
energy0 AS (SELECT record_date, workshop_code, energy_code, CAST(sum(consumption) AS DECIMAL(16,3)) AS consumption, CAST(round(sum(cost), 2) AS DECIMAL(16,2)) AS cost, max(updated_at) AS updated_at FROM records GROUP BY ALL),
energy AS (SELECT *, CASE WHEN (dayofyear(record_date) + CAST(substr(workshop_code, 3, 1) AS INTEGER) * 5) % 13 = 0 THEN 0 ELSE 1 END AS is_production_day,
    CASE WHEN dayofyear(record_date) % 50 = 0 THEN NULL ELSE round(15 - 17 * cos(2 * pi() * dayofyear(record_date) / 365e0), 1) END AS avg_temperature, 0 AS is_deleted FROM energy0),
production AS (SELECT {_FOLD.format("o_orderdate")} AS record_date, 'W0' || (o_custkey % 8 + 1) AS workshop_code, CAST(round(sum(CAST(o_totalprice AS DECIMAL(14,2))) * 0.001::DECIMAL(4,3), 3) AS DECIMAL(16,3)) AS output_qty FROM orders GROUP BY ALL)"""
