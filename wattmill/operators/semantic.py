"""The semantic layer: a catalogue of 36 metrics, compiled to one grouping plan, and the export of all analyses on one pinned snapshot."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattmill.operators import analyses
from wattmill.operators.views import Plant
from wattmill.operators.warehouse import content_hash
from wattmill.plans.catalog import BY_PLANT, ORACLES, query
from wattmill.sources.adapter import UTILITY
from wattmill.staging import new_path, written


@dataclass(frozen=True)
class Metric:
    """A sum of a column of the workshop-day cube, or a ratio of two sums times `scale`; `without` leaves a kind of workshop out. A ratio is of one workshop, as products have units of their own."""

    column: str
    denominator: str | None = None
    scale: float = 1.0
    without: str | None = None


# The catalogue's ids, columns and exclusions.
METRICS = {
    "total_energy_tce": Metric("tce"), "net_energy_tce": Metric("tce", without=UTILITY), "energy_intensity_kgce": Metric("tce", "output_qty", 1000.0, UTILITY), "total_cost_yuan": Metric("cost"),
    "net_cost_yuan": Metric("cost", without=UTILITY), "total_carbon_tco2": Metric("co2_t"), "net_carbon_tco2": Metric("co2_t", without=UTILITY),
}
#: Whole results by the analyses' numbers: they take no filter and aren't aggregated again.
RESULTS = {f"analysis_Q{name[1:3]}": name for name in sorted(BY_PLANT) if name[0] == "q" and name[1:3].isdigit()}


def metric_values(cube: DataFrame, names: Sequence[str] = tuple(METRICS), first: str | None = None, last: str | None = None, workshop: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """`by`, metric, value, n_rows, problem: all metrics asked for from one aggregate over the cube, which is read once.

    The value is null without rows or where the denominator is 0, and where there is a problem: `invalid_values` (negative or not finite), `several_workshops` for a ratio.
    """
    if unknown := [n for n in names if n not in METRICS]:
        raise KeyError(unknown[0])
    rows = cube
    if first:
        rows = rows.filter(F.col("record_date") >= F.to_date(F.lit(first)))
    if last:
        rows = rows.filter(F.col("record_date") <= F.to_date(F.lit(last)))
    if workshop:
        rows = rows.filter(F.col("workshop_code") == workshop)

    def parts(m: Metric) -> Column:
        inside = F.lit(True) if m.without is None else F.coalesce(F.col("process_type") != m.without, F.lit(True))
        columns = [c for c in (m.column, m.denominator) if c]
        bad = lambda c: F.isnan(c) | (F.col(c) < 0) | (F.col(c) == float("inf"))
        wrong = reduce(lambda a, b: a | b, (F.coalesce(bad(c), F.lit(False)) for c in columns))
        total = lambda c: F.sum(F.when(inside & ~wrong, F.col(c).cast("decimal(30,8)"))).cast("double") if c else F.lit(None).cast("double")
        return F.struct(total(m.column).alias("a"), total(m.denominator).alias("b"), F.count_if(inside).alias("n_rows"), F.count_if(inside & wrong).alias("wrong"), F.count_distinct(F.when(inside, F.col("workshop_code"))).alias("workshops"))

    summed = rows.groupBy(*by).agg(*(parts(METRICS[n]).alias(n) for n in names))
    named = [F.struct(F.lit(n).alias("metric"), F.lit(METRICS[n].denominator is not None).alias("is_ratio"), F.lit(METRICS[n].scale).alias("scale"), F.col(n).alias("p")) for n in names]
    told = summed.select(*by, F.explode(F.array(*named)).alias("m")).select(*by, "m.metric", "m.is_ratio", "m.scale", "m.p.*")
    problem = F.when(F.col("wrong") > 0, "invalid_values").when(F.col("is_ratio") & (F.col("workshops") > 1), "several_workshops")
    value = F.when(F.col("is_ratio"), F.try_divide(F.col("a") * F.col("scale"), F.col("b"))).otherwise(F.col("a"))
    return told.select(*by, "metric", F.when(problem.isNull(), value).alias("value"), "n_rows", problem.alias("problem"))


def result_of(p: Plant, name: str, first: str | None = None, last: str | None = None, workshop: str | None = None) -> DataFrame:
    """A whole result of the catalogue by its name."""
    if name not in RESULTS:
        raise KeyError(name)
    if first or last or workshop:
        raise ValueError(f"{name} is a whole result and takes no filter: it must be computed again for another scope")
    return BY_PLANT[RESULTS[name]](p)


def pinned(p: Plant) -> Plant:
    """The plant on copies of its facts as they are now, so that all that is derived from it is of one state."""
    held = Plant(p.spark, p.sf_dir)
    for name in ("energy", "production"):
        held.__dict__[name] = written(getattr(p, name), f"pinned-{name}")
    return held


def export_all(p: Plant, path: str, names: Sequence[str] | None = None) -> DataFrame:
    """Every analysis of the catalogue as a Parquet folder of its name under `path`, which must not be there yet, all on one pinned snapshot; the manifest, read from what was written:
    query, columns with types, rows, order-free content hash, and the snapshot's hash."""
    spark = p.spark
    try:
        spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
    else:
        raise FileExistsError(f"an export needs a new folder: {path}")
    held = pinned(p)
    snapshot = held.energy.agg(content_hash(held.energy, "snapshot_hash"))
    rows = []
    for name in names or RESULTS.values():
        BY_PLANT[name](held).write.parquet(f"{path}/{name}")
        frame = spark.read.parquet(f"{path}/{name}")
        kinds = ",".join(f"{f.name} {f.dataType.simpleString()}" for f in frame.schema)
        rows.append(frame.agg(F.count("*").alias("n_rows"), content_hash(frame)).select(F.lit(name).alias("query"), F.lit(kinds).alias("columns"), "n_rows", "content_hash"))
    manifest = reduce(DataFrame.unionByName, rows).join(F.broadcast(snapshot))  # one row
    manifest.write.parquet(f"{path}/manifest")
    return spark.read.parquet(f"{path}/manifest")


_VALUES = """c AS (SELECT e.record_date, e.workshop_code, process_type, sum(std_coal_kgce)::DOUBLE / 1000 AS tce, sum(cost)::DOUBLE AS cost, sum(co2_kg)::DOUBLE / 1000 AS co2_t, any_value(output_qty)::DOUBLE AS output_qty FROM v e LEFT JOIN production p USING (record_date, workshop_code) GROUP BY ALL),
m AS (SELECT * FROM (VALUES ('total_energy_tce', 'tce', false), ('net_energy_tce', 'tce', true), ('energy_intensity_kgce', 'ratio', true), ('total_cost_yuan', 'cost', false), ('net_cost_yuan', 'cost', true), ('total_carbon_tco2', 'co2_t', false), ('net_carbon_tco2', 'co2_t', true)) t(metric, col, net)),
s AS (SELECT *, CASE col WHEN 'tce' THEN tce WHEN 'ratio' THEN tce WHEN 'cost' THEN cost ELSE co2_t END AS x FROM c, m WHERE NOT (net AND process_type = '公用工程'))
"""


@query("r12_catalogue_values", _VALUES + "SELECT metric, CASE WHEN col <> 'ratio' THEN sum(x) END AS value, count(*) AS n_rows, CASE WHEN col = 'ratio' THEN 'several_workshops' END AS problem FROM s WHERE record_date BETWEEN DATE '2024-03-01' AND DATE '2025-06-30' GROUP BY metric, col")
def r_values(p: Plant) -> DataFrame:
    """All sums and ratios of the catalogue for a span of days, from one scan; the ratio is refused, as it spans workshops."""
    return metric_values(analyses.workshop_day_cube(p), first="2024-03-01", last="2025-06-30")


@query("r12_catalogue_by_workshop", _VALUES + "SELECT workshop_code, metric, CASE WHEN col = 'ratio' THEN sum(x) * 1000 / nullif(sum(output_qty), 0) ELSE sum(x) END AS value, count(*) AS n_rows, NULL::VARCHAR AS problem FROM s GROUP BY workshop_code, metric, col UNION ALL SELECT workshop_code, metric, NULL, 0, NULL FROM (SELECT DISTINCT workshop_code FROM c WHERE process_type = '公用工程'), m WHERE net")
def r_by_workshop(p: Plant) -> DataFrame:
    return metric_values(analyses.workshop_day_cube(p), by=("workshop_code",))


@query("o28_export_all", "\nUNION ALL ".join(f"SELECT '{name}' AS \"query\", (SELECT count(*) FROM ({ORACLES[name]})) AS n_rows" for name in RESULTS.values()), "")
def o_export(p: Plant) -> DataFrame:
    """The manifest of all 29 analyses."""
    return export_all(p, new_path(p.spark, "export")).select("query", "n_rows")
