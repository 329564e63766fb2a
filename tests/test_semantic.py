"""The catalogue's metrics on a hand-made cube, refusals, and exports of one snapshot."""

import datetime as dt

import pytest

from tests.conftest import DATA
from wattmill.operators import semantic
from wattmill.operators.views import Plant
from wattmill.sources.adapter import UTILITY

CUBE = "record_date date, workshop_code string, process_type string, tce double, cost double, co2_t double, output_qty double"


def cube(spark, *rows):
    return spark.createDataFrame([(dt.date(2024, 1, d), w, UTILITY if w == "W07" else "x", t, t * 10, t * 2, q) for d, w, t, q in rows], CUBE)


def values(frame):
    return {r.metric: (r.value, r.n_rows, r.problem) for r in frame.collect()}


def test_catalogue_has_its_36_metrics():
    assert len(semantic.METRICS) == 7 and list(semantic.RESULTS) == [f"analysis_Q{n:02d}" for n in range(1, 30)]


def test_sums_ratios_and_problems(spark):
    rows = cube(spark, (1, "W01", 2.0, 4.0), (2, "W01", 3.0, None), (1, "W07", 5.0, None), (3, "W02", 1.0, 0.0))
    got = values(semantic.metric_values(rows))
    assert got["total_energy_tce"] == (11.0, 4, None) and got["net_cost_yuan"] == (60.0, 3, None) and got["energy_intensity_kgce"] == (None, 3, "several_workshops")
    one = values(semantic.metric_values(rows, workshop="W01"))
    assert one["energy_intensity_kgce"] == (1250.0, 2, None) and one["net_carbon_tco2"] == (10.0, 2, None)
    assert values(semantic.metric_values(rows, workshop="W02"))["energy_intensity_kgce"] == (None, 1, None)  # nothing was made
    assert values(semantic.metric_values(rows, workshop="W07"))["net_energy_tce"] == (None, 0, None)
    assert values(semantic.metric_values(rows, first="2024-01-02", last="2024-01-02"))["total_cost_yuan"] == (30.0, 1, None)
    assert values(semantic.metric_values(rows, ["total_cost_yuan"], first="2030-01-01")) == {"total_cost_yuan": (None, 0, None)}


@pytest.mark.parametrize("bad", [-1.0, float("nan"), float("inf")])
def test_values_that_no_measure_has(spark, bad):
    got = values(semantic.metric_values(cube(spark, (1, "W01", bad, 1.0), (1, "W07", 1.0, None))))
    assert got["total_energy_tce"] == (None, 2, "invalid_values") and got["net_energy_tce"][2] == "invalid_values"
    utility = values(semantic.metric_values(cube(spark, (1, "W07", bad, 1.0), (1, "W01", 1.0, 2.0))))
    assert utility["net_energy_tce"] == (1.0, 1, None) and utility["total_energy_tce"][2] == "invalid_values"


def test_one_scan(spark):
    plan = semantic.metric_values(cube(spark, (1, "W01", 2.0, 4.0)))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") + plan.count("LocalRelation") == 1


def test_refusals(spark):
    p = Plant(spark, DATA)
    with pytest.raises(KeyError):
        semantic.metric_values(cube(spark), ["unknown"])
    with pytest.raises(KeyError):
        semantic.result_of(p, "analysis_Q30")
    with pytest.raises(ValueError):
        semantic.result_of(p, "analysis_Q03", workshop="W01")
    assert semantic.result_of(p, "analysis_Q03").count() > 0


def test_exports_of_one_state_are_alike(spark, tmp_path):
    names = ["q03_workshop_ranking", "q04_energy_mix"]
    first, again = (sorted(map(str, semantic.export_all(Plant(spark, DATA), str(tmp_path / n), names).collect())) for n in ("a", "b"))
    assert first == again and len(first) == 2 and "workshop_code string" in " ".join(first)
    with pytest.raises(FileExistsError):
        semantic.export_all(Plant(spark, DATA), str(tmp_path / "a"), names)
