"""Operators on hand-made tables with known results."""

import datetime as dt
import itertools
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import DATA
from wattmill.operators import boosting, cleaning, features, hourly, quality, warehouse
from wattmill.operators.views import Plant
from wattmill.plans import registry
from wattmill.sources import adapter, files
from wattmill.streaming import power

DAY = dt.date(2024, 3, 15)


def stamp(h: int) -> dt.datetime:
    return dt.datetime(2024, 3, 15, h)


def test_tombstones_and_invalid_versions_remove_keys(spark):
    rows = [("W01", 1, 9, 0, 10), ("W01", 2, 10, 1, 0), ("W02", 3, 9, 0, 5), ("W02", 4, 10, 0, 7), ("W03", 5, 9, 0, 5), ("W03", 6, 10, 0, -1), ("W04", 7, 11, 0, 1), ("W04", 8, 11, 0, 2)]
    frame = spark.createDataFrame([(DAY, w, "E01", i, stamp(h), d, Decimal(1), Decimal(c)) for w, i, h, d, c in rows], "record_date date, workshop_code string, energy_code string, source_id long, updated_at timestamp, is_deleted int, consumption decimal(16,3), cost decimal(16,2)")
    assert {r.workshop_code: float(r.cost) for r in warehouse.latest_valid_live(frame).collect()} == {"W02": 7.0, "W04": 2.0}


def test_layered_replay(spark, tmp_path):
    schema = "record_date date, workshop_code string, energy_code string, consumption decimal(16,3), cost decimal(16,2), updated_at timestamp, is_deleted int, source_id long"
    at = lambda s: dt.datetime.strptime(s, "%Y-%m-%d %H")
    batches = [
        [(1, "E01", 10, "2025-12-30 09", 0), (2, "E02", 20, "2025-12-30 09", 0)],
        [(1, "E01", 17, "2026-09-27 11", 0)],
        [(1, "E01", 17, "2026-09-28 09", 1)],
    ]
    path, costs = str(tmp_path / "dwd"), []
    for n, batch in enumerate(batches):
        new = spark.createDataFrame([(DAY, "W01", e, Decimal(1), Decimal(c), at(t), d, i) for i, e, c, t, d in batch], schema)
        merged = new if n == 0 else warehouse.late_merge(spark.read.parquet(path).drop("dt"), new)
        warehouse.overwrite_dates(merged, path, str(tmp_path / f"stage{n}"))
        costs.append(float(spark.read.parquet(path).filter("is_deleted = 0").agg(F.sum("cost")).first()[0]))
    assert costs == [30.0, 37.0, 20.0]
    assert spark.read.parquet(path).filter("energy_code = 'E01' AND is_deleted = 1").count() == 1


IMAGE = "struct<business_key:string,consumption:decimal(16,3),cost:decimal(16,2)>"
LOG = f"offset long, id string, op string, file_no int, pos long, row int, before {IMAGE}, after {IMAGE}"


def change(offset, op, pos, key, cost, before=None, id=None):
    image = lambda k, c: (k, Decimal(c) / 10, Decimal(c))
    return offset, id or key, op, 1, pos, 0, image(before, cost) if before else None, None if op == "d" else image(key, cost)


def test_cdc_redelivery_and_conflicts(spark):
    rows = [change(0, "c", 1, "k1", 10), change(1, "c", 2, "k2", 20), change(2, "u", 3, "k1", 17, "k1")]
    log = spark.createDataFrame(rows + [(o + 3, *r) for o, *r in rows], LOG)
    state, conflicts = warehouse.cdc_projection(log, strict=True)
    live = state.filter("is_deleted = 0").agg(F.count("*"), F.sum("image.cost"), F.sum("image.consumption")).first()
    assert (live[0], float(live[1]), float(live[2])) == (2, 37.0, 3.7) and conflicts.count() == 0
    assert warehouse.offset_gaps(log).first().contiguous
    more = lambda *r: log.unionByName(spark.createDataFrame(list(r), LOG))
    bad = more(change(6, "u", 3, "k1", 9, "k1"))
    assert [r.kind for r in warehouse.cdc_projection(bad)[1].collect()] == ["image"]
    with pytest.raises(ValueError):
        warehouse.cdc_projection(bad, strict=True)
    moved = more(change(6, "u", 4, "k3", 20, "k2", id="k2"))
    state, conflicts = warehouse.cdc_projection(moved)
    assert {r.business_key: r.is_deleted for r in state.collect()} == {"k1": 0, "k2": 1, "k3": 0} and conflicts.count() == 0
    taken = more(change(6, "c", 4, "k2", 5, id="other"))
    assert [(r.kind, r.business_key) for r in warehouse.cdc_projection(taken)[1].collect()] == [("owner", "k2")]
    old = more(change(6, "u", 2, "k1", 99, "k1"))
    assert float(warehouse.cdc_projection(old)[0].filter("business_key = 'k1'").first().image.cost) == 17.0
    last = {r.id: (r.offset, r.is_deleted) for r in warehouse.offset_projection(more(change(6, "d", 9, "k1", 17, "k1"))).collect()}
    assert last == {"k1": (6, 1), "k2": (4, 0)}


def test_snapshots_replay_and_time_travel(spark, tmp_path):
    schema = "record_date date, workshop_code string, energy_code string, cost int, updated_at timestamp"
    row = lambda c, h: spark.createDataFrame([(DAY, "W01", "E01", c, stamp(h))], schema)
    s = warehouse.Snapshots(spark, str(tmp_path))
    assert s.commit(row(10, 9)) == 1 and s.merge(row(17, 10)) == 2
    assert s.merge(row(17, 10)) == 3 and s.merge(row(5, 8)) == 4
    assert [s.read(n).first().cost for n in (1, 2, 3, 4)] == [10, 17, 17, 17]
    with pytest.raises(ValueError):
        s.read(9)


def test_newest_version_wins_and_ties_keep_the_first_row(spark):
    rows = [(1, "a", None), (2, "a", stamp(9)), (3, "b", stamp(9)), (4, "b", stamp(9)), (5, "c", None), (6, "c", None)]
    kept, lost = cleaning.split_latest(spark.createDataFrame(rows, "input_seq long, k string, updated_at timestamp"), ("k",))
    assert sorted(r.input_seq for r in kept.collect()) == [2, 3, 5] and lost.count() == 3


def test_dates_and_texts(spark):
    texts = ["2024-03-15", "2024/03/15", "2024.03.15", "2024年03月15日", "2024-03-15 08:00:00", "2024/03/15 08:00:00"]
    rows = spark.createDataFrame([(t,) for t in [*texts, "2024/3/15", "n/a", "2024-02-30", "2024/03/15 08:00"]], "t string").select(cleaning.parsed_date(F.col("t")).alias("d")).collect()
    assert [r.d for r in rows] == [DAY] * 7 + [None, None, None]
    assert spark.range(1).select(cleaning.normal_text(F.lit("　﻿ 动力站​ "))).first()[0] == "动力站"


def test_gap_fill_limits(spark):
    t0 = dt.datetime(2024, 1, 1)
    values = [None, 1.0, None, None, None, 3.0, None, None, None, None, 5.0]
    rows = spark.createDataFrame([("c", t0 + dt.timedelta(hours=i), v) for i, v in enumerate(values)], "city_id string, ts_local timestamp, pm10 double")
    got = [r.pm10 for r in hourly.gap_filled(rows, "pm10").orderBy("ts_local").collect()]
    assert got == [1.0, 1.0, 2.0, 2.0, 2.0, 3.0, None, None, None, None, 5.0]
    line = [r.pm10 for r in hourly.gap_filled(rows, "pm10", method="linear").orderBy("ts_local").collect()]
    assert line[0] is None and line[2:5] == [1.5, 2.0, 2.5]


def test_flattened_json_and_ingest(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"city_id": "c", "hourly": {"time": ["2024-01-01T00:00", "2024-01-01T01:00"], "pm10": [1.5]}}')
    docs = spark.read.schema("city_id string, hourly struct<time:array<string>,pm10:array<double>>").json(str(tmp_path))
    assert [(r.pm10) for r in hourly.flattened(docs, ["pm10"]).orderBy("ts_local").collect()] == [1.5, None]
    table = lambda *t: spark.createDataFrame([(str(i), x) for i, x in enumerate(t)], "name string, text string")
    problems = lambda t, k: [r.problem for r in files.ingest(t, k).orderBy("name").collect()]
    assert problems(table("a,b\n1,2", "a,a\n1,2", "a,\n1,2", "a,b\n1"), "csv") == [None, "repeated_header", "empty_header", "ragged"]
    assert problems(table("<a><b/></a>", "<!DOCTYPE a><a/>", "<a>"), "xml") == [None, "dtd", "invalid_xml"]


def test_interval_anti_join_ends(spark):
    at = lambda h: dt.datetime(2024, 1, 1, h)
    readings = spark.createDataFrame([(1, at(h)) for h in range(6)], "asset_id int, time timestamp")
    issues = spark.createDataFrame([(1, at(1), at(3), at(9)), (1, at(5), None, at(9))], "asset_id int, issue_start timestamp, issue_end timestamp, stream_end timestamp")
    assert sorted(r.time.hour for r in hourly.without_issues(readings, issues).collect()) == [0, 3, 4]


def test_expectations_and_missing_columns(spark):
    frame = spark.createDataFrame([(1, 5), (1, None), (2, 99)], "k int, v int")
    rules = (("some", "not_empty", None, None), ("uni", "unique", ("k",), None), ("range", "between", "v", (0, 10)), ("here", "not_null", "v", None), ("open", "between", "v", (6, None)))
    assert {r.rule: r.failures for r in quality.expectations(frame, rules).collect()} == {"some": 0, "uni": 1, "range": 1, "here": 1, "open": 1}
    assert quality.missing_columns(frame, ("k", "x")) == ["x"]
    assert [tuple(r) for r in quality.expectations(frame, rules, ("k", "x")).collect()] == [("missing column x", 1, False)]
    energy = [r[0] for r in quality.ENERGY_RULES]
    assert len(energy) == 10 and len(quality.PRODUCTION_RULES) == 5 and energy[3] == "energy.energy_code_required"


def test_strict_times(spark):
    texts = ["2026-01-02T00:00:00Z", "2026-01-02T00:00Z", "2026-01-02T00:00:00+08:00", "2026-01-02", "2026-01-02 00:00:00Z", "2026-1-2T00:00:00Z", "2026-13-01T00:00:00Z"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(power.strict_time(F.col("t")).isNotNull().alias("ok")).collect()
    assert [r.ok for r in rows] == [True, True, True, False, False, False, False]


def test_retrieval_reads_all_parts(spark):
    """Every part asks, and no evidence is passed over: brute force over all pairs of parts."""
    part = spark.read.parquet(f"{DATA}/part.parquet").collect()
    got = {}
    for r in registry.queries()["m14_retrieval_all"](spark, DATA).collect():
        got.setdefault(r.question_id, set()).add((r.evidence_id, r.score))
    for q in part:
        words = set(q.p_name.lower().split())
        score = {e.p_partkey: 4 * (e.p_brand.lower() in words) + len(words & set(e.p_name.lower().split())) + 6 * (e.p_type.lower() in words) for e in part}
        best = sorted((-s, i) for i, s in score.items() if s)[:8]
        assert got[q.p_partkey] == {(i, -s) for s, i in best}
    assert len(got) == len(part) and {e % 4 for found in got.values() for e, _ in found} == {0, 1, 2, 3}


def test_boosted_trees_predict_every_fold(spark):
    days = 28 + 365 + 3 * 30
    series = [(dt.date(2024, 1, 1) + dt.timedelta(n), w, float(100 * w + n % 7), 1.0 + n % 5, 20.0, n % 11 == 0) for n in range(days) for w in (1, 2)]
    f = features.features(spark.createDataFrame(series, "date date, workshop string, tce double, qty double, temperature double, idle boolean"))
    rows = features.in_folds(features.eligible(f), features.rolling_folds(f)).persist()
    got = features.boosted_folds(f, features.rolling_folds(f), {"none": ()}, trees=1).collect()
    expected = {(r.fold, r.date, r.workshop) for r in rows.filter("split = 'test'").collect()}
    assert len(got) == len(expected) == 3 * 30 * 2 and {(r.fold, r.date, r.workshop) for r in got} == expected


@pytest.mark.parametrize("name", ["m06_boosted_trees", "m07_group_ablation"])
def test_boosted_queries_have_every_fold(spark, name):
    got = {r.fold for r in registry.queries()[name](spark, DATA).select("fold").distinct().collect()}
    assert got == {r.fold for r in features.rolling_folds(features.features(features.daily_series(Plant(spark, DATA)))).collect()} and len(got) == 11


def brute_boosting(rows, models, edges, trees, depth, rate, least, scale):
    """One model after another, every split tried on plain lists of integers."""
    code = lambda x, e: sum(v < x for v in e)
    table = [(day, round(y * scale), [code(v, e) for v, e in zip(x, edges)]) for day, y, *x in rows]
    out = {}
    for m in models:
        own = [r for r in table if m.first_train <= r[0] < m.first_test]
        base = round(sum(y for _, y, _ in own) / len(own))
        grown = []

        def leaf_of(tree, codes):
            node = 1
            while node in tree:
                f, b = tree[node]
                node = 2 * node + (codes[f] > b)
            return node << (depth + 1 - node.bit_length())

        def predicted(codes):
            return base + sum(leaves.get(leaf_of(tree, codes), 0) for tree, leaves in grown)

        for _ in range(trees):
            left = [(y - predicted(c), c) for _, y, c in own]
            tree, leaves, todo = {}, {}, [(1, left)]
            while todo:
                node, part = todo.pop()
                score = lambda rows: sum(r for r, _ in rows) ** 2 / (len(rows) + boosting.RIDGE)
                best = None
                if node.bit_length() <= depth:
                    for f in m.seen:
                        for b in range(len(edges[f])):
                            low, high = [r for r in part if r[1][f] <= b], [r for r in part if r[1][f] > b]
                            if len(low) >= least and len(high) >= least and (gain := score(low) + score(high) - score(part)) > (best[0] if best else 0):
                                best = (gain, f, b, low, high)
                if best:
                    tree[node] = best[1:3]
                    todo += [(2 * node, best[3]), (2 * node + 1, best[4])]
                else:
                    leaves[node << (depth + 1 - node.bit_length())] = round(rate * sum(r for r, _ in part) / (len(part) + boosting.RIDGE))
            grown.append((tree, leaves))
        out |= {(m.name, m.fold, i): predicted(c) / scale for i, (day, _, c) in enumerate(table) if m.first_test <= day <= m.last_test}
    return out


@pytest.mark.parametrize("task_rows, keep, alone", [(3_000, 12, 0), (17, 2, 0), (3_000, 12, 1_000)])
def test_boosted_trees_are_those_of_a_plain_booster(spark, monkeypatch, task_rows, keep, alone):
    """However rows are dealt to tasks, however often predictions are written, and also if a task grows a model."""
    monkeypatch.setattr(boosting, "TASK_ROWS", task_rows)
    monkeypatch.setattr(boosting, "KEEP", keep)
    draw = np.random.default_rng(4)
    day = lambda n: dt.date(2024, 1, 1) + dt.timedelta(int(n))
    rows = [(day(n % 60), round(float(a * 3 - b + (a > 4) * c + e), 3), float(a), float(b), float(c)) for n, (a, b, c, e) in enumerate(zip(draw.integers(0, 9, 240), draw.normal(0, 2, 240).round(2), draw.integers(0, 2, 240), draw.normal(0, 1, 240)))]
    models = [boosting.Model(name, k, day(0), day(30 + 10 * k), day(39 + 10 * k), seen) for k in range(3) for name, seen in (("none", (0, 1, 2)), ("a", (1, 2)))]
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id long, date date, y double, a double, b double, c double")
    edges = boosting.bin_edges(frame, "abc", bins=8)
    fitted = boosting.fit(frame, models, "abc", "y", edges, trees=5, depth=3, rate=0.3, least=5, alone=alone)
    got = {(r.model, r.fold, r.id): r.prediction for r in boosting.predict(frame, fitted, models, "abc", ("id", "date")).collect()}
    expected = brute_boosting(rows, models, edges, 5, 3, 0.3, 5, fitted.scale)
    assert got.keys() == expected.keys() and len(got) == 6 * 40
    assert all(abs(got[k] - expected[k]) < 1e-6 for k in got)
    error = lambda name: sum(abs(got[k] - rows[k[2]][1]) for k in got if k[0] == name)
    assert error("none") < error("a")


def test_boosting_of_poor_tables(spark):
    """Labels and features that are all alike, and no whole fold."""
    rows = spark.createDataFrame([(DAY + dt.timedelta(n), 2.5, 1.0) for n in range(60)], "date date, y double, a double")
    models = [boosting.Model("none", 0, DAY, DAY + dt.timedelta(40), DAY + dt.timedelta(59), (0,))]
    got = boosting.predict(rows, boosting.fit(rows, models, "a", "y", trees=2), models, "a", ("date",)).collect()
    assert len(got) == 20 and {round(r.prediction, 6) for r in got} == {2.5}
    short = features.features(spark.createDataFrame([(DAY, "W01", 1.0, 1.0, 2.0, False)], "date date, workshop string, tce double, qty double, temperature double, idle boolean"))
    assert features.boosted_folds(short, features.rolling_folds(short), {"none": ()}).count() == 0


def test_block_bootstrap(spark, monkeypatch):
    """Bounds are those of all equally likely resamples; the query draws 20,000."""
    values = [3.0, -1.0, 4.0, 1.0, -5.0, 9.0, 2.0]
    frame = spark.createDataFrame(list(enumerate(values)), "position long, delta double")
    for block in (2, 3, 30):
        length = min(block, len(values))
        parts = [values[i : i + length] for i in range(len(values) - length + 1)]
        means = [np.mean(sum(chosen, [])[: len(values)]) for chosen in itertools.product(parts, repeat=-(-len(values) // length))]
        got = features.block_bootstrap(frame, block).first()
        assert (got.mean, got.block) == (pytest.approx(np.mean(values)), block)
        for bound, q in ((got.low, 0.025), (got.high, 0.975)):
            assert np.quantile(means, q - min(q, 1 - q) / 4) - 1e-9 <= bound <= np.quantile(means, q + min(q, 1 - q) / 4) + 1e-9
    drawn, own = [], features.block_bootstrap
    monkeypatch.setattr(features, "block_bootstrap", lambda d, block, replicates=20_000, seed=7: drawn.append((block, replicates)) or own(d, block, 10))
    assert registry.queries()["m09_block_bootstrap"](spark, DATA).count() == 3 and drawn == [(b, 20_000) for b in (7, 14, 30)]


def test_cusum_calibration(spark, monkeypatch):
    """The limit and the false alarms are those of all orders of the residuals; the query has 5,000 series."""
    z = [2.0, 1.5, -0.5, 0.25, -2.0, -1.0]

    def top(order):
        hi = lo = best = 0.0
        for x in order:
            hi, lo = max(0.0, hi + x - 0.5), max(0.0, lo - x - 0.5)
            best = max(best, hi, lo)
        return best

    tops = [top(o) for o in itertools.permutations(z)]
    got = features.cusum_calibration(spark.createDataFrame([("a", n, x) for n, x in enumerate(z)], "key string, position int, z double"), 5_000, limit=2.0).first()
    assert got.limit_99 == pytest.approx(np.quantile(tops, 0.99)) and got.false_alarms == pytest.approx(np.mean([t > 2 for t in tops]), abs=0.03)
    asked = []
    monkeypatch.setattr(features, "cusum_calibration", lambda rows, replicates: asked.append((replicates, rows.select("key").distinct().count())) or rows.select(F.lit(1.0).alias("limit_99"), F.lit(0.0).alias("false_alarms")))
    registry.queries()["m13_cusum_calibration"](spark, DATA)
    assert asked[0][0] >= 625 and asked[0][0] * asked[0][1] >= 5_000


def test_power_factor_queue(spark):
    rows = [(1, 80.0, 5.0), (2, 90.0, 9.0), (3, 80.0, 7.0), (4, 50.0, 0.0), (5, 70.0, 1.0), (6, 80.0, 5.0), (7, None, 3.0)]
    frame = spark.createDataFrame(rows, "event_id long, factor double, reactive double")
    assert [r.event_id for r in hourly.power_factor_queue(frame, "factor", "reactive", "event_id").collect()] == [5, 3, 1, 6]
    many = spark.range(300).select(F.col("id").alias("event_id"), (F.col("id") / 10).alias("factor"), F.lit(1.0).alias("reactive"))
    assert sorted(r.event_id for r in hourly.power_factor_queue(many, "factor", "reactive").collect()) == list(range(250))
    assert registry.queries()["p06_power_factor_queue"](spark, DATA).count() > 0


def test_spellings_and_holidays(spark):
    """Values as plants write them, typed here and not taken from the module."""
    shops = {"熔炼": "W01", "轧制": "W02", "热处理": "W03", "机加车间": "W04", "表处车间": "W05", "总装车间": "W06", "动力车间": "W07", "包装": "W08"}
    energies = {"电": "E01", "外购电": "E01", "电力度": "E01", "天燃气": "E02", "蒸气": "E03", "自来水": "E04", "新水": "E04", "压缩风": "E05", "0#柴油": "E06"}
    names = "record_date workshop_code workshop_name energy_code energy_name consumption unit unit_price cost output_qty output_unit avg_temperature record_status updated_at".split()
    raw = [{"workshop_name": w, "energy_name": e} for w in shops for e in energies]
    frame = spark.createDataFrame([(n, *(r.get(c) for c in names)) for n, r in enumerate(raw)], "input_seq long, " + ", ".join(f"{c} string" for c in names))
    got = {r.input_seq: (r.workshop_code, r.energy_code, r.unit) for r in cleaning.typed(frame).collect()}
    unit = {"E01": "kWh", "E02": "m³", "E03": "t", "E04": "m³", "E05": "m³", "E06": "kg"}
    assert got == {n: (shops[r["workshop_name"]], energies[r["energy_name"]], unit[energies[r["energy_name"]]]) for n, r in enumerate(raw)}
    days = {str(r.calendar_date): (r.holiday_name, r.weekday_name) for r in adapter.calendar(spark).collect()}
    assert [d for d, (h, _) in days.items() if h == "端午节" and d < "2025"] == ["2024-06-08", "2024-06-09", "2024-06-10"]
    assert days["2025-10-06"] == ("国庆节/中秋节", "Monday") and days["2025-10-09"][0] is None and len(days) == 731
    wide = adapter.calendar(spark, spark.createDataFrame([(dt.date(2023, 12, 30),), (dt.date(2026, 1, 2),), (None,)], "d date")).agg(F.min("calendar_date"), F.max("calendar_date")).first()
    assert tuple(wide) == (dt.date(2023, 12, 30), dt.date(2026, 1, 2))
    assert adapter.calendar(spark, spark.createDataFrame([], "d date")).count() == 731


def test_approximate_quantiles_give_the_same_rows(spark):
    raw = cleaning.dirty(Plant(spark, DATA))
    exact, near = (cleaning.cleaned(raw, accuracy)["energy"] for accuracy in (None, 100_000))
    assert exact.count() == near.count() and near.join(exact, list(cleaning.KEY), "left_anti").count() == 0


def test_groups_of_ones_own(spark):
    """Statistics by more keys than the fixed codes; null keys are a group."""
    rows = [(n, DAY, "W01", "E01", p, 10.0 * (1 + (p or 0)) + n % 3, 1.0, None) for p in (0, 1, None) for n in range(20)] + [(99, DAY, "W01", "E01", 1, None, None, None)]
    frame = spark.createDataFrame(rows, "input_seq long, record_date date, workshop_code string, energy_code string, plant_id int, consumption double, unit_price double, cost double")
    fixed = cleaning.repaired(frame, ("plant_id", "workshop_code", "energy_code"))
    row = fixed.filter("input_seq = 99").first()
    assert fixed.count() == 61 and (row.consumption, row.unit_price, row.cost, row.fix_reason) == (21.0, 1.0, 21.0, "missing")


def test_day_of_deleted_rows_stays_with_zeros(spark):
    plant = Plant(spark, DATA)
    rows = warehouse.incoming(warehouse.ods(plant).limit(0), plant.workshops, plant.energies, plant.calendar)
    one = warehouse.ods(plant).limit(1).withColumns({"is_deleted": F.lit(1), "unit_price": F.lit(0).cast("decimal(12,4)")})
    dwd = warehouse.incoming(one, plant.workshops, plant.energies, plant.calendar)
    day = warehouse.dws_day(dwd.unionByName(rows), plant.production.limit(0)).first()
    assert (float(day.cost_yuan), float(day.tce), day.unit_energy_kgce, day.has_shutdown, day.avg_temperature) == (0.0, 0.0, None, 0, None)
    ads = warehouse.ads_factory_day(warehouse.dws_day(dwd, plant.production.limit(0)), dwd).first()
    assert (ads.workshops, ads.bad_intensity) == (0, 1)
    live = warehouse.incoming(one.withColumn("is_deleted", F.lit(0)), plant.workshops, plant.energies, plant.calendar)
    assert live.count() == 0  # a price of 0 is invalid


def test_snapshot_apply_in_two_phases(spark, tmp_path):
    plant = Plant(spark, DATA)
    rows = warehouse.latest(warehouse.ods(plant), warehouse.KEY, F.desc("source_id"))
    boundary = str(tmp_path / "boundary")
    load = lambda frame, offset: warehouse.apply_snapshot(frame, "energy", offset, boundary, rows, plant.workshops, plant.energies, plant.calendar, plant.production)
    made = load(rows, 10)
    assert made["ads"].count() > 0 and spark.read.parquet(f"{boundary}/committed").first().end_offset == 10
    load(rows, 10)
    for frame, offset, word in ((rows, 9, "offset"), (rows.withColumn("cost", F.col("cost") + 1), 10, "content"), (rows.filter("energy_code <> 'E01'"), 11, "omitted"), (rows.unionByName(rows.limit(1)), 11, "keys")):
        with pytest.raises(ValueError, match=word):
            load(frame, offset)
    assert spark.read.parquet(f"{boundary}/committed").first().end_offset == 10


def test_layer_tables(spark, tmp_path):
    plant = Plant(spark, DATA)
    empty = warehouse.bootstrap_layers(spark, str(tmp_path))
    assert all(frame.count() == 0 for frame in empty.values()) and set(empty) == set(warehouse.LAYERS)
    made = warehouse.layers(plant)
    for name, key in (("dwd_energy", "dwd"), ("dws_day", "days"), ("dws_month", "months"), ("ads_factory_day", "ads")):
        part = made[key].filter(F.col("year_month") == "2024-03") if "year_month" in made[key].columns else made[key].filter(F.date_format("record_date", "yyyy-MM") == "2024-03")
        warehouse.write_layer(part, str(tmp_path), name)
        warehouse.write_layer(part, str(tmp_path), name)  # overwrites its own partitions
        assert warehouse.bootstrap_layers(spark, str(tmp_path))[name].count() == part.count() > 0
    with pytest.raises(Exception, match="tce"):
        warehouse.write_layer(made["ads"].drop("tce"), str(tmp_path), "ads_factory_day")


def test_second_committer_of_a_snapshot_fails(spark, tmp_path, monkeypatch):
    s = warehouse.Snapshots(spark, str(tmp_path))
    s.commit(spark.range(3))
    monkeypatch.setattr(s, "_last", lambda: 0)
    with pytest.raises(Exception, match="exist"):
        s.commit(spark.range(5))
    monkeypatch.undo()
    assert s.read(1).count() == 3 and [tuple(r) for r in s.lineage().collect()] == [(1, None)]


def test_watermark_after_the_data(spark, tmp_path):
    rows = spark.createDataFrame([(1, stamp(9))], "id int, updated_at timestamp")
    state = spark.createDataFrame([], "target_table string, watermark_val timestamp")
    for _ in range(2):
        row = warehouse.load_with_watermark(rows, str(tmp_path / "t"), state, str(tmp_path / "w"), "t", "b1").first()
    assert row.watermark_val == stamp(9) and spark.read.parquet(str(tmp_path / "t")).count() == spark.read.parquet(str(tmp_path / "w")).count() == 1


def scans_of(frame) -> int:
    return frame._jdf.queryExecution().optimizedPlan().toString().count("Relation [")


def test_fact_reads_its_rows_once(spark):
    """The rows and a few small tables of statistics: no part of the chain is derived again."""
    assert scans_of(cleaning.cleaned(cleaning.dirty(Plant(spark, DATA)))["energy"]) <= 5


@pytest.mark.parametrize("few", [100_000, 0])
def test_months_without_values_take_their_group(spark, monkeypatch, few):
    """A month whose quantities are all missing, an energy without any price in a month, and a null group; broadcast or not."""
    monkeypatch.setattr(cleaning, "BROADCAST_GROUPS", few)
    day = lambda m, d: dt.date(2024, m, d)
    rows = [("W01", "E01", day(1, d), float(d), 2.0 if d > 1 else None, 1.0) for d in range(1, 6)] + [("W01", "E01", day(2, d), None, 3.0, None) for d in (1, 2)] + [("W02", "E02", day(3, 1), 4.0, None, None), ("W02", "E02", day(4, 1), 4.0, 5.0, 20.0), (None, "E03", day(1, 1), 1.0, 1.0, 1.0), (None, "E03", day(1, 2), None, 1.0, 1.0)]
    frame = spark.createDataFrame(rows, "workshop_code string, energy_code string, record_date date, consumption double, unit_price double, cost double")
    got = {(r.workshop_code, r.record_date): r for r in cleaning.repaired(frame).collect()}
    assert len(got) == len(rows) and got["W01", day(2, 1)].consumption == 3.0 and got["W01", day(2, 1)].fix_reason == "missing" and got["W01", day(1, 1)].unit_price == 2.0
    assert got["W02", day(3, 1)].unit_price == 5.0 and got["W02", day(3, 1)].cost == 20.0 and got[None, day(1, 2)].consumption == 1.0


def test_sketched_statistics_repair_a_batch(spark):
    """A batch of later rows, repaired by sketches of all rows: no old row is read, and what is imputed lies within the sketches' error of rank."""
    draw = np.random.default_rng(5)
    old = [("W01", "E01", dt.date(2024, 1, 1 + n % 28), float(v), 2.0, None) for n, v in enumerate(draw.normal(100, 10, 4_000))]
    new = [("W01", "E01", dt.date(2025, 1, 1 + n % 28), None if n % 9 == 0 else 5_000.0 if n % 9 == 1 else float(v), None, None) for n, v in enumerate(draw.normal(100, 10, 400))]
    frame = lambda rows: spark.createDataFrame(rows, "workshop_code string, energy_code string, record_date date, consumption double, unit_price double, cost double")
    stored = cleaning.fix_sketches(frame(old))
    stats = cleaning.sketched_statistics(stored.unionByName(cleaning.fix_sketches(frame(new))))
    got = cleaning.repaired(frame(new), stats=stats).collect()
    values = sorted(v for *_, v, _, _ in (r for r in old + new) if v is not None and v < 1_000)
    rank = lambda v: sum(x < v for x in values) / len(values)
    filled = {r.consumption for r in got if r.fix_reason in ("missing", "outlier")}
    assert len(filled) == 1 and abs(rank(filled.pop()) - 0.5) <= 2 * cleaning.SKETCH_ERROR and {r.unit_price for r in got} == {2.0}
    assert sum(r.fix_reason == "outlier" for r in got) == sum(v == 5_000.0 for *_, v, _, _ in new)
    empty = cleaning.sketched_statistics(cleaning.fix_sketches(frame([]).limit(0)))
    assert cleaning.repaired(frame(new[:1]), stats=empty).count() == 1


PARSED = {
    "json": {'{"a": "x: NaN"}': None, '{"a": NaN}': "not_finite", '[1, -Infinity]': "not_finite", "{a: 1}": "invalid_json", "": "invalid_json", '﻿{"a": [1, null, "é"]}': None, '{"a": 1} x': "invalid_json", '{"a": 1, "a": 2}': None},
    "xml": {"<a><b></a>": "invalid_xml", "<a><b></a></b><c></a>": "invalid_xml", "<a>1</a><a>2</a>": "invalid_xml", "<!-- c --><a/>": None, '<a x="1">t<b/>u</a>': None, "<!DOCTYPE a><a/>": "dtd", "<a><! ENTITY></a>": "dtd", "": "invalid_xml", '<?xml version="1.0"?><a/>': None},
    "csv": {'a,b\n"1,5",2\n': None, 'a,b\n"1\n5",2': None, "a,b\n\n1,2\n": None, "a,b\n1": "ragged", "a,a\n": "repeated_header", "a,\n1,2": "empty_header", "": "empty", '\na,b': "empty", 'a,b\n"1"x,2': "invalid_csv"},
}


@pytest.mark.parametrize("kind", PARSED)
def test_documents_are_parsed(spark, kind):
    rows = files.ingest(spark.createDataFrame([*PARSED[kind].items(), (None, "none")], "text string, said string"), kind).collect()
    assert {r.text: r.problem for r in rows if r.text is not None} == PARSED[kind] and all((r.document is None) == (r.problem is not None) for r in rows)
    assert len({r.content_sha256 for r in rows}) == len(PARSED[kind])  # null reads as empty


def test_parsed_values(spark):
    one = lambda kind, text, path, as_: files.ingest(spark.createDataFrame([(text,)], "text string"), kind).select(F.variant_get("document", path, as_)).first()[0]
    assert one("csv", 'a,b\n"1,5","x\ny"\n2,3', "$[0].b", "string") == "x\ny" and one("csv", "a\n1\n2", "$[1].a", "string") == "2"
    assert one("xml", '<a k="v">t<b>u</b>w</a>', "$.children[0].tail", "string") == "w" and one("xml", '<a k="v"/>', "$.attributes.k", "string") == "v"
    assert one("json", '{"a": {"b": [1, 2.5]}}', "$.a.b[1]", "double") == 2.5
