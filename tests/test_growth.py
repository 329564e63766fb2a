"""Work that must grow with the tables and no faster: what is computed once, what isn't made at all, how many tasks there are."""

import datetime as dt
from fractions import Fraction

from pyspark.sql import Window
from pyspark.sql import functions as F

from tests.conftest import DATA
from wattmill.operators import cleaning, differences, warehouse
from wattmill.operators.views import Plant
from wattmill.plans import registry
from wattmill.sources import log
from wattmill.streaming import power, queries


def plan(frame) -> str:
    return frame._jdf.queryExecution().optimizedPlan().toString()


def writes(monkeypatch, *modules) -> list[str]:
    names = []
    for module in modules:
        monkeypatch.setattr(module, "written", lambda df, name, *by, keep=module.written: names.append(name) or keep(df, name, *by))
    return names


def test_a_payload_is_parsed_once(spark):
    """F7, F8, F10, F16."""
    for frame in (registry.queries()["t05_deletes"](spark, DATA), power.parsed_events(queries.payloads(Plant(spark, DATA)))):
        assert plan(frame).count("from_json") == 1


def test_cleaning_makes_only_what_is_asked_for(spark, monkeypatch):
    """F17 to F20."""
    names = writes(monkeypatch, cleaning)
    for query, made in (("c01_c08_typed_and_rejected", ["typed"]), ("c07_rejects_by_reason", ["typed"]), ("c08_duplicates", ["typed", "versions"])):
        names.clear()
        registry.queries()[query](spark, DATA)
        assert names == made


def test_cleaning_is_compiled_and_narrow(spark, monkeypatch):
    """No method of the stage is longer than the JVM compiles (8,000 bytes), and columns that a query doesn't use are neither derived nor written."""
    p, columns, keep = Plant(spark, DATA), {}, cleaning.written
    stages = cleaning.typed(cleaning.dirty(p))._jdf.queryExecution().debug().codegenToSeq()
    assert stages.size() and max(stages.apply(k)._3().maxMethodCodeSize() for k in range(stages.size())) < 7_500
    monkeypatch.setattr(cleaning, "written", lambda df, name, *by: columns.setdefault(name, set(df.columns)) and keep(df, name, *by))
    for query, extra in (("c07_rejects_by_reason", set()), ("c08_duplicates", {"updated_at"}), ("c09_c14_fix_ledger", {"updated_at", "consumption", "unit_price", "cost"})):
        columns.clear()
        registry.queries()[query](spark, DATA)
        assert columns["typed"] == {"input_seq", "date_text", "reject_reason", *cleaning.CODED} | extra
    every = cleaning.dirty(p)
    some = cleaning.dirty(p, *cleaning.METERED)
    assert some.columns == [c for c in every.columns if c in ("input_seq", *cleaning.METERED)] and some.exceptAll(every.select(some.columns)).isEmpty() and some.count() == every.count()


def test_only_newest_versions_are_ranked(spark, monkeypatch):
    """Rows that are older than their key's newest aren't shuffled; results are those of ranking all, also with null keys and versions, ties and too many keys to broadcast."""
    day = dt.date(2024, 3, 15)
    raw = [(n, day, w, e, n % 3 if v else None) for n, (w, e, v) in enumerate([("W01", "E01", 1)] * 9 + [("W02", "E01", 0)] * 3 + [(None, "E02", 1)] * 4 + [("W03", None, 0), ("W01", "E01", 0)])]
    rows = spark.createDataFrame(raw, "input_seq long, record_date date, workshop_code string, energy_code string, updated_at int")
    typed = rows.withColumn("reject_reason", F.when(F.col("input_seq") == 8, "bad"))
    kept = typed.filter("reject_reason IS NULL").drop("reject_reason")
    seqs = lambda frame: sorted(r.input_seq for r in frame.collect())
    latest, others = map(seqs, cleaning.split_latest(kept))
    for few in (100_000, 3):
        monkeypatch.setattr(cleaning, "BROADCAST_GROUPS", few)
        parts = cleaning.Cleaned(rows)
        parts.typed = typed
        assert seqs(parts.latest) == latest and ("ranked" in parts.__dict__) == (few == 3)
        parts = cleaning.Cleaned(rows)
        parts.typed = typed
        assert (seqs(parts.duplicates), seqs(parts.latest)) == (others, latest)
    monkeypatch.undo()
    newest, older = cleaning.contenders(kept)
    assert seqs(newest) + seqs(older) != [] and older.filter("input_seq IN (2, 5)").isEmpty() and "Window" not in plan(older)


def test_date_spellings_are_tried_where_they_can_fit(spark):
    """The same dates as by trying all of them; each attempt has a condition."""
    texts = ["2024-1-2", "2024-01-02", "2024/1/2", "2024.1.2", "2024年1月2日", "2024-1-2 3:4:5", "2024/1/2 03:04:05", "2024-1-2 3:4", "n/a", "", None, "2024-13-1", "2024/1-2", "2024.1.2 3:4:5", "-2024/1/1", "2024-1-2 ", "x2024-1-2", "+12024-1-2", "1-2-3", "2024年1月2", "2024-1-2T3:4:5", "::-- //"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    every = F.coalesce(*(F.try_to_timestamp("t", F.lit(f)) for f in cleaning.DATE_FORMATS)).cast("date")
    guarded = cleaning.parsed_date(F.col("t"))
    assert rows.filter(~guarded.eqNullSafe(every)).count() == 0 and rows.filter(guarded.isNotNull()).count() >= 7
    assert guarded._jc.toString().count("CASE WHEN") == len(cleaning.DATE_FORMATS)


def test_quantiles_are_exact_where_ranks_meet(spark):
    """F2."""
    n = 400_000
    rows = spark.range(n).select(F.lit("a").alias("g"), (F.col("id") % 50 + 1).cast("decimal(16,3)").alias("v")).unionByName(spark.sql("SELECT * FROM VALUES ('b', CAST(NULL AS DECIMAL(16,3))), ('c', CAST(7 AS DECIMAL(16,3))) t(g, v)"))
    found = {r.g: (r.q25, r.q50, r.q75) for r in cleaning.exact_quantiles(rows, "g", "v", {"q25": "0.25", "q50": "0.5", "q75": "0.75"}).collect()}
    assert found == {"a": (13, 25, 38), "b": (None, None, None), "c": (7, 7, 7)}
    assert "percentile_approx" not in plan(registry.queries()["a05_approximate_quantiles"](spark, DATA))


def test_replayed_means_are_exact(spark):
    """sums of doubles are off by their order; means of exact sums aren't, and no window is gone over row by row."""
    at, cents = dt.datetime(2024, 1, 1), [(i * 7919) % 9973 + 1500 for i in range(300)]
    rows = spark.createDataFrame([(i, at + dt.timedelta(seconds=40 * (i // 2)), "W01", c / 100) for i, c in enumerate(cents)], "event_id int, ts timestamp, workshop_code string, power_kw double")
    found = {r.event_id: r for r in power.replay_alarms(rows, 0.0, 0.0, 2, 900_000).collect()}
    assert len(found) == 300
    for i, r in found.items():
        window = [(40 * (k // 2), c) for k, c in enumerate(cents) if 0 <= 40 * (i // 2) - 40 * (k // 2) < 900]
        n, sx, sy = len(window), sum(x for x, _ in window), sum(c for _, c in window)
        assert r.n == n and r.mean_kw == float(Fraction(sy, 100)) / n
        spread, shared = n * sum(x * x for x, _ in window) - sx * sx, n * sum(x * c for x, c in window) - sx * sy
        assert (r.slope is None) == (spread == 0) and (not spread or abs(r.slope - float(Fraction(shared * 60, spread * 100))) < 1e-9)


def test_offsets_are_counted_in_buckets_and_tasks_are_bounded(spark, tmp_path, monkeypatch):
    """F8, F12."""
    rows = spark.range(0, 3_000, 3).select(F.col("id").alias("seq"), (F.col("id") % 2).cast("int").alias("partition"))
    order = F.row_number().over(Window.partitionBy("partition").orderBy("seq")) - 1
    assert queries.numbered(rows, 100).withColumn("o", order).filter("offset <> o OR offset IS NULL").count() == 0
    path, keep = str(tmp_path / "log"), log.TASKS
    values = spark.range(600).select(F.lit(0).alias("partition"), F.col("id").alias("offset"), F.col("id").cast("string").cast("binary").alias("value"))
    log.write_segments(values, path, 10)
    monkeypatch.setattr(log, "TASKS", 20)
    read = log.read_log(spark, path)
    assert read.rdd.getNumPartitions() == 20 and [r.offset for r in read.orderBy("offset").collect()] == list(range(600)) and keep > 20


def test_warehouse_rows_move_narrow(spark, monkeypatch):
    """F5, F9, F14, F15."""
    names = writes(monkeypatch, warehouse)
    p = Plant(spark, DATA)
    first, late = warehouse.first_and_late(p)
    assert names == ["late"] and late.groupBy(*warehouse.KEY).count().filter("count > 1").count() == 0
    made = warehouse.by_plant(first, 3, "scaled")
    assert "plant_id" in made.columns and made.count() == 3 * first.count()
    assert "md5" not in "".join(c._jc.toString() for c in differences.row_hash(["a", "b"]))
    assert "Expand" not in plan(warehouse.cdc_conflicts(warehouse.changes(p, faults=True)))
