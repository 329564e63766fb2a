"""Quality gates and reconciliation: expectations as one pass of conditional counts, key coverage, stream against batch, device energy."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattmill.operators.differences import differing_parts
from wattmill.operators.views import Plant
from wattmill.plans.catalog import query
from wattmill.sources.adapter import day_conditions
from wattmill.staging import written

KEY = ("record_date", "workshop_code", "energy_code")
# The rules of both batches: (id, kind, column or columns, arguments), and the columns that must be there.
ENERGY_COLUMNS = ("record_date", "workshop_code", "energy_code", "consumption", "unit_price", "cost", "record_status", "is_production_day")
ENERGY_RULES = (
    ("energy.batch_not_empty", "not_empty", None, None),
    ("energy.record_date_required", "not_null", "record_date", None),
    ("energy.workshop_code_required", "not_null", "workshop_code", None),
    ("energy.energy_code_required", "not_null", "energy_code", None),
    ("energy.business_key_unique", "unique", KEY, None),
    ("energy.consumption_non_negative", "between", "consumption", (0, None)),
    ("energy.unit_price_non_negative", "between", "unit_price", (0, None)),
    ("energy.cost_non_negative", "between", "cost", (0, None)),
    ("energy.production_day_binary", "in_set", "is_production_day", (0, 1)),
    ("energy.record_status_allowed", "in_set", "record_status", ("正常", "低负荷", "停产")),
)
PRODUCTION_COLUMNS = ("record_date", "workshop_code", "output_qty")
PRODUCTION_RULES = (
    ("production.batch_not_empty", "not_empty", None, None),
    ("production.record_date_required", "not_null", "record_date", None),
    ("production.workshop_code_required", "not_null", "workshop_code", None),
    ("production.business_key_unique", "unique", ("record_date", "workshop_code"), None),
    ("production.output_qty_non_negative", "between", "output_qty", (0, None)),
)
# The energies each workshop must report.
EXPECTED_ENERGIES = {"W01": "E01,E02,E04,E05", "W02": "E01,E02,E03,E04", "W03": "E01,E02,E03", "W04": "E01,E04,E05", "W05": "E01,E02,E03,E04", "W06": "E01,E05", "W07": "E01,E02,E04,E06", "W08": "E01,E05"}


def missing_columns(frame: DataFrame, required: tuple[str, ...]) -> list[str]:
    """Checked before any rule."""
    return [c for c in required if c not in frame.columns]


def expectations(frame: DataFrame, rules=ENERGY_RULES, required: tuple[str, ...] = ()) -> DataFrame:
    """G1: one row per rule with the number of failures; all rules but uniqueness share one pass. Missing columns are the only rows if there are any.

    Nulls fail `not_null` alone. `unique` counts a key's rows beyond the first; a bound of None is open.
    """
    if len({r[0] for r in rules}) != len(rules):
        raise ValueError("rule ids must be unique")
    if missing := missing_columns(frame, required):
        return frame.sparkSession.createDataFrame([(f"missing column {c}", 1, False) for c in missing], "rule string, failures long, passed boolean")
    counts, unique = [], []
    for name, kind, columns, arguments in rules:
        c = F.col(columns) if isinstance(columns, str) else None
        if kind == "not_empty":
            counts.append(F.when(F.count("*") == 0, 1).otherwise(0).cast("long").alias(name))
        elif kind == "not_null":
            counts.append(F.count(F.when(c.isNull(), 1)).alias(name))
        elif kind == "between":
            low, high = arguments
            outside = (F.lit(False) if low is None else c < low) | (F.lit(False) if high is None else c > high)
            counts.append(F.count(F.when(outside, 1)).alias(name))
        elif kind == "in_set":
            counts.append(F.count(F.when(~c.isin(*arguments), 1)).alias(name))
        elif kind == "unique":
            unique.append((name, columns))
        else:
            raise ValueError(f"unknown rule kind {kind}")
    row = frame.agg(*counts)
    out = row.select(F.explode(F.array(*(F.struct(F.lit(c).alias("rule"), F.col(f"`{c}`").alias("failures")) for c in row.columns))).alias("r")).select("r.*")
    for name, columns in unique:
        groups = frame.groupBy(*columns).agg(F.count("*").alias("n"))
        out = out.unionByName(groups.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("long").alias("failures")).select(F.lit(name).alias("rule"), "failures"))
    return out.withColumn("passed", F.col("failures") == 0)


def batch(p: Plant) -> DataFrame:
    """All incoming records with faults at fixed places; versions of a key stand beside each other."""
    m = lambda n: F.col("source_id") % n == 0
    production_day, _ = day_conditions()
    rows = p.records.withColumn("day", production_day)
    keep = lambda n, c: F.when(~m(n), F.col(c)).alias(c)
    signed = lambda n, c: F.when(m(n), -F.col(c)).otherwise(F.col(c)).alias(c)
    status = F.when(m(137), "x").when(F.col("day") == 0, "停产").otherwise("正常")
    return rows.select("source_id", keep(103, "record_date"), keep(107, "workshop_code"), keep(109, "energy_code"), signed(101, "consumption"), signed(113, "unit_price"), signed(127, "cost"), status.alias("record_status"), F.when(m(131), 2).otherwise(F.col("day")).alias("is_production_day"))


_BATCH = """b AS (SELECT source_id, CASE WHEN source_id % 103 <> 0 THEN record_date END AS record_date, CASE WHEN source_id % 107 <> 0 THEN workshop_code END AS workshop_code, CASE WHEN source_id % 109 <> 0 THEN energy_code END AS energy_code, CASE WHEN source_id % 101 = 0 THEN -consumption ELSE consumption END AS consumption,
    CASE WHEN source_id % 113 = 0 THEN -unit_price ELSE unit_price END AS unit_price, CASE WHEN source_id % 127 = 0 THEN -cost ELSE cost END AS cost FROM records),
f(rule, failures) AS (SELECT 'energy.batch_not_empty', count(CASE WHEN false THEN 1 END) FROM b UNION ALL SELECT 'energy.record_date_required', count(*) FROM b WHERE record_date IS NULL UNION ALL SELECT 'energy.workshop_code_required', count(*) FROM b WHERE workshop_code IS NULL UNION ALL SELECT 'energy.energy_code_required', count(*) FROM b WHERE energy_code IS NULL
    UNION ALL SELECT 'energy.business_key_unique', CAST(sum(n - 1) AS BIGINT) FROM (SELECT count(*) AS n FROM b GROUP BY record_date, workshop_code, energy_code) UNION ALL SELECT 'energy.consumption_non_negative', count(*) FROM b WHERE consumption < 0 UNION ALL SELECT 'energy.unit_price_non_negative', count(*) FROM b WHERE unit_price < 0
    UNION ALL SELECT 'energy.cost_non_negative', count(*) FROM b WHERE cost < 0 UNION ALL SELECT 'energy.production_day_binary', count(*) FROM b WHERE source_id % 131 = 0 UNION ALL SELECT 'energy.record_status_allowed', count(*) FROM b WHERE source_id % 137 = 0)
"""


@query("g01_expectations", _BATCH + "SELECT rule, failures, failures = 0 AS passed FROM f UNION ALL SELECT rule, failures, failures = 0 FROM (SELECT 'production.batch_not_empty' AS rule, CASE WHEN count(*) = 0 THEN 1 ELSE 0 END AS failures FROM production UNION ALL SELECT 'production.record_date_required', count(*) FROM production WHERE record_date IS NULL UNION ALL SELECT 'production.workshop_code_required', count(*) FROM production WHERE workshop_code IS NULL UNION ALL SELECT 'production.business_key_unique', count(*) - count(DISTINCT record_date || workshop_code) FROM production UNION ALL SELECT 'production.output_qty_non_negative', count(*) FROM production WHERE output_qty < 0)")
def g_rules(p: Plant) -> DataFrame:
    return expectations(batch(p), ENERGY_RULES, ENERGY_COLUMNS).unionByName(expectations(p.production, PRODUCTION_RULES, PRODUCTION_COLUMNS))


@query("g02_missing_columns", "SELECT 'missing column ' || c AS rule, 1::BIGINT AS failures, false AS passed FROM (VALUES ('l_orderkey'), ('l_quantity'), ('unit_price'), ('record_status')) r(c) WHERE c NOT IN (SELECT column_name FROM (DESCRIBE lineitem))", "")
def g_columns(p: Plant) -> DataFrame:
    """Columns come first: the raw table lacks two of four, so no rule runs."""
    return expectations(p.table("lineitem"), ENERGY_RULES, ("l_orderkey", "l_quantity", "unit_price", "record_status"))


def orphans(child: DataFrame, parent: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """Keys of `child` that `parent` lacks."""
    return child.select(*key).distinct().join(parent.select(*key).distinct(), list(key), "left_anti")


@query("g03_orphan_keys", "SELECT DISTINCT record_date, workshop_code FROM energy WHERE NOT EXISTS (SELECT 1 FROM production p WHERE p.record_date = energy.record_date AND p.workshop_code = energy.workshop_code)")
def g_orphans(p: Plant) -> DataFrame:
    return orphans(p.energy, p.production, ("record_date", "workshop_code"))


def warehouse_gates(dwd: DataFrame, dws: DataFrame, production: DataFrame) -> DataFrame:
    """Seven yes-or-no gates over a loaded batch."""
    unique = lambda f, k: f.groupBy(*k).count().agg((F.coalesce(F.max("count"), F.lit(1)) <= 1).alias("ok"))
    total = dwd.filter("is_deleted = 0").agg(F.coalesce(F.sum("cost"), F.lit(0)).cast("double").alias("a")).join(dws.agg(F.coalesce(F.sum("cost"), F.lit(0)).cast("double").alias("b")))  # one row each
    null_key = F.col("record_date").isNull() | F.col("workshop_code").isNull() | F.col("energy_code").isNull()
    none = lambda f: f.agg((F.count("*") == 0).alias("ok"))
    gates = {
        "batch_covered": none(dws.select("record_date").distinct().join(dwd.select("record_date").distinct(), "record_date", "left_anti")),
        "not_empty": dwd.agg((F.count("*") > 0).alias("ok")),
        "key_unique": unique(dwd, KEY),
        "required_present": none(dwd.filter(null_key)),
        "production_unique": unique(production, ("record_date", "workshop_code")),
        "day_reconciles": total.select((F.abs(F.col("a") - F.col("b")) < 0.01).alias("ok")),
        "partitions_covered": none(dwd.filter("is_deleted = 0").select("record_date").distinct().join(dws.select("record_date").distinct(), "record_date", "left_anti")),
    }
    out = None
    for name, frame in gates.items():
        row = frame.select(F.lit(name).alias("gate"), "ok")
        out = row if out is None else out.unionByName(row)
    return out


@query("g04_warehouse_gates", "SELECT * FROM (VALUES ('batch_covered', true), ('not_empty', true), ('key_unique', true), ('required_present', true), ('production_unique', true), ('day_reconciles', true), ('partitions_covered', true)) g(gate, ok)")
def g_gates(p: Plant) -> DataFrame:
    return warehouse_gates(p.energy, p.energy.groupBy("record_date", "workshop_code").agg(F.sum("cost").alias("cost")), p.production)


@query("g04_broken_batches", """e AS (SELECT *, dense_rank() OVER (ORDER BY record_date) AS n FROM energy), ds AS (SELECT DISTINCT record_date, n FROM e)
SELECT 'faults' AS batch, 'batch_covered' AS gate, (SELECT count(*) FROM ds WHERE n % 5 = 1) = 0 AS ok UNION ALL SELECT 'faults', 'not_empty', (SELECT count(*) FROM energy) > 0 UNION ALL SELECT 'faults', 'key_unique', (SELECT count(*) FROM e WHERE n % 7 = 1) = 0 UNION ALL SELECT 'faults', 'required_present', (SELECT count(*) FROM e WHERE n % 11 = 1) = 0
UNION ALL SELECT 'faults', 'production_unique', (SELECT count(*) FROM production WHERE workshop_code = 'W01') = 0 UNION ALL SELECT 'faults', 'day_reconciles', (SELECT sum(cost) FROM energy) < 0 UNION ALL SELECT 'faults', 'partitions_covered', (SELECT count(*) FROM ds WHERE n % 3 = 0) = 0
UNION ALL SELECT 'empty', g, g <> 'not_empty' FROM (VALUES ('batch_covered'), ('not_empty'), ('key_unique'), ('required_present'), ('production_unique'), ('day_reconciles'), ('partitions_covered')) x(g)""")
def g_broken(p: Plant) -> DataFrame:
    """A batch in which every gate but one fails, and an empty one."""
    n = p.energy.select("record_date").distinct().withColumn("n", F.row_number().over(Window.orderBy("record_date")))  # a row per day
    e = p.energy.select(*KEY, "cost", "is_deleted").join(F.broadcast(n), "record_date")
    sums = e.groupBy("record_date", "workshop_code", "n").agg(F.sum("cost").alias("cost"))
    dws = sums.filter("n % 3 <> 0").withColumn("cost", F.col("cost") * 2).unionByName(sums.filter("n % 5 = 1").withColumn("record_date", F.date_add("record_date", 10_000)))
    dwd = e.unionByName(e.filter("n % 7 = 1")).withColumn("energy_code", F.when(F.col("n") % 11 != 1, F.col("energy_code")))
    production = p.production.unionByName(p.production.filter("workshop_code = 'W01'"))
    broken = warehouse_gates(dwd, dws, production).withColumn("batch", F.lit("faults"))
    return broken.unionByName(warehouse_gates(dwd.filter("n < 0"), dws.filter("n < 0"), production.filter("output_qty < 0")).withColumn("batch", F.lit("empty")))


def energy_coverage(energy: DataFrame, production: DataFrame, expected=EXPECTED_ENERGIES) -> DataFrame:
    """Production days whose energies differ from the manifest: missing and unexpected ones."""
    manifest = energy.sparkSession.createDataFrame([(w, e.split(",")) for w, e in expected.items()], "workshop_code string, expected array<string>")
    seen = energy.groupBy("record_date", "workshop_code").agg(F.collect_set("energy_code").alias("seen"))
    rows = production.select("record_date", "workshop_code").join(seen, ["record_date", "workshop_code"], "left").join(F.broadcast(manifest), "workshop_code")
    seen_or_none = F.coalesce("seen", F.array().cast("array<string>"))
    text = lambda a: F.array_join(F.array_sort(a), ",")
    rows = rows.select("record_date", "workshop_code", text(F.array_except("expected", seen_or_none)).alias("missing"), text(F.array_except(seen_or_none, F.col("expected"))).alias("unexpected"))
    return rows.filter("missing <> '' OR unexpected <> ''")


_EXPECTED = "m AS (SELECT w AS workshop_code, unnest(string_split(e, ',')) AS energy_code FROM (VALUES " + ", ".join(f"('{w}', '{e}')" for w, e in EXPECTED_ENERGIES.items()) + ") x(w, e)),\n"


@query("g05_energy_coverage", _EXPECTED + """mis AS (SELECT p.record_date, p.workshop_code, string_agg(m.energy_code, ',' ORDER BY m.energy_code) AS missing FROM production p JOIN m USING (workshop_code) LEFT JOIN energy e ON e.record_date = p.record_date AND e.workshop_code = p.workshop_code AND e.energy_code = m.energy_code WHERE e.energy_code IS NULL GROUP BY ALL),
une AS (SELECT e.record_date, e.workshop_code, string_agg(e.energy_code, ',' ORDER BY e.energy_code) AS unexpected FROM energy e JOIN production p USING (record_date, workshop_code) LEFT JOIN m ON m.workshop_code = e.workshop_code AND m.energy_code = e.energy_code WHERE m.energy_code IS NULL GROUP BY ALL)
SELECT record_date, workshop_code, coalesce(missing, '') AS missing, coalesce(unexpected, '') AS unexpected FROM mis FULL JOIN une USING (record_date, workshop_code)""")
def g_coverage(p: Plant) -> DataFrame:
    return energy_coverage(p.energy, p.production)


def latest_events(events: DataFrame, key: tuple[str, ...] = KEY) -> DataFrame:
    """Per key the latest event by (updated_at, event_id); identical replays count once; `conflict` names ids or versions with several payloads.

    Where one id has several payloads, the largest by its columns in order is shown, so the result doesn't depend on the order of rows.
    """
    once = events.dropDuplicates()
    ids = once.groupBy("event_id").agg(F.count("*").alias("_k")).filter("_k > 1").select("event_id", F.lit(True).alias("_id_conflict"))
    rows = once.join(ids, "event_id", "left")
    payload = F.struct(*(c for c in events.columns if c not in ("event_id", "updated_at", *key)))
    e = F.struct("event_id", payload.alias("payload"))
    versions = rows.groupBy(*key, "updated_at").agg(F.count_distinct(payload).alias("_payloads"), F.max(F.coalesce("_id_conflict", F.lit(False))).alias("_ids"), F.max(e).alias("e"))
    last = versions.groupBy(*key).agg(F.max_by(F.struct("updated_at", "e", "_payloads", "_ids"), "updated_at").alias("v"))
    return last.select(*key, "v.updated_at", "v.e.event_id", "v.e.payload.*", F.when(F.col("v._ids"), "event_id").when(F.col("v._payloads") > 1, "version").alias("conflict"))


@query("g06_latest_events", """ev AS (SELECT source_id AS event_id, updated_at, record_date, workshop_code, energy_code, consumption, cost FROM records UNION SELECT source_id, updated_at, record_date, workshop_code, energy_code, consumption, cost + 1 FROM records WHERE source_id % 77 = 0),
vs AS (SELECT record_date, workshop_code, energy_code, updated_at, max({'e': event_id, 'q': consumption, 'c': cost}) AS e, count(DISTINCT {'q': consumption, 'c': cost}) AS payloads, max(twice) AS ids FROM (SELECT *, count(*) OVER (PARTITION BY event_id) > 1 AS twice FROM ev) GROUP BY ALL)
SELECT record_date, workshop_code, energy_code, e.e AS event_id, e.q::DOUBLE AS consumption, e.c::DOUBLE AS cost, CASE WHEN ids THEN 'event_id' WHEN payloads > 1 THEN 'version' END AS conflict FROM vs QUALIFY row_number() OVER (PARTITION BY record_date, workshop_code, energy_code ORDER BY updated_at DESC) = 1""")
def g_latest(p: Plant) -> DataFrame:
    """Events of which a part is delivered again, some with another cost under the same id."""
    e = p.records.select(F.col("source_id").alias("event_id"), "updated_at", *KEY, "consumption", "cost")
    again = e.filter("event_id % 5 = 0").unionByName(e.filter("event_id % 77 = 0").withColumn("cost", (F.col("cost") + 1).cast("decimal(16,4)")))
    rows = latest_events(e.unionByName(again))
    return rows.select(*KEY, "event_id", F.col("consumption").cast("double").alias("consumption"), F.col("cost").cast("double").alias("cost"), "conflict")


def local_instant(local: Column, zone: str) -> Column:
    """A local time as an instant (session time zone UTC); null where clocks skip it or show it twice."""
    utc = F.to_utc_timestamp(local, zone)
    back = lambda minutes: F.from_utc_timestamp(utc + F.expr(f"INTERVAL {minutes} MINUTES"), zone)
    twice = reduce(lambda a, m: a | (back(m) == local), (-120, -60, -30, 30, 60, 120), F.lit(False))
    return F.when((back(0) == local) & ~twice, utc)


@query("g07_local_versions", """WITH t AS (SELECT l_orderkey, l_linenumber, CAST(l_shipdate AS TIMESTAMP) + to_hours((l_orderkey % 4)::INTEGER) + INTERVAL 30 MINUTES AS local, CAST(l_shipdate AS DATE) AS d FROM lineitem),
k AS (SELECT *, isodow(d) = 7 AND month(d) = 4 AND day(d) <= 7 AS first_april, isodow(d) = 7 AND month(d) = 10 AND day(d) > 24 AS last_october, make_date(year(d), 4, 1) AS a, make_date(year(d), 10, 31) AS o FROM t),
s AS (SELECT *, a + ((7 - isodow(a)) % 7)::INTEGER AS spring, o - (isodow(o) % 7)::INTEGER AS autumn FROM k)
SELECT l_orderkey, l_linenumber, CASE WHEN (first_april AND hour(local) = 2) OR (last_october AND hour(local) = 1) THEN NULL ELSE local + CASE WHEN local >= CAST(spring AS TIMESTAMP) + INTERVAL 2 HOURS AND local < CAST(autumn AS TIMESTAMP) + INTERVAL 1 HOUR THEN INTERVAL 4 HOURS ELSE INTERVAL 5 HOURS END END AS instant FROM s""", "")
def g_local(p: Plant) -> DataFrame:
    """Ship dates with hours as local times of a zone whose clocks change in April and October."""
    t = p.table("lineitem").select("l_orderkey", "l_linenumber", (F.col("l_shipdate").cast("timestamp") + F.make_dt_interval(hours=(F.col("l_orderkey") % 4).cast("int"), mins=F.lit(30))).alias("local"))
    return t.select("l_orderkey", "l_linenumber", local_instant(F.col("local"), "America/New_York").cast("timestamp_ntz").alias("instant"))


def repeated_keys(batch: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """Keys that a batch holds more than once; they are no side of a comparison."""
    return batch.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1")


@query("g07_repeated_batch_keys", "SELECT record_date, workshop_code, energy_code, count(*) AS n FROM records GROUP BY ALL HAVING count(*) > 1")
def g_repeated(p: Plant) -> DataFrame:
    return repeated_keys(p.records, KEY)


def reconcile(stream: DataFrame, batch: DataFrame, key: tuple[str, ...], values: tuple[str, ...], few_differences: bool = False) -> DataFrame:
    """Keys of one side only and fields that differ; equal rows don't appear. With `few_differences`, for written tables that should be equal, only places where they differ are joined."""
    if few_differences:
        stream, batch = differing_parts(stream.select(*key, *values), batch.select(*key, *values), key)
    s = stream.select(*key, F.struct(*values).alias("s"))
    b = batch.select(*key, F.struct(*values).alias("b"))
    both = s.join(b, list(key), "full")
    differs = F.array_compact(F.array(*(F.when(~F.col(f"s.{v}").eqNullSafe(F.col(f"b.{v}")), F.lit(v)) for v in values)))
    status = F.when(F.col("b").isNull(), "only_stream").when(F.col("s").isNull(), "only_batch").when(F.size(differs) > 0, "differs")
    return both.select(*key, status.alias("status"), F.when(F.col("s").isNotNull() & F.col("b").isNotNull(), F.array_join(differs, ",")).otherwise("").alias("fields")).filter("status IS NOT NULL")


@query("g06_g07_stream_batch", """s AS (SELECT record_date, workshop_code, energy_code, arg_max(consumption, (updated_at, source_id)) AS consumption, arg_max(cost, (updated_at, source_id)) AS cost FROM records WHERE source_id % 7 <> 0 GROUP BY ALL), b AS (SELECT record_date, workshop_code, energy_code, arg_max(consumption, (updated_at, source_id)) AS consumption, arg_max(cost, (updated_at, source_id)) AS cost FROM records WHERE source_id % 11 <> 0 GROUP BY ALL),
j AS (SELECT coalesce(s.record_date, b.record_date) AS record_date, coalesce(s.workshop_code, b.workshop_code) AS workshop_code, coalesce(s.energy_code, b.energy_code) AS energy_code, CASE WHEN b.energy_code IS NULL THEN 'only_stream' WHEN s.energy_code IS NULL THEN 'only_batch' WHEN s.consumption <> b.consumption OR s.cost <> b.cost THEN 'differs' END AS status,
CASE WHEN s.energy_code IS NOT NULL AND b.energy_code IS NOT NULL THEN concat_ws(',', CASE WHEN s.consumption <> b.consumption THEN 'consumption' END, CASE WHEN s.cost <> b.cost THEN 'cost' END) ELSE '' END AS fields FROM s FULL JOIN b ON s.record_date = b.record_date AND s.workshop_code = b.workshop_code AND s.energy_code = b.energy_code) SELECT * FROM j WHERE status IS NOT NULL""")
def g_reconcile(p: Plant) -> DataFrame:
    events = p.records.select(F.col("source_id").alias("event_id"), "updated_at", *KEY, "consumption", "cost")
    last = lambda n: latest_events(events.filter(F.col("event_id") % n != 0))
    return reconcile(last(7), last(11), KEY, ("consumption", "cost"))


@query("g07_few_differences", """r AS (SELECT record_date, workshop_code, energy_code, arg_max(consumption, (updated_at, source_id)) AS consumption, arg_max(source_id, (updated_at, source_id)) AS id FROM records GROUP BY ALL)
SELECT record_date, workshop_code, energy_code, CASE WHEN id % 300 = 1 THEN 'only_stream' ELSE 'differs' END AS status, CASE WHEN id % 300 = 1 THEN '' ELSE 'consumption' END AS fields FROM r WHERE id % 300 IN (1, 2)""")
def g_few(p: Plant) -> DataFrame:
    """Two tables of one state, of which one lacks some keys and has other quantities in some."""
    rows = p.records.select(F.col("source_id").alias("event_id"), "updated_at", *KEY, "consumption", "cost", "source_id")
    stream = written(latest_events(rows), "stream")
    batch = written(stream.filter("source_id % 300 <> 1").withColumn("consumption", F.when(F.col("source_id") % 300 == 2, F.col("consumption") + 1).otherwise(F.col("consumption"))), "batch")
    return reconcile(stream, batch, KEY, ("consumption", "cost"), few_differences=True)


def engine_difference(a: DataFrame, b: DataFrame, key: tuple[str, ...], metrics: tuple[str, ...], tolerance: float) -> DataFrame:
    """Keys of one side only and the largest difference of each metric, with the verdict."""
    joined = a.select(*key, F.struct(*metrics).alias("a")).join(b.select(*key, F.struct(*metrics).alias("b")), list(key), "full")
    gap = lambda m: F.coalesce(F.max(F.abs(F.col(f"a.{m}") - F.col(f"b.{m}"))), F.lit(0.0)).cast("double")
    row = joined.agg(F.count(F.when(F.col("a").isNull() | F.col("b").isNull(), 1)).alias("unmatched"), *(F.round(gap(m), 6).alias(f"gap_{m}") for m in metrics))
    ok = F.col("unmatched") == 0
    for m in metrics:
        ok = ok & (F.col(f"gap_{m}") <= tolerance)
    return row.withColumn("ok", ok)


@query("g08_engine_difference", """x AS (SELECT *, CASE WHEN workshop_code = 'W03' THEN cost_yuan::DOUBLE + 5 ELSE cost_yuan::DOUBLE END AS other FROM days)
SELECT count(CASE WHEN day(record_date) = 7 THEN 1 END) AS unmatched, round(max(abs(tce::DOUBLE - round(tce::DOUBLE, 2))) FILTER (day(record_date) <> 7), 6) AS gap_tce, round(max(abs(cost_yuan::DOUBLE - other)) FILTER (day(record_date) <> 7), 6) AS gap_cost, count(CASE WHEN day(record_date) = 7 OR workshop_code = 'W03' THEN 1 END) = 0 AS ok FROM x""")
def g_engines(p: Plant) -> DataFrame:
    """The other side lacks a day of each month and has another cost in one workshop."""
    a = p.days.select("record_date", "workshop_code", F.col("tce").cast("double").alias("tce"), F.col("cost_yuan").cast("double").alias("cost"))
    b = a.filter(F.dayofmonth("record_date") != 7).withColumns({"tce": F.round("tce", 2), "cost": F.when(F.col("workshop_code") == "W03", F.col("cost") + 5).otherwise(F.col("cost"))})
    return engine_difference(a, b, ("record_date", "workshop_code"), ("tce", "cost"), 0.01)


def comparison_frame(energy: DataFrame, production: DataFrame, energies: DataFrame) -> DataFrame:
    """Days in the six columns in which engines are compared, from quantities times factors; nothing is rounded before the sums."""
    weighed = lambda f: F.sum(F.col("consumption") * F.col(f))
    days = energy.join(F.broadcast(energies), "energy_code").groupBy("record_date", "workshop_code").agg(weighed("std_coal_factor").cast("double").alias("kgce"), weighed("co2_factor").cast("double").alias("co2"), F.sum("cost").cast("double").alias("cost_yuan"))
    rows = days.join(production.select("record_date", "workshop_code", F.col("output_qty").cast("double").alias("qty")), ["record_date", "workshop_code"], "left")
    return rows.select("record_date", "workshop_code", (F.col("kgce") / 1000).alias("tce"), (F.col("co2") / 1000).alias("co2_t"), "cost_yuan", F.try_divide("kgce", "qty").alias("unit_energy_kgce"))


@query("g08b_comparison_frame", """k AS (SELECT record_date, workshop_code, sum(consumption * std_coal_factor)::DOUBLE AS kgce, sum(consumption * co2_factor)::DOUBLE AS co2, sum(cost)::DOUBLE AS cost_yuan FROM energy JOIN dim_energy USING (energy_code) GROUP BY ALL)
SELECT record_date, workshop_code, round(kgce / 1000, 7) AS tce, round(co2 / 1000, 7) AS co2_t, cost_yuan, round(kgce / output_qty::DOUBLE, 7) AS unit_energy_kgce FROM k LEFT JOIN production USING (record_date, workshop_code)""")
def g_frame(p: Plant) -> DataFrame:
    rows = comparison_frame(p.energy, p.production, p.energies)
    return rows.withColumns({c: F.round(c, 7) for c in ("tce", "co2_t", "unit_energy_kgce")})


def device_day(samples: DataFrame, targets: DataFrame, interval_s: int, least_coverage: float = 0.9, tolerance: float = 0.08) -> DataFrame:
    """Unique samples per workshop and day, coverage of what is expected, integrated energy against a daily target."""
    once = samples.dropDuplicates(["event_id"])
    got = once.groupBy("workshop_code", F.to_date("event_time").alias("record_date")).agg(F.count("*").alias("n"), F.count_distinct("device_id").alias("devices"), F.sum(F.col("power_kw") * interval_s / 3600.0).alias("kwh"))
    rows = got.join(targets, ["workshop_code", "record_date"], "full")
    coverage = F.least(F.lit(1.0), F.try_divide(F.col("n").cast("double"), F.col("devices") * 86400.0 / interval_s))
    error = F.try_divide(F.abs(F.col("kwh") - F.col("daily_kwh")), F.col("daily_kwh"))
    status = F.when(F.col("n").isNull(), "no_samples").when(F.col("daily_kwh").isNull(), "no_target").when(coverage < least_coverage, "low_coverage").when(error > tolerance, "energy_differs").otherwise("ok")
    return rows.select("workshop_code", "record_date", "n", "devices", F.round(coverage, 6).alias("coverage"), F.round("kwh", 4).alias("kwh"), F.round(error, 6).alias("relative_error"), status.alias("status"))


@query("g09_g10_device_day", """s AS (SELECT 'W0' || (user_id % 8 + 1) AS workshop_code, CAST(ts AS DATE) AS record_date, count(*) AS n, count(DISTINCT user_id) AS devices, sum(value * 600e0 / 3600) AS kwh FROM (SELECT DISTINCT ON (event_id) * FROM events) WHERE value >= 0 GROUP BY ALL), t AS (SELECT workshop_code, record_date, kwh * 1.05 AS daily_kwh FROM s WHERE day(record_date) % 5 <> 0)
SELECT workshop_code, record_date, n, devices, round(least(1, n / (devices * 144e0)), 6) AS coverage, round(kwh, 4) AS kwh, round(abs(kwh - daily_kwh) / daily_kwh, 6) AS relative_error, CASE WHEN daily_kwh IS NULL THEN 'no_target' WHEN n / (devices * 144e0) < 0.03 THEN 'low_coverage' WHEN abs(kwh - daily_kwh) / daily_kwh > 0.04 THEN 'energy_differs' ELSE 'ok' END AS status FROM s LEFT JOIN t USING (workshop_code, record_date)""")
def g_devices(p: Plant) -> DataFrame:
    samples = p.table("events").filter("value >= 0").select("event_id", F.concat(F.lit("W0"), F.col("user_id") % 8 + 1).alias("workshop_code"), F.col("user_id").alias("device_id"), F.col("ts").alias("event_time"), F.col("value").alias("power_kw"))
    daily = samples.groupBy("workshop_code", F.to_date("event_time").alias("record_date")).agg((F.sum(F.col("power_kw") * 600.0 / 3600.0) * 1.05).alias("daily_kwh")).filter(F.dayofmonth("record_date") % 5 != 0)
    return device_day(samples, daily, 600, 0.03, 0.04)


def sample_quality(samples: DataFrame, fleet: DataFrame, interval_s: int) -> DataFrame:
    """Per workshop and day of the fleet (workshop_code, device_id) expected and unique samples, repeats, misses and coverage, which is 1 at most."""
    days = samples.select(F.to_date("ts").alias("record_date")).distinct()
    expected = fleet.groupBy("workshop_code").agg((F.count_distinct("device_id") * (86_400 // interval_s)).alias("expected"))
    grid = expected.join(F.broadcast(days))  # a row per workshop and day: both are small dimensions
    got = samples.groupBy("workshop_code", F.to_date("ts").alias("record_date")).agg(F.count("*").alias("n_rows"), F.count_distinct("event_id").alias("n_unique"))
    rows = grid.join(got, ["workshop_code", "record_date"], "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_rows", "n_unique")})
    missed = F.greatest(F.col("expected") - F.col("n_unique"), F.lit(0))
    share = lambda c: F.try_divide(c.cast("double"), F.col("expected"))
    return rows.select("workshop_code", "record_date", "expected", "n_unique", (F.col("n_rows") - F.col("n_unique")).alias("repeats"), missed.alias("missed"), share(missed).alias("miss_rate"), F.least(F.lit(1.0), share(F.col("n_unique"))).alias("coverage"))


def day_evidence(samples: DataFrame, targets: DataFrame, fleet: DataFrame, interval_s: int, tolerance: float = 0.08, least_coverage: float = 0.9, band: float = 1e-6) -> DataFrame:
    """Per workshop and day the energy by three paths: samples, minutes, and the daily target (workshop_code, record_date, daily_kwh), with their
    distances relative to the target, and a status: missing_side, mismatch or ok."""
    from wattmill.streaming import power

    keys = ["workshop_code", "record_date"]
    once = samples.dropDuplicates(["event_id"])
    raw = once.groupBy("workshop_code", F.to_date("ts").alias("record_date")).agg(F.sum(F.col("power_kw") * F.col("interval_seconds") / 3600.0).alias("raw_kwh"))
    by_minute = power.workshop_minutes(power.device_minutes(once))
    minutes = by_minute.groupBy("workshop_code", F.to_date("minute").alias("record_date")).agg(F.sum(F.coalesce("kwh", F.col("total_kw") * 60 / 3600.0)).alias("minute_kwh"))
    rows = sample_quality(samples, fleet, interval_s).join(raw, keys, "left").join(minutes, keys, "left").join(targets, keys, "full")
    apart = lambda a, b: F.try_divide(F.abs(F.col(a) - F.col(b)), F.col("daily_kwh"))
    rows = rows.withColumns({"raw_vs_minute": apart("raw_kwh", "minute_kwh"), "minute_vs_daily": apart("minute_kwh", "daily_kwh"), "raw_vs_daily": apart("raw_kwh", "daily_kwh")})
    missing = F.col("daily_kwh").isNull() | F.col("raw_kwh").isNull() | F.col("minute_kwh").isNull()
    sound = (F.col("coverage") >= least_coverage) & (F.col("raw_vs_daily") <= tolerance) & (F.col("minute_vs_daily") <= tolerance) & (F.col("raw_vs_minute") <= band)
    return rows.withColumn("status", F.when(missing, "missing_side").when(F.coalesce(sound, F.lit(False)), "ok").otherwise("mismatch"))


def device_samples(p: Plant) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Samples of devices (a part delivered twice), the fleet with a device that never reports, and daily targets, of which some lie off and some are missing."""
    e = p.table("events").filter("value >= 0")
    samples = e.select("event_id", F.concat(F.lit("W0"), F.col("user_id") % 8 + 1).alias("workshop_code"), F.col("user_id").alias("device_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("power_kw"), F.lit(600).alias("interval_seconds"))
    fleet = samples.select("workshop_code", "device_id").unionByName(samples.select("workshop_code", F.lit(-1).cast("long").alias("device_id"))).distinct()
    daily = samples.groupBy("workshop_code", F.to_date("ts").alias("record_date")).agg(F.sum(F.col("power_kw") * 600.0 / 3600.0).alias("kwh"))
    off = F.when(F.dayofmonth("record_date") % 7 == 0, 1.5).otherwise(1.01)
    targets = daily.filter(F.dayofmonth("record_date") % 5 != 0).select("workshop_code", "record_date", (F.col("kwh") * off).alias("daily_kwh"))
    return samples.unionByName(samples.filter("event_id % 9 = 0")), fleet, targets


_DEVICES = """WITH s AS (SELECT event_id, 'W0' || (user_id % 8 + 1) AS workshop_code, user_id AS device_id, CAST(ts AS DATE) AS record_date, value FROM events WHERE value >= 0), x AS (SELECT workshop_code, (count(DISTINCT device_id) + 1) * 144 AS expected FROM s GROUP BY 1), g AS (SELECT * FROM x, (SELECT DISTINCT record_date FROM s)),
n AS (SELECT workshop_code, record_date, count(*) AS n, count(CASE WHEN event_id % 9 = 0 THEN 1 END) AS again, sum(value * 600e0 / 3600) AS kwh FROM s GROUP BY ALL), q AS (SELECT g.*, coalesce(n, 0) AS n_unique, coalesce(again, 0) AS repeats, greatest(expected - coalesce(n, 0), 0) AS missed, kwh FROM g LEFT JOIN n USING (workshop_code, record_date))
"""


@query("g09_sample_quality", _DEVICES + "SELECT workshop_code, record_date, expected, n_unique, repeats, missed, round(missed / expected, 8) AS miss_rate, round(least(1, n_unique / expected), 8) AS coverage FROM q", "")
def g_samples(p: Plant) -> DataFrame:
    samples, fleet, _ = device_samples(p)
    return sample_quality(samples, fleet, 600).withColumns({c: F.round(c, 8) for c in ("miss_rate", "coverage")})


@query("g11_three_paths", _DEVICES + """, t AS (SELECT *, CASE WHEN day(record_date) % 5 <> 0 THEN kwh * CASE WHEN day(record_date) % 7 = 0 THEN 1.5 ELSE 1.01 END END AS daily FROM q)
SELECT workshop_code, record_date, round(kwh, 6) AS raw_kwh, round(kwh, 6) AS minute_kwh, round(daily, 6) AS daily_kwh, round(abs(kwh - daily) / daily, 6) AS raw_vs_daily, CASE WHEN daily IS NULL THEN 'missing_side' WHEN n_unique / expected >= 0.01 AND abs(kwh - daily) / daily <= 0.08 THEN 'ok' ELSE 'mismatch' END AS status FROM t""", "")
def g_paths(p: Plant) -> DataFrame:
    samples, fleet, targets = device_samples(p)
    rows = day_evidence(samples, targets, fleet, 600, least_coverage=0.01)
    return rows.select("workshop_code", "record_date", *(F.round(c, 6).alias(c) for c in ("raw_kwh", "minute_kwh", "daily_kwh")), F.round("raw_vs_daily", 6).alias("raw_vs_daily"), "status")


@query("g12_cube_identities", "SELECT (SELECT round(sum(std_coal_kgce)::DOUBLE, 3) FROM v) AS all_records, (SELECT round(sum(e)::DOUBLE, 3) FROM (SELECT sum(std_coal_kgce) AS e FROM v GROUP BY record_date, workshop_code)) AS workshop_days, (SELECT round(sum(e)::DOUBLE, 3) FROM (SELECT sum(std_coal_kgce) AS e FROM v GROUP BY record_date, workshop_code, energy_code)) AS energy_days, (SELECT round(sum(std_coal_kgce)::DOUBLE, 3) FROM v WHERE process_type <> '公用工程') AS without_utility, (SELECT round(sum(std_coal_kgce)::DOUBLE, 3) FROM v WHERE workshop_code <> 'W07') AS without_station, (SELECT sum(std_coal_kgce) FROM v WHERE process_type = '公用工程') = (SELECT sum(std_coal_kgce) FROM v WHERE workshop_code = 'W07') AS agree")
def g_identities(p: Plant) -> DataFrame:
    """The plant's energy by record, by workshop and day, and by energy, too; without the utility workshop by its kind and by its code."""
    e = p.enriched
    total = lambda rows, name: rows.agg(F.round(F.sum("std_coal_kgce").cast("double"), 3).alias(name))
    by = lambda *keys: e.groupBy(*keys).agg(F.sum("std_coal_kgce").alias("std_coal_kgce"))
    days = by("record_date", "workshop_code", "process_type")
    parts = [total(e, "all_records"), total(days, "workshop_days"), total(by("record_date", "workshop_code", "energy_code"), "energy_days"), total(days.filter("process_type <> '公用工程'"), "without_utility"), total(days.filter("workshop_code <> 'W07'"), "without_station")]
    row = reduce(lambda a, b: a.join(b), parts)  # one row each
    same = (F.col("all_records") == F.col("workshop_days")) & (F.col("all_records") == F.col("energy_days")) & (F.col("without_utility") == F.col("without_station"))
    return row.withColumn("agree", same)
