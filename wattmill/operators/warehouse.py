"""Layered warehouse: incoming rows, late merges, day, month and factory layers, CDC projection, snapshots, audits.

Tables are Parquet folders partitioned by `dt`; merges rank versions per key and overwrite only the dates they touch. A tombstone is a
version: rank first, filter after.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wattmill.operators.differences import one_sided
from wattmill.operators.views import Plant, ratio, thousandth
from wattmill.plans.catalog import query
from wattmill.sources.adapter import ORACLE, day_conditions
from wattmill.staging import new_path, written

KEY = ("record_date", "workshop_code", "energy_code")


def latest(rows: DataFrame, key: tuple[str, ...], *order: Column) -> DataFrame:
    """The first row of each key in the given order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("_n = 1").drop("_n")


def latest_valid_live(rows: DataFrame, key: tuple[str, ...] = KEY) -> DataFrame:
    """Newest version (then largest source_id) of each key; keys whose newest version is deleted or invalid disappear."""
    top = latest(rows, key, F.col("updated_at").desc_nulls_last(), F.desc("source_id"))
    return top.filter("is_deleted = 0 AND consumption >= 0 AND cost >= 0")


def deleted_or_valid() -> Column:
    return (F.coalesce("is_deleted", F.lit(0)) == 1) | ((F.col("consumption") >= 0) & (F.col("unit_price") > 0))


def incoming(ods: DataFrame, workshops: DataFrame, energies: DataFrame, calendar: DataFrame) -> DataFrame:
    """O1: typed rows with surrogate key, names, calendar flags and factors; invalid rows go, deletes pass."""
    day = calendar.select(F.col("calendar_date").alias("record_date"), "is_weekend", "is_holiday", "year_month")
    rows = ods.drop("unit").join(F.broadcast(energies), "energy_code").join(F.broadcast(workshops.select("workshop_code", "workshop_name", "process_type")), "workshop_code").join(F.broadcast(day), "record_date")
    weighed = lambda factor: F.round(F.col("consumption") * F.col(factor), 3).cast("decimal(18,3)")
    return rows.filter(deleted_or_valid()).select(
        F.sha2(F.concat_ws("|", F.date_format("record_date", "yyyy-MM-dd"), "workshop_code", "energy_code").cast("binary"), 256).alias("energy_key"), *KEY, "workshop_name", "process_type", "energy_name", "consumption", "unit", "unit_price", "cost", "record_status", "avg_temperature",
        "is_production_day", "is_weekend", "is_holiday", "year_month", weighed("std_coal_factor").alias("std_coal_kgce"), weighed("co2_factor").alias("co2_kg"), "updated_at", F.coalesce("is_deleted", F.lit(0)).alias("is_deleted"), "source_id",
    )


def late_merge(current: DataFrame, new: DataFrame, key: tuple[str, ...] = KEY) -> DataFrame:
    """O2: rows of the business dates that `new` touches, newest version first, `new` before old on equal stamps."""
    touched = new.select("record_date").distinct()
    old = current.join(touched, "record_date", "left_semi").withColumn("_p", F.lit(0))
    both = old.unionByName(new.withColumn("_p", F.lit(1)), allowMissingColumns=True)
    return latest(both, key, F.col("updated_at").desc_nulls_last(), F.desc("_p"), F.desc("source_id")).drop("_p")


def overwrite_dates(rows: DataFrame, path: str, stage: str, date: str = "record_date") -> DataFrame:
    """O3: writes a stage first, then only the partitions in it; the target may be an input of `rows`. Columns go by name."""
    rows.write.mode("overwrite").parquet(stage)
    staged = rows.sparkSession.read.parquet(stage)
    staged.withColumn("dt", F.col(date)).repartition("dt").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dt").parquet(path)
    return staged


def production_rebuilt(current: DataFrame, snapshot: DataFrame, workshops: DataFrame, touched: DataFrame) -> DataFrame:
    """Production rows after a load: dates in `touched` anew from the whole snapshot, known workshops and quantities of 0 or more; other dates as they were."""
    dates = F.broadcast(touched.select("record_date").distinct())  # at most a row per calendar day
    fresh = snapshot.filter("output_qty >= 0").join(F.broadcast(workshops.select("workshop_code")), "workshop_code", "left_semi").join(dates, "record_date", "left_semi")
    return current.join(dates, "record_date", "left_anti").unionByName(fresh.select(*current.columns))


def dws_day(dwd: DataFrame, production: DataFrame) -> DataFrame:
    """Sums of live rows per workshop and day. A day all of whose rows are deleted stays, with zeros, so its partition is overwritten."""
    live = F.col("is_deleted") == 0
    total = lambda c: F.sum(F.when(live, F.col(c)).otherwise(F.lit(0)))
    days = dwd.groupBy("record_date", "workshop_code").agg(
        F.max("workshop_name").alias("workshop_name"), F.max("process_type").alias("process_type"), F.max("year_month").alias("year_month"), total("std_coal_kgce").alias("kgce"), total("co2_kg").alias("co2_kg"), total("cost").alias("cost_yuan"),
        F.max((live & (F.col("is_production_day") == 0)).cast("int")).alias("has_shutdown"), F.avg(F.when(live, F.col("avg_temperature"))).alias("avg_temperature"),
    )
    unit = F.when(F.col("output_qty") > 0, F.round(ratio(F.col("kgce"), F.col("output_qty")), 5))
    return days.join(production.select("record_date", "workshop_code", "output_qty"), ["record_date", "workshop_code"], "left").select(
        "record_date", "workshop_code", "workshop_name", "process_type", "year_month", F.round(thousandth(F.col("kgce")), 4).alias("tce"), F.round(thousandth(F.col("co2_kg")), 3).alias("co2_t"), F.round("cost_yuan", 2).alias("cost_yuan"),
        "output_qty", unit.alias("unit_energy_kgce"), "has_shutdown", "avg_temperature",
    )


def dws_month(days: DataFrame, touched: DataFrame | None = None) -> DataFrame:
    """Whole months; with `touched` (dates) only those that it touches."""
    rows = days
    if touched is not None:
        rows = rows.join(touched.select(F.date_format("record_date", "yyyy-MM").alias("year_month")).distinct(), "year_month", "left_semi")
    sums = rows.groupBy("year_month", "workshop_code").agg(
        F.max("workshop_name").alias("workshop_name"), F.max("process_type").alias("process_type"), F.round(F.sum("tce"), 4).alias("tce"), F.round(F.sum("co2_t"), 3).alias("co2_t"), F.round(F.sum("cost_yuan"), 2).alias("cost_yuan"), F.round(F.sum("output_qty"), 3).alias("output_qty")
    )
    per = lambda c, times, digits: F.when(F.col("output_qty") > 0, F.round(ratio(F.col(c) * times, F.col("output_qty")), digits))
    return sums.withColumns({"unit_energy_kgce": per("tce", 1000, 5), "unit_cost_yuan": per("cost_yuan", 1, 4)})


def ads_factory_day(days: DataFrame, dwd: DataFrame) -> DataFrame:
    """Factory totals, workshops with live rows, workshop days whose intensity is missing or negative."""
    live = dwd.filter("is_deleted = 0").select("record_date", "workshop_code", F.col("workshop_code").alias("live_workshop")).distinct()
    bad = F.col("unit_energy_kgce").isNull() | (F.col("unit_energy_kgce") < 0)
    return days.join(live, ["record_date", "workshop_code"], "left").groupBy("record_date").agg(
        F.round(F.sum("tce"), 4).alias("tce"), F.round(F.sum("co2_t"), 3).alias("co2_t"), F.round(F.sum("cost_yuan"), 2).alias("cost_yuan"), F.count_distinct("live_workshop").alias("workshops"), F.count(F.when(bad, 1)).alias("bad_intensity")
    )


def newer_wins(target: DataFrame, new: DataFrame, key: tuple[str, ...] = KEY) -> DataFrame:
    """Rows of `new` replace only strictly older ones; a missing stamp is oldest; the stamp never falls."""
    rows = target.withColumn("_p", F.lit(1)).unionByName(new.withColumn("_p", F.lit(0)))
    return latest(rows, key, F.col("updated_at").desc_nulls_last(), F.desc("_p")).drop("_p")


def insert_ignore(target: DataFrame, new: DataFrame, key: tuple[str, ...] = KEY) -> DataFrame:
    """Rows whose key isn't there yet."""
    return target.unionByName(new.join(target.select(*key), list(key), "left_anti"))


def advanced_watermark(state: DataFrame, loaded: DataFrame, table: str, column: str = "updated_at") -> DataFrame:
    """The table's watermark row after a load: never falls, an empty batch keeps it, a cold start is 1970."""
    new = loaded.agg(F.max(column).alias("_max"), F.count("*").alias("last_rows"))
    old = state.filter(F.col("target_table") == table).agg(F.max("watermark_val").alias("_old"))
    zero = F.timestamp_seconds(F.lit(0))
    return new.join(old).select(F.lit(table).alias("target_table"), F.greatest(F.coalesce("_old", zero), F.coalesce("_max", zero)).alias("watermark_val"), "last_rows")  # one row each


def load_with_watermark(new: DataFrame, target: str, state: DataFrame, state_path: str, table: str, batch_id: str) -> DataFrame:
    """Writes the batch's own folder, then the watermark row, so that a failed load leaves the old watermark. A repeated batch overwrites itself."""
    new.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")
    row = advanced_watermark(state, new, table)
    row.write.mode("overwrite").parquet(f"{state_path}/batch={batch_id}")
    return row


def uncovered_dates(rows: DataFrame, calendar: DataFrame) -> DataFrame:
    """Business dates that the calendar lacks (an inner join would drop them silently)."""
    return rows.select("record_date").distinct().join(calendar.select(F.col("calendar_date").alias("record_date")), "record_date", "left_anti")


class Snapshots:
    """Versions of a table as immutable `snapshot_id=` partitions of one Parquet folder; reading one is a partition filter.

    A commit makes the folder of the next number and fails if another writer has made it; the caller then commits again.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def lineage(self) -> DataFrame:
        """`snapshot_id` and its `parent`, from the folders' names."""
        ids = self._rows().select("snapshot_id").distinct()
        return ids.select("snapshot_id", F.nullif(F.col("snapshot_id") - 1, F.lit(0)).alias("parent"))

    def _rows(self) -> DataFrame:
        return self.spark.read.option("mergeSchema", "true").parquet(self.path)

    def _last(self) -> int:
        try:
            return self._rows().agg(F.max("snapshot_id")).first()[0] or 0
        except Exception as error:
            if "PATH_NOT_FOUND" not in str(error) and "UNABLE_TO_INFER_SCHEMA" not in str(error):
                raise
            return 0

    def commit(self, rows: DataFrame) -> int:
        number = self._last() + 1
        rows.write.mode("errorifexists").parquet(f"{self.path}/snapshot_id={number}")
        return number

    def read(self, snapshot_id: int | None = None) -> DataFrame:
        number = snapshot_id or self._last()
        if not 0 < number <= self._last():
            raise ValueError(f"no snapshot {snapshot_id} in {self.path}")
        return self.spark.read.parquet(f"{self.path}/snapshot_id={number}")

    def merge(self, new: DataFrame, key: tuple[str, ...] = KEY) -> int:
        """Newer rows replace older ones; replays and older versions change nothing."""
        return self.commit(newer_wins(self.read(), new, key))


def cdc_images(changes: DataFrame) -> DataFrame:
    """What a change log says of business keys: `business_key`, `id`, `version`, `is_deleted`, `image`; redelivered events count once.

    Changes have `op` (r, c, u or d), `id`, `file_no`, `pos`, `row` and the structs `before` and `after`, each with a `business_key`. A version
    is the binlog's file number, position and row, and whether the event is more than a first read. A delete or a changed key says that the old
    key is deleted.
    """
    version = F.struct("file_no", "pos", "row", (F.col("op") != "r").cast("int").alias("streamed"))
    rows = changes.withColumn("version", version)
    after = rows.filter("op <> 'd'").select(F.col("after.business_key").alias("business_key"), "id", "version", F.lit(0).alias("is_deleted"), F.col("after").alias("image"))
    moved = (F.col("op") == "d") | (F.col("before.business_key") != F.col("after.business_key"))
    gone = rows.filter(F.col("before").isNotNull() & moved).select(F.col("before.business_key").alias("business_key"), "id", "version", F.lit(1).alias("is_deleted"), F.col("before").alias("image"))
    return after.unionByName(gone).repartition("business_key").distinct()  # what goes on by key, too, isn't shuffled again


def cdc_conflicts(changes: DataFrame) -> DataFrame:
    """Replay anomalies: `kind`, `business_key`, `id`, `version`.

    image: one id's version has several contents. owner: a key is taken over or deleted by an id other than the live one before it.
    """
    version = F.struct("file_no", "pos", "row", (F.col("op") != "r").cast("int").alias("streamed"))
    signature = F.struct("op", "before", "after")
    twice = changes.withColumn("version", version).groupBy("id", "version").agg(F.min(F.xxhash64(signature)).alias("a"), F.max(F.xxhash64(signature)).alias("b"), F.min(F.coalesce("after.business_key", "before.business_key")).alias("business_key")).filter("a <> b")
    by = Window.partitionBy("business_key").orderBy("version", "is_deleted", "id")
    before = cdc_images(changes).withColumns({"_id": F.lag("id").over(by), "_deleted": F.lag("is_deleted").over(by)})
    taken = before.filter((F.col("_deleted") == 0) & (F.col("_id") != F.col("id")))
    return twice.select(F.lit("image").alias("kind"), "business_key", "id", "version").unionByName(taken.select(F.lit("owner").alias("kind"), "business_key", "id", "version"))


def cdc_projection(changes: DataFrame, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """(state, conflicts): per business key the newest image with its id, version and tombstone flag. `strict` raises on any conflict."""
    conflicts = cdc_conflicts(changes)
    if strict and (found := conflicts.limit(5).collect()):
        raise ValueError(f"conflicts in the change log: {found}")
    newest = F.max_by(F.struct("id", "is_deleted", "image", "version"), F.struct("version", "is_deleted", "id"))
    return cdc_images(changes).groupBy("business_key").agg(newest.alias("s")).select("business_key", "s.*"), conflicts


def offset_projection(changes: DataFrame) -> DataFrame:
    """The latest event of each id by offset; a delete is a row with is_deleted = 1."""
    last = changes.groupBy("id").agg(F.max_by(F.struct("op", "offset", "before", "after"), "offset").alias("e"))
    return last.select("id", "e.offset", "e.op", (F.col("e.op") == "d").cast("int").alias("is_deleted"), F.coalesce("e.after", "e.before").alias("image"))


def offset_gaps(changes: DataFrame) -> DataFrame:
    """First, last and number of offsets, and whether they run without a gap from 0."""
    return changes.agg(F.min("offset").alias("first"), F.max("offset").alias("last"), F.count_distinct("offset").alias("n")).withColumn("contiguous", (F.col("first") == 0) & (F.col("last") - F.col("first") + 1 == F.col("n")))


def normalised_images(rows: DataFrame) -> DataFrame:
    """Epoch days and milliseconds, decimals as text, code shapes and flags; `problem` names the first fault."""
    typed = rows.select(
        *(c for c in rows.columns if c not in ("epoch_day", "epoch_ms", "consumption", "cost")), F.date_add(F.lit("1970-01-01").cast("date"), F.col("epoch_day").cast("int")).alias("record_date"), F.timestamp_millis(F.col("epoch_ms").cast("long")).alias("updated_at"),
        F.col("consumption").try_cast("decimal(16,3)").alias("consumption"), F.col("cost").try_cast("decimal(16,2)").alias("cost"),
    )
    no = lambda c: ~F.coalesce(c, F.lit(False))
    problem = F.when(no(F.col("workshop_code").rlike("^W[0-9]{2}$")) | no(F.col("energy_code").rlike("^E[0-9]{2}$")), "code").when(no(F.col("is_deleted").isin(0, 1)), "flag").when(F.col("consumption").isNull() | F.col("cost").isNull(), "number").when((F.col("consumption") < 0) | (F.col("cost") < 0), "negative")
    return typed.withColumn("problem", problem)


def row_text(frame: DataFrame) -> Column:
    """A row as text, its columns in the order of their names; null is `~`."""
    return F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in sorted(frame.columns)))


def content_hash(frame: DataFrame, name: str = "content_hash") -> Column:
    """An order-free hash of all rows: the sum of the first 15 hex digits of each row's MD5. An aggregate, so rows stay where they are."""
    return F.coalesce(F.sum(F.conv(F.substring(F.md5(row_text(frame).cast("binary")), 1, 15), 16, 10).cast("decimal(38,0)")), F.lit(0)).cast("string").alias(name)


def snapshot_checks(snapshot: DataFrame, topic: str, end_offset: int, prior: DataFrame, existing: DataFrame, dimensions: dict[str, DataFrame], key: tuple[str, ...] = KEY) -> DataFrame:
    """`check`, `failures` before a snapshot is applied. `prior` holds the boundary rows (topic, end_offset, content_hash) of earlier ones.

    Same topic; offset not below; the same content at the same offset; no key repeated; no existing key left out; every row has exactly one match in each
    dimension (name of the key column -> frame).
    """
    own = snapshot.agg(content_hash(snapshot, "_own"))
    bad = lambda c: F.count(F.when(c, 1)).alias("failures")
    checks = {
        "topic": prior.agg(bad(F.col("topic") != topic)),
        "offset": prior.agg(bad(F.col("end_offset") > end_offset)),
        "content": prior.join(own).agg(bad((F.col("end_offset") == end_offset) & (F.col("content_hash") != F.col("_own")))),  # `own` has one row
        "keys": snapshot.groupBy(*key).count().agg(bad(F.col("count") > 1)),
        "omitted": existing.select(*key).distinct().join(snapshot.select(*key), list(key), "left_anti").agg(F.count("*").alias("failures")),
    }
    for column, frame in dimensions.items():
        matches = frame.groupBy(F.col(column).alias("_d")).agg(F.count("*").alias("_m"))
        checks[f"dimension {column}"] = snapshot.join(F.broadcast(matches), F.col(column) == F.col("_d"), "left").agg(bad(F.coalesce("_m", F.lit(0)) != 1))
    out = None
    for name, frame in checks.items():
        row = frame.select(F.lit(name).alias("check"), "failures")
        out = row if out is None else out.unionByName(row)
    return out


def layer_costs(dwd: DataFrame, days: DataFrame, months: DataFrame, ads: DataFrame) -> DataFrame:
    """The cost of each layer, and whether it is that of the live detail rows."""
    base = dwd.filter("is_deleted = 0").agg(F.coalesce(F.sum("cost"), F.lit(0)).alias("_base"))
    out = None
    for name, frame in (("day", days), ("month", months), ("factory", ads)):
        row = frame.agg(F.coalesce(F.sum("cost_yuan"), F.lit(0)).alias("cost")).join(base).select(F.lit(name).alias("layer"), "cost", (F.abs(F.col("cost") - F.col("_base")) < 0.005).alias("ok"))  # one row each
        out = row if out is None else out.unionByName(row)
    return out


def apply_snapshot(snapshot: DataFrame, topic: str, end_offset: int, boundary: str, existing: DataFrame, workshops: DataFrame, energies: DataFrame, calendar: DataFrame, production: DataFrame) -> dict[str, DataFrame]:
    """O17 in two phases: checks against the folder `boundary`, an intent row, all layers and their costs, then the committed row. Raises before anything is published."""
    spark = snapshot.sparkSession
    schema = "topic string, end_offset long, content_hash string"

    def rows(kind: str) -> DataFrame:
        try:
            return spark.read.schema(schema).parquet(f"{boundary}/{kind}")
        except Exception as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
            return spark.createDataFrame([], schema)

    snapshot = written(snapshot, "snapshot")
    days = calendar.withColumnRenamed("calendar_date", "record_date")
    checks = snapshot_checks(snapshot, topic, end_offset, rows("committed").unionByName(rows("intent")), existing, {"workshop_code": workshops, "energy_code": energies, "record_date": days})
    if failed := checks.filter("failures > 0").collect():
        raise ValueError(f"snapshot refused: {failed}")
    row = snapshot.agg(content_hash(snapshot)).select(F.lit(topic).alias("topic"), F.lit(end_offset).cast("long").alias("end_offset"), "content_hash")
    row.write.mode("overwrite").parquet(f"{boundary}/intent")
    dwd = written(incoming(snapshot, workshops, energies, calendar), "dwd")
    made = {"dwd": dwd, "days": written(dws_day(dwd, production), "days")}
    made |= {"months": written(dws_month(made["days"]), "months"), "ads": written(ads_factory_day(made["days"], dwd), "ads")}
    if failed := layer_costs(*(made[k] for k in ("dwd", "days", "months", "ads"))).filter("NOT ok").collect():
        raise ValueError(f"layers differ from the snapshot: {failed}")
    row.write.mode("overwrite").parquet(f"{boundary}/committed")
    return made


def duplicate_plan(rows: DataFrame, key: tuple[str, ...] = KEY, identity: str = "source_id", image: tuple[str, ...] = ("consumption", "cost")) -> DataFrame:
    """Keys with several rows: identical images keep the smallest id, others are conflicts."""
    g = rows.groupBy(*key).agg(F.count("*").alias("n"), F.count_distinct(F.struct(*image)).alias("images"), F.min(identity).alias("keep_id"), F.array_sort(F.collect_list(identity)).alias("ids"))
    return g.filter("n > 1").select(*key, "n", F.when(F.col("images") == 1, "repair").otherwise("conflict").alias("action"), "keep_id", F.array_remove("ids", F.col("keep_id")).alias("redundant_ids"))


def apply_repair(rows: DataFrame, plan: DataFrame, identity: str = "source_id") -> DataFrame:
    """Rows without the redundant ids of the plan's repairs."""
    redundant = plan.filter("action = 'repair'").select(F.explode("redundant_ids").alias(identity))
    return rows.join(redundant, identity, "left_anti")


def repair_totals(rows: DataFrame, plan: DataFrame, identity: str = "source_id") -> DataFrame:
    """What a repair must leave: rows before, redundant ones, rows after, and whether they add up and no key of a repair is left twice."""
    after = apply_repair(rows, plan, identity)
    planned = plan.filter("action = 'repair'").agg(F.coalesce(F.sum(F.size("redundant_ids")), F.lit(0)).alias("redundant"))
    twice = duplicate_plan(after).join(plan.filter("action = 'repair'").select(*KEY), list(KEY), "left_semi").agg(F.count("*").alias("still_twice"))
    row = rows.agg(F.count("*").alias("n_before")).join(planned).join(after.agg(F.count("*").alias("n_after"))).join(twice)  # one row each
    return row.withColumn("ok", (F.col("n_before") - F.col("redundant") == F.col("n_after")) & (F.col("still_twice") == 0))


def replicated(rows: DataFrame, scale: int) -> DataFrame:
    """The same facts for `scale` plants, each with its plant_id."""
    return rows.withColumn("plant_id", F.explode(F.sequence(F.lit(0), F.lit(scale - 1))))


def by_plant(rows: DataFrame, scale: int, name: str) -> DataFrame:
    """`replicated` rows as a table partitioned by plant. Each plant is written by itself, so no row is sorted by plant before it is written; the first one's table is what the others are written from."""
    path = new_path(rows.sparkSession, name)
    for plant in range(scale):
        (rows.sparkSession.read.schema(rows.schema).parquet(f"{path}/plant_id=0") if plant else rows).write.parquet(f"{path}/plant_id={plant}")
    return rows.sparkSession.read.schema(f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in rows.schema)}, plant_id int").parquet(path)


def layer_audit(layers: dict[str, tuple[DataFrame, tuple[str, ...]]], cost: str = "cost_yuan") -> DataFrame:
    """Of each layer (frame, its key) rows, cost, standard coal, repeated and null keys. Costs and coal have to be equal over layers."""
    out = None
    for name, (frame, key) in layers.items():
        null_key = F.max(F.greatest(F.lit(False), *(F.col(k).isNull() for k in key)).cast("int"))
        groups = frame.groupBy(*key).agg(F.count("*").alias("n"), F.sum(cost).alias("cost"), F.sum("tce").alias("tce"), null_key.alias("nulls"))
        row = groups.agg(
            F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n_rows"), F.round(F.sum("cost").cast("double"), 2).alias("cost"), F.round(F.sum("tce").cast("double"), 3).alias("tce"),
            F.count(F.when(F.col("n") > 1, 1)).alias("repeated_keys"), F.coalesce(F.sum(F.when(F.col("nulls") == 1, F.col("n"))), F.lit(0)).cast("long").alias("null_keys"),
        ).withColumn("layer", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that only one side has (with repeats), by side. By a tree of hashes: equal sides end after one small aggregate."""
    return one_sided(a, b.select(*a.columns), a.columns, ("snapshot", "source"))


def snapshot_against_source(events: DataFrame, source: DataFrame, sums: DataFrame | None = None) -> DataFrame:
    """One row on a first-read snapshot (`op` and the source's columns): events, those that aren't reads, source rows, differing rows, equal hashes, and the verdict.
    `sums` are the `source_sums`, if several snapshots meet one source."""
    rows = events.drop("op").select(*source.columns)
    sides = same_rows(rows, source).agg(F.count(F.when(F.col("side") == "snapshot", 1)).alias("only_snapshot"), F.count(F.when(F.col("side") == "source", 1)).alias("only_source"))
    own = events.agg(F.count("*").alias("n_events"), F.count(F.when(F.col("op") != "r", 1)).alias("not_read"), content_hash(rows, "_r"))
    counts = own.join(source_sums(source) if sums is None else sums).join(sides)  # one row each
    counts = counts.withColumn("same_hash", F.col("_s") == F.col("_r")).select("n_events", "not_read", "n_source", "only_snapshot", "only_source", "same_hash")
    return counts.withColumn("ok", (F.col("not_read") == 0) & (F.col("n_events") == F.col("n_source")) & (F.col("only_snapshot") + F.col("only_source") == 0) & F.col("same_hash"))


def source_sums(source: DataFrame) -> DataFrame:
    """Rows and hash of a source."""
    return source.agg(F.count("*").alias("n_source"), content_hash(source, "_s"))


def manifest_of(frames: dict[str, DataFrame]) -> DataFrame:
    """Per query its columns, rows and an order-free content hash, for an export of one snapshot."""
    out = None
    for name, frame in frames.items():
        row = frame.agg(F.count("*").alias("n_rows"), content_hash(frame)).select(F.lit(name).alias("query"), F.lit(",".join(sorted(frame.columns))).alias("columns"), "*")
        out = row if out is None else out.unionByName(row)
    return out


#: The layers' columns (a partition column last), grain and partitioning.
_DETAIL = (
    "energy_key string, record_date date, workshop_code string, energy_code string, workshop_name string, process_type string, energy_name string, consumption decimal(16,3), unit string, unit_price decimal(12,4), cost decimal(16,2), record_status string, avg_temperature double, "
    "is_production_day int, is_weekend int, is_holiday int, year_month string, std_coal_kgce decimal(18,3), co2_kg decimal(18,3), updated_at timestamp, is_deleted int, source_id bigint"
)
_DAY = "record_date date, workshop_code string, workshop_name string, process_type string, year_month string, tce decimal(38,4), co2_t decimal(38,3), cost_yuan decimal(38,2), output_qty decimal(16,3), unit_energy_kgce double, has_shutdown int, avg_temperature double"
_MONTH = "workshop_code string, workshop_name string, process_type string, tce decimal(38,4), co2_t decimal(38,3), cost_yuan decimal(38,2), output_qty decimal(38,3), unit_energy_kgce double, unit_cost_yuan double"
_FACTORY = "record_date date, tce decimal(38,4), co2_t decimal(38,3), cost_yuan decimal(38,2), workshops bigint, bad_intensity bigint"
LAYERS = {
    "dwd_energy": (_DETAIL, ("record_date", "workshop_code", "energy_code"), "dt date"),
    "dws_day": (_DAY, ("record_date", "workshop_code"), "dt date"),
    "dws_month": (_MONTH, ("year_month", "workshop_code"), "year_month string"),
    "ads_factory_day": (_FACTORY, ("record_date",), "dt date"),
}


def bootstrap_layers(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """An empty partitioned table for each layer that isn't there yet; all layers as frames with their declared columns."""
    for name, (columns, _, partition) in LAYERS.items():
        spark.createDataFrame([], f"{columns}, {partition}").write.mode("ignore").partitionBy(partition.split()[0]).parquet(f"{path}/{name}")
    return {name: spark.read.schema(f"{columns}, {partition}").parquet(f"{path}/{name}") for name, (columns, _, partition) in LAYERS.items()}


def write_layer(frame: DataFrame, path: str, name: str) -> None:
    """Overwrites the partitions that `frame` holds, with the declared columns in their order and types; a missing column raises."""
    columns, _, partition = LAYERS[name]
    part = partition.split()[0]
    rows = frame if part in frame.columns else frame.withColumn(part, F.col("record_date"))
    typed = rows.select(*(F.col(n).cast(t).alias(n) for n, t in (c.split(" ", 1) for c in f"{columns}, {partition}".split(", "))))
    typed.repartition(part).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(part).parquet(f"{path}/{name}")


def ods(p: Plant) -> DataFrame:
    """The plant's records as incoming source rows."""
    production_day, temperature = day_conditions()
    rows = p.records.withColumns({"cost": F.round("cost", 2).cast("decimal(16,2)"), "is_production_day": production_day, "avg_temperature": temperature})
    return rows.withColumn("record_status", F.when(F.col("is_production_day") == 0, "停产").otherwise("正常"))


def first_and_late(p: Plant) -> tuple[DataFrame, DataFrame]:
    """Incoming rows in two loads: per key the newest of the old versions, and the newest of the late ones. What `incoming` adds goes by key, so versions are ranked before it, as narrow rows."""
    rows, split = ods(p).filter(deleted_or_valid()), F.to_timestamp(F.lit("1996-01-01"))
    newest = lambda some: incoming(latest(rows.filter(some), KEY, F.col("updated_at").desc_nulls_last(), F.desc("source_id")), p.workshops, p.energies, p.calendar)
    return newest(F.col("updated_at") < split), written(newest(F.col("updated_at") >= split), "late")


def detail(p: Plant) -> DataFrame:
    """DWD from all records in two loads, staged as O3 says."""
    first, late = first_and_late(p)
    first = written(first, "first")
    untouched = first.join(late.select("record_date").distinct(), "record_date", "left_anti")
    return written(untouched.unionByName(late_merge(first, late).select(*untouched.columns)), "dwd")


def layers(p: Plant) -> dict[str, DataFrame]:
    """DWD and what lies above it, each written once."""
    dwd = detail(p)
    days = written(dws_day(dwd, p.production), "days")
    return {"dwd": dwd, "days": days, "months": dws_month(days), "ads": ads_factory_day(days, dwd)}


def doubles(frame: DataFrame, *columns: str) -> DataFrame:
    return frame.withColumns({c: F.col(c).cast("double") for c in columns})


_DWD = """inc AS (SELECT r.*, w.workshop_name, w.process_type, e.energy_name, e.unit, c.is_weekend, c.is_holiday, c.year_month, CASE WHEN (dayofyear(r.record_date) + CAST(substr(r.workshop_code, 3, 1) AS INTEGER) * 5) % 13 = 0 THEN 0 ELSE 1 END AS is_production_day,
    CASE WHEN dayofyear(r.record_date) % 50 = 0 THEN NULL ELSE round(15 - 17 * cos(2 * pi() * dayofyear(r.record_date) / 365e0), 1) END AS avg_temperature, CAST(round(r.cost, 2) AS DECIMAL(16,2)) AS paid, CAST(round(consumption * std_coal_factor, 3) AS DECIMAL(18,3)) AS std_coal_kgce, CAST(round(consumption * co2_factor, 3) AS DECIMAL(18,3)) AS co2_kg
    FROM records r JOIN dim_energy e USING (energy_code) JOIN dim_workshop w USING (workshop_code) JOIN dim_calendar c ON c.calendar_date = r.record_date WHERE r.is_deleted = 1 OR (r.consumption >= 0 AND r.unit_price > 0)),
dwd AS (SELECT * FROM inc QUALIFY row_number() OVER (PARTITION BY record_date, workshop_code, energy_code ORDER BY updated_at DESC, source_id DESC) = 1),
dws AS (SELECT d.*, output_qty, round(kgce * 0.001::DECIMAL(4,3), 4) AS tce, round(co2 * 0.001::DECIMAL(4,3), 3) AS co2_t, CASE WHEN output_qty > 0 THEN round(kgce::DOUBLE / output_qty::DOUBLE, 5) END AS unit_energy_kgce
    FROM (SELECT record_date, workshop_code, max(workshop_name) AS workshop_name, max(process_type) AS process_type, max(year_month) AS year_month, coalesce(sum(std_coal_kgce) FILTER (is_deleted = 0), 0)::DECIMAL(30,3) AS kgce, coalesce(sum(co2_kg) FILTER (is_deleted = 0), 0)::DECIMAL(30,3) AS co2, coalesce(sum(paid) FILTER (is_deleted = 0), 0) AS cost_yuan,
        max(CASE WHEN is_deleted = 0 AND is_production_day = 0 THEN 1 ELSE 0 END) AS has_shutdown, avg(avg_temperature) FILTER (is_deleted = 0) AS avg_temperature FROM dwd GROUP BY ALL) d LEFT JOIN production p USING (record_date, workshop_code)),
mon AS (SELECT year_month, workshop_code, sum(tce) AS tce, sum(co2_t) AS co2_t, sum(cost_yuan) AS cost_yuan, sum(output_qty) AS output_qty, CASE WHEN sum(output_qty) > 0 THEN round((sum(tce) * 1000)::DOUBLE / sum(output_qty)::DOUBLE, 5) END AS unit_energy_kgce, CASE WHEN sum(output_qty) > 0 THEN round(sum(cost_yuan)::DOUBLE / sum(output_qty)::DOUBLE, 4) END AS unit_cost_yuan FROM dws GROUP BY ALL),
ads AS (SELECT record_date, sum(tce) AS tce, sum(co2_t) AS co2_t, sum(cost_yuan) AS cost_yuan, count(DISTINCT CASE WHEN EXISTS (SELECT 1 FROM dwd WHERE dwd.record_date = dws.record_date AND dwd.workshop_code = dws.workshop_code AND is_deleted = 0) THEN workshop_code END) AS workshops, count(CASE WHEN unit_energy_kgce IS NULL OR unit_energy_kgce < 0 THEN 1 END) AS bad_intensity FROM dws GROUP BY 1)
"""


@query("o01_o02_dwd_merge", _DWD + """SELECT sha256(strftime(record_date, '%Y-%m-%d') || '|' || workshop_code || '|' || energy_code) AS energy_key, source_id, workshop_name, energy_name, unit, unit_price::DOUBLE AS unit_price, paid::DOUBLE AS cost, std_coal_kgce::DOUBLE AS kgce, co2_kg::DOUBLE AS co2_kg, year_month, is_weekend, is_holiday, is_production_day, is_deleted FROM dwd""")
def o_dwd(p: Plant) -> DataFrame:
    rows = doubles(detail(p).withColumnRenamed("std_coal_kgce", "kgce"), "cost", "kgce", "co2_kg", "unit_price")
    return rows.select("energy_key", "source_id", "workshop_name", "energy_name", "unit", "unit_price", "cost", "kgce", "co2_kg", "year_month", "is_weekend", "is_holiday", "is_production_day", "is_deleted")


@query("o03_staged_overwrite", _DWD + "SELECT record_date, workshop_code, energy_code, source_id, is_deleted FROM dwd")
def o_staged(p: Plant) -> DataFrame:
    """Both loads through a partitioned table: the second overwrites only the dates that it touches, from a stage."""
    first, late = first_and_late(p)
    path, stage = new_path(p.spark, "dwd-table"), new_path(p.spark, "stage")
    overwrite_dates(first, path, f"{stage}/1")
    overwrite_dates(late_merge(p.spark.read.parquet(path).drop("dt"), late), path, f"{stage}/2")
    return p.spark.read.parquet(path).select(*KEY, "source_id", "is_deleted")


@query("o04_production_rebuild", _DWD + """SELECT record_date, workshop_code, (CASE WHEN touched IS NULL THEN output_qty * 2 ELSE output_qty END)::DOUBLE AS output_qty FROM production LEFT JOIN (SELECT DISTINCT record_date AS touched FROM inc WHERE updated_at >= TIMESTAMP '1998-06-01') t ON touched = record_date WHERE touched IS NULL OR workshop_code <> 'W08'""")
def o_production(p: Plant) -> DataFrame:
    """Old production holds doubled quantities; the dates of the newest records are rebuilt from the snapshot, in which one workshop is negative."""
    touched = incoming(ods(p), p.workshops, p.energies, p.calendar).filter(F.col("updated_at") >= F.to_timestamp(F.lit("1998-06-01")))
    snapshot = p.production.withColumn("output_qty", F.when(F.col("workshop_code") == "W08", -F.col("output_qty")).otherwise(F.col("output_qty")))
    return doubles(production_rebuilt(p.production.withColumn("output_qty", F.col("output_qty") * 2), snapshot, p.workshops, touched), "output_qty")


@query("o05_dws_day", _DWD + """SELECT record_date, workshop_code, workshop_name, process_type, year_month, tce::DOUBLE AS tce, co2_t::DOUBLE AS co2_t, cost_yuan::DOUBLE AS cost_yuan, output_qty::DOUBLE AS output_qty, unit_energy_kgce, has_shutdown, round(avg_temperature, 4) AS avg_temperature FROM dws""")
def o_day(p: Plant) -> DataFrame:
    return doubles(dws_day(detail(p), p.production), "tce", "co2_t", "cost_yuan", "output_qty").withColumn("avg_temperature", F.round("avg_temperature", 4))


@query("o06_dws_month", _DWD + "SELECT year_month, workshop_code, tce::DOUBLE AS tce, co2_t::DOUBLE AS co2_t, cost_yuan::DOUBLE AS cost_yuan, output_qty::DOUBLE AS output_qty, unit_energy_kgce, unit_cost_yuan FROM mon")
def o_month(p: Plant) -> DataFrame:
    return doubles(layers(p)["months"], "tce", "co2_t", "cost_yuan", "output_qty").drop("workshop_name", "process_type")


@query("o07_ads_factory_day", _DWD + "SELECT record_date, tce::DOUBLE AS tce, co2_t::DOUBLE AS co2_t, cost_yuan::DOUBLE AS cost_yuan, workshops, bad_intensity FROM ads")
def o_ads(p: Plant) -> DataFrame:
    return doubles(layers(p)["ads"], "tce", "co2_t", "cost_yuan")


@query("o08_newer_wins_upsert", """a AS (SELECT record_date, workshop_code, energy_code, max(source_id) AS source_id, arg_max(updated_at, source_id) AS updated_at FROM records WHERE source_id % 2 = 0 GROUP BY ALL), b AS (SELECT record_date, workshop_code, energy_code, max(source_id) AS source_id, arg_max(updated_at, source_id) AS updated_at FROM records WHERE source_id % 2 = 1 GROUP BY ALL)
SELECT record_date, workshop_code, energy_code, CASE WHEN a.updated_at IS NULL OR b.updated_at > a.updated_at THEN b.source_id ELSE a.source_id END AS source_id FROM a FULL JOIN b USING (record_date, workshop_code, energy_code)""")
def o_upsert(p: Plant) -> DataFrame:
    part = lambda r: p.records.filter(F.col("source_id") % 2 == r).groupBy(*KEY).agg(F.max("source_id").alias("source_id"), F.max_by("updated_at", "source_id").alias("updated_at"))
    return newer_wins(part(0), part(1)).select(*KEY, "source_id")


@query("o09_latest_valid_live", """SELECT record_date, workshop_code, energy_code, source_id, cost::DOUBLE AS cost FROM (SELECT * FROM records QUALIFY row_number() OVER (PARTITION BY record_date, workshop_code, energy_code ORDER BY updated_at DESC, source_id DESC) = 1) WHERE is_deleted = 0 AND consumption >= 0 AND cost >= 0""")
def o_live(p: Plant) -> DataFrame:
    return latest_valid_live(p.records).select(*KEY, "source_id", F.col("cost").cast("double").alias("cost"))


@query("o10_insert_ignore", """a AS (SELECT DISTINCT record_date, workshop_code, 'old' AS origin FROM records WHERE energy_code = 'E01'), b AS (SELECT DISTINCT record_date, workshop_code, 'new' AS origin FROM records WHERE energy_code = 'E02') SELECT * FROM a UNION ALL SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.record_date = b.record_date AND a.workshop_code = b.workshop_code)""")
def o_ignore(p: Plant) -> DataFrame:
    part = lambda e, o: p.records.filter(F.col("energy_code") == e).select("record_date", "workshop_code", F.lit(o).alias("origin")).distinct()
    return insert_ignore(part("E01", "old"), part("E02", "new"), ("record_date", "workshop_code"))


@query("o11_watermark", """d AS (SELECT max(updated_at) AS top, count(*) AS n FROM records), o AS (SELECT max(updated_at) AS top, count(*) AS n FROM records WHERE updated_at < TIMESTAMP '1996-01-01')
SELECT 'cold' AS load, top AS watermark_val, n AS last_rows FROM d UNION ALL SELECT 'empty', TIMESTAMP '1997-01-01', 0 FROM d UNION ALL SELECT 'empty and cold', TIMESTAMP '1970-01-01', 0 FROM d UNION ALL SELECT 'older', greatest(top, TIMESTAMP '1997-01-01'), n FROM o UNION ALL SELECT 'newer', greatest(top, TIMESTAMP '1997-01-01'), n FROM d""")
def o_watermark(p: Plant) -> DataFrame:
    """Loads on a cold start and on a state of 1997: all rows, none, and only older ones."""
    name = "fact_energy_consumption"
    cold = p.spark.createDataFrame([], "target_table string, watermark_val timestamp")
    state = p.spark.range(1).select(F.lit(name).alias("target_table"), F.to_timestamp(F.lit("1997-01-01")).alias("watermark_val"))
    old, none = p.records.filter(F.col("updated_at") < F.to_timestamp(F.lit("1996-01-01"))), p.records.filter("source_id IS NULL")
    out = None
    for load, known, rows in (("cold", cold, p.records), ("empty", state, none), ("empty and cold", cold, none), ("older", state, old), ("newer", state, p.records)):
        row = advanced_watermark(known, rows, name).select(F.lit(load).alias("load"), F.col("watermark_val").cast("timestamp_ntz").alias("watermark_val"), "last_rows")
        out = row if out is None else out.unionByName(row)
    return out


@query("o12_calendar_coverage", "SELECT DISTINCT record_date FROM energy WHERE record_date NOT IN (SELECT calendar_date FROM dim_calendar WHERE calendar_date < DATE '2025-12-01')")
def o_coverage(p: Plant) -> DataFrame:
    return uncovered_dates(p.energy, p.calendar.filter(F.col("calendar_date") < F.to_date(F.lit("2025-12-01"))))


@query("o13_snapshot_merge", """a AS (SELECT * FROM records WHERE updated_at < TIMESTAMP '1996-01-01' QUALIFY row_number() OVER (PARTITION BY record_date, workshop_code, energy_code ORDER BY updated_at DESC, source_id DESC) = 1), b AS (SELECT * FROM records WHERE updated_at >= TIMESTAMP '1996-01-01' QUALIFY row_number() OVER (PARTITION BY record_date, workshop_code, energy_code ORDER BY updated_at DESC, source_id DESC) = 1),
m AS (SELECT * FROM b UNION ALL SELECT * FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.record_date = a.record_date AND b.workshop_code = a.workshop_code AND b.energy_code = a.energy_code))
SELECT snapshot_id, workshop_code, count(*) AS n, sum(source_id::HUGEINT)::DOUBLE AS ids FROM (SELECT 1 AS snapshot_id, * FROM a UNION ALL SELECT 2, * FROM m UNION ALL SELECT 3, * FROM m UNION ALL SELECT 4, * FROM m) GROUP BY ALL""")
def o_snapshots(p: Plant) -> DataFrame:
    """Old versions, the late ones merged in, the same again and older ones again (neither changes anything); each version is read back by its number."""
    newest = lambda rows: latest(rows, KEY, F.col("updated_at").desc_nulls_last(), F.desc("source_id"))
    split = F.to_timestamp(F.lit("1996-01-01"))
    table = Snapshots(p.spark, new_path(p.spark, "snapshots"))
    old, late = newest(p.records.filter(F.col("updated_at") < split)), newest(p.records.filter(F.col("updated_at") >= split))
    table.commit(old)
    for new in (late, late, old):
        table.merge(new)
    out = None
    for number in (1, 2, 3, 4):
        rows = table.read(number).groupBy("workshop_code").agg(F.count("*").alias("n"), F.sum(F.col("source_id").cast("decimal(38,0)")).cast("double").alias("ids")).withColumn("snapshot_id", F.lit(number))
        out = rows if out is None else out.unionByName(rows)
    return out


def changes(p: Plant, faults: bool = False) -> DataFrame:
    """A change log of the plant, one source row per business key: first reads, updates, deletes and changed keys with binlog positions, a part redelivered.

    With `faults`, some events have another content at the same position and some keys are taken over by another id.
    """
    key = F.concat_ws("|", F.date_format("record_date", "yyyy-MM-dd"), "workshop_code", "energy_code")
    r = p.records.withColumns({"key": key, "cost": F.round("cost", 2).cast("decimal(16,2)")})
    image = lambda k: F.struct(k.alias("business_key"), "consumption", "cost")
    m = lambda n: F.col("source_id") % n == 0
    owner = F.when(m(31), F.concat("key", F.lit("/2"))).otherwise(F.col("key")) if faults else F.col("key")
    op = F.when(F.col("is_deleted") == 1, "d").when(m(6), "r").otherwise("u")
    before = F.when(op != "r", image(F.when(m(17), F.concat("key", F.lit("~"))).otherwise(F.col("key"))))
    log = r.select(owner.alias("id"), F.col("source_id").alias("offset"), op.alias("op"), F.lit(1).alias("file_no"), F.unix_seconds("updated_at").alias("pos"), F.col("source_id").alias("row"), before.alias("before"), F.when(F.col("is_deleted") == 0, image(F.col("key"))).alias("after"))
    again = log.filter(F.col("offset") % 5 == 0)
    if faults:
        other = F.when(F.col("offset") % 35 == 0, F.struct(F.col("after.business_key").alias("business_key"), "after.consumption", (F.col("after.cost") + 1).cast("decimal(16,2)").alias("cost"))).otherwise(F.col("after"))
        again = again.withColumn("after", F.when(F.col("after").isNotNull(), other))
    return log.unionByName(again)


_LOG = """lg AS (SELECT *, strftime(record_date, '%Y-%m-%d') || '|' || workshop_code || '|' || energy_code AS key, round(cost, 2) AS paid, CASE WHEN is_deleted = 1 THEN 'd' WHEN source_id % 6 = 0 THEN 'r' ELSE 'u' END AS op FROM records),
im AS (SELECT key AS business_key, source_id, updated_at, 0 AS gone, consumption, paid FROM lg WHERE op <> 'd' UNION ALL SELECT CASE WHEN source_id % 17 = 0 THEN key || '~' ELSE key END, source_id, updated_at, 1, consumption, paid FROM lg WHERE op = 'd' OR (op = 'u' AND source_id % 17 = 0)),
st AS (SELECT * FROM im QUALIFY row_number() OVER (PARTITION BY business_key ORDER BY updated_at DESC, source_id DESC) = 1)
"""


@query("o15_cdc_projection", _LOG + "SELECT business_key, gone AS is_deleted, consumption::DOUBLE AS consumption, paid::DOUBLE AS cost, source_id AS \"row\" FROM st")
def o_cdc(p: Plant) -> DataFrame:
    state, _ = cdc_projection(changes(p), strict=False)
    return state.select("business_key", "is_deleted", F.col("image.consumption").cast("double").alias("consumption"), F.col("image.cost").cast("double").alias("cost"), F.col("version.row").alias("row"))


@query("o15_cdc_conflicts", """lg AS (SELECT *, strftime(record_date, '%Y-%m-%d') || '|' || workshop_code || '|' || energy_code AS key, round(cost, 2) AS paid, CASE WHEN is_deleted = 1 THEN 'd' WHEN source_id % 6 = 0 THEN 'r' ELSE 'u' END AS op FROM records),
ow AS (SELECT *, CASE WHEN source_id % 31 = 0 THEN key || '/2' ELSE key END AS id, CASE WHEN op = 'r' THEN 0 ELSE 1 END AS streamed FROM lg),
im AS (SELECT key AS business_key, id, updated_at, source_id, streamed, 0 AS gone FROM ow WHERE op <> 'd' UNION ALL SELECT CASE WHEN source_id % 17 = 0 THEN key || '~' ELSE key END, id, updated_at, source_id, streamed, 1 FROM ow WHERE op = 'd' OR (op = 'u' AND source_id % 17 = 0)
    UNION ALL SELECT key, id, updated_at, source_id, streamed, 0 FROM ow WHERE op <> 'd' AND source_id % 35 = 0),
lagged AS (SELECT *, lag(id) OVER w AS before_id, lag(gone) OVER w AS before_gone FROM im WINDOW w AS (PARTITION BY business_key ORDER BY updated_at, source_id, streamed, gone, id))
SELECT 'image' AS kind, key AS business_key, source_id AS "row" FROM ow WHERE op <> 'd' AND source_id % 35 = 0 UNION ALL SELECT 'owner', business_key, source_id FROM lagged WHERE before_gone = 0 AND before_id <> id""")
def o_conflicts(p: Plant) -> DataFrame:
    return cdc_conflicts(changes(p, faults=True)).select("kind", "business_key", F.col("version.row").alias("row"))


@query("o24_offset_projection", _LOG + """, lo AS (SELECT * FROM lg QUALIFY row_number() OVER (PARTITION BY key ORDER BY source_id DESC) = 1)
SELECT split_part(key, '|', 2) AS workshop_code, count(CASE WHEN op <> 'd' THEN 1 END) AS active, count(CASE WHEN op = 'd' THEN 1 END) AS deleted, max(source_id) AS last_offset, sum(CASE WHEN op <> 'd' THEN paid END)::DOUBLE AS cost FROM lo GROUP BY 1""")
def o_offsets(p: Plant) -> DataFrame:
    rows = offset_projection(changes(p)).withColumn("workshop_code", F.split_part("id", F.lit("|"), F.lit(2)))
    return rows.groupBy("workshop_code").agg(F.count(F.when(F.col("is_deleted") == 0, 1)).alias("active"), F.count(F.when(F.col("is_deleted") == 1, 1)).alias("deleted"), F.max("offset").alias("last_offset"), F.sum(F.when(F.col("is_deleted") == 0, F.col("image.cost"))).cast("double").alias("cost"))


@query("o16_image_normalisation", """SELECT source_id, record_date, updated_at, CASE WHEN source_id % 11 = 0 THEN NULL WHEN source_id % 13 = 0 THEN -consumption ELSE consumption END::DOUBLE AS consumption, CASE WHEN source_id % 5 = 0 OR source_id % 7 = 0 THEN 'code' WHEN source_id % 9 = 0 THEN 'flag' WHEN source_id % 11 = 0 THEN 'number' WHEN source_id % 13 = 0 THEN 'negative' END AS problem FROM records""")
def o_images(p: Plant) -> DataFrame:
    m = lambda n: F.col("source_id") % n == 0
    text = F.when(m(11), "many").when(m(13), (-F.col("consumption")).cast("string")).otherwise(F.col("consumption").cast("string"))
    raw = p.records.select(
        "source_id", F.unix_date("record_date").alias("epoch_day"), F.unix_millis("updated_at").alias("epoch_ms"), F.when(m(5), "W4").otherwise(F.col("workshop_code")).alias("workshop_code"), F.when(m(7), None).otherwise(F.col("energy_code")).alias("energy_code"),
        text.alias("consumption"), F.col("cost").cast("string").alias("cost"), F.when(m(9), 2).otherwise(F.col("is_deleted")).alias("is_deleted"),
    )
    return doubles(normalised_images(raw), "consumption").select("source_id", "record_date", F.col("updated_at").cast("timestamp_ntz").alias("updated_at"), "consumption", "problem")


@query("o17_snapshot_checks", """k AS (SELECT record_date, workshop_code, energy_code, max(source_id) AS source_id FROM records GROUP BY ALL), n AS (SELECT count(*) AS n FROM k WHERE source_id % 10 = 0), d AS (SELECT count(*) AS n FROM k WHERE energy_code = 'E06'),
c AS (SELECT unnest(['topic', 'offset', 'content', 'keys', 'omitted', 'dimension energy_code']) AS "check"), s AS (SELECT unnest(['whole', 'keys left out', 'older offset', 'other content', 'dimension lacks a code']) AS snapshot)
SELECT snapshot, "check", CASE WHEN snapshot = 'keys left out' AND "check" = 'omitted' THEN n.n WHEN snapshot IN ('keys left out', 'other content') AND "check" = 'content' THEN 1 WHEN snapshot = 'older offset' AND "check" = 'offset' THEN 1 WHEN snapshot = 'dimension lacks a code' AND "check" = 'dimension energy_code' THEN d.n ELSE 0 END AS failures FROM c, s, n, d""")
def o_boundary(p: Plant) -> DataFrame:
    """A whole snapshot and broken ones against the boundary that the whole one left."""
    rows = written(p.records.groupBy(*KEY).agg(F.max("source_id").alias("source_id")), "keys")
    prior = rows.agg(content_hash(rows)).select(F.lit("energy").alias("topic"), F.lit(100).cast("long").alias("end_offset"), "content_hash")
    few = p.energies.filter("energy_code <> 'E06'")
    cases = {"whole": (rows, 100, p.energies), "keys left out": (rows.filter("source_id % 10 <> 0"), 100, p.energies), "older offset": (rows, 99, p.energies), "other content": (rows.withColumn("source_id", F.col("source_id") + 1), 100, p.energies), "dimension lacks a code": (rows, 100, few)}
    out = None
    for name, (frame, offset, energies) in cases.items():
        checks = snapshot_checks(frame, "energy", offset, prior, rows, {"energy_code": energies}).withColumn("snapshot", F.lit(name))
        out = checks if out is None else out.unionByName(checks)
    return out


@query("o18_dimension_match", "SELECT count(*) AS n_rows, count(t.energy_code) AS matched FROM records r LEFT JOIN dim_energy t ON t.energy_code = r.energy_code AND t.energy_code <> 'E06'")
def o_match(p: Plant) -> DataFrame:
    known = p.energies.filter("energy_code <> 'E06'").select("energy_code", F.lit(1).alias("hit"))
    return p.records.join(F.broadcast(known), "energy_code", "left").agg(F.count("*").alias("n_rows"), F.count("hit").alias("matched"))


@query("o19_duplicate_plan", """SELECT record_date, workshop_code, energy_code, count(*) AS n, CASE WHEN count(DISTINCT consumption::VARCHAR || '/' || round(cost, 0)::VARCHAR) = 1 THEN 'repair' ELSE 'conflict' END AS action, min(source_id) AS keep_id, list_sort(list(source_id))[2:] AS redundant_ids FROM records GROUP BY ALL HAVING count(*) > 1""")
def o_plan(p: Plant) -> DataFrame:
    return duplicate_plan(p.records.withColumn("cost", F.round("cost", 0)))


@query("o20_o21_scaled_layers", "SELECT plant_id, record_date, sum(cost)::DOUBLE AS cost, count(*) AS n FROM energy, range(10) g(plant_id) GROUP BY ALL")
def o_scaled(p: Plant) -> DataFrame:
    return replicated(p.energy, 10).withColumn("plant_id", F.col("plant_id").cast("long")).groupBy("plant_id", "record_date").agg(F.sum("cost").cast("double").alias("cost"), F.count("*").alias("n"))


@query("o21_written_layers", _DWD + """, b AS (SELECT 'ods' AS layer, count(*) AS n, sum(paid) AS cost FROM inc UNION ALL SELECT 'dwd', count(*), sum(paid) FROM dwd UNION ALL SELECT 'dws', count(*), sum(cost_yuan) FROM dws UNION ALL SELECT 'ads', count(*), sum(cost_yuan) FROM ads)
SELECT layer, n * 3 AS n_rows, (cost * 3)::DOUBLE AS cost, 3::BIGINT AS plants, true AS ok FROM b""")
def o_written(p: Plant) -> DataFrame:
    """Four layers of three plants, each written by plant and read back; rows and cost are those of one plant, three times."""
    rows, one = incoming(ods(p), p.workshops, p.energies, p.calendar), layers(p)
    base = {"ods": rows, "dwd": one["dwd"], "dws": one["days"].withColumnRenamed("cost_yuan", "cost"), "ads": one["ads"].withColumnRenamed("cost_yuan", "cost")}
    out = None
    for name, frame in base.items():
        made = by_plant(frame, 3, f"scaled-{name}")
        each = frame.agg(F.count("*").alias("_n"), F.sum("cost").alias("_cost"))
        row = made.agg(F.count("*").alias("n_rows"), F.sum("cost").alias("cost"), F.count_distinct("plant_id").alias("plants")).join(each)  # one row each
        row = row.select(F.lit(name).alias("layer"), "n_rows", F.col("cost").cast("double").alias("cost"), "plants", ((F.col("n_rows") == 3 * F.col("_n")) & (F.col("cost") == 3 * F.col("_cost"))).alias("ok"))
        out = row if out is None else out.unionByName(row)
    return out


@query("o22_layer_audit", _DWD + """, live AS (SELECT *, round(std_coal_kgce * 0.001::DECIMAL(4,3), 6) AS t FROM dwd WHERE is_deleted = 0), bad AS (SELECT *, CASE WHEN source_id % 53 = 0 THEN NULL ELSE workshop_code END AS w FROM (SELECT * FROM live UNION ALL SELECT * FROM live WHERE source_id % 97 = 0)),
g AS (SELECT record_date, w, energy_code, count(*) AS n FROM bad GROUP BY ALL)
SELECT 'dwd' AS layer, count(*) AS n_rows, sum(paid)::DOUBLE AS cost, round(sum(t)::DOUBLE, 3) AS tce, (count(*) - count(DISTINCT record_date || workshop_code || energy_code))::BIGINT AS repeated_keys, count(CASE WHEN workshop_code IS NULL THEN 1 END) AS null_keys FROM live
UNION ALL SELECT 'dws', count(*), sum(cost_yuan)::DOUBLE, round(sum(tce)::DOUBLE, 3), (count(*) - count(DISTINCT record_date || workshop_code))::BIGINT, count(CASE WHEN workshop_code IS NULL THEN 1 END) FROM dws
UNION ALL SELECT 'ads', count(*), sum(cost_yuan)::DOUBLE, round(sum(tce)::DOUBLE, 3), (count(*) - count(DISTINCT record_date))::BIGINT, 0 FROM ads
UNION ALL SELECT 'dwd, broken', count(*), sum(paid)::DOUBLE, round(sum(t)::DOUBLE, 3), (SELECT count(*) FROM g WHERE n > 1), count(CASE WHEN w IS NULL THEN 1 END) FROM bad""")
def o_audit(p: Plant) -> DataFrame:
    """The three layers, and the first with repeated and null keys planted."""
    made = layers(p)
    live = made["dwd"].filter("is_deleted = 0").withColumns({"cost_yuan": F.col("cost"), "tce": thousandth(F.col("std_coal_kgce"))})
    broken = live.unionByName(live.filter("source_id % 97 = 0")).withColumn("workshop_code", F.when(F.col("source_id") % 53 != 0, F.col("workshop_code")))
    return layer_audit({"dwd": (live, KEY), "dws": (made["days"], ("record_date", "workshop_code")), "ads": (made["ads"], ("record_date",)), "dwd, broken": (broken, KEY)})


@query("o23_additive_schema", "SELECT workshop_code, count(*) AS n, sum(CASE WHEN is_deleted IS NULL THEN 1 ELSE 0 END)::BIGINT AS old_rows FROM (SELECT workshop_code, CASE WHEN source_id % 2 = 0 THEN is_deleted END AS is_deleted FROM records) GROUP BY 1")
def o_schema(p: Plant) -> DataFrame:
    old, new = p.records.filter("source_id % 2 = 1").drop("is_deleted"), p.records.filter("source_id % 2 = 0")
    return old.unionByName(new, allowMissingColumns=True).groupBy("workshop_code").agg(F.count("*").alias("n"), F.sum(F.col("is_deleted").isNull().cast("long")).alias("old_rows"))


@query("o25_snapshot_against_source", """n AS (SELECT count(*) AS n, count(CASE WHEN source_id % 100 = 0 THEN 1 END) AS c, count(CASE WHEN source_id % 70 = 0 THEN 1 END) AS u FROM records)
SELECT 'equal' AS events, n AS n_events, 0::BIGINT AS not_read, n AS n_source, 0::BIGINT AS only_snapshot, 0::BIGINT AS only_source, true AS same_hash, true AS ok FROM n UNION ALL SELECT 'changed', n, 0, n, c, c, c = 0, c = 0 FROM n UNION ALL SELECT 'short', n - c, 0, n, 0, c, c = 0, c = 0 FROM n UNION ALL SELECT 'updated', n, u, n, 0, 0, true, u = 0 FROM n""")
def o_source(p: Plant) -> DataFrame:
    """First-read snapshots against their source: equal, with changed values, with missing rows, with an event that isn't a read."""
    source = written(p.records.select("source_id", *KEY, "consumption"), "source")
    sums = written(source_sums(source), "sums")
    m = lambda n: F.col("source_id") % n == 0
    events = source.withColumn("op", F.lit("r"))
    cases = {"equal": events, "changed": events.withColumn("consumption", F.when(m(100), (F.col("consumption") + 1).cast("decimal(16,3)")).otherwise(F.col("consumption"))), "short": events.filter(~m(100)), "updated": events.withColumn("op", F.when(m(70), "u").otherwise("r"))}
    out = None
    for name, frame in cases.items():
        row = snapshot_against_source(frame, source, sums).select(F.lit(name).alias("events"), "*")
        out = row if out is None else out.unionByName(row)
    return out


@query("o26_repaired_rows", """d AS (SELECT *, min(source_id) OVER w AS least, count(DISTINCT consumption) OVER w AS images, count(*) OVER w AS n FROM records WINDOW w AS (PARTITION BY record_date, workshop_code, energy_code)) SELECT source_id FROM d WHERE n = 1 OR images > 1 OR source_id = least""")
def o_repair(p: Plant) -> DataFrame:
    return apply_repair(p.records, duplicate_plan(p.records, image=("consumption",))).select("source_id")


@query("o26_repair_totals", """d AS (SELECT *, min(source_id) OVER w AS least, count(DISTINCT consumption) OVER w AS images, count(*) OVER w AS n FROM records WINDOW w AS (PARTITION BY record_date, workshop_code, energy_code)) SELECT count(*) AS n_before, count(CASE WHEN n > 1 AND images = 1 AND source_id <> least THEN 1 END) AS redundant, count(CASE WHEN n = 1 OR images > 1 OR source_id = least THEN 1 END) AS n_after, 0::BIGINT AS still_twice, true AS ok FROM d""")
def o_totals(p: Plant) -> DataFrame:
    return repair_totals(p.records, duplicate_plan(p.records, image=("consumption",)))


_HASH = "coalesce(sum(CAST('0x' || left(md5({}), 15) AS BIGINT)::HUGEINT), 0)::VARCHAR"


@query("o28_export_manifest", "SELECT 'daily cost' AS query, 'cost,record_date' AS columns, count(*) AS n_rows, " + _HASH.format("cost::VARCHAR || '|' || record_date::VARCHAR") + " AS content_hash FROM (SELECT record_date, sum(cost)::DECIMAL(18,2) AS cost FROM energy GROUP BY 1) UNION ALL SELECT 'energy', 'consumption,energy_code,record_date,workshop_code', count(*), " + _HASH.format("consumption::VARCHAR || '|' || energy_code || '|' || record_date::VARCHAR || '|' || workshop_code") + " FROM energy UNION ALL SELECT 'output', 'output_qty,record_date,workshop_code', count(*), " + _HASH.format("output_qty::VARCHAR || '|' || record_date::VARCHAR || '|' || workshop_code") + " FROM production", ORACLE)
def o_manifest(p: Plant) -> DataFrame:
    return manifest_of({"daily cost": p.energy.groupBy("record_date").agg(F.sum("cost").cast("decimal(18,2)").alias("cost")), "energy": p.energy.select(*KEY, "consumption"), "output": p.production})
