"""Scans over long series in two levels, so that a series isn't one task.

A series is cut into buckets of time. Each bucket gives a small state (sums, first and last values), the states of a series are folded in order, a row a bucket,
and each bucket is finished with what the buckets before or behind it hand on. Rows are dealt by key and bucket, whatever the series' length; only the table of states is
dealt by key. Results are those of one window over the series, but for the order in which floats are added.

A row without a time is in a bucket of its own kind, to which nothing is handed on.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET = "_bucket"
DAY_S = 86_400


def bucketed(rows: DataFrame, at: str, bucket_s: int) -> DataFrame:
    """`rows` with the number of their bucket of time."""
    return rows.withColumn(BUCKET, F.floor(F.unix_seconds(F.col(at).cast("timestamp")) / bucket_s))


def inside(keys: Sequence[str]):
    """The window of a bucket."""
    return Window.partitionBy(*keys, BUCKET)


def before(keys: Sequence[str]):
    """In the table of states: all buckets before."""
    return Window.partitionBy(*keys).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)


def behind(keys: Sequence[str]):
    """In the table of states: all buckets behind."""
    return Window.partitionBy(*keys).orderBy(BUCKET).rowsBetween(1, Window.unboundedFollowing)


def carried(rows: DataFrame, keys: Sequence[str], states: dict[str, Column], fold: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """`rows` with what their bucket is handed: `fold` takes the table of states (keys, bucket, states) and returns keys, bucket and the columns to hand on."""
    table = rows.groupBy(*keys, BUCKET).agg(*(c.alias(name) for name, c in states.items()))
    return rows.join(fold(table), [*keys, BUCKET], "left")


def running(state: str) -> Column:
    return F.coalesce(state, F.lit(0.0))


def cusums(rows: DataFrame, keys: Sequence[str], at: str, terms: dict[str, Column], bucket_s: int = 256 * DAY_S) -> DataFrame:
    """For every term the running sum less its running minimum, at most 0, as `s_<name>`. Null terms add nothing; before the first other one the result is null."""
    order = inside(keys).orderBy(at).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = bucketed(rows, at, bucket_s).withColumns({f"_v_{k}": v.cast("double") for k, v in terms.items()})
    rows = rows.withColumns({f"_c_{k}": F.sum(f"_v_{k}").over(order) for k in terms})
    rows = rows.withColumns({f"_m_{k}": F.min(f"_c_{k}").over(order) for k in terms})
    states = {f"_t_{k}": F.sum(f"_v_{k}") for k in terms} | {f"_p_{k}": F.min(f"_c_{k}") for k in terms}

    def fold(table: DataFrame) -> DataFrame:
        sums = table.withColumns({f"_sum_{k}": F.sum(f"_t_{k}").over(before(keys)) for k in terms})
        least = {f"_least_{k}": F.min(running(f"_sum_{k}") + F.col(f"_p_{k}")).over(before(keys)) for k in terms}
        return sums.withColumns(least).select(*keys, BUCKET, *(f"{c}_{k}" for k in terms for c in ("_sum", "_least")))

    rows = carried(rows, keys, states, fold)
    value = {}
    for k in terms:
        total = F.when(F.col(f"_sum_{k}").isNotNull() | F.col(f"_c_{k}").isNotNull(), running(f"_sum_{k}") + running(f"_c_{k}"))
        value[f"s_{k}"] = total - F.least(F.lit(0.0), F.col(f"_least_{k}"), running(f"_sum_{k}") + F.col(f"_m_{k}"))
    return rows.withColumns(value).drop(BUCKET, *(f"{c}_{k}" for k in terms for c in ("_v", "_c", "_m", "_sum", "_least")))


def neighbours(rows: DataFrame, keys: Sequence[str], at: str, columns: Sequence[str], bucket_s: int) -> DataFrame:
    """For every column `<column>_prev` and `<column>_next`, the nearest values that aren't null (place, value), a row's own first; `_place` is the row's place in its series and `_places` their number."""
    order = inside(keys).orderBy(at)
    rows = bucketed(rows, at, bucket_s).withColumn("_place", F.row_number().over(order).cast("long"))
    own = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.col("_place").alias("place"), F.col(c).alias("value")))
    back, on = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(0, Window.unboundedFollowing)
    rows = rows.withColumns({f"{c}_prev": F.last(own(c), True).over(back) for c in columns} | {f"{c}_next": F.first(own(c), True).over(on) for c in columns})
    states = {"_n": F.count("*")} | {f"_first_{c}": F.min(own(c)) for c in columns} | {f"_last_{c}": F.max(own(c)) for c in columns}
    moved = lambda s: F.when(F.col(s).isNotNull(), F.struct((F.col(s).getField("place") + F.col("_offset")).alias("place"), F.col(s).getField("value").alias("value")))

    def fold(table: DataFrame) -> DataFrame:
        placed = table.withColumns({"_offset": F.coalesce(F.sum("_n").over(before(keys)), F.lit(0)), "_places": F.sum("_n").over(Window.partitionBy(*keys))})
        handed = {f"_before_{c}": F.last(moved(f"_last_{c}"), True).over(before(keys)) for c in columns} | {f"_behind_{c}": F.first(moved(f"_first_{c}"), True).over(behind(keys)) for c in columns}
        return placed.select(*keys, BUCKET, "_offset", "_places", *(v.alias(k) for k, v in handed.items()))

    rows = carried(rows, keys, states, fold).withColumn("_offset", F.coalesce("_offset", F.lit(0)))
    known = {f"{c}_prev": F.coalesce(moved(f"{c}_prev"), F.col(f"_before_{c}")) for c in columns} | {f"{c}_next": F.coalesce(moved(f"{c}_next"), F.col(f"_behind_{c}")) for c in columns}
    return rows.withColumns(known | {"_place": F.col("_place") + F.col("_offset")}).drop(BUCKET, "_offset", *(f"{s}_{c}" for c in columns for s in ("_before", "_behind")))


def stretches(rows: DataFrame, keys: Sequence[str], at: str, step_s: int, bucket_s: int) -> DataFrame:
    """`episode`, counted from 1 in each series: a row goes on with the one before it if it comes exactly `step_s` seconds later."""
    order = inside(keys).orderBy("_t")
    rows = bucketed(rows, at, bucket_s).withColumn("_t", F.unix_seconds(F.col(at).cast("timestamp")))
    rows = rows.withColumn("_new", F.coalesce((F.col("_t") - F.lag("_t").over(order) != step_s).cast("long"), F.lit(0)))

    def fold(table: DataFrame) -> DataFrame:
        since = F.col("_first") - F.lag("_last").over(Window.partitionBy(*keys).orderBy(BUCKET))
        opened = table.withColumn("_opens", F.coalesce((since != step_s).cast("long"), F.lit(1)))
        return opened.select(*keys, BUCKET, (F.col("_opens") + F.coalesce(F.sum(F.col("_opens") + F.col("_inner")).over(before(keys)), F.lit(0))).alias("_from"))

    rows = carried(rows, keys, {"_first": F.min("_t"), "_last": F.max("_t"), "_inner": F.sum("_new")}, fold)
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("episode", F.col("_from") + F.sum("_new").over(upto)).drop(BUCKET, "_t", "_new", "_from")


def covered(points: DataFrame, intervals: DataFrame, key: str, at: str, start: str, end: str, bucket_s: int = DAY_S) -> DataFrame:
    """`points` with `covered`: whether an interval of their key holds their time, its end left out. No point meets an interval: both are sorted into one series, in which the largest
    end so far decides. Intervals may overlap; those without a key, a start or an end, or with an end that isn't later, hold nothing."""
    names = points.columns
    point = points.select(F.col(key).alias("_key"), F.col(at).cast("timestamp").alias("_at"), F.lit(None).cast("timestamp").alias("_end"), F.struct(*names).alias("_row"))
    kind = point.schema["_row"].dataType
    sound = intervals.filter((F.col(end) > F.col(start)) & F.col(key).isNotNull())
    opened = sound.select(F.col(key).alias("_key"), F.col(start).cast("timestamp").alias("_at"), F.col(end).cast("timestamp").alias("_end"), F.lit(None).cast(kind).alias("_row"))
    both = bucketed(point.unionByName(opened), "_at", bucket_s)
    order = inside(["_key"]).orderBy("_at").rangeBetween(Window.unboundedPreceding, Window.currentRow)  # of one time: intervals that start then count
    both = both.withColumn("_until", F.max("_end").over(order))
    fold = lambda table: table.select("_key", BUCKET, F.max("_most").over(before(["_key"])).alias("_before"))
    both = carried(both, ["_key"], {"_most": F.max("_end")}, fold)
    is_covered = F.coalesce(F.greatest("_until", "_before") > F.col("_at"), F.lit(False))
    return both.filter("_row IS NOT NULL").select("_row.*", is_covered.alias("covered"))
