"""Comparison of two tables by a tree of hashes: equal ones end after one small aggregate, unequal ones move only the rows of the places where they differ.

Rows lie in buckets by the hash of their key. A side's bucket is summed up by its number of rows and two order-free sums of row hashes, so each side is read where it lies and sends a row a
bucket. Buckets whose sums differ are looked at again in finer buckets, until few rows are left or buckets no longer tell places apart; only their rows are compared one by one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattmill.staging import written

#: Buckets of a level, as a power of two; levels; rows below which a finer level isn't worth a pass.
BITS, LEVELS, FEW_ROWS = 10, 3, 50_000
#: Differing buckets up to this number are broadcast: a number each.
BROADCAST_BUCKETS = 1 << 20


def row_hash(columns: Sequence[str]) -> list[Column]:
    """Two hashes of a row that tell nulls from their neighbours."""
    values = [*columns, *(F.col(c).isNull() for c in columns)]
    return [F.xxhash64(*salt, *values).cast("decimal(20,0)") for salt in ((), (F.lit("second"),))]


def _bucket(key: Sequence[str], level: int) -> Column:
    return F.xxhash64(*key).bitwiseAND(F.lit((1 << BITS * level) - 1))


def _within(rows: DataFrame, key: Sequence[str], level: int, buckets: DataFrame) -> DataFrame:
    few = buckets.limit(BROADCAST_BUCKETS + 1).count() <= BROADCAST_BUCKETS
    return rows.withColumn("_bucket", _bucket(key, level)).join(F.broadcast(buckets) if few else buckets, "_bucket", "left_semi").drop("_bucket")


def differing_parts(left: DataFrame, right: DataFrame, key: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """The rows of both sides in buckets that aren't equal; both empty if the sides hold the same rows. Both are read once a level: give tables, or frames that are cheap to derive."""
    columns = left.columns
    right = right.select(*(F.col(c).cast(left.schema[c].dataType).alias(c) for c in columns))
    for level in range(1, LEVELS + 1):
        sums = lambda side, n: side.groupBy(_bucket(key, level).alias("_bucket")).agg(F.count("*").alias(f"n{n}"), *(F.sum(h).alias(f"h{n}{i}") for i, h in enumerate(row_hash(columns))))
        both = written(sums(left, 0).join(sums(right, 1), "_bucket", "full"), "buckets")
        same = F.col("n0").eqNullSafe(F.col("n1")) & F.col("h00").eqNullSafe(F.col("h10")) & F.col("h01").eqNullSafe(F.col("h11"))
        size = lambda c: F.coalesce(F.sum(c), F.lit(0))
        rows = F.coalesce("n0", F.lit(0)) + F.coalesce("n1", F.lit(0))
        told = both.agg(size(rows).alias("rows"), size(F.when(~same, rows)).alias("odd"), F.count_if(~same).alias("buckets")).first()
        if told.odd < told.rows:
            odd = both.filter(~same).select("_bucket")
            left, right = (_within(side, key, level, odd) for side in (left, right)) if told.buckets else (left.limit(0), right.limit(0))
        if told.odd <= FEW_ROWS or 2 * told.odd > told.rows:
            break
    return left, right


def one_sided(left: DataFrame, right: DataFrame, key: Sequence[str], names: tuple[str, str] = ("left", "right")) -> DataFrame:
    """Rows that one side has more often than the other, as often as it has them more, with `side`."""
    a, b = differing_parts(left, right, key)
    columns = a.columns
    both = a.withColumn("_n", F.lit(1)).unionByName(b.withColumn("_n", F.lit(-1)))
    counted = both.groupBy(*columns).agg(F.sum("_n").alias("_n")).filter("_n <> 0")
    return counted.withColumns({"side": F.when(F.col("_n") > 0, names[0]).otherwise(names[1]), "_n": F.explode(F.sequence(F.lit(1).cast("long"), F.abs("_n")))}).drop("_n")
