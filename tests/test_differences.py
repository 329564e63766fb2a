"""The tree of hashes against exceptAll, with levels of all kinds."""

import collections

import pytest
from pyspark.sql import functions as F

from wattmill.operators import differences, quality, warehouse


def table(spark, n, **changes):
    rows = spark.range(n).select((F.col("id") % 5).alias("part"), "id", F.when(F.col("id") % 7 != 1, F.concat(F.lit("t"), "id")).alias("text"), (F.col("id") / 8).alias("x"))
    return rows.withColumns({k: F.expr(v) for k, v in changes.items()})


def counts(frame):
    return collections.Counter(map(str, frame.collect()))


SIDES = {
    "equal": ({}, "true"), "value": ({"x": "IF(id = 333, x + 1, x)"}, "true"), "null": ({"text": "IF(id = 12, NULL, text)"}, "true"), "gone": ({}, "id <> 77"), "many": ({"x": "x + id % 2"}, "id % 3 <> 0"), "all": ({"text": "'other'"}, "true"), "nothing": ({}, "false"),
}


@pytest.mark.parametrize("kind", SIDES)
@pytest.mark.parametrize("bits, few", [(10, 50_000), (2, 0), (5, 10)])
def test_differences(spark, monkeypatch, kind, bits, few):
    monkeypatch.setattr(differences, "BITS", bits)
    monkeypatch.setattr(differences, "FEW_ROWS", few)
    changes, keep = SIDES[kind]
    left, right = table(spark, 600), table(spark, 600, **changes).filter(keep)
    left = left.unionByName(left.filter("id % 100 = 5"))  # repeats
    right = right.unionByName(right.filter("id % 50 = 5"))
    got = differences.one_sided(left, right, ["part", "id"])
    expected = left.exceptAll(right).withColumn("side", F.lit("left")).unionByName(right.exceptAll(left).withColumn("side", F.lit("right")))
    assert counts(got) == counts(expected)
    assert counts(warehouse.same_rows(left, right)) == counts(expected.replace({"left": "snapshot", "right": "source"}, subset=["side"]))


def test_equal_tables_end_after_the_sums(spark):
    left = table(spark, 5_000)
    a, b = differences.differing_parts(left, left.orderBy(F.desc("id")), ["id"])
    assert a.isEmpty() and b.isEmpty() and "Join" not in a._jdf.queryExecution().optimizedPlan().toString()


def test_few_rows_move(spark, monkeypatch):
    left, right = table(spark, 20_000), table(spark, 20_000, x="IF(id IN (5, 19000), -1.0, x)")
    a, b = differences.differing_parts(left, right, ["id"])
    assert 2 <= a.count() == b.count() < 200
    monkeypatch.setattr(differences, "BROADCAST_BUCKETS", 0)
    assert counts(differences.differing_parts(left, right, ["id"])[0]) == counts(a)


def test_reconcile_alike_with_and_without_the_tree(spark):
    left, right = table(spark, 400), table(spark, 400, x="IF(id = 9, NULL, x)").filter("id <> 30").unionByName(table(spark, 402).filter("id >= 400"))
    plain = quality.reconcile(left, right, ("part", "id"), ("text", "x"))
    assert counts(quality.reconcile(left, right, ("part", "id"), ("text", "x"), few_differences=True)) == counts(plain) and plain.count() == 4
