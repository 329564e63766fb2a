"""Mixing sources to target weights: hierarchical budgeting with DataFrame functions only.

Leaves are (domain, lang, source). A budget of tokens is shared out from the root: every child gets its weight's share of its
parent's budget, at most what it can supply (its tokens times `max_epochs`). What a child can't supply goes to its siblings first;
only what a whole family can't supply reaches the parent's siblings. Each leaf then takes its budget as a prefix of seeded epochs:
as many whole epochs as fit, then documents of the next epoch, in the order of md5(seed, epoch, doc_id), while they fit whole.

Leaf totals are pre-aggregated. A hot leaf is never ordered in one task: the order's first hex digits split it into slices, running
totals are taken over slices (at most 16 ** `SLICE_DIGITS` a leaf), and only the one slice that holds the cut is ordered row by row. Tables with a
row a leaf are broadcast if they are small by count.

Null domain, lang or source count as the value `none`; null and empty texts have 0 tokens, go with every whole epoch and count nothing.
Repeated rows are mixed one by one; equal ids have equal places in the order and are taken or left together. An empty table gives none.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattmill.llm.common import small_side, written

LEVELS = ("domain", "lang", "source")
#: Weights of domains and languages; names that aren't listed, and all sources, weigh 1.
WEIGHTS: dict[str, dict[str, float]] = {"domain": {"web": 4.0, "books": 3.0, "forum": 2.0}, "lang": {"en": 4.0, "de": 2.0, "fr": 2.0, "es": 2.0}, "source": {}}
#: Tokens to take as a share of all there are, and how often a document may be seen at most.
SHARE, MAX_EPOCHS, SEED = 0.5, 2, 17
#: Hex digits of the order that name a slice: 16 ** 3 slices a leaf.
SLICE_DIGITS = 3
SPACE = r"[\x20\x09-\x0D]+"


def domain_of(source: Column) -> Column:
    """The domain of a source, by the number at the end of its name."""
    n = F.pmod(F.regexp_extract(F.coalesce(source, F.lit("")), "([0-9]{1,9})$", 1).try_cast("bigint"), F.lit(4))
    return F.when(n == 0, "web").when(n == 1, "books").when(n == 2, "forum").when(n == 3, "code").otherwise("none")


def token_rows(docs: DataFrame) -> DataFrame:
    """Per document row: id, leaf and number of tokens. Texts go no further than this projection."""
    none = F.lit("none")
    return docs.select(
        "doc_id",
        domain_of(F.col("source")).alias("domain"),
        F.coalesce("lang", none).alias("lang"),
        F.coalesce("source", none).alias("source"),
        F.size(F.array_remove(F.split(F.coalesce("text", F.lit("")), SPACE), "")).cast("long").alias("n_tokens"),
    )


def weight(level: str, weights: Mapping[str, Mapping[str, float]]) -> Column:
    value = F.lit(1.0)
    for name, w in weights.get(level, {}).items():
        value = F.when(F.col(level) == name, F.lit(float(w))).otherwise(value)
    return value


def shared_out(children: DataFrame, parent: list[str], child: str) -> DataFrame:
    """Budget for each child: min(cap, level * weight), the level such that the parent's `budget` is spent (or all caps are).

    Children are ordered by cap / weight. If those before the k-th are filled, it and those after it share what is left; the level is
    the largest of these shares, as it rises while children can be filled and falls after.
    """
    by = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    order = by.orderBy(F.col("cap") / F.col("w"), child)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    still = F.sum("w").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    level = F.max("_level").over(by)
    return children.withColumn("_level", left / still).withColumn("budget", F.least(F.col("cap"), level * F.col("w"))).drop("_level", "w")


def leaf_budgets(tokens: DataFrame, weights: Mapping[str, Mapping[str, float]] = WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """One row per leaf: supply in tokens, budget, whole epochs and tokens of the partial one. Work here is on tree nodes, not rows."""
    leaves = tokens.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("supply"))
    leaves = written(leaves, "supplies")
    total = (leaves.agg(F.sum("supply")).first()[0] or 0) * float(share)
    budgets, parent = None, []
    for level in LEVELS:
        nodes = leaves.groupBy(*parent, level).agg(F.sum("supply").alias("supply")).withColumn("cap", F.col("supply").cast("double") * max_epochs)
        nodes = nodes.withColumn("w", weight(level, weights))
        nodes = nodes.join(budgets.select(*parent, "budget"), parent) if parent else nodes.withColumn("budget", F.lit(total))
        budgets = shared_out(nodes, parent, level)
        parent = [*parent, level]
    return budgets.select(*LEVELS, "supply", F.floor(F.round("budget", 3)).alias("leaf_budget")).selectExpr(
        "*", "coalesce(leaf_budget div nullif(supply, 0), 0) as epochs", "coalesce(leaf_budget % nullif(supply, 0), 0) as rest"
    )


def mix(tokens: DataFrame, weights: Mapping[str, Mapping[str, float]] = WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """Per row of `token_rows`: leaf_budget, and `copies`, the number of epochs that take it."""
    tokens = written(tokens, "tokens")  # the texts are read once
    leaves = written(leaf_budgets(tokens, weights, share, max_epochs), "leaves")
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("epochs").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    placed = tokens.join(small_side(leaves), list(LEVELS)).withColumn("_o", order).withColumn("_slice", F.substring("_o", 1, SLICE_DIGITS))
    slices = placed.groupBy(*LEVELS, "_slice", "rest").agg(F.sum("n_tokens").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*LEVELS).orderBy("_slice")) - F.col("_n")
    slices = written(slices.withColumn("_before", before), "slices")
    cut = slices.filter((F.col("_before") <= F.col("rest")) & (F.col("_before") + F.col("_n") > F.col("rest")) & (F.col("_n") > 0))
    cut = cut.select(*LEVELS, F.col("_slice").alias("_cut"), F.col("_before").alias("_at_cut"))
    cuts = written(leaves.select(*LEVELS).join(cut, list(LEVELS), "left"), "cuts")
    rows = placed.join(small_side(cuts), list(LEVELS))
    inside = rows.filter(F.col("_slice") == F.col("_cut"))
    running = F.sum("n_tokens").over(Window.partitionBy(*LEVELS).orderBy("_o")) + F.col("_at_cut")
    inside = inside.withColumn("_in", (F.col("rest") > 0) & (running <= F.col("rest")))
    outside = rows.filter(F.col("_cut").isNull() | (F.col("_slice") != F.col("_cut"))).withColumn("_in", (F.col("rest") > 0) & F.coalesce(F.col("_slice") < F.col("_cut"), F.lit(False)))
    chosen = outside.unionByName(inside)
    return chosen.select("doc_id", *LEVELS, "n_tokens", "leaf_budget", (F.col("epochs") + F.col("_in").cast("long")).alias("copies"))


def mix_report(docs: DataFrame) -> DataFrame:
    """One row per document row that at least one epoch takes."""
    return mix(token_rows(docs)).filter("copies > 0")


#: The same in DuckDB SQL.
ORACLE_SQL = r"""
WITH t AS (SELECT doc_id,
    CASE CAST(nullif(regexp_extract(coalesce(source, ''), '([0-9]{1,9})$', 1), '') AS BIGINT) % 4 WHEN 0 THEN 'web' WHEN 1 THEN 'books' WHEN 2 THEN 'forum' WHEN 3 THEN 'code' ELSE 'none' END AS domain,
    coalesce(lang, 'none') AS lang, coalesce(source, 'none') AS source,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS n_tokens FROM documents),
leaves AS (SELECT domain, lang, source, CAST(sum(n_tokens) AS BIGINT) AS supply FROM t GROUP BY ALL),
d0 AS (SELECT domain, sum(supply) * 2.0::DOUBLE AS cap, CASE domain WHEN 'web' THEN 4.0::DOUBLE WHEN 'books' THEN 3.0 WHEN 'forum' THEN 2.0 ELSE 1.0 END AS w,
    (SELECT sum(supply) * 0.5::DOUBLE FROM leaves) AS budget FROM leaves GROUP BY domain),
d1 AS (SELECT domain, least(cap, w * max(level) OVER ()) AS budget FROM (SELECT *, (budget - coalesce(sum(cap) OVER (ORDER BY cap / w, domain ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY cap / w, domain ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM d0)),
l0 AS (SELECT domain, lang, sum(supply) * 2.0::DOUBLE AS cap, CASE lang WHEN 'en' THEN 4.0::DOUBLE WHEN 'de' THEN 2.0 WHEN 'fr' THEN 2.0 WHEN 'es' THEN 2.0 ELSE 1.0 END AS w, any_value(d1.budget) AS budget
    FROM leaves JOIN d1 USING (domain) GROUP BY domain, lang),
l1 AS (SELECT domain, lang, least(cap, w * max(level) OVER (PARTITION BY domain)) AS budget FROM (SELECT *, (budget - coalesce(sum(cap) OVER (PARTITION BY domain ORDER BY cap / w, lang ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (PARTITION BY domain ORDER BY cap / w, lang ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM l0)),
s0 AS (SELECT domain, lang, source, supply, supply * 2.0::DOUBLE AS cap, 1.0::DOUBLE AS w, l1.budget FROM leaves JOIN l1 USING (domain, lang)),
s1 AS (SELECT domain, lang, source, supply, least(cap, w * max(level) OVER (PARTITION BY domain, lang)) AS budget FROM (SELECT *, (budget - coalesce(sum(cap) OVER (PARTITION BY domain, lang ORDER BY cap / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (PARTITION BY domain, lang ORDER BY cap / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s0)),
b AS (SELECT domain, lang, source, CAST(floor(round(budget, 3)) AS BIGINT) AS leaf_budget,
    coalesce(CAST(floor(round(budget, 3)) AS BIGINT) // nullif(supply, 0), 0) AS epochs, coalesce(CAST(floor(round(budget, 3)) AS BIGINT) % nullif(supply, 0), 0) AS rest FROM s1),
o AS (SELECT t.*, leaf_budget, epochs, rest, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5('17:' || epochs || ':' || coalesce(CAST(doc_id AS VARCHAR), ''))) AS upto
    FROM t JOIN b USING (domain, lang, source))
SELECT doc_id, domain, lang, source, n_tokens, leaf_budget, epochs + CASE WHEN rest > 0 AND upto <= rest THEN 1 ELSE 0 END AS copies FROM o
WHERE epochs + CASE WHEN rest > 0 AND upto <= rest THEN 1 ELSE 0 END > 0
"""
