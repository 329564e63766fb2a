"""URL filters: host and path rules first, gradient-boosted trees on lexical features for the rest. DataFrame and pyspark.ml only.

A rule has a host and a path prefix; it fits its host and all subdomains, the longest rule wins, ties go to the smaller string.
URLs that a rule decides are the labelled URLs from which the trees learn (block is 1). Suffix statistics count all labelled URLs out of fold;
the trees are fitted on at most `sample_rows` of them, the smallest by hash of the URL. Without labelled URLs of both kinds every
other URL is allowed.

Null URLs and those without `://` have an empty host and path and are judged like any other. Long URLs are read whole. Empty tables give no rows. Repeated
rows are judged one by one. Columns other than page_id and url are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattmill.llm.common import ascii_lower, written

RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
#: Labelled URLs for the fit, and the trees' shape.
SAMPLE_ROWS, TREES, DEPTH = 20_000, 20, 4
#: Folds of hosts, for suffix statistics and held-out figures.
FOLDS = 5
#: Rules up to this number are compiled into the projection; more are joined on the host's suffixes, with the same result.
COMPILED_RULES = 1_000
#: A suffix table up to this number of rows is broadcast (its rows are a short string and two numbers).
BROADCAST_SUFFIXES = 50_000
FEATURES = ("u_length", "u_host_length", "u_depth", "u_digits", "u_entropy", "u_parameters", "u_labels", "u_hyphens", "u_suffix_share", "u_suffix_block")
SHAPE = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_fold() -> Column:
    """The fold of a URL's host."""
    return F.pmod(F.xxhash64("host"), F.lit(FOLDS)).cast("int")


def parts(pages: DataFrame) -> DataFrame:
    """`page_id`, `url`, `host` and `path`."""
    url = F.coalesce(F.col("url"), F.lit(""))
    return pages.select("page_id", "url", ascii_lower(F.regexp_extract(url, SHAPE, 1)).alias("host"), F.regexp_extract(url, SHAPE, 2).alias("path"))


def suffixes(host: Column) -> Column:
    """All suffixes of a host at its dots, the host itself first."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def apply_rules(urls: DataFrame, rules: Sequence[tuple[str, str]] = RULES) -> DataFrame:
    """`urls` with `rule` and `ruled` (block, allow or null). Needs host and path."""
    split = [(verdict, rule, *rule.partition("/")[::2]) for verdict, rule in rules]
    if len(split) <= COMPILED_RULES:
        best = F.lit(None).cast("struct<rule:string,verdict:string>")
        for verdict, rule, host, path in sorted(split, key=lambda r: (len(r[1]), [-ord(c) for c in r[1]])):  # later ones win
            fits = ((F.col("host") == host) | F.endswith(F.col("host"), F.lit(f".{host}"))) & F.startswith(F.col("path"), F.lit(f"/{path}"))
            best = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(best)
        return urls.withColumn("_r", best).select("*", F.col("_r.rule").alias("rule"), F.col("_r.verdict").alias("ruled")).drop("_r")
    table = urls.sparkSession.createDataFrame([(v, r, h, f"/{p}") for v, r, h, p in split], "verdict string, rule string, rule_host string, rule_path string")
    # hosts and paths are joined once each; a host's rules are a bounded list, so the hot hosts' rows stay spread over the partitions
    distinct = urls.select("host", "path").distinct()
    won = (
        distinct.withColumn("rule_host", F.explode(suffixes(F.col("host"))))
        .join(table, "rule_host")
        .filter(F.startswith("path", "rule_path"))
        .groupBy("host", "path")
        .agg(F.min_by(F.struct("rule", "verdict"), F.struct(-F.length("rule"), "rule")).alias("_r"))
    )
    return urls.join(won, ["host", "path"], "left").select(*urls.columns, F.col("_r.rule").alias("rule"), F.col("_r.verdict").alias("ruled"))


def lexical(urls: DataFrame) -> DataFrame:
    """`urls` with the features that need the URL alone, and its `suffix` (the last two labels of the host)."""
    u = F.coalesce(F.col("url"), F.lit(""))
    n = F.length(u)
    step = urls.withColumn("_chars", F.array_distinct(F.split(u, "")))
    count = lambda pattern: n - F.length(F.regexp_replace(u, pattern, ""))
    part = lambda c: F.try_divide((n - F.length(F.replace(u, c, F.lit("")))).cast("double"), n)
    return step.select(
        *urls.columns,
        n.cast("double").alias("u_length"),
        F.length("host").cast("double").alias("u_host_length"),
        (F.length("path") - F.length(F.replace("path", F.lit("/"), F.lit("")))).cast("double").alias("u_depth"),
        F.coalesce(F.try_divide(count("[0-9]").cast("double"), n), F.lit(0.0)).alias("u_digits"),
        F.aggregate(F.filter("_chars", lambda c: c != ""), F.lit(0.0), lambda a, c: a - F.coalesce(part(c) * F.log2(part(c)), F.lit(0.0))).alias("u_entropy"),
        count("[?&=]").cast("double").alias("u_parameters"),
        F.size(F.split("host", r"\.")).cast("double").alias("u_labels"),
        count("-").cast("double").alias("u_hyphens"),
        F.substring_index("host", ".", -2).alias("suffix"),
    )


def with_suffix_statistics(urls: DataFrame) -> DataFrame:
    """Adds each suffix's share of all URLs and its smoothed share of blocked ones among the labelled, both over the whole table.

    Labels are counted out of fold: hosts are dealt to `FOLDS` folds by hash, and a URL, labelled or not, sees the labels of the other folds' hosts only. So neither its own
    label nor those of its host are in what the trees see, and URLs that have no label see what labelled ones did.
    """
    folds = urls.withColumn("fold", host_fold())
    counts = written(folds.groupBy("suffix", "fold").agg(F.count("*").alias("n"), F.count("ruled").alias("labelled"), F.count(F.when(F.col("ruled") == "block", 1)).alias("blocked")), "suffixes")
    size = counts.agg(F.count("*").alias("rows"), F.coalesce(F.sum("n"), F.lit(0)).alias("urls")).first()
    whole = Window.partitionBy("suffix")
    others = lambda c: F.sum(c).over(whole) - F.col(c)
    stats = counts.select("suffix", "fold", (F.sum("n").over(whole).cast("double") / F.lit(float(max(1, size.urls)))).alias("u_suffix_share"), ((others("blocked") + 1.0) / (others("labelled") + 2.0)).alias("u_suffix_block"))
    return folds.join(F.broadcast(stats) if size.rows <= BROADCAST_SUFFIXES else stats, ["suffix", "fold"], "left")


def fit(urls: DataFrame, sample_rows: int = SAMPLE_ROWS, features: Sequence[str] = FEATURES) -> GBTClassificationModel | None:
    """Trees from labelled URLs (column `ruled`) with the features named; None if only one kind is there."""
    labelled = urls.filter(F.col("ruled").isNotNull()).select((F.col("ruled") == "block").cast("double").alias("label"), *features, F.xxhash64("url").alias("_h"), "page_id")
    sample = labelled.orderBy("_h", "page_id").limit(sample_rows).drop("_h", "page_id")
    sample = written(sample, "urls")
    if sample.agg(F.count_distinct("label")).first()[0] < 2:
        return None
    return GBTClassifier(featuresCol="features", labelCol="label", maxIter=TREES, maxDepth=DEPTH, seed=7).fit(VectorAssembler(inputCols=list(features), outputCol="features").transform(sample))


def held_out(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, features: Sequence[str] = FEATURES) -> DataFrame:
    """fold, n, accuracy, base: labelled URLs of each fold's hosts, judged by trees that saw none of these hosts; `base` is the share of the commoner verdict among what the trees saw."""
    urls = with_suffix_statistics(lexical(apply_rules(parts(pages), rules))).filter("ruled IS NOT NULL")
    urls = written(urls.withColumn("label", (F.col("ruled") == "block").cast("double")), "labelled-urls")
    out = []
    for fold in range(FOLDS):
        model, test = fit(urls.filter(F.col("fold") != fold), features=features), urls.filter(F.col("fold") == fold)
        if model is not None:
            common = F.lit(float(urls.filter(F.col("fold") != fold).agg(F.avg("label")).first()[0] >= 0.5))
            scored = model.transform(VectorAssembler(inputCols=list(features), outputCol="features").transform(test))
            out.append(scored.groupBy("fold").agg(F.count("*").alias("n"), F.avg((F.col("prediction") == F.col("label")).cast("double")).alias("accuracy"), F.avg((F.col("label") == common).cast("double")).alias("base")))
    return reduce(DataFrame.unionByName, out) if out else urls.select("fold", F.lit(0).cast("long").alias("n"), F.lit(None).cast("double").alias("accuracy"), F.lit(None).cast("double").alias("base")).limit(0)


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, and `block_score` (the trees' probability; null without a model)."""
    urls = with_suffix_statistics(lexical(apply_rules(parts(pages), rules)))
    model = fit(urls, sample_rows)
    if model is None:
        return urls.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.lit("allow")).alias("verdict"), F.lit(None).cast("double").alias("block_score"))
    scored = model.transform(VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(urls.fillna(0.0, list(FEATURES))))
    score = vector_to_array("probability")[1]
    return scored.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(score >= 0.5, "block").otherwise("allow")).alias("verdict"), score.alias("block_score"))
