"""License scans by diagonal voting, with DataFrame functions only.

Every rolling pair of words of a document is joined by hash (and words, so results are exact) with the pairs of the license templates. A
hit votes for the diagonal (position in the document minus position in the template). Votes are summed by diagonal, diagonals that lie
within a template's band of each other are merged, and a merged span is verified: its hits are read in the document's order, and a place
of the template counts once, if it lies behind all places counted before. So neither repeated words nor words in another order verify a
span. The share of places that counts must be at least `LEAST_SHARE`, on a stretch of less than two templates. A base phrase is a template as
short that all of its pairs must stand on one diagonal.

Templates are a table (template, label, base, text); by default the one below. It is broadcast if it has at most `BROADCAST_PAIRS` pairs,
else joined by a shuffle on the pair's hash; a small table's hashes are also looked up before pairs become rows.

Words are runs of characters outside ASCII non-alphanumerics, A-Z lower-cased. Null and empty texts give a row without places; long texts are read
whole; equal shares are one score. Repeated rows are scanned one by one (a row number made by the scan keeps them apart). An empty table gives no
rows. Input columns other than doc_id and text are ignored, so clashing names do no harm.
"""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wattmill.llm.common import ascii_lower

#: Words are what lies between these (A-Z is lower-cased before).
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Base phrases and their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Opening passages of public license texts; found by voting, they add labels to those of the phrases.
PASSAGES = (
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction", "mit-text"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("you may not use this file except in compliance with the license you may obtain a copy of the license at", "apache-text"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gpl-text"),
    ("this source code form is subject to the terms of the mozilla public license", "mpl"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("licensed under cc by", "cc"),
    ("licensed under a creative commons attribution", "cc"),
    ("all rights reserved", "proprietary"),
)
#: Diagonals of a span lie at most BAND apart (words inserted or left out), in short templates a quarter of their pairs; the share of places that verifies it.
BAND, LEAST_SHARE = 3, 0.6
#: A template table up to this number of pairs is broadcast; up to the smaller one, the hashes also filter the documents' pairs before the join. Results are the same.
BROADCAST_PAIRS, COMPILED_PAIRS = 100_000, 1_000


def default_templates(spark: SparkSession) -> DataFrame:
    """The phrases and passages above as a table."""
    return spark.createDataFrame([(n, label, n < len(PHRASES), text) for n, (text, label) in enumerate(PHRASES + PASSAGES)], "template int, label string, base boolean, text string")


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), GAP), "")


def word_pairs(words: Column, known: Collection[int] | None = None) -> Column:
    """One struct for each rolling pair: its place, hash and words (null if there is none); with `known`, only pairs whose hash is in it."""
    at = lambda i: F.get(words, i)
    places = F.when(F.size(words) > 1, F.sequence(F.lit(0), F.size(words) - 2))
    hashed = F.transform(places, lambda i: F.struct(i.alias("i"), F.xxhash64(at(i), at(i + 1)).alias("h")))
    if known is not None:
        hashed = F.filter(hashed, lambda x: x["h"].isin(*known))
    return F.transform(hashed, lambda x: F.struct(x["i"].alias("i"), x["h"].alias("h"), at(x["i"]).alias("a"), at(x["i"] + 1).alias("b")))


def template_pairs(templates: DataFrame) -> DataFrame:
    """Pairs of all templates by position, with the template's number of pairs; templates of fewer than two words have none."""
    rows = templates.select("template", "label", F.coalesce("base", F.lit(False)).alias("base"), words_of(F.col("text")).alias("_w"))
    rows = rows.select("template", "label", "base", (F.size("_w") - 1).alias("n_pairs"), F.explode(word_pairs(F.col("_w"))).alias("p"))
    return rows.select("template", "label", "base", "n_pairs", F.col("p.i").alias("at"), F.col("p.h").alias("t_h"), F.col("p.a").alias("t_a"), F.col("p.b").alias("t_b"))


def spans(docs: DataFrame, templates: DataFrame) -> DataFrame:
    """Per row of `docs` (doc_id, text) one row per candidate span: template, label, base, first and last word, share of the template's pairs
    that it verifies; and one row without template, with doc_id and n_words."""
    pairs = template_pairs(templates)
    known = [r.t_h for r in pairs.select("t_h").limit(COMPILED_PAIRS + 1).collect()]
    pairs = F.broadcast(pairs) if len(known) <= COMPILED_PAIRS or pairs.limit(BROADCAST_PAIRS + 1).count() <= BROADCAST_PAIRS else pairs
    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("_row"), words_of(F.col("text")).alias("_w"))
    own = F.array(F.struct(F.lit(-1).alias("i"), F.xxhash64("_row").alias("h"), F.lit(None).cast("string").alias("a"), F.lit(None).cast("string").alias("b")))
    own_pairs = word_pairs(F.col("_w"), set(known) if len(known) <= COMPILED_PAIRS else None)
    grams = rows.select("_row", "doc_id", F.size("_w").cast("long").alias("n_words"), F.explode(F.concat(own, F.coalesce(own_pairs, F.array()))).alias("d"))
    grams = grams.select("_row", F.when(F.col("d.i") < 0, F.col("doc_id")).alias("doc_id"), F.when(F.col("d.i") < 0, F.col("n_words")).alias("n_words"), "d.*")
    found = grams.join(pairs, (F.col("h") == F.col("t_h")) & (F.col("a") == F.col("t_a")) & (F.col("b") == F.col("t_b")), "left").filter("i < 0 OR template IS NOT NULL")
    diagonals = (
        found.withColumn("diagonal", F.col("i") - F.col("at"))
        .groupBy("_row", "doc_id", "n_words", "template", "label", "base", "n_pairs", "diagonal")
        .agg(F.count("*").alias("votes"), F.collect_list(F.struct("i", "at")).alias("places"))
    )
    by = Window.partitionBy("_row", "template").orderBy("diagonal")
    far = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(by) > F.least(F.lit(BAND), F.floor(F.col("n_pairs") / 4)), F.lit(True))
    merged = (
        diagonals.withColumn("island", F.sum(far.cast("int")).over(by))
        .groupBy("_row", "doc_id", "n_words", "template", "label", "base", "n_pairs", "island")
        .agg(F.max("votes").alias("best"), F.sort_array(F.flatten(F.collect_list("places"))).alias("places"))
    )
    start = F.struct(F.lit(0).alias("n"), F.lit(-1).alias("top"), F.lit(-1).alias("first"), F.lit(-1).alias("last"))
    counts = lambda s, x: F.struct((s["n"] + 1).alias("n"), x["at"].alias("top"), F.when(s["n"] == 0, x["i"]).otherwise(s["first"]).alias("first"), x["i"].alias("last"))
    order = F.aggregate("places", start, lambda s, x: F.when((x["at"] > s["top"]) & (x["i"] > s["last"]), counts(s, x)).otherwise(s))
    merged = merged.withColumn("_v", order).withColumn("_near", F.col("_v.last") - F.col("_v.first") + 2 < 2 * (F.col("n_pairs") + 1))
    verified = F.greatest("best", F.when(F.col("_near"), F.col("_v.n")).otherwise(0))
    return merged.select(
        "_row", "doc_id", "n_words", "template", "label", "base", F.get("places", F.lit(0))["i"].alias("first_word"), (F.get("places", F.size("places") - 1)["i"] + 1).alias("last_word"), F.try_divide(verified, F.col("n_pairs")).alias("share")
    )


def license_scan(docs: DataFrame, templates: DataFrame | None = None) -> DataFrame:
    """One row per input row: all places of the phrases, the labels, and the best share of a verified template (0 if none)."""
    sound = F.col("base") & (F.col("share") == 1)
    passage = ~F.col("base") & (F.col("share") >= LEAST_SHARE)
    labels = lambda when: F.array_join(F.array_sort(F.collect_set(F.when(when, F.col("label")))), ",")
    return (
        spans(docs, default_templates(docs.sparkSession) if templates is None else templates)
        .groupBy("_row")
        .agg(
            F.max("doc_id").alias("doc_id"),
            F.max("n_words").alias("n_words"),
            F.count(F.when(sound, 1)).alias("n_base"),
            F.min(F.when(sound, F.col("first_word"))).cast("long").alias("first_word"),
            F.max(F.when(sound, F.col("first_word"))).cast("long").alias("last_word"),
            labels(sound).alias("base_labels"),
            labels(sound | passage).alias("labels"),
            F.coalesce(F.max(F.when(sound | passage, F.col("share"))), F.lit(0.0)).alias("score"),
        )
        .drop("_row")
    )


def oracle_sql() -> str:
    """The scan in DuckDB SQL (ids are unique in the driver's table); the templates are written out as rows."""
    rows = ", ".join(f"({n}, '{label}', {n < len(PHRASES)}, {len(text.split()) - 1}, {i}, '{a}', '{b}')" for n, (text, label) in enumerate(PHRASES + PASSAGES) for i, (a, b) in enumerate(zip(text.split(), text.split()[1:])))
    return rf"""
WITH t(template, label, base, n_pairs, place, a, b) AS (VALUES {rows}),
d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{GAP}'), lambda x: x <> '') AS w FROM documents),
grams AS (SELECT doc_id, i, w[i + 1] AS a, w[i + 2] AS b FROM d, unnest(range(0, greatest(0, len(w) - 1))) u(i)),
hits AS (SELECT doc_id, template, label, base, n_pairs, i, place, i - place AS diagonal FROM grams JOIN t USING (a, b)),
votes AS (SELECT doc_id, template, diagonal, any_value(n_pairs) AS n_pairs, count(*) AS votes FROM hits GROUP BY ALL),
far AS (SELECT *, CASE WHEN coalesce(diagonal - lag(diagonal) OVER v > least({BAND}, n_pairs // 4), true) THEN 1 ELSE 0 END AS far FROM votes WINDOW v AS (PARTITION BY doc_id, template ORDER BY diagonal)),
islands AS (SELECT *, sum(far) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS island FROM far),
spans AS (SELECT doc_id, template, any_value(h.label) AS label, any_value(h.base) AS base, any_value(h.n_pairs) AS n_pairs, max(votes) AS best, min(h.i) AS first_word, list({{'i': h.i, 'at': h.place}} ORDER BY h.i, h.place) AS places
    FROM hits h JOIN islands USING (doc_id, template, diagonal) GROUP BY doc_id, template, island),
ordered AS (SELECT *, list_reduce(places, lambda s, x: CASE WHEN x.at > s.top AND x.i > s.last THEN {{'n': s.n + 1, 'top': x.at, 'first': CASE WHEN s.n = 0 THEN x.i ELSE s.first END, 'last': x.i}} ELSE s END,
    {{'n': 0::BIGINT, 'top': (-1)::BIGINT, 'first': (-1)::BIGINT, 'last': (-1)::BIGINT}}) AS v FROM (SELECT * REPLACE (list_transform(places, lambda x: {{'i': x.i::BIGINT, 'at': x.at::BIGINT}}) AS places) FROM spans)),
judged AS (SELECT *, greatest(best, CASE WHEN v.last - v.first + 2 < 2 * (n_pairs + 1) THEN v.n ELSE 0 END)::DOUBLE / n_pairs AS share FROM ordered),
kinds AS (SELECT *, base AND share = 1 AS sound, NOT base AND share >= {LEAST_SHARE} AS passage FROM judged)
SELECT doc_id, CAST(len(any_value(w)) AS BIGINT) AS n_words, count(*) FILTER (sound) AS n_base, CAST(min(first_word) FILTER (sound) AS BIGINT) AS first_word, CAST(max(first_word) FILTER (sound) AS BIGINT) AS last_word,
    coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (sound), '') AS base_labels, coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (sound OR passage), '') AS labels,
    coalesce(max(share) FILTER (sound OR passage), 0.0)::DOUBLE AS score FROM d LEFT JOIN kinds USING (doc_id) GROUP BY doc_id
"""


ORACLE_SQL = oracle_sql()
