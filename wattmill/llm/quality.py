"""Quality rules: a threshold table compiled into one Spark projection, without user functions.

All measures come from built-in column functions over the whole text; nothing is shuffled. Words are runs of characters other
than ASCII white space. A null or empty text has no words and fails the base rule; every other column may be null or have any name.
Repeated rows are judged row by row. Long texts cost n log n: repeated windows are found by sorting window hashes (64 bits over the
five words, each hashed with its length, so word borders count). An empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattmill.llm.common import under_own_names

SPACE = r"[\x20\x09-\x0D]+"
WINDOW = 5
#: Frequent function words of the four languages.
STOP_WORDS = tuple(
    "the of and to in is that for it was on with as be by at this a are or an not "
    "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als "
    "de la le et les des en un du une que est pour qui dans par sur au avec ce "
    "el y los se del las por con su para una al lo como es no".split()
)


@dataclass(frozen=True)
class Rule:
    """A document fails if `ratio` leaves [low, high]; documents with fewer than `least_words` words pass."""

    name: str
    ratio: str
    low: float = float("-inf")
    high: float = float("inf")
    least_words: int = 0


#: The table. Ratios are the keys of `ratios`.
RULES = (
    Rule("mean_word_length", "chars_per_word", low=1.5, high=25.0),
    Rule("symbols_per_word", "symbols_per_word", high=0.4),
    Rule("stop_words", "stop_share", low=0.01, least_words=100),
    Rule("repeated_lines", "dup_line_share", high=0.5),
    Rule("words_with_letters", "alpha_share", low=0.5),
)


def ratios() -> dict[str, Column]:
    """Ratios over the measured columns; a denominator of 0 gives 0."""
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0))
    return {
        "chars_per_word": share("_q_word_chars", "_q_words"),
        "symbols_per_word": share("_q_symbols", "_q_words"),
        "stop_share": share("_q_stops", "_q_words"),
        "dup_line_share": share("_q_dup_lines", "_q_lines"),
        "alpha_share": share("_q_alpha", "_q_words"),
    }


def compile_rules(rules: tuple[Rule, ...] = RULES) -> Column:
    """One boolean: true if every rule of the table passes."""
    ratio, passed = ratios(), F.lit(True)
    for rule in rules:
        value = ratio[rule.ratio]
        passed = passed & ((F.col("_q_words") < rule.least_words) | ((value >= rule.low) & (value <= rule.high)))
    return passed


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` and the measures as columns `_q_*`. Columns of these names in the input are replaced."""
    at = lambda array, i: F.get(F.col(array), i)
    step = docs.withColumn("_q_text", F.coalesce(F.col(text).cast("string"), F.lit("")))
    step = step.withColumns(
        {
            "_q_w": F.array_remove(F.split("_q_text", SPACE), ""),
            "_q_l": F.filter(F.split("_q_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
            "_q_symbols": F.length("_q_text") - F.length(F.regexp_replace("_q_text", r"[#*$%&|<>]", "")),
        }
    )
    step = step.withColumns(
        {
            "_q_words": F.size("_q_w").cast("long"),
            "_q_word_chars": F.length(F.array_join("_q_w", "")).cast("long"),
            "_q_lines": F.size("_q_l").cast("long"),
            "_q_dup_lines": (F.size("_q_l") - F.size(F.array_distinct("_q_l"))).cast("long"),
            "_q_stops": F.size(F.filter("_q_w", lambda x: F.lower(x).isin(*STOP_WORDS))).cast("long"),
            "_q_alpha": F.size(F.filter("_q_w", lambda x: x.rlike(r"\p{L}"))).cast("long"),
            "_q_g": F.when(
                F.size("_q_w") >= WINDOW,
                F.transform(F.sequence(F.lit(0), F.size("_q_w") - WINDOW), lambda i: F.xxhash64(*(at("_q_w", i + k) for k in range(WINDOW)))),
            ),
        }
    )
    # only texts with a repeated window pay for the sort
    step = step.withColumn(
        "_q_s", F.when(F.size(F.array_distinct("_q_g")) < F.size("_q_g"), F.sort_array(F.transform("_q_g", lambda g, i: F.struct(g.alias("g"), i.alias("i")))))
    )
    same = lambda x, k: F.coalesce(at("_q_s", k)["g"] == x["g"], F.lit(False))
    step = step.withColumn(
        "_q_p", F.sort_array(F.filter(F.transform("_q_s", lambda x, k: F.when(same(x, k - 1) | same(x, k + 1), x["i"])), lambda p: p.isNotNull()))
    )
    covered = F.transform("_q_p", lambda p, k: F.least(F.lit(WINDOW), F.coalesce(at("_q_p", k + 1) - p, F.lit(WINDOW))))
    return step.withColumn("_q_repeat", F.coalesce(F.aggregate(covered, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long"))


def verdict(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """`docs`, the measures, `_q_base_failed` and `_q_kept`.

    The verdict also names the row's number, which is never negative: so Spark leaves a filter on it above these projections. Moved
    below, its expression would hold the whole tree of measures once for every reference.
    """
    failed = (F.col("_q_words") < 10) | (100 * F.col("_q_repeat") > 20 * F.col("_q_words"))
    return measured(docs, text).withColumn("_q_base_failed", failed).withColumn("_q_kept", ~F.col("_q_base_failed") & compile_rules(rules) & (F.monotonically_increasing_id() >= 0))


def quality_report(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per input row: the contract's measures and the verdict."""
    return verdict(docs.select("doc_id", "text"), "text", rules).select(
        "doc_id",
        F.col("_q_words").alias("n_words"),
        F.col("_q_word_chars").alias("word_chars"),
        F.col("_q_symbols").cast("long").alias("n_symbols"),
        F.col("_q_dup_lines").alias("n_dup_lines"),
        F.col("_q_repeat").alias("n_repeat_words"),
        F.col("_q_base_failed").alias("base_failed"),
        F.col("_q_kept").alias("kept"),
    )


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of `docs` that pass, with their own columns only."""
    inner, back = under_own_names(docs, "text")
    return verdict(inner, "text", rules).filter("_q_kept").select(*back)


#: The same in DuckDB SQL (ids are unique in the driver's table).
ORACLE_SQL = rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
m AS (SELECT doc_id, w, l, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
    len(list_filter(w, lambda x: lower(x) IN ({", ".join(f"'{x}'" for x in STOP_WORDS)}))) AS stops, len(list_filter(w, lambda x: regexp_matches(x, '\p{{L}}'))) AS alpha FROM t),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM (SELECT doc_id, i, w[i + 1:i + 5] AS gram FROM m, unnest(range(0, greatest(0, len(w) - 4))) u(i))),
r AS (SELECT doc_id, CAST(sum(least(5, coalesce(nxt - i, 5))) AS BIGINT) AS n FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM g WHERE c > 1) GROUP BY doc_id),
v AS (SELECT m.*, coalesce(r.n, 0) AS n_repeat_words, n_words < 10 OR 100 * coalesce(r.n, 0) > 20 * n_words AS base_failed FROM m LEFT JOIN r USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(word_chars / nullif(n_words, 0), 0) BETWEEN 1.5 AND 25 AND coalesce(n_symbols / nullif(n_words, 0), 0) <= 0.4
    AND (n_words < 100 OR stops / n_words >= 0.01) AND coalesce(n_dup_lines / nullif(len(l), 0), 0) <= 0.5 AND coalesce(alpha / nullif(n_words, 0), 0) >= 0.5 AS kept FROM v
"""
