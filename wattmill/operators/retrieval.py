"""Evidence search: tokens of a question found as parts of texts, weighted, with hints on files and the row that maps a code to its name.

No question meets every text, and equal questions are searched once. A token is looked up by its rarest run of letters in postings of the texts, and verified. Texts that hold the same tokens and fit the same hints have the same score for every
question, so each such signature goes on with its first `limit` ids only: a common word costs different questions times signatures, not questions times texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattmill.operators.views import Plant
from wattmill.plans.catalog import query
from wattmill.sources.adapter import WORKSHOPS
from wattmill.staging import written

# Words that count as tokens wherever they stand, files that words point to, what names of workshops hold, and the file whose mapping row is shown first.
KEYWORDS = ("综合能耗", "单耗", "异常", "停产", "待机", "费用", "碳排放", "温度", "产量", "CUSUM", "2sigma", "2σ", "能源结构", "同比", "环比")
HINTS = {"待机": "Q13", "停产": "Q13", "单耗异常": "Q16", "2sigma": "Q16", "2σ": "Q16", "cusum": "Q27", "三种检测": "Q26", "碳排放": "Q21"}
NAME_PART, MAPPING_FILE = "车间", "Q03"
TOKEN, CODE, STRONG = r"[A-Za-z]+[0-9]*|W[0-9]{2}|[0-9]{4}-[0-9]{2}-[0-9]{2}", r"^w[0-9]{2}$", r"^(w[0-9]{2}|[0-9]{4}-[0-9]{2}-[0-9]{2})$"
#: Weights of codes, dates and names of workshops, of other tokens, and of a file that the question points to.
STRONG_WEIGHT, WEIGHT, HINT_WEIGHT = 4, 1, 6
GRAM = 3


def tokens(question: Column) -> Column:
    """Distinct lower-case tokens of two characters or more."""
    own = F.transform(F.regexp_extract_all(question, F.lit(TOKEN), F.lit(0)), F.lower)
    words = F.filter(F.array(*(F.lit(k.lower()) for k in KEYWORDS)), lambda k: F.contains(F.lower(question), k))
    return F.filter(F.array_distinct(F.concat(own, words)), lambda t: F.length(t) >= 2)


def grams(text: Column, size: int) -> Column:
    """Distinct runs of `size` characters; none of a shorter text."""
    at = F.when(F.length(text) >= size, F.sequence(F.lit(1), F.length(text) - size + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(at, lambda i: F.substr(text, i, F.lit(size))))


def found_in(wanted: DataFrame, texts: DataFrame) -> DataFrame:
    """`token`, `evidence_id` for every token (of two characters or more) that is part of a text (evidence_id, hay). Tokens of two characters are looked up by both of them, others by their rarest three."""
    out = None
    for size, own in ((2, F.length("token") == 2), (GRAM, F.length("token") > 2)):
        parts = wanted.filter(own).select("token", F.explode(grams(F.col("token"), size)).alias("gram"))
        postings = texts.select("evidence_id", F.explode(grams(F.col("hay"), size)).alias("gram")).join(parts.select("gram").distinct(), "gram", "left_semi")
        postings = written(postings, "postings")
        known = parts.join(postings.groupBy("gram").agg(F.count("*").alias("n")), "gram", "left")
        # a token with a run of letters that no text has is in no text
        rarest = known.groupBy("token").agg(F.count_if(F.col("n").isNull()).alias("absent"), F.min_by("gram", F.struct("n", "gram")).alias("gram")).filter("absent = 0").select("token", "gram")
        pairs = rarest.join(postings, "gram").select("token", "evidence_id")
        out = pairs if out is None else out.unionByName(pairs)
    return out.join(texts, "evidence_id").filter(F.contains("hay", "token")).select("token", "evidence_id")


def ranked_evidence(questions: DataFrame, evidence: DataFrame, limit: int = 8) -> DataFrame:
    """question_id, rank, evidence_id for questions (question_id, question) over evidence (evidence_id, path, text, values as a map).

    A question with codes also asks for the workshops' names in evidence that holds one of them. Score: the tokens' weights, and 6 for each hint that the question holds and the path fits; ties by the
    number of tokens, then by id. Of the evidence that gave names one row, that of the mapping file with the smallest id first, is always shown: it takes the last place where it isn't among the first.
    A question without tokens, or a null one, finds nothing.
    """
    # equal questions are searched once
    asked = written(questions.select("question").distinct().select("question", F.lower("question").alias("said"), F.explode(tokens(F.col("question"))).alias("token")), "asked")
    texts = written(evidence.select(F.col("evidence_id"), F.lower("path").alias("path"), F.lower("text").alias("hay"), F.transform(F.filter(F.map_values("values"), lambda v: F.contains(v, F.lit(NAME_PART))), F.lower).alias("names")), "texts")
    by_code = written(texts.filter(F.size("names") > 0).select("evidence_id", "path", "names", F.explode(F.array_distinct(F.regexp_extract_all("hay", F.lit("w[0-9]{2}"), F.lit(0)))).alias("token")), "names")
    codes = asked.filter(F.col("token").rlike(CODE)).select("question", "said", "token")
    named = codes.join(by_code.select("token", F.explode("names").alias("name")).distinct(), "token").select("question", "said", F.col("name").alias("token"))
    asked = written(asked.unionByName(named).distinct(), "asked")
    first = F.min(F.struct((~F.contains("path", F.lit(MAPPING_FILE.lower()))).alias("other"), "evidence_id"))
    mapping = codes.join(by_code.groupBy("token").agg(first.alias("m")), "token").groupBy("question").agg(F.min("m").alias("m")).select("question", F.col("m.evidence_id").alias("mapping"))

    held = written(found_in(asked.select("token").distinct(), texts.select("evidence_id", "hay")), "held")
    fits = F.filter(F.array(*(F.lit(q.lower()) for q in sorted(set(HINTS.values())))), lambda q: F.contains(F.col("path"), q))
    signed = held.groupBy("evidence_id").agg(F.sort_array(F.collect_set("token")).alias("sign")).join(texts.select("evidence_id", fits.alias("files")), "evidence_id")  # tokens of one text
    order = Window.partitionBy("sign", "files").orderBy("evidence_id")
    members = written(signed.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= limit), "members")
    signs = members.filter("n = 1").select(F.col("evidence_id").alias("sign_id"), "sign", "files")
    members = members.select(F.first("evidence_id").over(order).alias("sign_id"), "evidence_id")

    strong = F.col("token").rlike(STRONG) | F.contains("token", F.lit(NAME_PART))
    scores = asked.join(signs.select("sign_id", F.explode("sign").alias("token")), "token").groupBy("question", "said", "sign_id").agg(F.sum(F.when(strong, STRONG_WEIGHT).otherwise(WEIGHT)).alias("score"), F.count("*").alias("n"))
    pointed = F.array(*(F.struct(F.lit(w.lower()).alias("word"), F.lit(q.lower()).alias("file")) for w, q in HINTS.items()))
    bonus = F.size(F.filter(pointed, lambda h: F.contains(F.col("said"), h.word) & F.array_contains(F.col("files"), h.file)))
    scored = scores.join(signs.select("sign_id", "files"), "sign_id").withColumn("score", F.col("score") + HINT_WEIGHT * bonus)
    best = Window.partitionBy("question").orderBy(F.desc("score"), F.desc("n"), "evidence_id")
    top = scored.join(members, "sign_id").withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= limit)
    shown = written(top.join(mapping, "question", "left").select("question", "rank", "evidence_id", "mapping"), "shown")
    missing = shown.groupBy("question", "mapping").agg(F.max("rank").alias("last"), F.coalesce(F.bool_or(F.col("evidence_id") == F.col("mapping")), F.lit(True)).alias("there")).filter("NOT there")
    put = missing.select("question", F.least(F.col("last") + 1, F.lit(limit)).alias("rank"), F.col("mapping").alias("evidence_id"))
    found = written(shown.select("question", "rank", "evidence_id").join(put.select("question", "rank"), ["question", "rank"], "left_anti").unionByName(put), "found")
    return questions.select("question_id", "question").join(found, "question").select("question_id", "rank", "evidence_id")


_NAMES = "CASE " + " ".join(f"WHEN {w[0]!r} THEN {w[1]!r}" for w in WORKSHOPS).replace("CASE WHEN", "CASE code WHEN") + " END"
_EVIDENCE = (
    "WITH p AS (SELECT *, 'W0' || (p_partkey % 8 + 1) AS code FROM part), e AS (SELECT 'e' || lpad(p_partkey::VARCHAR, 9, '0') AS evidence_id, 'output/Q' || lpad((p_partkey % 29 + 1)::VARCHAR, 2, '0') || '.csv' AS path, CASE WHEN p_partkey % 11 = 0 THEN "
    + _NAMES.replace("CASE WHEN", "CASE code WHEN")
    + """ END AS name, 'Q' || lpad((p_partkey % 29 + 1)::VARCHAR, 2, '0') || ' ' || p_name || CASE WHEN p_partkey % 5 = 0 OR p_partkey % 11 = 0 THEN ' ' || code ELSE '' END || CASE WHEN p_partkey % 11 = 0 THEN ' ' || """
    + _NAMES.replace("CASE WHEN", "CASE code WHEN")
    + """ ELSE '' END || CASE WHEN p_partkey % 13 = 0 THEN ' 待机' ELSE '' END || ' 2024-0' || (p_partkey % 7 + 1) || '-15' AS text FROM p),
q AS (SELECT p_partkey AS question_id, split_part(p_name, ' ', 1) || CASE WHEN p_partkey % 3 = 0 THEN ' W0' || (p_partkey // 20 % 8 + 1) ELSE '' END || CASE WHEN p_partkey % 7 = 0 THEN ' 待机 cusum' ELSE '' END || CASE WHEN p_partkey % 9 = 0 THEN ' 2024-03-15' ELSE '' END AS question FROM part WHERE p_partkey % 20 = 0),
w AS (SELECT unnest(['综合能耗', '单耗', '异常', '停产', '待机', '费用', '碳排放', '温度', '产量', 'cusum', '2sigma', '2σ', '能源结构', '同比', '环比']) AS k),
t0 AS (SELECT question_id, question, lower(unnest(regexp_extract_all(question, '[A-Za-z]+[0-9]*|W[0-9]{2}|[0-9]{4}-[0-9]{2}-[0-9]{2}'))) AS token FROM q UNION SELECT question_id, question, k FROM q, w WHERE contains(lower(question), k)),
t1 AS (SELECT DISTINCT * FROM t0 WHERE length(token) >= 2), c AS (SELECT DISTINCT question_id, question, evidence_id, path, name FROM t1 JOIN e ON regexp_matches(token, '^w[0-9]{2}$') AND contains(lower(e.text), token) AND contains(e.name, '车间')),
t2 AS (SELECT * FROM t1 UNION SELECT question_id, question, lower(name) FROM c), h AS (SELECT * FROM (VALUES ('待机', 'q13'), ('停产', 'q13'), ('单耗异常', 'q16'), ('2sigma', 'q16'), ('2σ', 'q16'), ('cusum', 'q27'), ('三种检测', 'q26'), ('碳排放', 'q21')) x(word, file)),
s AS (SELECT question_id, any_value(question) AS question, evidence_id, any_value(path) AS path, sum(CASE WHEN regexp_matches(token, '^(w[0-9]{2}|[0-9]{4}-[0-9]{2}-[0-9]{2})$') OR contains(token, '车间') THEN 4 ELSE 1 END) AS score, count(*) AS n FROM t2 JOIN e ON contains(lower(e.text), token) GROUP BY question_id, evidence_id),
r AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score + 6 * (SELECT count(*) FROM h WHERE contains(lower(question), word) AND contains(lower(path), file)) DESC, n DESC, evidence_id) AS rank FROM s QUALIFY rank <= 8),
m AS (SELECT question_id, arg_min(evidence_id, (CASE WHEN contains(path, 'Q03') THEN 0 ELSE 1 END, evidence_id)) AS mapping FROM c GROUP BY 1), x AS (SELECT question_id, mapping, max(rank) AS last FROM r JOIN m USING (question_id) GROUP BY ALL HAVING NOT bool_or(evidence_id = mapping))
SELECT question_id, rank, evidence_id FROM r WHERE (question_id, rank) NOT IN (SELECT question_id, least(last + 1, 8) FROM x) UNION ALL SELECT question_id, least(last + 1, 8), mapping FROM x"""
)


@query("m14_ranked_evidence", _EVIDENCE, "")
def m_ranked(p: Plant) -> DataFrame:
    """All parts play evidence, those with an id divisible by 20 ask."""
    part, n = p.table("part"), F.col("p_partkey")
    code = F.concat(F.lit("W0"), (n % 8 + 1).cast("string"))
    name = F.lit(None).cast("string")
    for w in WORKSHOPS:
        name = F.when(code == w[0], w[1]).otherwise(name)
    stem = F.concat(F.lit("Q"), F.lpad((n % 29 + 1).cast("string"), 2, "0"))
    also = lambda when, text: F.when(when, F.concat(F.lit(" "), text)).otherwise("")
    text = F.concat(stem, F.lit(" "), "p_name", also((n % 5 == 0) | (n % 11 == 0), code), also(n % 11 == 0, name), also(n % 13 == 0, F.lit("待机")), F.lit(" 2024-0"), (n % 7 + 1).cast("string"), F.lit("-15"))
    evidence = part.select(F.concat(F.lit("e"), F.lpad(n.cast("string"), 9, "0")).alias("evidence_id"), F.concat(F.lit("output/"), stem, F.lit(".csv")).alias("path"), text.alias("text"), F.when(n % 11 == 0, F.create_map(F.lit("name"), name)).otherwise(F.create_map(F.lit("brand"), F.col("p_brand"))).alias("values"))
    question = F.concat(F.substring_index("p_name", " ", 1), also(n % 3 == 0, F.concat(F.lit("W0"), (F.floor(n / 20) % 8 + 1).cast("string"))), also(n % 7 == 0, F.lit("待机 cusum")), also(n % 9 == 0, F.lit("2024-03-15")))
    return ranked_evidence(part.filter(n % 20 == 0).select(n.alias("question_id"), question.alias("question")), evidence)
