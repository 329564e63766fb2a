"""Spelling variants: words at one edit from each other, found by asymmetric q-chunks, and the form that each word is a variant of.

Words are maximal runs of letters of at least `LEAST` code points with at least `OCCURRENCES` occurrences. Two words are near if they differ
by exactly one inserted, deleted or replaced code point. A word's form is its near word of largest count (ties: the smallest in code-point
order), if that is at least `TIMES` times the word's own count. Counts grow along forms, so they end in a root.

Search: the shorter word x of a pair (either, if both are of one length) is cut into two disjoint chunks, its halves; one edit
leaves one of them whole. The longer word y gives its positional grams of the chunk's size. They are joined on the chunk within a
shift of one: a chunk before the edit stands at the same distance from y's start, one behind it at the same distance from its end. Grams at other places
within that shift belong to pairs whose other chunk is whole as well, so they aren't sent. Candidates are verified on the whole words.

A key that is shared by more than `MOST_PAIRS` pairs isn't joined: the edit then lies in what the chunk leaves over, which is cut into two chunks
in the same way, and so on until keys are rare or one code point is left, where the letters of the alphabet bound a key's words. No pair is lost and no
key's words are paired in bulk. Keys are 64-bit hashes; what collides fails the verification.

Null and empty texts have no words. Repeated rows count again; a null doc_id reads as empty in the hash of `runs_as_written`. Long texts are read whole. An
empty table gives no rows. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattmill.llm.common import ascii_lower, small_side, written

LEAST, OCCURRENCES, TIMES = 6, 5, 5
#: Pairs of a key above which its words are told apart by further chunks.
MOST_PAIRS = 4_096
#: One run in so many loses a letter (`runs_as_written`).
DROPS = 199
LETTERS = r"[A-Za-zÀ-ÿ]"


def runs_as_written(docs: DataFrame, least: int = LEAST, drops: int = DROPS) -> DataFrame:
    """`run`: the lower-cased runs of letters of all texts, of at least `least` code points; where crc32 of `doc_id:run` is divisible by `drops`, one code point of the run is left out, that at the hash modulo its length."""
    found = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all("text", F.lit(f"{LETTERS}{{{least},}}"), F.lit(0))).alias("run"))
    lowered = found.select("id", F.when(F.lower("run") == F.col("run"), F.col("run")).otherwise(ascii_lower(F.col("run"))).alias("run"))
    hashed = lowered.select("run", F.crc32(F.concat_ws(":", "id", "run").cast("binary")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    return hashed.select(F.when(F.col("h") % drops != 0, F.col("run")).otherwise(F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))).alias("run"))


def vocabulary(runs: DataFrame, least: int = LEAST, occurrences: int = OCCURRENCES) -> DataFrame:
    """`word` and `n` of the runs that are long and frequent enough."""
    return runs.filter(F.length("run") >= least).groupBy(F.col("run").alias("word")).agg(F.count("*").alias("n")).filter(F.col("n") >= occurrences)


def chunks(rows: DataFrame) -> DataFrame:
    """Each row twice: one half of x's rest joins its key, the other is the new rest. `size` is the length of x's rest on either side of the join."""
    half, behind = F.expr("size div 2"), F.expr("size - size div 2")
    over = F.length("rest") - behind
    part = lambda which, chunk, rest, size: F.struct(F.xxhash64("key", F.lit(which), chunk).alias("key"), rest.alias("rest"), size.cast("int").alias("size"))
    first = part(1, F.substr("rest", F.lit(1), half), F.substr("rest", half + 1), behind)
    second = part(2, F.substr("rest", over + 1), F.substr("rest", F.lit(1), over), half)
    return rows.select("side", "word", "n", F.explode(F.array(first, second)).alias("c")).select("side", "word", "n", "c.*")


def one_edit(x: Column, y: Column) -> Column:
    return F.levenshtein(x, y, 1) == 1


def near_words(words: DataFrame) -> DataFrame:
    """`word`, `n`, `other`, `other_n` for all pairs of near words of a table (word, n), in both directions."""
    length = F.length("word")
    side = lambda name, size: F.struct(F.lit(name).alias("side"), F.xxhash64(size).alias("key"), size.cast("int").alias("size"))
    sides = F.array(side("x", length), side("y", length), side("y", length - 1))
    rows = words.select("word", "n", F.col("word").alias("rest"), F.explode(sides).alias("s")).select("word", "n", "rest", "s.*")
    found = None
    while True:
        rows = written(chunks(rows), "chunks")
        counts = rows.groupBy("key").agg(F.count_if(F.col("side") == "x").alias("x"), F.count_if(F.col("side") == "y").alias("y"), F.max("size").alias("size"))
        hot = small_side(written(counts.filter((F.col("x") * F.col("y") > MOST_PAIRS) & (F.col("size") > 1)).select("key"), "hot-keys"))
        joined = rows.join(hot, "key", "left_anti")
        x = joined.filter("side = 'x'").select("key", "word", "n")
        y = joined.filter("side = 'y'").select("key", F.col("word").alias("other"), F.col("n").alias("other_n"))
        once = (F.length("word") < F.length("other")) | (F.col("word") < F.col("other"))
        pairs = written(x.join(y, "key").filter(once & one_edit(F.col("word"), F.col("other"))).drop("key").distinct(), "pairs")
        found = pairs if found is None else found.unionByName(pairs)
        rows = rows.join(hot, "key", "left_semi")
        if hot.isEmpty():
            break
    found = found.distinct()
    return found.unionByName(found.select(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n")))


def roots(forms: DataFrame) -> DataFrame:
    """`word`, `root` from (word, form): forms are followed twice as far in every round."""
    rows = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = rows.select(F.col("word").alias("root"), F.col("root").alias("next"))
        longer = written(rows.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        rows = longer.select("word", "root")
        if longer.filter("moved").isEmpty():
            return rows


def variants(words: DataFrame, times: int = TIMES) -> DataFrame:
    """One row per word of (word, n): word, form, root, n, n_near, form_n."""
    words = written(words, "words")
    best = F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("form")))
    near = written(near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best")), "near")
    told = words.join(near, "word", "left").withColumn("is_form", F.coalesce(-F.col("best.less") >= times * F.col("n"), F.lit(False)))
    told = written(told.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(F.col("is_form"), F.col("best.form")).alias("form"), F.when(F.col("is_form"), -F.col("best.less")).alias("form_n")), "forms")
    ends = roots(told.filter("form IS NOT NULL"))
    return told.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def variant_report(docs: DataFrame) -> DataFrame:
    """The variants of all words of all texts."""
    return variants(vocabulary(runs_as_written(docs)))
