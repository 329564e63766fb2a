"""Periodic runs, spelling variants and personal data against brute force and hostile tables."""

import collections
import hashlib
import itertools
import random
import re
import time
import zlib

import pytest
from pyspark.sql import functions as F

from tests.llm.test_llm import both, docs, lower, pairs, real  # noqa: F401
from wattmill.llm import pii, runs, spelling

sha = lambda t: hashlib.sha256(t.encode()).hexdigest()


def brute_runs(words):
    """All runs by trying every period at every place."""
    found, n = set(), len(words)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            length = i + q - start
            part = words[start : start + length]
            if length >= max(6, 4 * q) and not any(part[p:] == part[:-p] for p in range(1, q)):
                found.add((start, length, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def kept(words, found):
    gone = {i for s, m, q in found for i in range(s + q, s + m)}
    return [w for i, w in enumerate(words) if i not in gone]


def test_runs_of_random_words():
    random.seed(5)
    for _ in range(3000):
        size, words = random.randint(1, 4), []
        while len(words) < random.randint(0, 60):
            words += [random.choice("abcd"[:size]) for _ in range(random.randint(1, 5))] * random.randint(1, 7) if random.random() < 0.3 else [random.choice("abcdxyz")]
        coded = [w.encode() for w in words]
        found = runs.runs_of_words(coded)
        assert [tuple(r) for r in found.tolist()] == brute_runs(words)
        assert runs.collapsed(coded, found).decode().split() == kept(words, brute_runs(words))


@pytest.mark.parametrize("words", [["a"] * 5, ["a"] * 6, ["a", "b"] * 4, ["a", "b"] * 3 + ["a"], (["x"] + ["a"] * 7) * 4, ["a"] * 3000, [str(i % 700) for i in range(3000)], list("abaababaabaab" * 30)])
def test_runs_of_plain_cases(words):
    assert [tuple(r) for r in runs.runs_of_words([w.encode() for w in words]).tolist()] == brute_runs(words)


@pytest.mark.parametrize("rounds", [0, 1, 24])
def test_runs_with_any_number_of_rounds(rounds, monkeypatch):
    monkeypatch.setattr(runs, "ROUNDS", rounds)
    words = (["the", "cat"] * 5 + [str(i) for i in range(40)] + ["so", "on", "and"] * 4) * 2
    assert [tuple(r) for r in runs.runs_of_words([w.encode() for w in words]).tolist()] == brute_runs(words)


def brute_run_row(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = (zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1), len(words)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    found = brute_runs(words)
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    told = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(found), *told, sha("".join(f"{s},{m},{q}\n" for s, m, q in found)), sha(" ".join(kept(words, found))), n)


def test_run_report(both):  # noqa: F811
    short = both.filter("text IS NULL OR length(text) < 6000")  # brute force is quadratic
    got = [tuple(r) for r in runs.run_report(runs.with_repeats(short)).collect()]
    assert sorted(map(str, got)) == sorted(str(brute_run_row(i, t)) for i, t in pairs(short))
    assert runs.run_report(runs.with_repeats(both)).count() == both.count()


def test_runs_keep_their_texts(spark):
    rows = spark.createDataFrame([(1, "x  no no no no no no\ty"), (2, None)], "doc_id long, text string")
    found = {r.doc_id: r for r in runs.periodic_runs(rows).collect()}
    assert found[1].collapsed == "x no y" and [tuple(r) for r in found[1].runs] == [(1, 6, 1)] and found[2].collapsed == "" and found[2].n_words == 0
    assert runs.run_report(rows.limit(0)).count() == 0


def brute_variants(rows):
    counts = collections.Counter()
    for i, text in rows:
        for run in map(lower, re.findall(r"[A-Za-zÀ-ÿ]+", text or "")):
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            at = h % len(run)
            counts[run[:at] + run[at + 1 :] if h % 199 == 0 else run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    less = collections.defaultdict(set)
    for w in words:
        for k in range(len(w) + 1):
            less[w[:k] + w[k + 1 :]].add(w)
    near = collections.defaultdict(set)
    for group in less.values():
        for a, b in itertools.permutations(group, 2):
            x, y = sorted((a, b), key=len)
            k = next((i for i in range(len(x)) if x[i] != y[i]), len(x))
            if len(y) - len(x) <= 1 and (x[k + 1 :] == y[k + 1 :] if len(x) == len(y) else x[k:] == y[k + 1 :]):
                near[a].add(b)
    best = {w: min(near[w], key=lambda o: (-words[o], o)) for w in words if near[w]}
    form = {w: f for w, f in best.items() if words[f] >= 5 * words[w]}
    result = []
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        result.append((w, form.get(w), root, n, len(near[w]), words[form[w]] if w in form else None))
    return result


VARIANTS = [
    ("colours", 625), ("coulors", 5), ("colour", 100), ("colourss", 25), ("colorss", 5), ("colores", 6), ("mañana", 30), ("manana", 6), ("mañanas", 6), ("ÀÀÀÀÀÀ", 5), ("ààÀÀÀÀ", 5), ("shortt", 4), ("abcde", 90), ("abcdef", 5), ("abcdeg", 25), ("abcdeh", 25), ("abcdehg", 5), ("x" * 300, 5), ("x" * 299 + "y", 25), ("x" * 301, 5),
]


@pytest.mark.parametrize("most", [4_096, 1])
def test_variants(spark, both, most, monkeypatch):  # noqa: F811
    """With keys of all sizes joined, and with nearly all cut further."""
    monkeypatch.setattr(spelling, "MOST_PAIRS", most)
    planted = spark.createDataFrame([(900 + i, " ".join([w] * n)) for i, (w, n) in enumerate(VARIANTS)], "doc_id long, text string")
    rows = both.select("doc_id", "text").unionByName(planted)
    got = [tuple(r) for r in spelling.variant_report(rows).collect()]
    expected = brute_variants(pairs(rows))
    assert sorted(map(str, got)) == sorted(map(str, expected))
    roots = {w: r for w, _, r, *_ in expected}
    assert roots["colourss"] == "colours" and roots["abcdef"] == "abcdeg"


def test_variants_of_a_shared_stem(spark):
    """Thousands of words with one first half: pairs are found, the stem's words aren't paired in bulk."""
    words = spark.range(1000).select(F.concat(F.lit("stemstem"), F.translate(F.lpad("id", 8, "0"), "0123456789", "abcdefghij")).alias("word"), (F.col("id") % 7 + 5).alias("n"))
    got = spelling.near_words(words).groupBy("word").count().collect()
    digits = [f"{i:08d}" for i in range(1000)]
    expected = {d: sum(d[:k] + c + d[k + 1 :] in set(digits) for k in range(8) for c in "0123456789" if c != d[k]) for d in digits[::100]}
    found = {r.word[8:].translate(str.maketrans("abcdefghij", "0123456789")): r["count"] for r in got}
    assert {d: found[d] for d in expected} == expected


def test_no_variants(spark):
    empty = spark.createDataFrame([(1, None), (2, ""), (3, "few words")], "doc_id long, text string")
    assert spelling.variant_report(empty).count() == 0 and spelling.variant_report(empty.limit(0)).count() == 0


KIND_PATTERNS = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    return sum(d if i % 2 == 0 else d * 2 // 10 + d * 2 % 10 for i, d in enumerate(map(int, digits[::-1]))) % 10 == 0


def brute_spans(text):
    found = []
    for kind, pattern in enumerate(KIND_PATTERNS):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if (True, kind == 1 and all(int(x) <= 255 for x in m[0].split(".")), 13 <= len(digits) <= 19 and kind == 2 and luhn(digits), 9 <= len(digits) <= 15)[kind]:
                found.append((kind, *m.span()))
    return found


def test_base_spans_of_random_texts():
    random.seed(2)
    for _ in range(30_000):
        text = "".join(random.choice("ab1 2.@+-(0.@5") for _ in range(random.randint(0, 40)))
        assert [s[:3] for s in pii.spans(text) if not s[3]] == brute_spans(text)


DISGUISED = {
    "mail john [at] example [dot] com now": "email john [at] example [dot] com", "john.doe(at)mail7(dot)example(dot)com": "email john.doe(at)mail7(dot)example(dot)com", "write john at mail dot example dot org today": "email john at mail dot example dot org",
    "jоhn@exаmple.com": "email jоhn@exаmple.com", "ｊｏｈｎ＠ｅｘａｍｐｌｅ．ｃｏｍ x": "email ｊｏｈｎ＠ｅｘａｍｐｌｅ．ｃｏｍ", "jo\u200bhn@example.com": "email jo\u200bhn@example.com", "john @ example . com x": "email john @ example . com",
    "john&#64;example&#46;com": "email john&#64;example&#46;com", "JOHN AT EXAMPLE DOT COM": "email JOHN AT EXAMPLE DOT COM", "é 𝟒 a b x＠y.de": "email x＠y.de", "call plus one five five five two three four eight seven six five ok": "phone plus one five five five two three four eight seven six five",
    "+٤٤ ٢٠ ٧٩٤٦ ٠٩٥٨ x": "phone +٤٤ ٢٠ ٧٩٤٦ ٠٩٥٨", "ip one nine two dot one six eight dot zero dot one.": "ip one nine two dot one six eight dot zero dot one", "ip 192 [dot] 168 [dot] 0 [dot] 1 x": "ip 192 [dot] 168 [dot] 0 [dot] 1",
    "card 4111 1111 1111 one one one one": "card 4111 1111 1111 one one one one", "𝟒𝟏𝟏𝟏 𝟏𝟏𝟏𝟏 𝟏𝟏𝟏𝟏 𝟏𝟏𝟏𝟏": "card 𝟒𝟏𝟏𝟏 𝟏𝟏𝟏𝟏 𝟏𝟏𝟏𝟏 𝟏𝟏𝟏𝟏",
}
CLEAN = ["see you at home. dot dot", "it is at of and dot the end", "one two three four five six seven eight nine", "look at this", "Привет, мир. Как дела", "at 5 or at 10.30", "a [dot] b", "un deux trois", "we met at example.com and left", "+1 one", "version 1.2.3 dot four"]


@pytest.mark.parametrize("text", DISGUISED)
def test_disguised(text):
    added = [f"{pii.KINDS[k]} {text[a:b]}" for k, a, b, new in pii.spans(text) if new]
    assert added == [DISGUISED[text]]


@pytest.mark.parametrize("text", CLEAN)
def test_clean_texts_stay(text):
    assert [s for s in pii.spans(text) if s[3]] == []


def test_spans_in_the_midst_of_texts():
    for text, told in DISGUISED.items():
        kind, value = told.split(" ", 1)
        before = "ünd 𝟘 wörds, x " * 50
        a = len(before) + text.index(value)
        assert (pii.KINDS.index(kind), a, a + len(value), True) in pii.spans(before + text + " and more words" * 20)


@pytest.mark.parametrize("text", ["a" * 200_000, "1" * 200_000, "1." * 100_000, "+1" + " " * 200_000, "a@" * 100_000, "one " * 50_000, "plus " * 50_000, " at a" * 50_000, " dot " * 50_000, "(at)" * 50_000, "​" * 100_000, "a at b dot " * 30_000, "x at " + "a dot " * 50_000, " " * 200_000, "[ " * 100_000])
def test_long_texts_take_time_in_proportion(text):
    began = time.time()
    pii.spans(text)
    assert time.time() - began < 10


def test_pii_report(both):  # noqa: F811
    got = {(r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in pii.pii_report(both).collect()}
    expected = set()
    for i, text in pairs(both):
        found = brute_spans(text)
        expected.add((i, *(sum(k == kind for k, *_ in found) for kind in range(4)), sha(",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in found))))
    assert got == expected and pii.pii_report(both).count() == both.count() and pii.pii_report(both.limit(0)).count() == 0


def test_values_are_the_texts_own(spark):
    rows = spark.createDataFrame([(1, "to jоhn [at] example.com and +1 (524) 555-5024")], "doc_id long, text string")
    assert {s.value for s in pii.personal_data(rows).first().spans} == {"jоhn [at] example.com", "+1 (524) 555-5024"}
