"""The training-data operators against brute force, round trips and hostile tables."""

import base64
import collections
import hashlib
import itertools
import math
import re
import zlib

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from tests.conftest import DATA, same
from wattmill.llm import chat, common, decontaminate, langid, licenses, lm, mixing, quality, simhash, urls, warc
from wattmill.llm import queries as llm_queries

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD, RUN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"word{i % 4000}" for i in range(30_000))
PASSAGE = "the quick brown fox jumps over the lazy dog while seven wizards make toxic brew for the queen"
HOSTILE = [
    (1, None, "en", "src1", None), (2, "", "en", None, 0), (3, "   \n\t ", None, "src2", 5), (4, "one", "en", "src1", 3), (5, LONG, "en", "src1", 9), (6, PASSAGE, "en", "src2", 9), (6, PASSAGE, "en", "src2", 9), (7, PASSAGE + " x", "de", "src3", 9),
    (8, "Ünï cödé ＭＩＴ license MIT License; apache LICENSE", None, "src3", 9), (9, "a b c d e a b c d e f g h i j k", "fr", "src4", 9), (10, "1234 5678 !!", "en", "src5", 9), (None, "null id text of some words", "en", "src6", 9), (11, "Apache License and GNU General Public License\nline\nline\n", "es", "x", 1),
]


def lower(text: str) -> str:
    return (text or "").translate({i: i + 32 for i in range(65, 91)})


@pytest.fixture(scope="module")
def docs(spark):
    common.ship(spark)
    rows = spark.createDataFrame(HOSTILE, SCHEMA)
    for extra in ("n_words", "score", "key", "hash", "row", "label", "_h"):  # names that operators use themselves
        rows = rows.withColumn(extra, F.lit("x"))
    return rows


@pytest.fixture(scope="module")
def real(spark):
    common.ship(spark)
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="module", params=["hostile", "real"])
def both(request, docs, real):
    return docs if request.param == "hostile" else real


def pairs(frame):
    return [(r.doc_id, r.text) for r in frame.select("doc_id", "text").collect()]


def check(got, expected) -> None:
    assert sorted(map(str, got)) == sorted(map(str, expected))


def contamination(text, windows):
    words, hit, items = WORD.findall(lower(text)), set(), set()
    for size in {len(w) for w in windows}:
        for a in range(len(words) - size + 1):
            if (w := tuple(words[a : a + size])) in windows:
                hit.update(range(a, a + size))
                items |= windows[w]
    return len(words), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(words)


@pytest.mark.parametrize("slots, broadcast", [(decontaminate.SLOTS, 100_000), (8, 0)])
def test_contamination(spark, both, slots, broadcast, monkeypatch):
    """With and without what tells places apart before the join, and with broadcasts and shuffles."""
    monkeypatch.setattr(common.small_side, "__defaults__", (broadcast,))
    items = spark.createDataFrame([(1, PASSAGE), (2, "null id text"), (3, None), (4, ""), (5, "ONE"), (1, PASSAGE), (77, "word1 word2 word3 word4")], "item_id long, text string")
    windows = collections.defaultdict(set)
    for i, t in [(r.item_id, r.text) for r in items.collect()]:
        w = WORD.findall(lower(t))
        for a in range(max(1, len(w) - 12) if w else 0):
            windows[tuple(w[a : a + 13])].add(str(i))
    got = decontaminate.contamination_report(both, items, slots).collect()
    check([tuple(r) for r in got], [(i, *contamination(t, windows)) for i, t in pairs(both)])
    kept = decontaminate.clean(both, items, slots)
    assert kept.columns == both.columns and kept.count() == sum(not r.contaminated for r in got)


def test_contamination_without_items(spark, docs):
    got = decontaminate.contamination_report(docs, spark.createDataFrame([], "item_id long, text string")).collect()
    assert len(got) == len(HOSTILE) and not any(r.contaminated for r in got)


def test_contamination_rests_on_words_not_on_keys(spark):
    """Places of one key: those with other words behind it, or with a longer word at the end, aren't found."""
    wanted = spark.createDataFrame([("a b c d", 4, 0, 7), ("a b c d", 4, 1, 8)], "window string, size int, offset int, key long")
    rows = [(row, 5, at, key, " ".join(words.split()[at:])) for row, words in enumerate(["a b c d e", "a b c x e", "a b c de f"]) for at, key in ((0, 7), (1, 8))]
    places = spark.createDataFrame(rows, "row long, n_words long, pos int, key long, words string")
    assert [tuple(r) for r in decontaminate.occurrences(places, wanted).collect()] == [(0, 0, 4, "a b c d")]


def test_contamination_table_grows_with_the_benchmark(spark):
    sized = lambda n: decontaminate.slots_for(spark.range(n).select(F.col("id").alias("key")))
    assert sized(0) == sized(1_000) == decontaminate.SLOTS and sized(300_000) == 1 << 25 and sized(5_000_000) == decontaminate.MOST_SLOTS


def brute_fingerprint(text) -> int:
    words = RUN.findall(lower(text))
    grams = [" ".join(words[a : a + 4]) for a in range(len(words) - 3)] if len(words) >= 4 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(nodes: dict) -> dict:
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = list(nodes)
    prints = np.array([nodes[k] for k in keys], np.uint64)
    for n, k in enumerate(keys):
        for m in np.flatnonzero(np.bitwise_count(prints ^ prints[n]) <= 4):
            a, b = sorted((root(k), root(keys[m])))
            parent[b] = a
    return {n: root(n) for n in nodes}


def test_near_duplicates(both):
    texts = pairs(both)
    prints = {i: brute_fingerprint(t) for i, t in texts if i is not None}
    named = brute_components(prints)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.duplicate_report(both).collect() if r.doc_id is not None}
    assert got == {i: (f"{prints[i]:016x}", named[i]) for i in prints}
    kept = simhash.keep_one(both)
    assert kept.columns == both.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(i for i in prints if named[i] == i)


def test_golay_keys_lose_no_link():
    """Any two fingerprints at 4 or fewer bits share a key; codewords have the perfect code's distances."""
    rng = np.random.default_rng(1)
    words = rng.integers(0, 2**23, 2000)
    near = simhash.nearby_codewords(words)
    assert set(np.unique((near >= 0).sum(1))) == {1, 6}
    rows = [simhash.GENERATOR << b for b in range(12)]
    codewords = np.array(sorted({int(np.bitwise_xor.reduce([0, *(r for b, r in enumerate(rows) if n >> b & 1)])) for n in range(1 << 12)}))
    assert len(codewords) == len({int(c) >> 11 for c in codewords}) == 4096 and min(int(c).bit_count() for c in codewords[1:]) == 7
    for w, own in zip(words[:50].tolist(), near[:50].tolist()):
        assert sorted(x for x in own if x >= 0) == sorted(int(c) >> 11 for c in codewords if int(c ^ w).bit_count() <= 4)
    base = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    other = base.copy()
    for n in range(len(other)):
        for b in rng.choice(64, rng.integers(0, 5), replace=False):
            other[n] ^= np.uint64(1) << np.uint64(b)
    def keys(x):
        places, k = simhash.joint_keys(x)
        out = collections.defaultdict(set)
        for p, v in zip(places.tolist(), k.tolist()):
            out[p].add(v)
        return out
    a, b = keys(base), keys(other)
    assert all(a[n] & b[n] for n in range(len(base)))


def test_components_of_chains(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in simhash.components(links).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {101: 100}


def test_quality_measures(both):
    expected = []
    for i, t in pairs(both):
        t = t or ""
        w = RUN.findall(t)
        grams = [tuple(w[a : a + 5]) for a in range(len(w) - 4)]
        n, rep = collections.Counter(grams), set()
        for a, g in enumerate(grams):
            if n[g] > 1:
                rep.update(range(a, a + 5))
        lines = [x for x in t.split("\n") if RUN.search(x)]
        expected.append((i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(rep), len(w) < 10 or 100 * len(rep) > 20 * len(w)))
    got = quality.quality_report(both).collect()
    check([tuple(r)[:7] for r in got], expected)
    assert not any(r.kept and r.base_failed for r in got)
    kept = quality.keep_good(both)
    assert kept.columns == both.columns and kept.count() == sum(r.kept for r in got)


def test_license_places(both):
    expected = []
    for i, t in pairs(both):
        w, starts, labels = WORD.findall(lower(t)), [], set()
        for phrase, name in licenses.PHRASES:
            q = phrase.split()
            for a in range(len(w) - len(q) + 1):
                if w[a : a + len(q)] == q:
                    starts.append(a)
                    labels.add(name)
        expected.append((i, len(w), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))))
    check([tuple(r)[:6] for r in licenses.license_scan(both).collect()], expected)


def test_license_passages_with_edits(spark):
    text = licenses.PASSAGES[1][0].split()
    edited = " ".join(["lead", "in", *text[:6], "inserted", *text[6:], "tail"])
    row = licenses.license_scan(spark.createDataFrame([(1, edited), (2, "source and binary")], "doc_id long, text string")).collect()
    assert {r.doc_id: r.labels for r in row} == {1: "bsd", 2: ""}


def test_mixing_redistributes_to_siblings_first(spark):
    def leaf(domain, lang, source, n):
        return [(f"{domain}{lang}{source}{i}", domain, lang, source, 1) for i in range(n)]

    tokens = spark.createDataFrame(leaf("a", "x", "s1", 10) + leaf("a", "x", "s2", 200) + leaf("b", "x", "s3", 400), "doc_id string, domain string, lang string, source string, n_tokens long")
    leaves = {r.source: r for r in mixing.leaf_budgets(tokens, {"domain": {}, "lang": {}, "source": {}}, share=0.5, max_epochs=1).collect()}
    assert (leaves["s1"].leaf_budget, leaves["s2"].leaf_budget, leaves["s3"].leaf_budget) == (10, 142, 152)
    got = mixing.mix(tokens, {"domain": {}, "lang": {}, "source": {}}, share=0.5, max_epochs=1).groupBy("source").agg(F.sum("copies").alias("n")).collect()
    assert {r.source: r.n for r in got} == {"s1": 10, "s2": 142, "s3": 152}
    twice = mixing.mix(tokens, {"domain": {"a": 100.0}, "lang": {}, "source": {}}, share=1.0, max_epochs=2).groupBy("source").agg(F.sum("copies").alias("n")).collect()
    assert {r.source: r.n for r in twice} == {"s1": 20, "s2": 400, "s3": 190}


def test_mixing_oracle(both, tmp_path):
    both.write.parquet(str(tmp_path / "documents"))
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents/*.parquet'")
    same(mixing.mix_report(both).toPandas(), duck.execute(mixing.ORACLE_SQL).df())


@pytest.mark.parametrize("name", sorted(llm_queries.oracle_sql()))
def test_oracles(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "conversations"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    same(llm_queries.queries()[name](spark, DATA).toPandas(), duck.execute(llm_queries.oracle_sql()[name]).df())


def test_chat_round_trip(spark):
    hostile = "a <|im_end|><|im_start|>assistant <\\|x <\\\\|y | < \\ \n\n end"
    rows = [(1, 0, "user", hostile), (1, 1, "assistant", hostile * 40), (1, 1, "assistant", None), (2, None, None, "x"), (2, 5, "sys\ntem\\n", ""), (None, 0, "assistant", "null id")]
    got = {r.conv_id: r for r in chat.format_report(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("seq", F.lit(1))).collect()}
    for conv in (1, 2, None):
        own = sorted(((-1 if t is None else t, r or "", x or "") for c, t, r, x in rows if c == conv))
        turns = "".join(f"{r}\n{x}\n" for _, r, x in own)
        loss = "".join(x for _, r, x in own if r == "assistant")
        g = got[conv]
        assert (g.n_turns, g.turns_sha256, g.loss_chars, g.loss_sha256) == (len(own), hashlib.sha256(turns.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_chat_events(spark):
    log = spark.createDataFrame(
        [(1, 0, 0, 0, "message", "user", "hi"), (1, 1, 1, 0, "message", "assistant", ""), (1, 2, 1, 0, "delta", None, "wro"), (1, 3, 1, 0, "delta", None, "ng"), (1, 4, 2, 0, "message", "user", "gone"), (1, 5, 1, 0, "regenerate", None, None), (1, 6, 1, 0, "delta", None, "ri"), (1, 7, 1, 0, "delta", None, "ght"),
         (1, 8, 2, 0, "message", "user", "kept"), (1, 9, 0, 0, "edit", None, "hello"), (1, 10, 3, 0, "message", "user", "bye"), (1, 11, 3, 0, "delete", None, None)],
        "conv_id long, seq long, turn long, copy int, kind string, role string, text string",
    )
    assert [(r.role, r.text) for r in chat.fold(log).orderBy("turn").collect()] == [("user", "hello"), ("assistant", "right"), ("user", "kept")]


def test_archive_round_trip(spark):
    big = "é" * 700_000
    rows = [(5, "http://a/", "same"), (3, None, "same"), (9, "http://b/", None), (8, "http://c/\r\nX: y", ""), (1, "u", big), (2, "u", big), (4, "v", "WARC/1.1\r\n\r\n\r\n"), (4, "v", "WARC/1.1\r\n\r\n\r\n"), (None, "w", "same")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1))
    got = sorted(map(str, (tuple(r) for r in warc.archive_report(pages).collect())))
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    expected = []
    for i, _, h in rows:
        b, f = (h or "").encode(), first[h or ""]
        expected.append(str((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if f == i else "revisit", None if f == i else f)))
    assert got == sorted(expected)


def test_url_rules(spark):
    rows = ["http://com/en/x", "https://EXAMPLE.com/en/7?x", "https://a.example.com/en/71", "http://notexample.com/en/7", "http://x.example.net/de/8#a", "http://xcom/en/", None, "no scheme", "http://", "a://b://c/d", "http://org?/es/", "http://q.org/es/1"]
    pages = spark.createDataFrame(list(enumerate(rows)), "page_id long, url string")
    got = {r.page_id: (r.host, r.path, r.rule) for r in urls.judge(pages).collect()}
    assert got[0] == ("com", "/en/x", "com/en/") and got[1] == ("example.com", "/en/7", "example.com/en/7") and got[2][2] == "example.com/en/7" and got[3][2] == "com/en/"
    assert got[4] == ("x.example.net", "/de/8", "example.net/de/8") and got[5][2] is None and got[6] == got[7] == ("", "", None) and got[8] == ("", "", None)
    assert got[9] == ("b:", "//c/d", None) and got[10] == ("org", "", None) and got[11][2] == "org/es/"
    many = [("block", f"h{i}.com/p") for i in range(urls.COMPILED_RULES)] + list(urls.RULES)
    frame = urls.parts(pages)
    same(urls.apply_rules(frame, many).toPandas().fillna("~"), urls.apply_rules(frame).toPandas().fillna("~"))


def test_language_accuracy_and_hostile_rows(real, docs):
    truth = {r.doc_id: r.lang for r in real.collect()}
    got = langid.language_report(real).collect()
    held = [r for r in got if r.held_out]
    assert len(got) == len(truth) and all((zlib.crc32(str(r.doc_id).encode()) % 5 == 0) == r.held_out for r in got)
    assert sum(truth[r.doc_id] == r.lang_pred for r in held) >= 0.95 * len(held)
    rows = {r.doc_id: r for r in langid.language_report(docs).collect()}
    assert all(rows[i].lang_pred == "und" and rows[i].score == 0 for i in (1, 2, 3, 10)) and all(0 <= r.score <= 1 for r in rows.values())
    assert langid.keep_known(docs).columns == docs.columns


def test_language_of_switched_words(real):
    model = langid.fit(real)
    by = {r.lang: r.text for r in real.filter("n_chars > 800").collect()}
    langs = sorted(by)[:2]
    text = " ".join(" ".join(by[x].split()[:60]) for x in langs)
    spans = langid.label(real.limit(1).select(F.lit(1).alias("doc_id"), F.lit(text).alias("text")), model, spans=True).first()._l_spans
    assert [s.lang for s in spans if s.last - s.first > 20] == langs


def test_language_without_labels(spark):
    rows = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert langid.language_report(rows).first().lang_pred == "und"


def test_language_model(both):
    texts = pairs(both)
    tokens = [(i, (t or "").encode().lower().split() + [None]) for i, t in texts]
    train = [w for i, w in tokens if zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2]
    counts = collections.Counter(x for w in train for x in w)
    n, v = sum(counts.values()), len(counts)
    expected = sorted(((-1 if i is None else i), len(w), sum(counts[x] > 0 for x in w), n, sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w)) for i, w in tokens)
    got = sorted(((-1 if r.doc_id is None else r.doc_id), r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in lm.fit_and_score(both).collect())
    assert [g[:4] for g in got] == [e[:4] for e in expected]
    assert all(abs(g[4] - e[4]) < 1e-6 * max(1, abs(e[4])) and g[5] < 0 for g, e in zip(got, expected))


def brute_katz(train, scored):
    """Katz over all word pairs, by dictionaries: scores of token lists, and the probability function."""
    cut = lm.CUT
    uni = collections.Counter(x for w in train for x in w)
    pair = collections.Counter(p for w in train for p in zip([None, *w[:-1]], w))
    total = sum(uni.values())
    du, dp = (lm.discounts(collections.Counter(c.values())) for c in (uni, pair))
    d = lambda f, r: f[r] * r if r <= cut else r
    scale, unseen = lm.scaled(sum(d(du, r) for r in uni.values()) / total, total)
    p1 = lambda x: scale * d(du, uni[x]) / total if uni[x] else unseen
    followers = collections.defaultdict(list)
    for (v, x), r in pair.items():
        followers[v].append((x, r))
    context = {}
    for v, own in followers.items():
        n = sum(r for _, r in own)
        s, left = lm.scaled(sum(d(dp, r) for _, r in own) / n, n)
        context[v] = n, s, left / (1 - math.fsum(p1(x) for x, _ in own))

    def p2(v, x):
        n, s, back = context.get(v, (0, 0, 1))
        return s * d(dp, pair[v, x]) / n if pair[v, x] else back * p1(x)

    return [sum(math.log10(p2(v, x)) for v, x in zip([None, *w[:-1]], w)) for w in scored], p2, uni


@pytest.mark.parametrize("sizes", [{}, {"lexicon_size": 50, "hot_words": 20, "bucket_tokens": 3_000, "near_words": 400}, {"lexicon_size": 1, "hot_words": 1, "bucket_tokens": 300, "near_words": 0}, {"lexicon_size": 0, "hot_words": 0, "bucket_tokens": 50_000}])
def test_language_model_counts_every_pair(both, sizes):
    """Scores are those of Katz over all word pairs, whatever is sent to the tasks."""
    apart = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    tokens = [(i, (t or "").encode().lower().split() + [None]) for i, t in pairs(both)]
    scores, p2, uni = brute_katz([w for i, w in tokens if not apart(i)], [w for _, w in tokens])
    expected = sorted(((-1 if i is None else i), len(w), s) for (i, w), s in zip(tokens, scores))
    if sizes:
        docs = both.select("doc_id", "text", (common.crc_mod(F.col("doc_id"), 7) == 2).alias("apart"))
        rows = lm.katz_score(lm.katz(docs, **sizes)).collect()
    else:
        rows = lm.fit_and_score(both).collect()
    got = sorted(((-1 if r.doc_id is None else r.doc_id), r.n_tokens, r.score) for r in rows)
    assert len(got) == len(expected) and any(apart(i) for i, _ in tokens)
    assert all(g[:2] == e[:2] and abs(g[2] - e[2]) < 1e-6 * max(1, abs(e[2])) for g, e in zip(got, expected))
    for v in (None, uni.most_common(2)[1][0], min(x for x in uni if x and uni[x] == 1)):  # brute force itself adds up to 1
        assert abs(math.fsum(p2(v, x) for x in [*uni, b"no such word"]) - 1) < 1e-9


def test_language_model_is_normalised(real):
    """Each context's seen pairs and what its backoff weight gives to all other words add up to 1; so do the unigrams."""
    docs = real.select("doc_id", "text", F.lit(False).alias("apart"))
    model = lm.katz(docs, lexicon_size=300, hot_words=30, bucket_tokens=20_000)
    tokens = [(t or "").encode().lower().split() + [None] for _, t in pairs(real)]
    uni, pair = collections.Counter(x for w in tokens for x in w), collections.Counter(p for w in tokens for p in zip([None, *w[:-1]], w))
    p = dict(zip(uni, model.unigrams.probability(np.array(list(uni.values())))))
    assert abs(math.fsum(p.values()) + model.unigrams.unseen - 1) < 1e-9
    rows = {r.hash: r for r in model.contexts.collect()}
    number = lambda x: np.uint64(xxhash.xxh64_intdigest(x or b"", 42)).view(np.int64).item()
    followers = collections.defaultdict(list)
    for (v, x), n in pair.items():
        followers[v].append((x, n))
    assert len(rows) == len(followers)
    for v, own in followers.items():
        r = rows[number(v)]
        seen = math.fsum(10**r.scale * model.factors[min(n, lm.CUT + 1)] * n / r.n for _, n in own)
        assert r.n == uni[v] and abs(seen + 10**r.back * (1 - math.fsum(p[x] for x, _ in own)) - 1) < 1e-9


def test_packed_arrays_come_back():
    arrays = [np.array([], np.int64), np.array([0, 1, 255]), np.array([-5, 1 << 40]), np.array([1.5, -2.0]), np.array([70_000, 2])]
    assert all(np.array_equal(a, b) for a, b in zip(arrays, lm.unpacked(lm.packed(*arrays)), strict=True))


@pytest.mark.parametrize("name", sorted(llm_queries.queries()))
def test_empty_tables(spark, tmp_path, name):
    for t, schema in (("documents", SCHEMA), ("pages", "page_id long, url string, html string"), ("conversations", "conv_id long, turn long, role string, text string"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(str(tmp_path / f"{t}.parquet"))
    assert llm_queries.queries()[name](spark, str(tmp_path)).count() == (1 if name.startswith("op4_") else 0)


def test_pipeline(spark, real):
    docs, sizes = real, []
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        kept = stage(spark, docs, DATA)
        assert n == len(corpus_pipeline.STAGES) - 1 or kept.columns == real.columns
        docs = common.written(kept, "stage")
        sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0
    same(docs.toPandas(), corpus_pipeline.run(spark, DATA).toPandas())


@pytest.mark.parametrize("copies", [1, 2, 3, 4, 40])
def test_license_of_repeated_text(spark, copies):
    got = licenses.license_scan(spark.createDataFrame([(1, "all rights reserved\n" * copies)], "doc_id long, text string")).first()
    assert got.labels == "proprietary" and got.score == 1.0 and got.base_labels == ""


def test_long_line_alone_rejects_nothing(spark):
    text = " ".join(f"the word{i} and" for i in range(40_000))
    frame = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert quality.quality_report(frame).first().kept and quality.keep_good(frame).count() == 1


CLASHING = ("_l_lang", "_l_score", "_d_words", "_d_hit", "_q_w", "_q_kept", "_s_n", "_s_fp", "in0", "n", "b`t", "dot.ted")


@pytest.mark.parametrize("stage", [langid.keep_known, quality.keep_good, simhash.keep_one, lambda d: decontaminate.clean(d, d.sparkSession.createDataFrame([(1, PASSAGE)], "item_id long, text string"))])
def test_clashing_names_come_back(docs, real, stage):
    frame = docs.unionByName(real.limit(40), allowMissingColumns=True)
    for name in CLASHING:
        frame = frame.withColumn(name, F.concat(F.lit(name), F.coalesce(F.col("doc_id").cast("string"), F.lit("~"))))
    kept = stage(frame)
    rows = kept.collect()
    assert kept.columns == frame.columns and rows
    assert all(r[name] == name + str("~" if r.doc_id is None else r.doc_id) for r in rows for name in CLASHING)


@pytest.mark.parametrize("text", ["all rights all rights", "licensed under licensed under", "rights reserved all rights", "cc by licensed under", "mit x license"])
def test_license_verification_refuses(spark, text):
    row = licenses.license_scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (row.labels, row.base_labels, row.score, row.n_base) == ("", "", 0.0, 0)


def test_license_oracle_on_hostile_texts(docs, tmp_path):
    spark = docs.sparkSession
    passage = licenses.PASSAGES[0][0].split()
    more = [" ".join(passage[:8] + ["odd"] + passage[8:]), " ".join(passage[10:] + passage[:10]), "all rights reserved " * 4, "all rights all rights reserved", " ".join(passage * 3), "mit license mit license"]
    frame = docs.select("doc_id", "text").distinct().unionByName(spark.createDataFrame([(100 + i, t) for i, t in enumerate(more)], "doc_id long, text string"))
    frame.write.parquet(str(tmp_path / "documents"))
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents/*.parquet'")
    same(licenses.license_scan(frame).toPandas(), duck.execute(licenses.ORACLE_SQL).df())


def test_license_template_table(spark, docs, monkeypatch):
    """A table of one's own, and tables too large to be compiled, give the same places."""
    own = licenses.default_templates(spark).unionByName(spark.createDataFrame([(99, "lone", False, "word"), (98, "fox", False, "quick brown fox jumps over")], "template int, label string, base boolean, text string"))
    small = licenses.license_scan(docs, own).toPandas()
    assert "fox" in set(small.labels)
    monkeypatch.setattr(licenses, "COMPILED_PAIRS", 0)
    monkeypatch.setattr(licenses, "BROADCAST_PAIRS", 0)
    same(licenses.license_scan(docs, own).toPandas(), small)


def test_url_rules_tie_alike_in_both_forms(spark):
    pages = spark.createDataFrame([(1, "http://b.a.com/xy"), (2, "http://a.com/xyz"), (3, "http://c.b.a.com/xy?q")], "page_id long, url string")
    tied = [("block", "a.com/xy"), ("allow", "b.a.com/")]
    many = tied + [("block", f"h{i}.com/p") for i in range(urls.COMPILED_RULES)]
    few, lots = ({r.page_id: (r.rule, r.ruled) for r in urls.apply_rules(urls.parts(pages), rules).collect()} for rules in (tied, many))
    assert few == lots == {1: ("a.com/xy", "block"), 2: ("a.com/xy", "block"), 3: ("a.com/xy", "block")}


def brute_url(url):
    url = url or ""
    rest = url.split("://", 1)[1] if "://" in url else ""
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0] if "://" in url else ""
    host, best = lower(host), None
    for verdict, rule in urls.RULES:
        h, p = rule.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[0])):
            best = rule, verdict
    return host, path, best


def test_url_parts_against_brute_force(spark):
    real = spark.read.parquet(f"{DATA}/pages.parquet").select("page_id", "url")
    longest = "https://Sub.Example.COM/en/7" + "x" * 50_000 + "?q=1#f"
    odd = spark.createDataFrame([(-1, None), (-2, ""), (-3, longest), (-3, longest), (-4, "a://b?c://d/e"), (-5, "://x.net/de/"), (-6, "http://h#/p\nq")], "page_id long, url string")
    frame = real.unionByName(odd).withColumns({"host": F.lit("x"), "rule": F.lit("y"), "_r": F.lit(1)})
    for r in urls.judge(frame).join(frame.select("page_id", "url").distinct(), "page_id").collect():
        host, path, best = brute_url(r.url)
        assert (r.host, r.path, r.rule) == (host, path, best and best[0]) and r.verdict in ("allow", "block") and (best is None or r.verdict == best[1])


def test_url_trees_predict_labels_they_did_not_see(spark):
    """Trees fitted on two thirds of the labelled URLs tell the others' labels better than the more frequent label does."""
    shaped = spark.range(900).select(F.col("id").alias("page_id"), F.when(F.col("id") % 3 == 0, F.format_string("http://a%d.com/en/p?x=%d&y=12345&z=%d", "id", "id", "id")).otherwise(F.format_string("http://b%d.net/de/page", "id")).alias("url"))
    frame = urls.with_suffix_statistics(urls.lexical(urls.apply_rules(urls.parts(shaped)))).withColumn("test", F.col("page_id") % 9 > 5)
    model = urls.fit(frame.filter("NOT test"))
    from pyspark.ml.feature import VectorAssembler

    rows = model.transform(VectorAssembler(inputCols=list(urls.FEATURES), outputCol="features").transform(frame.filter("test"))).select("prediction", "ruled").collect()
    assert sum((r.prediction == 1) == (r.ruled == "block") for r in rows) > 0.95 * len(rows)


@pytest.mark.parametrize("text", ["½ ²", "Ⅻ", "１２ ٣", "____", "🙂 !!"])
def test_language_of_text_without_letters(real, text):
    frame = real.limit(50).unionByName(real.limit(1).withColumns({"doc_id": F.lit(-5).cast("long"), "text": F.lit(text)}))
    row = langid.language_report(frame).filter("doc_id = -5").first()
    assert (row.lang_pred, row.score) == ("und", 0.0)


def test_forward_backward_against_all_paths():
    rng = np.random.default_rng(3)
    lengths = np.array([4, 1, 3])
    emissions, transitions = rng.normal(size=(8, 3)), rng.normal(size=(3, 3))
    gamma, xi = langid.forward_backward(emissions, lengths, transitions, pairs=True)
    expected, moves = np.zeros((8, 3)), np.zeros((3, 3))
    for at, n in zip(np.cumsum(lengths) - lengths, lengths):
        paths = list(itertools.product(range(3), repeat=int(n)))
        weight = np.array([math.exp(sum(emissions[at + t, y] for t, y in enumerate(p)) + sum(transitions[a, b] for a, b in zip(p, p[1:]))) for p in paths])
        for p, w in zip(paths, weight / weight.sum()):
            for t, y in enumerate(p):
                expected[at + t, y] += w
            for a, b in zip(p, p[1:]):
                moves[a, b] += w
    assert np.allclose(gamma, expected) and np.allclose(xi, moves)


def test_archive_ranges_split_and_join(spark, monkeypatch):
    """Records come back whatever the gap and the size of a read; a selection of the index reads only its records."""
    pages = spark.createDataFrame([(i, f"http://h/{i}", f"payload {i} " * (i % 40)) for i in range(300)], "page_id long, url string, html string")
    folder = common.new_path(spark, "warc")
    index = warc.write(pages, folder)
    expected = {r.page_id: r.payload for r in warc.read(index, folder).collect()}
    chosen = index.filter("page_id % 7 = 0")
    for gap, size in ((0, 1), (0, 1 << 20), (1 << 20, 1 << 20)):
        monkeypatch.setattr(warc, "GAP", gap)
        monkeypatch.setattr(warc, "READ", size)
        assert {r.page_id: r.payload for r in warc.read(index, folder).collect()} == expected
        assert {r.page_id for r in warc.read(chosen, folder).collect()} == {i for i in range(300) if i % 7 == 0}


@pytest.mark.parametrize("kind", ["empty", "hostile"])
def test_pipeline_on_odd_tables(spark, docs, tmp_path, kind):
    frame = docs if kind == "hostile" else docs.limit(0)
    frame.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, PASSAGE)] if kind == "hostile" else [], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert all(r.copies > 0 for r in got) and not {r.doc_id for r in got} & {1, 2, 3, 4, 6, 7, 10} and (kind == "hostile" or not got)


def test_suffix_shares_do_not_tell_labels(spark):
    """All URLs of a suffix and fold of hosts see one share, labelled or not, and no label of their own fold is in it."""
    pages = spark.read.parquet(f"{DATA.replace('0.001', '0.01')}/pages.parquet")
    rows = urls.with_suffix_statistics(urls.lexical(urls.apply_rules(urls.parts(pages)))).select("host", "suffix", "fold", "ruled", "u_suffix_block").collect()
    shares = collections.defaultdict(set)
    for r in rows:
        shares[r.suffix, r.fold].add(r.u_suffix_block)
    assert all(len(s) == 1 for s in shares.values()) and len({r.fold for r in rows}) == urls.FOLDS
    for (suffix, fold), found in shares.items():
        others = [r.ruled for r in rows if r.suffix == suffix and r.fold != fold and r.ruled]
        assert math.isclose(found.pop(), (sum(v == "block" for v in others) + 1) / (len(others) + 2))


def test_url_trees_use_lexical_features_and_beat_a_constant(spark):
    pages = spark.read.parquet(f"{DATA.replace('0.001', '0.1')}/pages.parquet")
    frame = urls.with_suffix_statistics(urls.lexical(urls.apply_rules(urls.parts(pages))))
    weight = dict(zip(urls.FEATURES, urls.fit(frame).featureImportances.toArray()))
    assert sum(w for f, w in weight.items() if "suffix" not in f) > 0.05
    told = urls.held_out(pages).collect()
    n = sum(r.n for r in told)
    assert len(told) == urls.FOLDS and sum(r.n * r.accuracy for r in told) > sum(r.n * r.base for r in told) + 0.05 * n


@pytest.mark.parametrize("broadcast", [50_000, 0])
def test_suffixes_broadcast_or_joined(spark, broadcast, monkeypatch):
    monkeypatch.setattr(urls, "BROADCAST_SUFFIXES", broadcast)
    pages = spark.read.parquet(f"{DATA}/pages.parquet").select("page_id", "url")
    got = urls.judge(pages).collect()
    assert len(got) == pages.count() and urls.held_out(pages.limit(0)).count() == 0
    monkeypatch.setattr(urls, "BROADCAST_SUFFIXES", 50_000 - broadcast)
    assert sorted(map(str, urls.judge(pages).collect())) == sorted(map(str, got))
