"""Language ID: a linear-chain conditional random field that labels the words of code-switched text.

Words are runs of ASCII letters and non-ASCII characters, A-Z lower-cased. A word's features are the 2-, 3- and 4-grams of its UTF-8
bytes with a mark at both ends (so affixes are grams with a mark), by table index, and its log share among the languages in a lexicon.
The lexicon counts the words of all labelled training documents by language, in a table of `LEXICON_BUCKETS` hashed words: its size is fixed, so
tasks hold it whatever the corpus (and as many columns as there are languages). Gram weights, lexicon weights and transitions are fitted by
gradient on at most `SAMPLE_DOCS` whole texts a language; pieces of `SEGMENT` words of different languages are put together, so that switches are seen.

Prediction runs forward-backward over all words of a text; a document's language has the largest sum of word posteriors, its score
is that sum's share (ties: the first label in order). Null texts and those without a letter get `und` and 0, and so do all without a trained
model. A letter is one by Unicode's classes. Repeated rows are labelled one by one, an empty table gives none. Languages, sources and ids are no inputs; other columns are carried along.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wattmill.llm.common import crc_mod, small_batches, under_own_names

LEXICON_BUCKETS, GRAM_BUCKETS = 1 << 16, 1 << 16
SAMPLE_DOCS, SEGMENT, SEGMENTS = 60, 10, 12
STEPS, RATE, DECAY = 60, 0.15, 1e-4
UNKNOWN = "und"
BATCH_DOCS, BATCH_SIZE = 1_000, 4 << 20
#: Words whose grams are held at once.
HELD_WORDS = 20_000
_TABLE = bytes(c if 0x61 <= c <= 0x7A or c >= 0x80 else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))
_LETTER = regex.compile(r"\p{L}")
_MULTIPLIERS = np.random.default_rng(11).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(_TABLE).split() if text and _LETTER.search(text) else []


def gram_ids(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gram numbers of all words, each word's number of grams, and its lexicon bucket."""
    data = np.frombuffer(b"^" + b"$^".join(words) + b"$", np.uint8).astype(np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    starts = np.cumsum(sizes) - sizes
    ids, counts = [], []
    place = np.arange(len(data)) - np.repeat(starts, sizes)
    left = np.repeat(sizes, sizes) - place  # bytes from here to the word's end
    value = data.copy()
    parts = []
    for n in (2, 3, 4):
        value = value[:-1] * np.uint64(257) + data[n - 1 :] if n <= len(data) else value[:0]
        whole = np.flatnonzero(left[: len(value)] >= n)
        mixed = value[whole] * np.uint64(0x9E3779B97F4A7C15)
        parts.append((whole, (mixed >> np.uint64(48)).astype(np.int64) % GRAM_BUCKETS + (n - 2) * GRAM_BUCKETS))
    at = np.concatenate([p[0] for p in parts])
    order = np.argsort(at, kind="stable")
    ids = np.concatenate([p[1] for p in parts])[order]
    owner = np.repeat(np.arange(len(words)), sizes)[at[order]]
    counts = np.bincount(owner, minlength=len(words))
    hashed = np.add.reduceat(data * _MULTIPLIERS[np.minimum(place, 255)] + (data << np.uint64(32)), starts)
    return ids, counts, ((hashed * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(np.int64) % LEXICON_BUCKETS


@dataclass
class Crf:
    labels: list[str]
    grams: np.ndarray  # (3 * GRAM_BUCKETS, labels)
    lexicon: np.ndarray  # log share of each label by bucket
    lexical: np.ndarray  # weight by label
    transitions: np.ndarray

    def emissions(self, words: list[bytes]) -> np.ndarray:
        """Scores of each word for each label."""
        out = np.empty((len(words), len(self.labels)), np.float32)
        for at in range(0, len(words), HELD_WORDS):
            ids, counts, buckets = gram_ids(words[at : at + HELD_WORDS])
            sums = np.add.reduceat(self.grams[ids], np.cumsum(counts) - counts, axis=0)
            out[at : at + HELD_WORDS] = sums / np.sqrt(counts)[:, None] + self.lexicon[buckets] * self.lexical
        return out


def forward_backward(emissions: np.ndarray, lengths: np.ndarray, transitions: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """Posteriors of all words of sequences that stand one behind the other; with `pairs` also the expected transitions.

    Sequences go through time together; the longest come first, so that those still running are a prefix.
    """
    k, n = emissions.shape[1], len(emissions)
    order = np.argsort(-lengths, kind="stable")
    starts = (np.cumsum(lengths) - lengths)[order]
    ordered = lengths[order]
    running = np.searchsorted(-ordered, -np.arange(ordered[0] if len(ordered) else 0), "left")
    e = np.exp(emissions - emissions.max(1, keepdims=True))
    a = np.exp(transitions)
    alpha = np.empty((n, k))
    now = np.full((len(order), k), 1.0)
    for t, m in enumerate(running.tolist()):
        at = starts[:m] + t
        now = (now[:m] @ a if t else now[:m]) * e[at]
        now /= now.sum(1, keepdims=True)
        alpha[at] = now
    gamma, xi = np.empty((n, k)), np.zeros((k, k)) if pairs else None
    beta = np.ones((len(order), k))
    for t in range(len(running) - 1, -1, -1):
        m = running[t]
        at = starts[:m] + t
        if t + 1 < len(running) and (later := running[t + 1]):
            nxt = starts[:later] + t + 1
            right = e[nxt] * beta[:later]
            if pairs:
                joint = alpha[at[:later]][:, :, None] * a[None] * right[:, None, :]
                xi += (joint / joint.sum((1, 2), keepdims=True)).sum(0)
            back = right @ a.T
            beta[:later] = back / back.sum(1, keepdims=True)
        g = alpha[at] * beta[:m]
        gamma[at] = g / g.sum(1, keepdims=True)
    return gamma, xi


def train(docs: DataFrame, labels: list[str], lexicon: np.ndarray, sample: list[tuple[str, list[bytes]]]) -> Crf:
    """Fits the weights to texts (label, words) by gradient ascent with Adam."""
    rng = np.random.default_rng(5)
    pieces = [(labels.index(lang), words[i : i + SEGMENT]) for lang, words in sample for i in range(0, len(words), SEGMENT)]
    # three of four pieces go on in the language before, so transitions learn both staying and switching
    by_label = [[p for p in pieces if p[0] == n] for n in range(len(labels))]
    sequences, now = [], 0
    while any(by_label):
        row = []
        for _ in range(SEGMENTS):
            open_labels = [n for n, p in enumerate(by_label) if p]
            if not open_labels:
                break
            if now not in open_labels or rng.random() < 0.25:
                now = int(rng.choice(open_labels))
            row.append(by_label[now].pop())
        sequences.append(row)
    words = [w for row in sequences for _, ws in row for w in ws]
    gold = np.array([label for row in sequences for label, ws in row for _ in ws])
    lengths = np.array([sum(len(ws) for _, ws in row) for row in sequences])
    ids, counts, buckets = gram_ids(words)
    k = len(labels)
    model = Crf(labels, np.zeros((3 * GRAM_BUCKETS, k), np.float32), lexicon, np.ones(k, np.float32), np.zeros((k, k)))
    owner = np.repeat(np.arange(len(words)), counts)
    one = np.eye(k)[gold]
    first = np.zeros(len(words), bool)
    first[np.cumsum(lengths) - lengths] = True
    seen = np.zeros((k, k))
    np.add.at(seen, (gold[:-1][~first[1:]], gold[1:][~first[1:]]), 1)
    used, where = np.unique(ids, return_inverse=True)
    w = [np.zeros((len(used), k)), np.ones(k), np.zeros((k, k))]
    m, v = [np.zeros_like(x) for x in w], [np.zeros_like(x) for x in w]
    norm = (1 / np.sqrt(counts))[owner]
    starts = np.cumsum(counts) - counts
    for step in range(1, STEPS + 1):
        emissions = np.add.reduceat(w[0][where] * norm[:, None], starts, axis=0) + lexicon[buckets] * w[1]
        gamma, xi = forward_backward(emissions, lengths, w[2], pairs=True)
        error = (one - gamma) / len(words)
        grams = np.stack([np.bincount(where, error[owner, j] * norm, len(used)) for j in range(k)], 1)
        for i, g in enumerate((grams, (error * lexicon[buckets]).sum(0), (seen - xi) / len(words))):
            g = g - DECAY * w[i] / 10
            m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.99 * v[i] + 0.01 * g * g
            w[i] += RATE * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.99**step)) + 1e-9)
    model.grams[used] = w[0]
    model.lexical, model.transitions = w[1].astype(np.float32), w[2]
    return model


def lexicon_counts(docs: DataFrame, labels: list[str]) -> np.ndarray:
    """Words of all labelled documents by bucket and label: a table of fixed size."""
    number = {name: n for n, name in enumerate(labels)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(LEXICON_BUCKETS * len(labels), np.int64)
        for batch in small_batches(batches, BATCH_DOCS, BATCH_SIZE):
            texts = [words_of(text.as_py()) for text in batch.column("text")]
            owners = np.repeat([number[lang.as_py()] for lang in batch.column("lang")], [len(ws) for ws in texts])
            index = dict.fromkeys(w for ws in texts for w in ws)
            if not index:
                continue
            distinct = list(index)
            for part in range(0, len(distinct), HELD_WORDS):
                chunk = distinct[part : part + HELD_WORDS]
                index.update(zip(chunk, gram_ids(chunk)[2].tolist()))
            at = np.fromiter((index[w] for ws in texts for w in ws), np.int64, len(owners))
            total += np.bincount(at * len(labels) + owners, minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.record_batch([pa.array(some.astype(np.int32)), pa.array(total[some])], ["cell", "n"])

    cells = docs.select("text", "lang").mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(LEXICON_BUCKETS * len(labels))
    counts[cells.cell] = cells.n
    return counts.reshape(-1, len(labels))


def fit(docs: DataFrame, folds: int = 5, held_out: int = 0) -> Crf | None:
    """A model from the text and lang of rows outside the held-out fold; None without labelled rows."""
    known = docs.select("doc_id", "text", "lang").filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (crc_mod(F.col("doc_id"), folds) != held_out))
    sizes = {r.lang: r["count"] for r in known.groupBy("lang").count().collect()}  # one row per language
    labels = sorted(sizes)
    if not labels:
        return None
    share = F.lit(0.0)
    for lang in labels:
        share = F.when(F.col("lang") == lang, min(1.0, 3.0 * SAMPLE_DOCS / sizes[lang])).otherwise(share)
    drawn = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1_000_003))
    near = known.withColumn("_h", drawn).filter(F.col("_h") < share * 1_000_003)  # about three times the sample, before it is ordered
    near = near.withColumn("_n", F.row_number().over(Window.partitionBy("lang").orderBy("_h", "doc_id"))).filter(F.col("_n") <= SAMPLE_DOCS)
    sample = [(r.lang, words) for r in near.select("lang", "text").collect() if (words := words_of(r.text))]
    if not sample:
        return None
    counts = lexicon_counts(known, labels)
    share_of = (counts + 0.5) / (counts.sum(0) + 0.5 * LEXICON_BUCKETS)
    lexicon = np.log(share_of / share_of.sum(1, keepdims=True)).astype(np.float32)
    return train(docs, labels, np.maximum(lexicon, -5.0), sample)


def label(docs: DataFrame, model: Crf | None, spans: bool = False) -> DataFrame:
    """`docs` with `_l_lang` and `_l_score`; with `spans` also `_l_spans`, the runs of words of one language."""
    names = docs.columns
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.withColumns({"_l_lang": F.lit(""), "_l_score": F.lit(0.0), "_l_spans": F.lit(None).cast("array<struct<first:int,last:int,lang:string>>")}).schema
    spans_type = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("lang", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf = shared.value
        for batch in small_batches(batches, BATCH_DOCS, BATCH_SIZE):
            texts = [words_of(t.as_py()) if crf else [] for t in batch.column("text")]
            lengths = np.array([len(ws) for ws in texts], np.int64)
            langs, scores, runs = [UNKNOWN] * len(texts), np.zeros(len(texts)), [None] * len(texts)
            if lengths.sum():
                index = dict.fromkeys(w for ws in texts for w in ws)
                scored = crf.emissions(list(index))
                index = {w: n for n, w in enumerate(index)}
                gamma, _ = forward_backward(scored[np.fromiter((index[w] for ws in texts for w in ws), np.int64, int(lengths.sum()))], lengths[lengths > 0], crf.transitions)
                some = np.flatnonzero(lengths)
                starts = (np.cumsum(lengths) - lengths)[some]
                sums = np.add.reduceat(gamma, starts, axis=0)
                best = sums.argmax(1)
                scores[some] = np.clip(sums.max(1) / lengths[some], 0, 1)
                for n, b in zip(some.tolist(), best.tolist()):
                    langs[n] = crf.labels[b]
                if spans:
                    for n, a in zip(some.tolist(), starts.tolist()):
                        words = gamma[a : a + lengths[n]].argmax(1).tolist()
                        at, runs[n] = 0, []
                        for value, group in groupby(words):
                            size = len(list(group))
                            runs[n].append({"first": at, "last": at + size - 1, "lang": crf.labels[value]})
                            at += size
            yield pa.record_batch([*batch.columns, pa.array(langs, pa.string()), pa.array(scores), pa.array(runs, spans_type)], [*names, "_l_lang", "_l_score", "_l_spans"])

    out = docs.mapInArrow(run, schema)
    return out if spans else out.drop("_l_spans")


def language_report(docs: DataFrame, folds: int = 5, held_out: int = 0) -> DataFrame:
    """One row per document row: doc_id, held_out, lang_pred, score."""
    model = fit(docs, folds, held_out)
    return label(docs.select("doc_id", "text"), model).select("doc_id", (crc_mod(F.col("doc_id"), folds) == held_out).alias("held_out"), F.col("_l_lang").alias("lang_pred"), F.col("_l_score").alias("score"))


def keep_known(docs: DataFrame, least: float = 0.4) -> DataFrame:
    """The rows of `docs` with a language whose share of words is at least `least`, with their own columns only."""
    inner, back = under_own_names(docs, "text")
    return label(inner, fit(docs)).filter((F.col("_l_lang") != UNKNOWN) & (F.col("_l_score") >= least)).select(*back)
