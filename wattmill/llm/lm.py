"""Katz backoff language model over word pairs, trained and evaluated with Spark.

Tokens are the words of a text (A-Z lower-cased, split at ASCII white space) and one end, which also stands before the first word.
All words and all pairs of neighbouring tokens of the whole training corpus count; none is left out. Counts up to `CUT` are discounted by
Good-Turing, unigrams and pairs apart. P(w|v) is the discounted pair or else v's backoff weight times P(w); after an unseen word it is P(w). The
weights make each context's probabilities add up to 1. Where discounts leave a context less than 1 / (n + 1), its pairs are scaled to leave that.

A pair's count and the documents that ask for it need the same shuffle, so there is one:
  - `emitted` reads texts in batches and deals each batch's pairs, by document, to buckets by the context's hash, packed as arrays. Contexts among the
    `HOT` most frequent words are dealt by the follower, too; pairs within these words are counted in the tasks, in a table of fixed size;
  - `counted` has a bucket's pairs of all documents at once: it counts them, sums up its contexts, and keeps where they were asked for;
  - `contexts` writes the table of contexts, by hash bucket: their counts by class, the unigram mass of their followers, and the backoff weight;
  - `partial_sums` turns counts into probabilities, once the corpus's discounts are known; sums go back by batch and come together in `totals`;
  - `far_sums` joins what unseen pairs need of rare words (unigram, backoff weight) with the table of contexts.
The `LEXICON` most frequent words are sent to tasks: by their numbers pairs are short; of the `NEAR` most frequent ones, hashes and counts. What is sent has a
fixed size whatever the corpus; what isn't among it is joined. A bucket holds about
`BUCKET_TOKENS` tokens; a pair outside the hot words is as frequent as its rarer word at most.

Null and empty texts have one token, the end; long texts are read whole. Repeated rows are trained on and scored each. Without training rows every token goes to
the unseen mass. An empty table gives no rows. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattmill.llm.common import crc_mod, small_batches, written

#: Words sent to the tasks; words whose pairs among each other are counted in a table of fixed size; counts up to CUT are discounted.
LEXICON, HOT, CUT = 200_000, 500, 5
#: Words whose counts alone are sent to the tasks that count pairs: 12 bytes each.
NEAR = 1_000_000
#: Buckets of the written word tables; distinct words that a task holds before it hands on counts; tokens in a bucket of pairs, about.
BUCKETS, HELD_WORDS, BUCKET_TOKENS = 16, 150_000, 800_000
#: Bytes of text of which a task deals the pairs at once.
BATCH = 5 << 20
#: The hash of the end, which no word has (that of empty bytes).
END_HASH = np.uint64(xxhash.xxh64_intdigest(b"", 42)).view(np.int64).item()
CLASSES = [f"k{r}" for r in range(1, CUT + 1)]
EMITTED = "bucket long, kind string, batch long, data binary"
COUNTED = "kind string, batch long, data binary, v long, w long, n long, " + ", ".join(f"{k} long" for k in CLASSES) + ", big long, p double"
_TYPES = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary(), "double": pa.float64(), "boolean": pa.bool_()}


def words_of(text: str | None) -> list[bytes]:
    return text.encode().lower().split() if text else []


def discounts(counts: dict[int, int], cut: int = CUT) -> list[float]:
    """Katz's factors for counts 0..cut (index 0 unused) from counts of counts; 1 where Good-Turing gives no value in (0, 1]."""
    n = lambda r: counts.get(r, 0)
    out = [1.0] * (cut + 1)
    common = (cut + 1) * n(cut + 1) / n(1) if n(1) else 1.0
    for r in range(1, cut + 1):
        if n(r) and n(r + 1) and common < 1:
            d = ((r + 1) * n(r + 1) / (r * n(r)) - common) / (1 - common)
            out[r] = d if 0 < d <= 1 else 1.0
    return out


def scaled(mass: float, total: float) -> tuple[float, float]:
    """A factor for seen mass and what is left for the unseen: at least 1 / (total + 1)."""
    left = 1 - mass
    floor = 1 / (total + 1)
    return (1.0, left) if left >= floor else ((1 - floor) / mass if mass else 1.0, floor)


@dataclass
class Unigrams:
    """The corpus's totals and the discounted unigram probabilities as a function of the count."""

    table: DataFrame
    ends: int
    tokens: int
    types: int
    factors: list[float]
    scale: float
    unseen: float

    def probability(self, count: np.ndarray) -> np.ndarray:
        return self.probabilities()(count)

    def probabilities(self) -> Callable[[np.ndarray], np.ndarray]:
        """`probability` without the table, for tasks."""
        factors, scale, tokens, unseen = np.array([*self.factors, 1.0]), self.scale, max(1, self.tokens), self.unseen
        return lambda count: np.where(count > 0, scale * factors[np.minimum(count, CUT + 1)] * count / tokens, unseen)

    def column(self, count: Column) -> Column:
        """The same as a Spark column; null counts are unseen."""
        factor = F.lit(1.0)
        for r in range(1, CUT + 1):
            factor = F.when(count == r, self.factors[r]).otherwise(factor)
        return F.coalesce(factor * count * (self.scale / max(1, self.tokens)), F.lit(self.unseen))


def count_words(train: DataFrame) -> DataFrame:
    """Rows (word, n), partial counts by task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            return pa.record_batch([pa.array(list(counts.keys()), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

        for batch in small_batches(batches):
            for text in batch.column(0):
                counts.update(words_of(text.as_py()))
            if len(counts) > HELD_WORDS:
                yield out()
                counts.clear()
        if counts:
            yield out()

    return train.select("text").mapInArrow(run, "word binary, n long")


def unigrams(train: DataFrame) -> Unigrams:
    table = count_words(train).groupBy("word").agg(F.sum("n").alias("n")).withColumn("hash", F.xxhash64("word")).withColumn("bucket", F.pmod("hash", F.lit(BUCKETS)))
    table = written(table, "unigrams", "bucket")
    ends = train.count()
    low = [F.count(F.when(F.col("n") == r, 1)).alias(f"n{r}") for r in range(1, CUT + 2)]
    totals = table.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("types"), *low).first()
    of_counts = {r: totals[f"n{r}"] + (ends == r) for r in range(1, CUT + 2)}
    tokens, factors = totals.n + ends, discounts(of_counts)
    mass = (tokens - sum((1 - factors[r]) * r * of_counts[r] for r in range(1, CUT + 1))) / tokens if tokens else 0.0
    scale, unseen = scaled(mass, tokens)
    return Unigrams(table, ends, tokens, totals.types + (ends > 0), factors, scale, unseen)


@dataclass
class Lexicon:
    """The end and the most frequent words by number, with their counts and probabilities; what tasks look up."""

    words: list[bytes]
    counts: np.ndarray
    p: np.ndarray
    hashes: np.ndarray
    hot: int
    #: Sorted hashes of the `NEAR` most frequent words, and their counts.
    near: tuple[np.ndarray, np.ndarray]

    @property
    def size(self) -> int:
        return len(self.counts)

    def near_counts(self, hashes: np.ndarray) -> np.ndarray:
        """Counts of words by hash; 0 for those that aren't among the most frequent."""
        known, n = self.near
        if not len(known):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
        return np.where(known[at] == hashes, n[at].astype(np.int64), 0)


def most_frequent(table: DataFrame, size: int) -> DataFrame:
    """The most frequent words of a table with counts `n`, at most `size`: those above the count at which, by a histogram over classes of counts, they fit.

    The histogram has 64 classes an octave, so a few thousand rows whatever the corpus; no task sorts or sends words that don't go in.
    """
    of_count = F.floor(F.log2(F.col("n").cast("double")) * 64).cast("int")
    fits, least = 0, 1 << 30
    for row in sorted(table.groupBy(of_count.alias("bin")).count().collect(), reverse=True):
        if (fits := fits + row["count"]) > size:
            break
        least = row.bin
    return table.filter(of_count >= least)


def lexicon(model: Unigrams, size: int = LEXICON, hot: int = HOT, near: int = NEAR) -> Lexicon:
    rows = most_frequent(model.table, size).select("word", "n").toPandas().sort_values(["n", "word"], ascending=[False, True])
    words = [bytes(w) for w in rows.word]
    counts = np.concatenate(([model.ends], rows.n.to_numpy(np.int64))).astype(np.int64)
    known = most_frequent(model.table, near).select("hash", "n").toArrow()
    hashes, n = known["hash"].to_numpy(), known["n"].to_numpy()
    order = np.argsort(hashes)
    n = n[order].astype(np.uint32) if not len(n) or n.max() < 1 << 32 else n[order]
    return Lexicon(words, counts, model.probability(counts), Ids(words).hashed(), min(hot, len(counts)), (hashes[order], n))


class Ids(dict):
    """Numbers of words, and their hashes by number; the end (empty bytes) is 0. New words get the next number."""

    def __init__(self, words: Iterable[bytes] = ()):
        super().__init__()
        self.hashes: list[int] = []
        for w in (b"", *words):
            self[w]  # numbers it

    def __missing__(self, word: bytes) -> int:
        self.hashes.append(xxhash.xxh64_intdigest(word, 42))
        self[word] = n = len(self.hashes) - 1
        return n

    def path(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The texts' tokens in one row, an end before the first and after each text; and the texts' numbers of tokens."""
        tokens, sizes = [b""], []
        for text in texts:
            own = words_of(text.as_py())
            tokens += own
            tokens.append(b"")
            sizes.append(len(own) + 1)
        return np.fromiter(map(self.__getitem__, tokens), np.int64, len(tokens)), np.array(sizes, np.int64)

    def hashed(self) -> np.ndarray:
        return np.array(self.hashes, np.uint64).view(np.int64)


def summed(at: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of values by place, as doubles even where there are none."""
    return np.bincount(at, values, n).astype(np.float64)


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed value, whole numbers in as few bytes as they need; bytes of equal worth stand together."""
    parts = []
    for a in arrays:
        if a.dtype.kind in "iu" and (not len(a) or a.min() >= 0):
            a = a.astype(np.min_scalar_type(int(a.max()) if len(a) else 0))
        parts.append(np.ascontiguousarray(a))
    head = " ".join(f"{a.dtype.str} {len(a)}" for a in parts)
    return zstandard.compress(head.encode() + b"\n" + b"".join(a.view(np.uint8).reshape(len(a), -1).T.tobytes() for a in parts if len(a)), 3)


def unpacked(data: bytes) -> list[np.ndarray]:
    """The arrays again; whole numbers are 64 bits wide."""
    raw = zstandard.decompress(data)
    head = raw.partition(b"\n")[0]
    names, at, out = head.decode().split(), len(head) + 1, []
    for kind, n in zip(names[::2], map(int, names[1::2])):
        kind = np.dtype(kind)
        a = np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * kind.itemsize, at).reshape(kind.itemsize, n).T).view(kind).reshape(n)
        out.append(a.astype(np.int64) if kind.kind == "u" else a)
        at += n * kind.itemsize
    return out


def rows_of(schema: str, length: int, /, **columns: object) -> dict[str, pa.Array]:
    """Arrow columns by a schema's names: given arrays, given values for all rows, or nulls."""
    out = {}
    for field in schema.split(", "):
        name, kind = field.split()
        value = columns.get(name)
        out[name] = pa.array(value, _TYPES[kind]) if isinstance(value, (list, np.ndarray)) else pa.nulls(length, _TYPES[kind]) if value is None else pa.array([value] * length, _TYPES[kind])
    return out


def batch_of(schema: str, length: int, /, **columns: object) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(rows_of(schema, length, **columns))


def table_of(schema: str, parts: list[dict[str, pa.Array]]) -> pa.Table:
    batches = [pa.RecordBatch.from_pydict(p) for p in parts] or [batch_of(schema, 0)]
    return pa.Table.from_batches(batches)


def emitted(docs: DataFrame, shared: Broadcast[Lexicon], buckets: int) -> DataFrame:
    """Packed rows of `docs` (doc_id, text, apart). Kind own: a batch's documents, what the lexicon alone says of them, and their hot pairs; pairs: a
    batch's other pairs of one bucket; hot: a task's counts of hot pairs. Batches are numbered by partition, so a repeated task repeats its numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value
        size, hot, task = words.size, words.hot, TaskContext.get().partitionId()
        add_one, known, ids = np.log10(words.counts + 1.0), words.counts > 0, Ids(words.words)
        hot_counts = np.zeros(hot * hot, np.int64)
        for number, batch in enumerate(small_batches(batches, size=BATCH)):
            if len(ids) > size + HELD_WORDS:
                ids = Ids(words.words)
            path, sizes = ids.path(batch.column("text"))
            hashes, n_docs = ids.hashed().view(np.uint64), len(sizes)
            doc, apart = np.repeat(np.arange(n_docs), sizes), batch.column("apart").to_numpy(zero_copy_only=False).astype(bool)
            inside = path[1:] < size
            own, at = path[1:][inside], doc[inside]
            base, n_known = summed(at, add_one[own], n_docs), np.bincount(at[known[own]], minlength=n_docs)
            # pairs of each document, in the order of the pairs
            pair, which = np.unique(path[:-1] << 32 | path[1:], return_inverse=True)
            both, times = np.unique(which << 32 | doc, return_counts=True)
            v, w, of = pair[both >> 32] >> 32, pair[both >> 32] & 0xFFFFFFFF, both & 0xFFFFFFFF
            is_hot = (v < hot) & (w < hot)
            hot_pair, hot_of, hot_times = (v * hot + w)[is_hot], of[is_hot], times[is_hot]
            trained = ~apart[hot_of]
            hot_counts += np.bincount(hot_pair[trained], hot_times[trained], hot * hot).astype(np.int64)
            doc_id = batch.column("doc_id")
            row = packed(doc_id.fill_null(0).to_numpy(zero_copy_only=False), doc_id.is_null().to_numpy(zero_copy_only=False).astype(np.uint8), apart.astype(np.uint8), sizes, n_known, base, np.diff(hot_pair, prepend=0), hot_of, hot_times)
            name = (task << 24) + number
            rows = [(-1 - name % 64, "own", name, row)]
            v, w, of, times = v[~is_hot], w[~is_hot], of[~is_hot], times[~is_hot]
            mixed = np.where(v < hot, hashes[v] ^ (hashes[w] << np.uint64(1) | hashes[w] >> np.uint64(63)), hashes[v])
            bucket = ((mixed >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket.astype(np.uint16) if buckets < 1 << 16 else bucket, kind="stable")
            v, w, of, times, bucket = v[order], w[order], of[order], times[order], bucket[order]
            cuts = np.flatnonzero(np.diff(bucket)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(bucket)]) if len(bucket) else ():
                # words outside the lexicon are numbered in the row, which lists their hashes
                codes = np.concatenate((v[a:b], w[a:b]))
                rare, place = np.unique(codes[codes >= size], return_inverse=True)
                codes[codes >= size] = size + place
                mine = codes[: b - a]
                rows.append((int(bucket[a]), "pairs", name, packed(np.diff(mine, prepend=0) if np.all(np.diff(mine, prepend=0) >= 0) else mine, np.array([np.all(np.diff(mine, prepend=0) >= 0)], np.uint8), codes[b - a :], of[a:b] << 1 | apart[of[a:b]], times[a:b], hashes[rare].view(np.int64))))
            columns = list(zip(*rows))
            yield batch_of(EMITTED, len(rows), bucket=list(columns[0]), kind=list(columns[1]), batch=list(columns[2]), data=list(columns[3]))
        some = np.flatnonzero(hot_counts)
        yield batch_of(EMITTED, 1, bucket=-100 - task % 16, kind="hot", batch=task, data=[packed(some, hot_counts[some])])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "apart").mapInArrow(run, EMITTED)


def counted(rows: DataFrame, shared: Broadcast[Lexicon], model: Unigrams) -> DataFrame:
    """Buckets counted. Kind own: as before; hot (v: number of the pair, n); seen (v: a count up to CUT + 1, n: pairs with it); ctx: a context `v` with
    its count n, pairs by count (k1 and so on; big: the sum of larger counts) and the mass p of its followers whose counts it has; rare: a context v with a follower w
    whose count the task doesn't have; occ: who asked for the bucket's pairs."""
    probability = model.probabilities()

    def pairs(group: pa.Table, words: Lexicon) -> list[dict[str, pa.Array]]:
        size, parts = words.size, []
        names, place = np.unique(group.column("batch").to_numpy(), return_inverse=True)
        for data, at in zip(group.column("data"), place.tolist()):
            v, rising, w, of, times, rare = unpacked(data.as_py())
            v = np.cumsum(v) if rising[0] else v
            full = lambda c: np.where(c < size, words.hashes[np.minimum(c, size - 1)], rare[np.maximum(c - size, 0)] if len(rare) else 0)
            number = lambda c: np.where(c < size, c, -1).astype(np.int32)
            parts.append((full(v), number(v), full(w), number(w), of.astype(np.int32), times.astype(np.int32), np.full(len(v), at, np.int32)))
        columns = [np.concatenate(x) for x in zip(*parts)]
        parts.clear()
        rolled = columns[2].view(np.uint64)
        order = np.argsort(columns[0].view(np.uint64) ^ (rolled << np.uint64(1) | rolled >> np.uint64(63)), kind="stable")
        for i in range(len(columns)):  # one by one, so that only one of them is there twice
            columns[i] = columns[i][order]
        v, v_no, w, w_no, of, times, batch = columns
        trained = (of & 1) == 0
        first = np.flatnonzero(np.concatenate(([True], (v[1:] != v[:-1]) | (w[1:] != w[:-1]))))
        n = np.add.reduceat(times * trained, first)
        pair = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(v))))
        context, example, of_pair = np.unique(v[first], return_index=True, return_inverse=True)
        per = lambda at, values=None: np.bincount(of_pair[at], values, len(context))
        kinds = [per(n == r) for r in range(1, CUT + 1)]
        big, total = per(n > CUT, n[n > CUT]).astype(np.int64), per(n >= 0, n).astype(np.int64)
        follower, some = w_no[first], total > 0
        near = np.where(follower >= 0, words.counts[np.maximum(follower, 0)], 0)
        near[follower < 0] = words.near_counts(w[first][follower < 0])
        inside, outside = (n > 0) & (near > 0), (n > 0) & (near == 0)
        mass = summed(of_pair[inside], probability(near[inside]), len(context))
        seen = np.bincount(np.minimum(n, CUT + 2), minlength=CUT + 3)[1 : CUT + 2]
        # who asked, by context; of pairs that weren't seen, also the follower
        order = np.argsort(of_pair[pair], kind="stable")
        asked, unseen = of_pair[pair][order], n[pair][order] == 0
        occ = packed(names, np.diff(asked, prepend=0), n[pair][order], batch[order], of[order] >> 1, times[order], w[order][unseen], w_no[order][unseen] + 1, context, v_no[first][example] + 1, total, big, *kinds)
        ctx = {k: x[some].astype(np.int64) for k, x in zip(CLASSES, kinds)}
        return [
            rows_of(COUNTED, 1, kind="occ", data=[occ]),
            rows_of(COUNTED, int(some.sum()), kind="ctx", v=context[some], n=total[some], big=big[some], p=mass[some], **ctx),
            rows_of(COUNTED, int(outside.sum()), kind="rare", v=v[first][outside], w=w[first][outside]),
            rows_of(COUNTED, len(seen), kind="seen", v=np.arange(1, CUT + 2), n=seen.astype(np.int64)),
        ]

    def run(group: pa.Table) -> pa.Table:
        words, kind = shared.value, group.column("kind")[0].as_py()
        if kind == "pairs":
            return table_of(COUNTED, pairs(group, words))
        if kind == "own":
            return table_of(COUNTED, [rows_of(COUNTED, group.num_rows, kind="own", batch=group.column("batch").to_numpy(), data=group.column("data").to_pylist())])
        total = np.zeros(words.hot**2, np.int64)
        for data in group.column("data"):
            pair, n = unpacked(data.as_py())
            total[pair] += n
        some = np.flatnonzero(total)
        return table_of(COUNTED, [rows_of(COUNTED, len(some), kind="hot", v=some, n=total[some])])

    return rows.groupBy("bucket").applyInArrow(run, COUNTED)


@dataclass
class Katz:
    """The trained model. `contexts`: hash, n, logp (log10 of the unigram), scale and back (log10 of the pairs' scale and of the backoff weight)."""

    unigrams: Unigrams
    #: The lexicon is sent to the tasks once, for all steps.
    words: Broadcast[Lexicon]
    rows: DataFrame
    contexts: DataFrame
    factors: np.ndarray
    hot_counts: np.ndarray
    #: log10 by number in the lexicon: probability, backoff weight, scale
    logp: np.ndarray
    back: np.ndarray
    scale: np.ndarray

    def __post_init__(self) -> None:
        self.shared = self.rows.sparkSession.sparkContext.broadcast((self.factors, self.hot_counts, self.logp, self.back, self.scale))


def log_scale(seen: np.ndarray, n: np.ndarray) -> np.ndarray:
    """log10 of what the discounted counts `seen` of contexts with `n` tokens are multiplied by."""
    floor, mass = 1 / (n + 1.0), seen / np.maximum(n, 1)
    tight = (1 - mass < floor) & (n > 0)
    return np.log10(np.where(tight, (1 - floor) / np.where(mass > 0, mass, 1), 1.0))


def contexts(rows: DataFrame, hot: DataFrame, model: Unigrams, factors: np.ndarray) -> DataFrame:
    """The table of contexts, written by hash bucket. `hot` has the counts of pairs within the hot words as ctx rows."""
    sums = [*(F.sum(k).alias(k) for k in CLASSES), *(F.sum(k).alias(k) for k in ("n", "big", "p"))]
    known = rows.filter("kind = 'ctx'").select("v", "n", *CLASSES, "big", "p").unionByName(hot).groupBy("v").agg(*sums)
    # other followers get their unigrams by a join; a word's count is that of the word as a context
    p = known.select(F.col("v").alias("w"), model.column(F.col("n")).alias("_p"))
    far = rows.filter("kind = 'rare'").select("v", "w").join(p, "w").groupBy(F.col("v").alias("_v")).agg(F.sum("_p").alias("_far"))
    n = F.col("n").cast("double")
    seen = F.col("big").cast("double")
    for r, k in enumerate(CLASSES, 1):
        seen = seen + F.col(k) * F.lit(float(factors[r]) * r)
    mass, floor = seen / n, 1 / (n + 1)
    tight = 1 - mass < floor
    joined = known.join(far, F.col("v") == F.col("_v"), "left")
    left = F.when(tight, floor).otherwise(1 - mass) / (1 - F.col("p") - F.coalesce("_far", F.lit(0.0)))
    made = joined.select(F.col("v").alias("hash"), "n", F.log10(model.column(F.col("n"))).alias("logp"), F.log10(F.when(tight, (1 - floor) / mass).otherwise(1.0)).alias("scale"), F.log10(left).alias("back"))
    return written(made.withColumn("bucket", F.pmod("hash", F.lit(BUCKETS))), "contexts", "bucket")


def katz(docs: DataFrame, lexicon_size: int = LEXICON, hot_words: int = HOT, bucket_tokens: int = BUCKET_TOKENS, near_words: int = NEAR) -> Katz:
    """Trains on the rows of `docs` (doc_id, text, apart) that aren't apart; pairs of all rows are counted and kept for scoring."""
    spark = docs.sparkSession
    model = unigrams(docs.filter(~F.col("apart")))
    words = lexicon(model, lexicon_size, hot_words, near_words)
    shared = spark.sparkContext.broadcast(words)
    rows = written(counted(emitted(docs, shared, max(1, -(-model.tokens // bucket_tokens))), shared, model), "pairs", "kind")
    hot_counts = np.zeros(words.hot**2, np.int64)
    found = rows.filter("kind = 'hot'").groupBy("v").agg(F.sum("n").alias("n")).toPandas()  # at most hot_words squared rows
    hot_counts[found.v.to_numpy(np.int64)] = found.n.to_numpy(np.int64)
    low = {r.v: r.n for r in rows.filter("kind = 'seen'").groupBy("v").agg(F.sum("n").alias("n")).collect()}
    factors = np.array([*discounts({r: low.get(r, 0) + int((hot_counts == r).sum()) for r in range(1, CUT + 2)}), 1.0])
    square = hot_counts.reshape(words.hot, words.hot)
    hot = {"v": words.hashes[: words.hot], "n": square.sum(1), "big": np.where(square > CUT, square, 0).sum(1), "p": (square > 0) @ words.p[: words.hot]}
    hot = pd.DataFrame(hot | {k: (square == r).sum(1) for r, k in enumerate(CLASSES, 1)}).query("n > 0")
    hot = spark.createDataFrame(hot, "v long, n long, big long, p double, " + ", ".join(f"{k} long" for k in CLASSES))
    table = contexts(rows, hot, model, factors)
    number = pd.DataFrame({"hash": words.hashes, "number": np.arange(words.size)})
    short = table.join(F.broadcast(spark.createDataFrame(number, "hash long, number long")), "hash").select("number", "back", "scale").toPandas()  # at most the lexicon
    back, scale = np.zeros(words.size), np.zeros(words.size)
    back[short.number], scale[short.number] = short.back, short.scale
    return Katz(model, shared, rows, table, factors, hot_counts, np.log10(words.p), back, scale)


SUMS, FAR = "batch long, data binary", "batch long, doc long, hash long, as_word boolean, times long"


def asked(model: Katz, far: bool) -> DataFrame:
    """What buckets say of the documents that asked: with `far` what is to be looked up in the table of contexts, else sums by batch."""
    lexicon, shared, probability = model.words, model.shared, model.unigrams.probabilities()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, (factors, _, logp, back, hot_scale) = lexicon.value, shared.value
        for data in (x for b in batches for x in b.column(0)):
            names, asked, n, batch, doc, times, w, w_no, context, v_no, total, big, *kinds = unpacked(data.as_py())
            at, unseen, v_no, w_no = np.cumsum(asked), n == 0, v_no - 1, w_no - 1
            is_hot = (v_no >= 0) & (v_no < words.hot)
            total = np.where(is_hot, words.counts[np.maximum(v_no, 0)], total)
            trained = total[at[unseen]] > 0
            near = words.near_counts(w)
            if far:
                look_v, look_w = trained & (v_no[at[unseen]] < 0), (w_no < 0) & (near == 0)
                which = np.concatenate((np.flatnonzero(unseen)[look_v], np.flatnonzero(unseen)[look_w]))
                as_word = np.arange(len(which)) >= look_v.sum()
                hashes = np.concatenate((context[at[unseen]][look_v], w[look_w]))
                yield batch_of(FAR, len(which), batch=names[batch[which]], doc=doc[which], hash=hashes, as_word=as_word, times=times[which])
                continue
            seen = big + sum(k * (factors[r] * r) for r, k in enumerate(kinds, 1))
            own = np.where(is_hot, hot_scale[np.maximum(v_no, 0)], log_scale(seen, total)) - np.log10(np.maximum(total, 1))
            value = np.where(unseen, 0.0, np.log10(factors[np.minimum(n, CUT + 1)] * np.maximum(n, 1)) + own[at])
            value[unseen] = np.where(trained & (v_no[at[unseen]] >= 0), back[np.maximum(v_no[at[unseen]], 0)], 0.0) + np.where(w_no >= 0, logp[np.maximum(w_no, 0)], np.where(near > 0, np.log10(probability(near)), 0.0))
            # a word outside the lexicon stands once as a context for each time it is a token
            token = v_no[at] < 0
            key, where = np.unique(batch << 32 | doc, return_inverse=True)
            sums = [summed(where, times * value, len(key)), summed(where, times * token * np.log10(total[at] + 1.0), len(key)), np.bincount(where, times * (token & (total[at] > 0)), len(key)).astype(np.int64)]
            cuts = [0, *(np.flatnonzero(np.diff(key >> 32)) + 1).tolist(), len(key)]
            rows = [(int(names[key[a] >> 32]), packed(key[a:b] & 0xFFFFFFFF, *(x[a:b] for x in sums))) for a, b in zip(cuts, cuts[1:])]
            yield batch_of(SUMS, len(rows), batch=[r[0] for r in rows], data=[r[1] for r in rows])

    return model.rows.filter("kind = 'occ'").select("data").mapInArrow(run, FAR if far else SUMS)


TOTALS = "batch long, doc long, doc_id long, apart boolean, n_tokens long, n_known long, base double, logp double"


def totals(model: Katz) -> DataFrame:
    """One row per document: its own sums, its hot pairs and what the buckets say."""
    lexicon, shared = model.words, model.shared

    def run(group: pa.Table) -> pa.Table:
        words, (factors, hot_counts, logp, back, scale) = lexicon.value, shared.value
        parts = list(zip(group.column("own").to_pylist(), group.column("data").to_pylist()))
        doc_id, no_id, apart, sizes, n_known, base, pair, of, times = unpacked(next(data for own, data in parts if own))
        pair = np.cumsum(pair)
        v, w, n = pair // max(1, words.hot), pair % max(1, words.hot), hot_counts[pair]
        seen = np.log10(factors[np.minimum(n, CUT + 1)] * np.maximum(n, 1)) + scale[v] - np.log10(np.maximum(words.counts[v], 1))
        score = summed(of, times * np.where(n > 0, seen, back[v] + logp[w]), len(sizes))
        base, n_known = base.copy(), n_known.copy()
        for data in (data for own, data in parts if not own):
            doc, a, b, c = unpacked(data)
            score[doc] += a
            base[doc] += b
            n_known[doc] += c
        ids = pa.array(doc_id.astype(np.int64), mask=no_id.astype(bool))
        rows = rows_of(TOTALS, len(sizes), batch=group.column("batch")[0].as_py(), doc=np.arange(len(sizes)), apart=apart.astype(bool), n_tokens=sizes, n_known=n_known, base=base, logp=score) | {"doc_id": ids}
        return table_of(TOTALS, [{name.split()[0]: rows[name.split()[0]] for name in TOTALS.split(", ")}])

    own = model.rows.filter("kind = 'own'").select("batch", "data", F.lit(True).alias("own"))
    return own.unionByName(asked(model, False).withColumn("own", F.lit(False))).groupBy("batch").applyInArrow(run, TOTALS)


def far_sums(model: Katz) -> DataFrame:
    """Per document that asked for unseen pairs with rare words: log10 of their unigrams and backoff weights."""
    rows = asked(model, True).join(model.contexts.select("hash", "logp", "back"), "hash", "left")
    value = F.when(F.col("as_word"), F.coalesce("logp", F.lit(float(np.log10(model.unigrams.unseen))))).otherwise(F.coalesce("back", F.lit(0.0)))
    return rows.groupBy("batch", "doc").agg(F.sum(F.col("times") * value).alias("far"))


def katz_score(model: Katz) -> DataFrame:
    """Per row that the model was made with: doc_id, apart, n_tokens, n_known, base_score, score."""
    constant = float(np.log10(max(1, model.unigrams.tokens + model.unigrams.types + 1)))
    rows = totals(model).join(far_sums(model), ["batch", "doc"], "left")
    return rows.select("doc_id", "apart", "n_tokens", "n_known", (F.col("base") - F.col("n_tokens") * F.lit(constant)).alias("base_score"), (F.col("logp") + F.coalesce("far", F.lit(0.0))).alias("score"))


def fit_and_score(docs: DataFrame, held_out_of: int = 7, held_out: int = 2) -> DataFrame:
    """Trains on rows whose id's crc32 modulo `held_out_of` isn't `held_out`, scores all rows."""
    docs = docs.select("doc_id", "text", (crc_mod(F.col("doc_id"), held_out_of) == held_out).alias("apart"))
    model = katz(docs)
    return katz_score(model).select("doc_id", F.col("apart").alias("held_out"), "n_tokens", "n_known", F.lit(int(model.unigrams.tokens)).cast("long").alias("train_tokens"), "base_score", "score")
