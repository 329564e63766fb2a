"""Benchmark decontamination: a prefix-filtered set join of item windows with documents.

Benchmark items are cut into windows (13 consecutive words; a shorter item is one window), a window into shingles of `SHINGLE` words (a shorter
window is one). To hold the whole window a document must hold each of its shingles, so a prefix of one is enough, and the rarest over all documents is taken.
  - `spots` reads the documents once. Of each it keeps the number of words and the places whose shingle may be one of the benchmark's (by a table of
    bits, sized by the benchmark's distinct shingles up to `MOST_SLOTS`), with the shingle's key and the words of the longest window that would start there;
  - places and benchmark shingles are joined, which gives each shingle's count and so the order of rarity;
  - `occurrences` joins each window's prefix with the places. A place says where the window would start; windows that would leave the document are cut by
    length and position, and the rest are verified over the whole window, word by word: the place where the window starts has its words.
Keys of shingles are 64-bit hashes and only nominate; what is found rests on the words. Tables of the benchmark (short rows: a window, or a window and one item)
are broadcast if they are small by count, else joined by a shuffle. No text and no item goes through the driver.

Words are runs of characters outside ASCII non-alphanumerics, A-Z lower-cased. A null text or item has no words, long ones are read whole. Repeated
document rows are judged one by one, repeated items count once by id; a null item id counts as `null`. Of shingles with equal counts the first in the window is
taken; results don't depend on it. Empty documents give no rows; without items no document is hit. Columns other than those named are carried along.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattmill.llm.common import ascii_lower, small_batches, small_side, under_own_names, written

WINDOW, SHINGLE = 13, 3
#: Bits of the table that tells which shingles may be the benchmark's, at least and at most (powers of two; it has 64 a shingle in between); words whose hashes a task holds.
SLOTS, MOST_SLOTS, HELD_WORDS = 1 << 24, 1 << 28, 200_000
#: ASCII bytes to spaces, but for digits and letters, which are lower-cased; bytes of other characters stay.
_TABLE = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SPOTS = "row long, doc_id long, n_words long, digest string, pos int, key long, words string"


class Hashes(dict):
    """Hashes of words, each taken once."""

    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh64_intdigest(word, 7)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(_TABLE).split() if text else []


def keys_at(hashes: np.ndarray, places: np.ndarray, size: int) -> np.ndarray:
    """One key for the `size` words from each place on."""
    out = np.full(len(places), size, np.uint64)
    for k in range(size):
        out = ((out << np.uint64(23) | out >> np.uint64(41)) ^ hashes[places + k]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(32)
    return out


def item_windows(items: DataFrame) -> DataFrame:
    """The benchmark's windows (their words, space-joined) with their number of words, a row for each of their items; written."""
    words = F.array_remove(F.split(ascii_lower(F.coalesce(F.col("text").cast("string"), F.lit(""))), GAP), "")
    rows = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), words.alias("w")).filter(F.size("w") > 0)
    start = F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - WINDOW + 1)))
    rows = rows.select("item", "w", start.alias("i")).select("item", F.slice("w", F.col("i"), F.lit(WINDOW)).alias("w"))
    return written(rows.select(F.array_join("w", " ").alias("window"), F.size("w").alias("size"), "item").distinct(), "windows")


def shingles(windows: DataFrame) -> DataFrame:
    """Per window (each once), a row each, its shingles' offsets and keys; written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Hashes()
        for batch in batches:
            rows = []
            for window in batch.column(0).to_pylist():
                h = known.of(words_of(window))
                size = min(SHINGLE, len(h))
                rows += [(window, len(h), n, k) for n, k in enumerate(keys_at(h, np.arange(len(h) - size + 1), size).view(np.int64).tolist())]
            kinds = [pa.string(), pa.int32(), pa.int32(), pa.int64()]
            yield pa.record_batch([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["window", "size", "offset", "key"])

    return written(windows.select("window").distinct().mapInArrow(run, "window string, size int, offset int, key long"), "shingles")


def slots_for(wanted: DataFrame) -> int:
    """Bits of the table for these shingles: some 64 a shingle, so that one place in 64 or fewer is nominated in vain; a power of two within the bounds."""
    n = wanted.select("key").distinct().count()
    return min(MOST_SLOTS, max(SLOTS, 1 << (64 * n - 1).bit_length() if n else 0))


def spots(docs: DataFrame, wanted: DataFrame, sizes: list[int], slots: int) -> DataFrame:
    """One row per document row (doc_id, n_words, the text's MD5) and one per place whose shingle may be wanted, with the words from there on, as many as the largest of `sizes`; written."""
    bits = np.zeros(slots, bool)
    bits[wanted.select(F.col("key").bitwiseAND(F.lit(slots - 1)).alias("slot")).distinct().toArrow()["slot"].to_numpy()] = True  # at most `slots` numbers
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(bits, bitorder="little"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, known, row = shared.value, Hashes(), TaskContext.get().partitionId() << 40
        lengths = sorted({min(SHINGLE, s) for s in sizes})
        for batch in small_batches(batches):
            if len(known) > HELD_WORDS:
                known.clear()
            own, parts, ahead = [], [], []
            for text in batch.column("text"):
                text = text.as_py()
                words = words_of(text)
                h = known.of(words)
                own.append((row, len(h), hashlib.md5((text or "").encode()).hexdigest()))
                for size in lengths:
                    if len(h) < size:
                        continue
                    keys = keys_at(h, np.arange(len(h) - size + 1), size)
                    slot = keys & np.uint64(slots - 1)
                    at = np.flatnonzero(table[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8) & 1)
                    if len(at):
                        parts.append((np.full(len(at), row), np.full(len(at), len(h)), at, keys[at]))
                        ahead += [b" ".join(words[i : i + sizes[-1]]) for i in at.tolist()]
                row += 1
            rows, n_words, at, keys = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.int64),) * 4
            n, m = len(own), len(rows)
            yield pa.record_batch(
                [
                    pa.array(np.concatenate(([r[0] for r in own], rows)).astype(np.int64)), pa.concat_arrays([batch.column("doc_id"), pa.nulls(m, pa.int64())]), pa.array(np.concatenate(([r[1] for r in own], n_words)).astype(np.int64)),
                    pa.concat_arrays([pa.array([r[2] for r in own], pa.string()), pa.nulls(m, pa.string())]), pa.concat_arrays([pa.nulls(n, pa.int32()), pa.array(at.astype(np.int32))]),
                    pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(keys.astype(np.uint64).view(np.int64))]), pa.concat_arrays([pa.nulls(n, pa.string()), pa.array(ahead, pa.binary()).cast(pa.string())]),
                ],
                [x.split()[0] for x in SPOTS.split(", ")],
            )

    return written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SPOTS), "spots")


def prefixes(places: DataFrame, wanted: DataFrame) -> DataFrame:
    """Each window's rarest shingle over all documents; windows with a shingle that no document has are left out. Written."""
    counts = places.join(small_side(wanted.select("key").distinct()), "key").groupBy("key").agg(F.count("*").alias("n"))
    rows = wanted.join(counts, "key", "left").groupBy("window", "size")
    found = rows.agg(F.count("*").alias("_all"), F.count("n").alias("_some"), F.min_by(F.struct("offset", "key"), F.struct("n", "offset")).alias("p"))
    return written(found.filter("_all = _some").select("window", "size", "p.*"), "prefixes")


def occurrences(places: DataFrame, wanted: DataFrame) -> DataFrame:
    """`row`, `start`, `size`, `window` of every window in every document row; written."""
    p = small_side(prefixes(places, wanted))
    near = places.select("row", "n_words", "pos", "key").join(p, "key").withColumn("start", F.col("pos") - F.col("offset"))
    near = near.filter("start >= 0 AND start + size <= n_words").select("row", "start", "size", "window")
    starts = places.select("row", F.col("pos").alias("start"), F.concat("words", F.lit(" ")).alias("_ahead"))
    return written(near.join(starts, ["row", "start"]).filter(F.startswith("_ahead", F.concat("window", F.lit(" ")))).select("row", "start", "size", "window").distinct(), "occurrences")


def found(docs: DataFrame, items: DataFrame, slots: int | None = None) -> DataFrame:
    """Per row of `docs` (doc_id, text): doc_id, n_words, digest (the text's MD5), n_hit and `items`, the sorted ids of items with occurring windows."""
    windows = item_windows(items)
    wanted = shingles(windows)
    sizes = sorted(r.size for r in windows.select("size").distinct().collect())  # 1 to 13
    rows = spots(docs, wanted, sizes, slots or slots_for(wanted))
    own, places = rows.filter("pos IS NULL").select("row", "doc_id", "n_words", "digest"), rows.filter("pos IS NOT NULL")
    hits = occurrences(places, wanted)
    # spans are sorted, so each adds what lies behind the furthest end so far
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).alias("end"))
    step = lambda a, x: F.struct((a["n"] + F.greatest(F.lit(0), x["last"] - F.greatest(x["first"], a["end"] + 1) + 1)).alias("n"), F.greatest(a["end"], x["last"]).alias("end"))
    spans = F.array_sort(F.collect_set(F.struct(F.col("start").alias("first"), (F.col("start") + F.col("size") - 1).alias("last"))))
    words = hits.groupBy("row").agg(spans.alias("s")).select("row", F.aggregate("s", zero, step, lambda a: a["n"]).alias("n_hit"))
    owners = hits.select("row", "window").distinct().join(small_side(windows.select("window", "item")), "window").select("row", "item")
    names = owners.groupBy("row").agg(F.array_sort(F.collect_set("item")).alias("items"))
    both = own.join(words.join(names, "row"), "row", "left")
    return both.select("doc_id", "n_words", "digest", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


#: The contract's rule: hit words are a twentieth of all or more.
CONTAMINATED = "n_hit > 0 AND 20 * n_hit >= n_words"


def contamination_report(docs: DataFrame, items: DataFrame, slots: int | None = None) -> DataFrame:
    """One row per document row: words, hit words, items and the verdict."""
    return found(docs.select("doc_id", "text"), items, slots).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), F.expr(CONTAMINATED).alias("contaminated")
    )


def clean(docs: DataFrame, items: DataFrame, slots: int | None = None) -> DataFrame:
    """The rows of `docs` that aren't contaminated, with their own columns only. The verdict is the text's, so contaminated texts go by their MD5."""
    inner, back = under_own_names(docs, "text")
    gone = written(found(inner.select(F.lit(None).cast("long").alias("doc_id"), "text"), items, slots).filter(CONTAMINATED).select("digest").distinct(), "contaminated")
    return inner.withColumn("digest", F.md5(F.coalesce("text", F.lit("")).cast("binary"))).join(small_side(gone), "digest", "left_anti").select(*back)


#: The same in DuckDB SQL (ids are unique in the driver's tables).
ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
win AS (SELECT DISTINCT item, least(13, len(w)) AS n, array_to_string(w[i + 1:i + least(13, len(w))], ' ') AS window FROM b, unnest(range(0, greatest(1, len(w) - 12))) u(i) WHERE len(w) > 0),
pos AS (SELECT doc_id, i, s.n, array_to_string(w[i + 1:i + s.n], ' ') AS window FROM d, (SELECT DISTINCT n FROM win) s, unnest(range(0, len(w))) u(i) WHERE i + s.n <= len(w)),
hits AS (SELECT doc_id, i, win.n, item FROM pos JOIN win ON win.window = pos.window AND win.n = pos.n),
words AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM hits, unnest(range(0, n)) u(k) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hits GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""
