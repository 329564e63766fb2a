"""Periodic runs of words: stretches that repeat a period, found by longest common extensions in suffix trees.

A run is a stretch of consecutive words with smallest period q (words q apart are identical), at least `REPEATS` periods and `LEAST` words
long, that no neighbouring word extends keeping the period. A word is dropped from the collapsed text if a run contains it after that run's
first q words.

Per document: every word of a run stands in it `REPEATS` times or more, so a word that is rarer in a stretch parts it, and only the
stretches that are left can hold runs. Of such a stretch and of its reversal suffix trees are built by Ukkonen's algorithm; an Euler tour
of a tree with block minima answers how far two places agree, to the right or to the left, in constant time. Each run has a Lyndon root
among the longest Lyndon words that begin at its places under the order of the words or the inverse order: the span to the next smaller
suffix. Each root, extended both ways, is a run if it is long enough; equal ones are one.

Documents are spread over tasks by Spark, whole; a stretch of n dense words takes some 700 n bytes while its trees are built, a document
otherwise a few times its text. Null and empty texts have no words and no runs. Repeated rows get the same result each. A null doc_id is
kept. Empty tables give no rows. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattmill.llm.common import small_batches

LEAST, REPEATS = 6, 4
#: Rounds in which rare words part stretches. Any number gives the same runs; what is left goes to the trees.
ROUNDS = 24
#: Places of a tour that share a block.
BLOCK = 16
WORDS = r"[^\x20\x09-\x0D]+"
RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def dense_stretches(codes: np.ndarray) -> list[tuple[int, int]]:
    """Bounds of stretches that hold every run of a text of coded words."""
    found, todo = [], [(0, len(codes), 0)]
    while todo:
        a, b, depth = todo.pop()
        _, place, counts = np.unique(codes[a:b], return_inverse=True, return_counts=True)
        rare = np.flatnonzero(counts[place] < REPEATS)
        if not len(rare) or depth == ROUNDS:
            found.append((a, b))
            continue
        bounds = np.concatenate(([-1], rare, [b - a]))
        wide = np.flatnonzero(np.diff(bounds) > LEAST)
        todo += [(a + int(bounds[k]) + 1, a + int(bounds[k + 1]), depth + 1) for k in wide]
    return found


def suffix_tree(text: list[int]) -> tuple[dict[int, int], int, list[int], list[int]]:
    """Ukkonen's tree of a text that ends in a symbol of its own, 0: children by node * size + first symbol, the size, and where the label of each node's edge starts and ends."""
    n, size = len(text), max(text) + 1
    child: dict[int, int] = {}
    start, end, link = [0], [0], [0]
    node = edge = length = remaining = 0
    for i, symbol in enumerate(text):
        remaining += 1
        last = 0
        while remaining:
            if not length:
                edge = i
            key = node * size + text[edge]
            below = child.get(key)
            if below is None:
                child[key] = len(start)
                start.append(i)
                end.append(n)
                link.append(0)
                if last:
                    link[last] = node
                last = 0
            else:
                span = end[below] - start[below]
                if length >= span:
                    edge, length, node = edge + span, length - span, below
                    continue
                at = start[below] + length
                if text[at] == symbol:
                    if last:
                        link[last] = node
                    length += 1
                    break
                split = len(start)
                start += (start[below], i)
                end += (at, n)
                link += (0, 0)
                start[below] = at
                child[key] = split
                child[split * size + symbol] = split + 1
                child[split * size + text[at]] = below
                if last:
                    link[last] = split
                last = split
            remaining -= 1
            if node:
                node = link[node]
            elif length:
                length -= 1
                edge = i - remaining + 1
    return child, size, start, end


class Extensions:
    """How many symbols from two places on agree, for arrays of places, and the suffixes' ranks under both orders of the symbols."""

    def __init__(self, text: list[int], ranked: bool = False):
        n = len(text) + 1
        child, size, start, end = suffix_tree([*text, 0])
        keys = sorted(child)  # by node, then by symbol
        kids = [child[k] for k in keys]
        of = np.array(keys, np.int64) // size
        bounds = np.searchsorted(of, np.arange(len(start) + 1)).tolist()
        del child, of
        depth, at, place, leaves, tour, stack = [0] * len(start), bounds[:-1], [0] * n, [], [], [0]
        while stack:
            v = stack[-1]
            d = depth[v]
            k = at[v]
            if k < bounds[v + 1]:
                tour.append(d)
                u = kids[k]
                at[v] = k + 1
                depth[u] = d + end[u] - start[u]
                stack.append(u)
            else:
                if bounds[v] == k:  # a leaf
                    place[n - d] = len(tour)
                    leaves.append(n - d)
                    tour.append(d)
                stack.pop()
        self.place = np.array(place)
        self.ranks = [np.argsort(np.array(leaves)), self._inverse(kids, keys, size, bounds, depth, n)] if ranked else []
        blocks = np.full((len(tour) // BLOCK + 1, BLOCK), n, np.int32)
        blocks.ravel()[: len(tour)] = tour
        self.blocks, self.before, self.after = blocks, np.minimum.accumulate(blocks, axis=1), np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1]
        self.levels = [self.before[:, -1]]
        while (half := 1 << (len(self.levels) - 1)) * 2 <= len(blocks):
            self.levels.append(np.minimum(self.levels[-1][:-half], self.levels[-1][half:]))

    @staticmethod
    def _inverse(kids: list[int], keys: list[int], size: int, bounds: list[int], depth: list[int], n: int) -> np.ndarray:
        """Ranks of suffixes if symbols have the inverse order, but for the end, which stays the smallest."""
        leaves, stack = [], [0]
        while stack:
            v = stack.pop()
            a, b = bounds[v], bounds[v + 1]
            if a == b:
                leaves.append(n - depth[v])
                continue
            stack += kids[a:b]  # the last is taken first
            if keys[a] % size == 0:
                stack.append(stack.pop(a - b))
        return np.argsort(np.array(leaves))

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        a, b = np.minimum(self.place[i], self.place[j]), np.maximum(self.place[i], self.place[j])
        block_a, block_b = a // BLOCK, b // BLOCK
        least = np.minimum(self.after[block_a, a % BLOCK], self.before[block_b, b % BLOCK])
        between = block_b - block_a - 1
        far = np.flatnonzero(between > 0)
        if len(far):
            level = np.int64(np.log2(between[far]))
            for k in np.unique(level).tolist():
                own = far[level == k]
                table = self.levels[k]
                least[own] = np.minimum(least[own], np.minimum(table[block_a[own] + 1], table[block_b[own] - (1 << k)]))
        near = np.flatnonzero(between < 0)
        if len(near):
            rows, x, y = self.blocks[block_a[near]], (a % BLOCK)[near, None], (b % BLOCK)[near, None]
            places = np.arange(BLOCK)
            least[near] = np.where((places >= x) & (places <= y), rows, np.iinfo(np.int32).max).min(axis=1)
        return least.astype(np.int64)


def next_smaller(rank: list[int]) -> np.ndarray:
    """For each place the next one whose suffix is smaller, or the end: the longest Lyndon word from a place on ends there."""
    n = len(rank)
    after = [n] * (n + 1)
    for i in range(n - 2, -1, -1):
        j, r = i + 1, rank[i]
        while j < n and rank[j] > r:
            j = after[j]
        after[i] = j
    return np.array(after[:n], np.int64)


def runs_of_stretch(codes: np.ndarray) -> np.ndarray:
    """Rows (start, length, period) of all runs of a stretch."""
    n = len(codes)
    _, text = np.unique(codes, return_inverse=True)
    text = (text + 1).tolist()
    right = Extensions(text, ranked=True)
    places = np.arange(n)
    roots = []
    for rank in right.ranks:
        period = next_smaller(np.delete(rank, n).tolist()) - places
        some = np.flatnonzero((period * REPEATS <= n) & (places + period < n))
        roots.append(np.stack((some, period[some])))
    at, period = np.unique(np.concatenate(roots, axis=1), axis=1)
    onward = right(at, at + period)
    some = onward >= (REPEATS - 2) * period  # a run's first root has whole copies after it
    at, period, onward = at[some], period[some], onward[some]
    if not len(at):
        return np.zeros((0, 3), np.int64)
    del right
    left = Extensions(text[::-1])
    back = left(n - at, n - at - period)  # place n of the reversal is its end, where nothing agrees
    found = np.stack((at - back, period + onward + back, period), axis=1)
    return np.unique(found[found[:, 1] >= np.maximum(LEAST, REPEATS * found[:, 2])], axis=0)


def runs_of_words(words: list[bytes]) -> np.ndarray:
    """Rows (start, length, period) of all runs of a text's words, by start, then period."""
    code = {w: i for i, w in enumerate(dict.fromkeys(words))}
    if len(words) < LEAST or len(words) - len(code) < LEAST - 1:
        return np.zeros((0, 3), np.int64)
    codes = np.fromiter(map(code.__getitem__, words), np.int32, len(words))
    parts = [runs_of_stretch(codes[a:b]) + (a, 0, 0) for a, b in dense_stretches(codes)]
    found = np.concatenate([np.zeros((0, 3), np.int64), *parts])
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def collapsed(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words that no run repeats, joined by one space."""
    if not len(runs):
        return b" ".join(words)
    change = np.zeros(len(words) + 1, np.int32)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()])


def periodic_runs(docs: DataFrame) -> DataFrame:
    """Per row of `docs`: doc_id, n_words, runs (array of start, length, period, by start, then period), collapsed (text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            sizes, runs, texts = [], [], []
            for text in batch.column("text"):
                words = (text.as_py() or "").encode().split()
                found = runs_of_words(words)
                sizes.append(len(words))
                runs.append([{"start": s, "length": m, "period": p} for s, m, p in found.tolist()])
                texts.append(collapsed(words, found).decode())
            yield pa.record_batch([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(runs, RUNS), pa.array(texts, pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def with_repeats(docs: DataFrame) -> DataFrame:
    """`doc_id` and `text`, where a tenth of the texts (crc32 of the id, h, divisible by 10) repeat from word a on the p words that begin there. Rows without an id keep their text."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    coded = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(WORDS), F.lit(0))).alias("words"))
    placed = coded.withColumn("n", F.size("words").cast("long")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    placed = placed.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    tail = F.expr("slice(flatten(array_repeat(slice(words, int(a + 1), int(p)), int((n - a) div p + 1))), 1, int(n - a))")
    text = F.when(F.col("n") > 0, F.array_join(F.concat(F.expr("slice(words, 1, int(a))"), tail), " ")).otherwise(F.col("text"))
    return placed.select("doc_id", text.alias("text"))


def run_report(docs: DataFrame) -> DataFrame:
    """One row per row of `docs`: doc_id, n_runs; start, length, period and exponent_milli of the longest run (ties: smallest start, then period); digests of all runs and of the collapsed text; n_words."""
    found = periodic_runs(docs)
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r.length).alias("less"), r.start.alias("start"), r.period.alias("period"))))
    line = lambda r: F.concat(F.concat_ws(",", r.start.cast("string"), r.length.cast("string"), r.period.cast("string")), F.lit("\n"))
    told = found.withColumn("best", best)
    length = -F.col("best.less")
    return told.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        length.alias("length"),
        F.col("best.period").alias("period"),
        F.floor(1000 * length / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
        "n_words",
    )
