"""SimHash near-duplicates by Golay-code fuzzy hashing.

A fingerprint has 64 bits, by majority over the hashes of all word shingles. Documents link at `MOST` (4) or fewer differing bits; a
component is what links reach. Equal fingerprints are counted as one row before anything is joined.

Candidates: the fingerprint is cut into segments of 22, 21 and 21 bits. A segment, padded to the 23 bits of the perfect binary Golay
code, has as keys the indices of all codewords within 4 bits of it (1 or 6 of them); any two words at 2 or fewer bits share one. By
pigeonhole, two fingerprints at 4 bits or fewer fall in one of these cases, each of which gives a joint key of 33 or 34 bits:
  - some segment has no error and another has at most 2: that segment exactly, with a Golay key of the other;
  - all have errors, (1, 1, 1) or (2, 1, 1) in some order: two segments have 1, so a half of each is exact; these halves with a
    Golay key of the third segment.
Rows of one key are verified on the full fingerprint. In a key's group, links are found by search over what isn't reached yet, and only a spanning
forest goes on: never all pairs. Such edges lose no link between texts. A key's group holds distinct fingerprints that agree in
about 33 bits; 8 bytes each are held while it is searched. Components come from alternating large-star and small-star rounds on
the edges, as Spark joins and grouped minima.

Null and empty texts have fingerprint zero and link like others. Repeated rows get the same result. A null doc_id is never a component's
name unless all its ids are null. Further columns are ignored by the report and kept by `keep_one`.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wattmill.llm.common import small_batches, under_own_names, written

SHINGLE, SEED, MOST = 4, 42, 4
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Generator polynomial of the (23, 12) Golay code, x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GENERATOR = 0b101011100011


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The 64-bit SimHash of a text; 0 without words."""
    words = text.encode().lower().split() if text else []  # bytes: only ASCII letters and spaces count
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    hash_of = xxhash.xxh64_intdigest
    hashes = np.fromiter((hash_of(joined[a:b], seed) for a, b in zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist())), np.uint64, len(words) - shingle + 1)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(sum(1 << bit for bit in np.flatnonzero(2 * counts > len(hashes)).tolist()))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """`docs` and `_s_fp`, the fingerprint as a signed long."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            prints = np.array([fingerprint(t.as_py(), shingle) for t in batch.column("text")], np.uint64).view(np.int64)
            yield pa.record_batch([*batch.columns, pa.array(prints)], [*names, "_s_fp"])

    return docs.mapInArrow(run, docs.withColumn("_s_fp", F.lit(0).cast("long")).schema)


@cache
def golay() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the low 12 and the high 11 bits of a word, and for each syndrome the error patterns of weight 4 or less: 1 or 6 (-1: none)."""
    of_bit = []
    for bit in range(23):
        rest = 1 << bit
        for top in range(22, 10, -1):  # the remainder by the generator polynomial
            rest ^= GENERATOR << (top - 11) if rest >> top & 1 else 0
        of_bit.append(rest)
    table = lambda first, size: np.array([np.bitwise_xor.reduce([0, *(of_bit[first + b] for b in range(size) if n >> b & 1)]) for n in range(1 << size)], np.int64)
    patterns = np.full((1 << 11, 6), -1, np.int64)
    count = [0] * (1 << 11)
    for size in range(5):
        for bits in combinations(range(23), size):
            syndrome = 0
            for b in bits:
                syndrome ^= of_bit[b]
            patterns[syndrome, count[syndrome]] = sum(1 << b for b in bits)
            count[syndrome] += 1
    return table(0, 12), table(12, 11), patterns


def nearby_codewords(words: np.ndarray) -> np.ndarray:
    """For 23-bit words the indices (12 bits) of the codewords within 4 bits, 6 columns, -1 where there are fewer.

    Any 12 neighbouring places of a cyclic code tell its codewords apart, so the upper 12 bits are the index.
    """
    low, high, patterns = golay()
    errors = patterns[low[words & 0xFFF] ^ high[words >> 12]]
    return np.where(errors < 0, -1, (words[:, None] ^ errors) >> 11)


def joint_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All joint keys of fingerprints: the fingerprint's place and the key, without repeats."""
    seg = [((prints >> np.uint64(at)) & np.uint64((1 << size) - 1)).astype(np.int64) for at, size in SEGMENTS]
    near = [nearby_codewords(s) for s in seg]
    places, keys = [], []
    rows = np.arange(len(prints))

    def add(family: int, exact: np.ndarray, codes: np.ndarray) -> None:
        for k in range(codes.shape[1]):
            some = codes[:, k] >= 0
            places.append(rows[some])
            keys.append((np.int64(family) << np.int64(50)) | (exact[some] << np.int64(12)) | codes[some, k])

    family = 0
    for a in range(3):
        for b in range(3):
            if a != b:
                add(family, seg[a], near[b])
                family += 1
    for third in range(3):
        a, b = (i for i in range(3) if i != third)
        for half_a in range(2):
            for half_b in range(2):
                part_a = seg[a] & 0x7FF if half_a else seg[a] >> 11
                part_b = seg[b] & 0x7FF if half_b else seg[b] >> 11
                add(family, part_a << np.int64(11) | part_b, near[third])
                family += 1
    return np.concatenate(places), np.concatenate(keys)


def forest(prints: np.ndarray, most: int = MOST) -> list[tuple[int, int]]:
    """Edges (root, member) that span the links among distinct fingerprints; the root is the smallest of what it reaches."""
    left, edges = np.sort(prints), []
    while len(left) > 1:
        root, left = left[0], left[1:]
        queue = [root]
        while queue and len(left):
            near = np.bitwise_count(left ^ queue.pop()) <= most
            if near.any():
                queue.extend(left[near])
                edges.extend((int(root), int(x)) for x in left[near])
                left = left[~near]
    return edges


def edges(distinct: DataFrame, most: int = MOST) -> DataFrame:
    """Links among distinct fingerprints (`_s_fp`) as spanning edges a, b (a < b as unsigned), by joint keys."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, rows=4000):
            prints = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            places, keys = joint_keys(prints)
            for at in range(0, len(keys), 50_000):
                yield pa.record_batch([pa.array(keys[at : at + 50_000]), pa.array(prints[places[at : at + 50_000]].view(np.int64))], ["key", "fp"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest_key, rest_fp = np.zeros(0, np.int64), np.zeros(0, np.uint64)

        def pairs(key: np.ndarray, fp: np.ndarray) -> list[tuple[int, int]]:
            if len(key) < 2:
                return []
            start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            size = np.diff(np.append(start, len(key)))
            twos = start[size == 2]
            near = twos[np.bitwise_count(fp[twos] ^ fp[twos + 1]) <= most]
            out = [(min(a, b), max(a, b)) for a, b in zip(fp[near].tolist(), fp[near + 1].tolist())]
            for at, n in zip(start[size > 2].tolist(), size[size > 2].tolist()):
                out += forest(np.unique(fp[at : at + n]), most)
            return [(a, b) for a, b in set(out) if a != b]

        def batch_of(found: list[tuple[int, int]]) -> pa.RecordBatch:
            found = np.array(found, np.uint64).reshape(-1, 2)
            return pa.record_batch([pa.array(found[:, 0].copy().view(np.int64)), pa.array(found[:, 1].copy().view(np.int64))], ["a", "b"])

        for batch in batches:  # rows come sorted by key; the last key's group may go on in the next batch
            key = np.concatenate((rest_key, batch.column(0).to_numpy(zero_copy_only=False)))
            fp = np.concatenate((rest_fp, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)))
            if len(key):
                cut = int(np.searchsorted(key, key[-1]))
                rest_key, rest_fp = key[cut:], fp[cut:]
                yield batch_of(pairs(key[:cut], fp[:cut]))
        yield batch_of(pairs(rest_key, rest_fp))

    keyed = distinct.select("_s_fp").mapInArrow(emit, "key long, fp long")
    grouped = keyed.repartition("key").sortWithinPartitions("key")
    return grouped.mapInArrow(verify, "a long, b long").distinct()


def components(links: DataFrame) -> DataFrame:
    """`node`, `root` for all nodes of edges (a, b): alternating stars until nothing changes. Roots are the smallest as signed longs."""
    links = written(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct(), "links")
    before = None
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min(F.least("a", "b")).alias("m"))  # partial minima are taken before the shuffle
        large = both.filter("b > a").join(least, "a").select("m", "b")
        # each node's smallest neighbour takes its others
        down = large.filter("m < b").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a").select(F.explode(F.array(F.struct("a", "m"), F.struct(F.col("b").alias("a"), "m"))).alias("e")).select("e.*")
        links = written(small.filter("m < a").select(F.col("m").alias("a"), F.col("a").alias("b")).distinct(), "links")
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return links.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root"))
        before = now


def with_components(docs: DataFrame, shingle: int = SHINGLE, most: int = MOST) -> DataFrame:
    """`doc_id`, `_s_fp`, `component_id` per row of `docs`."""
    rows = written(fingerprints(docs.select("doc_id", "text"), shingle).select("doc_id", "_s_fp"), "fingerprints")
    distinct = written(rows.groupBy("_s_fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "distinct")
    nodes = written(components(edges(distinct, most)), "nodes")
    member = nodes.unionByName(nodes.select(F.col("root").alias("node"), "root").distinct())
    named = member.join(distinct, member.node == distinct._s_fp).groupBy("root").agg(F.min("first").alias("component_id"))
    linked = member.join(named, "root").select(F.col("node").alias("_s_fp"), F.col("component_id").alias("_linked"))
    names = distinct.filter("n > 1").join(linked, "_s_fp", "full").select("_s_fp", F.coalesce("_linked", "first").alias("_named"))
    return rows.join(names, "_s_fp", "left").select("doc_id", "_s_fp", F.coalesce("_named", "doc_id").alias("component_id"))


def duplicate_report(docs: DataFrame) -> DataFrame:
    """One row per document row: doc_id, fingerprint in hex, component_id."""
    return with_components(docs).select("doc_id", F.lpad(F.lower(F.hex("_s_fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each component: the rows of `docs` whose id names their component, once each (of rows with one id the smallest
    text stays). Rows without an id stay, as none can name them."""
    ids = written(with_components(docs).select("doc_id", "component_id"), "components")
    repeated = ids.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id")
    other = ids.filter("doc_id != component_id").select("doc_id").distinct()
    inner, back = under_own_names(docs, "doc_id", "text")
    once = inner.join(other.unionByName(repeated), "doc_id", "left_anti").select(*back)
    first = Window.partitionBy("doc_id").orderBy(F.col("text").asc_nulls_first())
    again = inner.join(repeated.join(other, "doc_id", "left_anti"), "doc_id", "left_semi").withColumn("_s_n", F.row_number().over(first)).filter("_s_n = 1")
    return once.unionByName(again.select(*back))
