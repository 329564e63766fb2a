"""Boosted regression trees, many models in step: one level of all models is one aggregate of gradient sums over (model, node, feature, bin).

Models differ in the days that they train on and in the features that they see; rows are binned once and shared. Each level is a job: tasks add up their
rows' residuals by model, node, feature and bin, the sums are dealt by model and the best split of every node comes back, some numbers a model. So the
driver holds trees and split numbers, never rows, and a task holds a batch of rows and one table of sums, whatever the number of rows.

Where no model trains on more than `ALONE_ROWS` rows (counted before), rows are dealt by model instead and a task grows all trees of one, which saves hundreds of
small jobs. Sums are the same, so trees are, too.

Residuals are integers (the label times a power of two), so sums don't depend on their order: trees are the same however rows are dealt and however often a
task is run again. Predictions so far are part of the rows' table, which is written anew every `KEEP` trees into the shared folder; trees since then are added again by each
job. A job's shuffle is bounded by tasks x models x nodes x features x bins.
"""

from __future__ import annotations

import datetime
import math
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wattmill.staging import written

#: Trees of a model, their depth, shrinkage, ridge on leaves and fewest rows of a child; bins of a feature.
TREES, DEPTH, RATE, RIDGE, LEAST_ROWS, BINS = 180, 4, 0.04, 0.1, 20, 32
#: Trees after which predictions are written; rows of a task; models whose sums one task adds up.
KEEP, TASK_ROWS, TASK_MODELS = 12, 3_000, 32
#: Training rows of a model up to which one task grows its trees: some 100 bytes a row.
ALONE_ROWS = 200_000
#: Bits of the largest label as an integer.
BITS = 30


@dataclass(frozen=True)
class Model:
    """Trains on days from `first_train` up to `first_test`, and sees the features (numbers in the list of columns) in `seen`."""

    name: str
    fold: int
    first_train: datetime.date
    first_test: datetime.date
    last_test: datetime.date
    seen: tuple[int, ...]


@dataclass(frozen=True)
class Trees:
    """For each tree and model: feature and last left bin of the inner nodes (feature -1: all rows go left), and the leaves; `scale` turns labels into integers."""

    features: np.ndarray
    bins: np.ndarray
    leaves: np.ndarray
    base: np.ndarray
    scale: float
    edges: tuple[tuple[float, ...], ...]


def bin_edges(rows: DataFrame, columns: Sequence[str], bins: int = BINS) -> tuple[tuple[float, ...], ...]:
    """Upper edges of each column's bins but the last, by quantiles; columns of few values get a bin each."""
    at = [k / bins for k in range(1, bins)]
    found = rows.agg(*(F.percentile_approx(c, at, 10_000).alias(f"e{i}") for i, c in enumerate(columns)), *(F.max(c).alias(f"m{i}") for i, c in enumerate(columns))).first()
    return tuple(tuple(sorted({float(e) for e in found[f"e{i}"] or () if e < found[f"m{i}"]})) for i in range(len(columns)))


def binned(rows: DataFrame, columns: Sequence[str], edges: Sequence[Sequence[float]], keys: Sequence[str]) -> DataFrame:
    """`keys`, and `codes`: a byte a column, the number of edges below the value."""

    def below(column: str, own: Sequence[float]) -> Column:
        return F.size(F.filter(F.array(*map(F.lit, own)), lambda x: x < F.col(column))) if own else F.lit(0)

    return rows.select(*keys, F.unhex(F.concat(*(F.lpad(F.hex(below(c, e)), 2, "0") for c, e in zip(columns, edges)))).alias("codes"))


@contextmanager
def _plain_plans(spark: SparkSession):
    """Jobs of a known number of tasks need no plan made anew between their stages: hundreds of small jobs are quicker without."""
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        yield
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)


def fit(rows: DataFrame, models: Sequence[Model], columns: Sequence[str], label: str, edges: Sequence[Sequence[float]] | None = None, trees: int = TREES, depth: int = DEPTH, rate: float = RATE, least: int = LEAST_ROWS, alone: int = ALONE_ROWS) -> Trees:
    """All models from `rows` (date, label, columns; none of them null). Without `edges` bins are made of the days on which all models train."""
    common = rows.filter((F.col("date") >= max(m.first_train for m in models)) & (F.col("date") < min(m.first_test for m in models)))
    edges = tuple(map(tuple, edges)) if edges is not None else bin_edges(common, columns)
    size = rows.agg(F.count("*").alias("n"), F.max(F.abs(label)).alias("most")).first()
    scale = 2.0 ** (BITS - math.frexp(size.most or 1.0)[1])
    spans = [((m.first_train - datetime.date(1970, 1, 1)).days, (m.first_test - datetime.date(1970, 1, 1)).days) for m in models]
    widths = [len(e) + 1 for e in edges]
    offsets = np.concatenate(([0], np.cumsum(widths)))
    n_models, inner = len(models), (1 << depth) - 1
    seen = [np.array(m.seen, np.int64) for m in models]

    def arrays(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        codes = np.frombuffer(b"".join(batch.column("codes").to_pylist()), np.uint8).reshape(batch.num_rows, len(columns))
        return batch.column("day").to_numpy(zero_copy_only=False), batch.column("y").to_numpy(zero_copy_only=False), codes

    def node_of(tree_features: np.ndarray, tree_bins: np.ndarray, codes: np.ndarray, levels: int) -> np.ndarray:
        node, every = np.zeros(len(codes), np.int64), np.arange(len(codes))
        for level in range(levels):
            at = (1 << level) - 1 + node
            feature = tree_features[at]
            node = 2 * node + ((feature >= 0) & (codes[every, feature] > tree_bins[at]))
        return node

    def cell_sums(residual: np.ndarray, cells: np.ndarray, node: np.ndarray, nodes: int) -> np.ndarray:
        """Sums of residuals and numbers of rows by node and bin."""
        width = int(offsets[-1])
        sums = np.zeros((2, nodes * width), np.int64)
        for start in range(0, len(residual), 50_000):  # 50,000 residuals of 31 bits add up exactly
            own = slice(start, start + 50_000)
            at = (node[own, None] * width + cells[own]).ravel()
            sums[0] += np.bincount(at, np.repeat(residual[own], cells.shape[1]), nodes * width).astype(np.int64)
            sums[1] += np.bincount(at, minlength=nodes * width)
        return sums

    def best_of(m: int, sums: np.ndarray, nodes: int) -> np.ndarray:
        """A model's split of largest gain by node (ties: smaller feature, then bin): feature, bin, sum and count of the left side, sum and count of all."""
        g, n = sums.reshape(2, nodes, int(offsets[-1]))
        first = seen[m][0]
        all_g, all_n = (x[:, offsets[first] : offsets[first + 1]].sum(1) for x in (g, n))
        gain, chosen = np.zeros(nodes), np.stack([np.full(nodes, -1), np.zeros(nodes, np.int64), all_g, all_n])
        whole = all_g.astype(float) ** 2 / (all_n + RIDGE)
        for f in seen[m].tolist():
            if widths[f] < 2:
                continue
            left_g, left_n = (x[:, offsets[f] : offsets[f + 1] - 1].cumsum(1) for x in (g, n))
            right_g, right_n = all_g[:, None] - left_g, all_n[:, None] - left_n
            gains = left_g.astype(float) ** 2 / (left_n + RIDGE) + right_g.astype(float) ** 2 / (right_n + RIDGE) - whole[:, None]
            gains = np.where((left_n >= least) & (right_n >= least), gains, -1.0)
            at = gains.argmax(1)
            top = gains[np.arange(nodes), at]
            better = top > gain
            gain = np.where(better, top, gain)
            found = np.stack([np.full(nodes, f), at, left_g[np.arange(nodes), at], left_n[np.arange(nodes), at]])
            chosen = np.where(better, found, chosen)
        return np.concatenate([chosen, np.stack([all_g, all_n])]).astype(np.int64)

    def taken(chosen: np.ndarray, f: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Enters a level's splits into a tree; the children's sums and counts."""
        nodes = chosen.shape[1]
        at = slice(nodes - 1, 2 * nodes - 1)
        f[at], b[at] = chosen[0], chosen[1]
        children = np.zeros((2, 2 * nodes), np.int64)
        children[:, 0::2], children[:, 1::2] = chosen[2:4], chosen[4:6] - chosen[2:4]
        return children

    def leaves_of(children: np.ndarray) -> np.ndarray:
        return np.rint(rate * children[0] / (children[1] + RIDGE)).astype(np.int64)

    def grown(group: pa.Table) -> pa.Table:
        """All trees of the model whose training rows these are."""
        m, group = group.column("model")[0].as_py(), group.combine_chunks()
        _, y, codes = arrays(group)
        residual, cells = y - base[m], codes[:, seen[m]] + offsets[seen[m]]
        made = []
        for _ in range(trees):
            f, b = np.full(inner, -1, np.int64), np.zeros(inner, np.int64)
            for level in range(depth):
                node = node_of(f, b, codes, level)
                children = taken(best_of(m, cell_sums(residual, cells, node, 1 << level), 1 << level), f, b)
            leaf = leaves_of(children)
            residual = residual - leaf[node_of(f, b, codes, depth)]
            made.append(np.concatenate((f, b, leaf)))
        return pa.table({"model": pa.array([m], pa.int32()), "trees": pa.array([np.stack(made).tobytes()], pa.binary())})

    def with_predictions(added: list[tuple[np.ndarray, np.ndarray, np.ndarray]], base: np.ndarray):
        """Adds trees to the predictions that rows carry."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                _, _, codes = arrays(batch)
                if "so_far" in batch.schema.names:
                    so_far = np.frombuffer(b"".join(batch.column("so_far").to_pylist()), np.int64).reshape(batch.num_rows, n_models).copy()
                else:
                    so_far = np.repeat(base[None, :], batch.num_rows, axis=0)
                for f, b, leaf in added:
                    for m in range(n_models):
                        so_far[:, m] += leaf[m][node_of(f[m], b[m], codes, depth)]
                flat = so_far.tobytes()
                step = 8 * n_models
                yield pa.record_batch([batch.column("day"), batch.column("y"), batch.column("codes"), pa.array([flat[i : i + step] for i in range(0, len(flat), step)], pa.binary())], ["day", "y", "codes", "so_far"])

        return run

    def partial_sums(added: list[tuple[np.ndarray, np.ndarray, np.ndarray]], now: tuple[np.ndarray, np.ndarray], level: int):
        """One row a task and model: sums of residuals and numbers of rows by node and bin."""
        nodes, width = 1 << level, int(offsets[-1])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros((n_models, 2, nodes * width), np.int64)
            for batch in batches:
                day, y, codes = arrays(batch)
                so_far = np.frombuffer(b"".join(batch.column("so_far").to_pylist()), np.int64).reshape(batch.num_rows, n_models)
                for m, (first, end) in enumerate(spans):
                    own = np.flatnonzero((day >= first) & (day < end))
                    residual = y[own] - so_far[own, m]
                    own_codes = codes[own]
                    for f, b, leaf in added:
                        residual -= leaf[m][node_of(f[m], b[m], own_codes, depth)]
                    sums[m] += cell_sums(residual, own_codes[:, seen[m]] + offsets[seen[m]], node_of(now[0][m], now[1][m], own_codes, level), nodes)
            yield pa.record_batch([pa.array(range(n_models), pa.int32()), pa.array([s.tobytes() for s in sums], pa.binary())], ["model", "sums"])

        return run

    def best_splits(level: int):
        """The splits of each model by its tasks' sums."""
        nodes = 1 << level

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            totals: dict[int, np.ndarray] = {}
            for batch in batches:
                for m, s in zip(batch.column("model").to_pylist(), batch.column("sums").to_pylist()):
                    totals[m] = totals.get(m, 0) + np.frombuffer(s, np.int64)
            out = [(m, best_of(m, s, nodes).tobytes()) for m, s in totals.items()]
            yield pa.record_batch([pa.array([m for m, _ in out], pa.int32()), pa.array([s for _, s in out], pa.binary())], ["model", "splits"])

        return run

    tasks = max(1, -(-size.n // TASK_ROWS))
    y = F.round(F.col(label) * scale).cast("long")
    table = binned(rows.withColumns({"day": F.unix_date("date"), "y": y}), columns, edges, ("day", "y"))
    table = written(table.repartition(tasks), "boost-rows")
    counts = table.agg(*(F.struct(F.coalesce(F.sum(F.when(F.col("day").between(a, b - 1), F.col("y"))), F.lit(0)).alias("y"), F.count_if(F.col("day").between(a, b - 1)).alias("n")).alias(f"m{i}") for i, (a, b) in enumerate(spans))).first()
    base = np.array([round(c.y / c.n) if c.n else 0 for c in counts], np.int64)
    if trees and max((c.n for c in counts), default=0) <= alone:
        own = F.filter(F.array(*(F.when(F.col("day").between(a, b - 1), F.lit(m)) for m, (a, b) in enumerate(spans))), lambda m: m.isNotNull())
        by_model = table.withColumn("model", F.explode(own)).repartition(n_models, "model").groupBy("model")
        found = {r.model: np.frombuffer(r.trees, np.int64).reshape(trees, -1) for r in by_model.applyInArrow(grown, "model int, trees binary").collect()}
        none = np.tile(np.concatenate((np.full(inner, -1), np.zeros(2 * inner + 1, np.int64))), (trees, 1))
        every = np.stack([found.get(m, none) for m in range(n_models)], 1)
        return Trees(every[..., :inner], every[..., inner : 2 * inner], every[..., 2 * inner :], base, scale, edges)
    schema = "day int, y long, codes binary, so_far binary"
    table = written(table.mapInArrow(with_predictions([], base), schema), "boost-rows").persist()  # read by every level; what is lost is read again from the written table
    done, kept = [], 0
    for tree in range(trees):
        f, b = np.full((n_models, inner), -1, np.int64), np.zeros((n_models, inner), np.int64)
        for level in range(depth):
            parts = table.mapInArrow(partial_sums(done[kept:], (f, b), level), "model int, sums binary")
            with _plain_plans(rows.sparkSession):
                splits = parts.repartition(-(-n_models // TASK_MODELS), "model").mapInArrow(best_splits(level), "model int, splits binary").collect()
            children = np.zeros((n_models, 2, 2 << level), np.int64)
            for row in splits:
                children[row.model] = taken(np.frombuffer(row.splits, np.int64).reshape(6, -1), f[row.model], b[row.model])
        done.append((f, b, np.stack([leaves_of(c) for c in children])))
        if len(done) - kept == KEEP and tree + 1 < trees:
            before, kept = table, len(done)
            table = written(before.mapInArrow(with_predictions(done[-KEEP:], base), schema), "boost-rows").persist()
            before.unpersist()
    table.unpersist()
    stack = lambda i, shape: np.stack([t[i] for t in done]) if done else np.zeros((0, n_models, shape), np.int64)
    return Trees(stack(0, inner), stack(1, inner), stack(2, inner + 1), base, scale, edges)


def predict(rows: DataFrame, fitted: Trees, models: Sequence[Model], columns: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """`keys`, model, fold and prediction for every row (column date among the keys) in the test days of a model."""
    names = [(m.name, m.fold, (m.first_test - datetime.date(1970, 1, 1)).days, (m.last_test - datetime.date(1970, 1, 1)).days) for m in models]
    depth = int(fitted.leaves.shape[2]).bit_length() - 1
    features, bins, leaves, base, scale, width = fitted.features, fitted.bins, fitted.leaves, fitted.base, fitted.scale, len(columns)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = np.frombuffer(b"".join(batch.column("codes").to_pylist()), np.uint8).reshape(batch.num_rows, width)
            day = batch.column("_day").to_numpy(zero_copy_only=False)
            for m, (name, fold, first, last) in enumerate(names):
                own = np.flatnonzero((day >= first) & (day <= last))
                if not len(own):
                    continue
                total, every = np.full(len(own), base[m]), np.arange(len(own))
                for t in range(len(features)):
                    node = np.zeros(len(own), np.int64)
                    for level in range(depth):
                        at = (1 << level) - 1 + node
                        feature = features[t, m][at]
                        node = 2 * node + ((feature >= 0) & (codes[own][every, feature] > bins[t, m][at]))
                    total = total + leaves[t, m][node]
                kept = [batch.column(k).take(pa.array(own)) for k in keys]
                yield pa.record_batch([*kept, pa.array([name] * len(own)), pa.array([fold] * len(own), pa.int64()), pa.array(total / scale)], [*keys, "model", "fold", "prediction"])

    coded = binned(rows.withColumn("_day", F.unix_date("date")), columns, fitted.edges, (*keys, "_day"))
    return coded.mapInArrow(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", model string, fold long, prediction double")
