"""A forest for two classes that is trained level by level: histograms from all tasks, all trees at once.

The rows are cut into quantile bins once and stored as blocks of one byte per value. A level of all trees is one
job: a task adds up, tree by tree, how much of each class lies in each bin of the features drawn for each node,
and the sums of a tree meet in one small group that picks its splits. What a row weighs in a tree (drawn with
replacement) follows from the seed, the block and the tree, so nothing is kept per row and tree, and a lost task
finds the same numbers again.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Estimator, Model
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeline.session import stored

BINS = 32
BLOCK_ROWS, LEAST_BLOCK = 65_536, 256
TASK_BLOCKS = 16
# Rows whose arrays stay in the processor's caches.
CHUNK = 16_384
# Chances of 0, 1, 2.. draws of a row, looked up by 16 random bits.
_POISSON = np.cumsum([math.exp(-1.0) / math.factorial(i) for i in range(12)])
DRAWS = np.searchsorted(_POISSON, (np.arange(65_536) + 0.5) / 65_536, "right").astype(np.uint8)


@dataclass
class Trees:
    """Full trees, a row each: ``feature`` and ``bin`` of the inner nodes level by level (bin 255: no split, go left)
    and the share of the second class in each of the lowest nodes."""

    feature: np.ndarray
    bin: np.ndarray
    share: np.ndarray

    def walk(self, tree: int, binned: np.ndarray, first: np.ndarray, depth: int) -> np.ndarray:
        """The node ``depth`` levels down of the rows whose values start at ``first`` in ``binned``."""
        at = np.zeros(len(first), np.int64)
        for level in range(depth):
            lo, hi = (1 << level) - 1, (2 << level) - 1
            value = binned.take(first + self.feature[tree, lo:hi].take(at))
            at = 2 * at + (value > self.bin[tree, lo:hi].take(at))
        return at


def _binned(columns: Sequence[np.ndarray], cuts: Sequence[np.ndarray]) -> np.ndarray:
    """One byte per value, row by row: how many cuts lie below it. Missing values are the lowest."""
    out = np.empty((len(columns[0]), len(cuts)), np.uint8)
    for i, (x, c) in enumerate(zip(columns, cuts)):
        out[:, i] = np.searchsorted(c, np.where(np.isnan(x), -np.inf, x), "left")
    return out


def _weights(seed: int, block: int, tree: int, n: int) -> np.ndarray:
    return DRAWS.take(np.random.default_rng([seed, block, tree]).integers(0, 65_536, n, np.uint16))


def drawn_features(seed: int, tree: int, level: int, n: int, some: int) -> np.ndarray:
    """The ``some`` of ``n`` features that each node of the level may split by."""
    rng = np.random.default_rng([seed, tree, level, 1])
    return np.argsort(rng.random((1 << level, n)), axis=1)[:, :some].astype(np.int64)


def level_sums(
    trees: Trees, tree: int, level: int, binned: np.ndarray, y: np.ndarray, weight: np.ndarray, drawn: np.ndarray, bins: int
) -> np.ndarray:
    """Weights by drawn feature, node, bin and class of a block's rows."""
    width, some = drawn.shape
    flat, n_features = binned.ravel(), binned.shape[1]
    sums = np.zeros((some, width * bins * 2))
    for lo in range(0, len(y), CHUNK):
        in_bag = np.flatnonzero(weight[lo : lo + CHUNK]) + lo
        first, w = in_bag * n_features, weight.take(in_bag).astype(float)
        at = trees.walk(tree, flat, first, level)
        home = at * (2 * bins) + y.take(in_bag)
        for j in range(some):
            value = flat.take(first + drawn[:, j].take(at)).astype(np.int64)
            sums[j] += np.bincount(home + 2 * value, w, sums.shape[1])
    return sums.reshape(some, width, bins, 2)


def best_splits(sums: np.ndarray, drawn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature and bin of the best split by Gini impurity of every node (bin 255: none is better than no split), and the
    share of the second class to its left and right."""
    left = sums.cumsum(2)
    whole = left[:, :, -1:, :]
    right = whole - left

    def pure(part):
        n = part.sum(-1)
        return np.divide((part**2).sum(-1), n, out=np.zeros_like(n), where=n > 0)

    gain = pure(left) + pure(right) - pure(whole)
    gain[(left.sum(-1) < 1) | (right.sum(-1) < 1)] = 0
    some, width, bins = gain.shape
    flat = gain.transpose(1, 0, 2).reshape(width, -1)
    best, node = flat.argmax(1), np.arange(width)
    j, b = np.divmod(best, bins)
    good = flat[node, best] > 1e-9
    share = lambda part: np.divide(part[:, 1], part.sum(-1), out=np.zeros(width), where=part.sum(-1) > 0)
    mine = share(whole[0, :, 0])
    low, high = share(left[j, node, b]), share(right[j, node, b])
    shares = np.column_stack([np.where(good, low, mine), np.where(good, high, mine)]).ravel()
    return np.where(good, drawn[node, j], 0), np.where(good, b, 255), shares


def _blocks(df: DataFrame, features: Sequence[str], label: str, cuts: list[np.ndarray], n: int) -> DataFrame:
    """(block, x, y): the ``n`` rows binned, in blocks that are dealt over all cores."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    rows = min(BLOCK_ROWS, max(LEAST_BLOCK, n // (4 * cores)))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def made():
            x, y = (np.concatenate([h[i] for h in held]) for i in (0, 1))
            return pa.RecordBatch.from_pydict({"x": pa.array([x.tobytes()]), "y": pa.array([y.tobytes()])})

        for part in parts:
            at = 0
            while at < part.num_rows:
                some = part.slice(at, rows - n)
                at, n = at + some.num_rows, n + some.num_rows
                columns = [some.column(i).to_numpy(zero_copy_only=False).astype(float) for i in range(len(features) + 1)]
                held.append((_binned(columns[1:], cuts), columns[0].astype(np.uint8)))
                if n == rows:
                    yield made()
                    held, n = [], 0
        if held:
            yield made()

    slim = df.select(F.col(label).cast("double"), *[F.col(c).cast("double") for c in features])
    tasks = cores * max(1, -(-n // (cores * rows * TASK_BLOCKS)))
    dealt = slim.mapInArrow(run, "x binary, y binary").repartition(tasks)
    return stored(dealt.select(F.monotonically_increasing_id().alias("block"), "x", "y"), "blocks")


def fit(
    df: DataFrame, *, features: Sequence[str], label: str, trees: int = 300, depth: int = 5, bins: int = BINS, seed: int = 42
) -> tuple[Trees, list[np.ndarray]]:
    """Trees of ``depth`` on rows drawn with replacement, and the cuts between the bins; ``label`` is 0 or 1.

    Every node splits by the best of a few features drawn for it (the root of their number), between quantiles.
    """
    features = list(features)
    n = df.count()
    shares = [i / bins for i in range(1, bins)]
    cuts = [np.unique(q) for q in df.select([F.col(c).cast("double") for c in features]).approxQuantile(features, shares, 0.25 / bins)]
    blocks = _blocks(df, features, label, cuts, n)
    some = math.ceil(math.sqrt(len(features)))
    made = Trees(np.zeros((trees, 0), np.int64), np.zeros((trees, 0), np.uint8), np.zeros((trees, 0)))
    for level in range(depth):
        job = blocks.mapInArrow(_adder(made, level, len(features), some, bins, seed), "tree int, sums binary")
        picked = job.groupBy("tree").applyInArrow(
            _picker(level, len(features), some, bins, seed), "tree int, feature array<int>, bin array<int>, share array<double>"
        )
        rows = sorted(picked.collect(), key=lambda r: r["tree"])
        made = Trees(
            np.column_stack([made.feature, np.array([r["feature"] for r in rows], np.int64)]),
            np.column_stack([made.bin, np.array([r["bin"] for r in rows], np.uint8)]),
            np.array([r["share"] for r in rows]),
        )
    return made, cuts


def _adder(trees: Trees, level: int, n_features: int, some: int, bins: int, seed: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_trees = len(trees.feature)
        drawn = [drawn_features(seed, t, level, n_features, some) for t in range(n_trees)]
        sums, seen = np.zeros((n_trees, some, 1 << level, bins, 2)), False
        for part in parts:
            for block, x, y in zip(*(part.column(i).to_pylist() for i in range(3))):
                y, seen = np.frombuffer(y, np.uint8), True
                x = np.frombuffer(x, np.uint8).reshape(len(y), n_features)
                for t in range(n_trees):
                    sums[t] += level_sums(trees, t, level, x, y, _weights(seed, block, t, len(y)), drawn[t], bins)
        if seen:
            for t in range(n_trees):
                yield pa.RecordBatch.from_pydict({"tree": pa.array([t], pa.int32()), "sums": pa.array([sums[t].astype(np.int64).tobytes()])})

    return run


def _picker(level: int, n_features: int, some: int, bins: int, seed: int):
    def run(table: pa.Table) -> pa.Table:
        tree = table["tree"][0].as_py()
        sums = np.sum([np.frombuffer(s.as_py(), np.int64) for s in table["sums"]], axis=0).reshape(some, 1 << level, bins, 2)
        feature, cut, share = best_splits(sums.astype(float), drawn_features(seed, tree, level, n_features, some))
        types = {"feature": pa.list_(pa.int32()), "bin": pa.list_(pa.int32()), "share": pa.list_(pa.float64())}
        made = {n: pa.array([v.tolist()], t) for (n, t), v in zip(types.items(), (feature, cut, share))}
        return pa.table({"tree": pa.array([tree], pa.int32()), **made})

    return run


class BinaryForest(Estimator):
    """``fit`` as an estimator, for pipelines."""

    def __init__(self, *, features: Sequence[str], label: str, trees: int = 300, depth: int = 5, seed: int = 42):
        super().__init__()
        self.args = dict(features=list(features), label=label, trees=trees, depth=depth, seed=seed)

    def _fit(self, dataset: DataFrame) -> ForestModel:
        trees, cuts = fit(dataset, **self.args)
        return ForestModel(self.args["features"], trees, cuts)


class ForestModel(Model):
    """Adds ``score``: the mean share of the second class over all trees."""

    def __init__(self, features: list[str], trees: Trees, cuts: list[np.ndarray]):
        super().__init__()
        self.features, self.trees, self.cuts = features, trees, cuts

    def _transform(self, dataset: DataFrame) -> DataFrame:
        trees, cuts = self.trees, self.cuts
        depth = trees.share.shape[1].bit_length() - 1

        @F.pandas_udf("double")
        def score(parts: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
            for part in parts:
                x = part.to_numpy(float)
                flat, first = _binned(list(x.T), cuts).ravel(), np.arange(len(x)) * len(cuts)
                total = np.zeros(len(x))
                for t in range(len(trees.share)):
                    total += trees.share[t].take(trees.walk(t, flat, first, depth))
                yield pd.Series(total / max(1, len(trees.share)))

        return dataset.withColumn("score", score(F.struct(*[F.col(c).cast("double").alias(f"f{i}") for i, c in enumerate(self.features)])))
