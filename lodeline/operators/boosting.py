"""Gradient-boosted regression trees with patience: histograms from all tasks, one tree per round.

The rows are cut into bins once and stay with the tasks as compact blocks. A level of a tree is one
job: every block adds up gradients per node, feature and bin, the sums are merged as a tree, and only
they (nodes times features times bins, whatever the table) reach the driver, which picks the splits.
Blocks keep the predictions of finished stages; the trees of the current one come with the job. A lost
block is made again from the stored rows and the trees so far.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeline.session import stored

BINS = 256
# Trees that come with a job before blocks take them into their predictions.
STAGE = 25
BLOCK_ROWS = 200_000
PENALTY = 1.0


@dataclass
class Tree:
    """A full tree: ``feature`` and ``cut`` of the inner nodes level by level (-1: no split, go left), leaf values."""

    depth: int
    feature: list[int] = field(default_factory=list)
    cut: list[float] = field(default_factory=list)
    bin: list[int] = field(default_factory=list)
    leaf: list[float] = field(default_factory=list)

    def nodes(self, columns: np.ndarray, cuts: Sequence[float], depth: int | None = None) -> np.ndarray:
        """The node of every row ``depth`` levels down; ``columns`` is one array per feature."""
        at = np.zeros(columns.shape[1], np.int64)
        rows = np.arange(columns.shape[1])
        feature, limit = np.array(self.feature, np.int64), np.array(cuts)
        for level in range(self.depth if depth is None else depth):
            inner = (1 << level) - 1 + at
            f = feature[inner]
            at = 2 * at + ((f >= 0) & (columns[f, rows] > limit[inner]))
        return at


@dataclass
class BoostedTrees:
    """A fitted ensemble, cut at its best round. ``losses`` has the validation error after each round tried."""

    features: list[str]
    base: float
    trees: list[Tree]
    losses: list[float]
    best_loss: float

    @property
    def n_rounds(self) -> int:
        return len(self.trees)

    def predict(self, columns: np.ndarray) -> np.ndarray:
        out = np.full(columns.shape[1], self.base)
        for t in self.trees:
            out += np.array(t.leaf)[t.nodes(columns, t.cut)]
        return out

    def transform(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        """``df`` with the prediction; a missing feature counts as the lowest value."""

        @F.pandas_udf("double")
        def score(parts: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
            for part in parts:
                x = part.to_numpy(float).T
                yield pd.Series(self.predict(np.where(np.isnan(x), -np.inf, x)))

        return df.withColumn(out, score(F.struct(*[F.col(c).cast("double").alias(f"f{i}") for i, c in enumerate(self.features)])))

    def save(self, path: str, spark) -> None:
        spark.createDataFrame([(json.dumps(self, default=vars),)], "model string").coalesce(1).write.mode("overwrite").text(path)

    @staticmethod
    def load(path: str, spark) -> BoostedTrees:
        raw = json.loads(spark.read.text(path).first()[0])
        return BoostedTrees(**{**raw, "trees": [Tree(**t) for t in raw["trees"]]})


def fit(
    df: DataFrame, *, target: str, features: Sequence[str], valid: str, rounds: int = 1000, rate: float = 0.01,
    depth: int = 3, patience: int = 50, bins: int = BINS, penalty: float = PENALTY,
) -> BoostedTrees:
    """Squared-error boosting on the rows where ``valid`` is false, watched on those where it is true.

    A round is a tree of ``depth`` on the gradients, weighted by ``rate``. Training ends ``patience`` rounds
    after the best validation error, or after ``rounds``, and the ensemble is cut at the best round. Without
    validation rows all rounds are trained and kept. Rows without a target are left out; a table without
    training rows raises an error. Splits lie between quantile bins of the features.
    """
    features = list(features)
    lowest = F.lit(float("-inf"))
    cols = [F.coalesce(F.nanvl(F.col(c).cast("double"), lowest), lowest).alias(f"f{i}") for i, c in enumerate(features)]
    rows = df.where(F.col(target).isNotNull()).select(*cols, F.col(target).cast("double").alias("y"), F.col(valid).alias("v"))
    rows = stored(rows, "boosting")
    n, n_valid, base = rows.agg(
        F.count(F.when(~F.col("v"), 1)), F.count(F.when(F.col("v"), 1)), F.avg(F.when(~F.col("v"), F.col("y")))
    ).first()
    if not n:
        raise ValueError("no rows to train on")
    names = [f"f{i}" for i in range(len(features))]
    shares = [i / bins for i in range(1, bins)]
    quantiles = rows.where(~F.col("v")).approxQuantile(names, shares, 0.25 / bins)
    cuts = [np.unique(q) for q in quantiles]
    parts = max(1, -(-(n + n_valid) // BLOCK_ROWS))
    raw = rows.coalesce(parts) if parts < rows.rdd.getNumPartitions() else rows

    def block(part) -> Iterator[tuple]:
        data = np.array([tuple(r) for r in part], float)
        for lo in range(0, len(data), BLOCK_ROWS):
            x = data[lo : lo + BLOCK_ROWS]
            binned = np.array([np.searchsorted(c, x[:, i], "left") for i, c in enumerate(cuts)], np.int16)
            yield binned, x[:, -2], x[:, -1] > 0, np.full(len(x), base)

    blocks = raw.rdd.mapPartitions(block)
    trees: list[Tree] = []
    losses: list[float] = []
    held, pending = None, []

    def advanced(done: list[Tree]):
        """The blocks with the predictions of all trees so far."""
        new = blocks.map(lambda b: (*b[:3], b[3] + _sum(done, b[0]))).persist(StorageLevel.MEMORY_AND_DISK)
        new.count()
        return new

    best, best_at = np.inf, 0
    while True:
        if held is None or len(pending) == STAGE:
            old, held, pending = held, advanced(list(trees)), []
            if old is not None:
                old.unpersist()
        tree, level = Tree(depth), 0
        while level <= depth:
            sums, loss = held.map(_work(list(pending), tree, level, len(features), bins)).treeReduce(_merge)
            if level == 0:
                # What the trees before this one reach on the validation rows.
                losses.append((loss / n_valid) ** 0.5 if n_valid else 0.0)
                if losses[-1] < best - 1e-12 or not n_valid:
                    best, best_at = losses[-1], len(trees)
                if len(trees) == rounds or len(trees) - best_at >= patience:
                    held.unpersist()
                    return BoostedTrees(features, base, trees[:best_at], losses[1:], best)
            if level == depth:
                tree.leaf = [float(-rate * g / (c + penalty)) for g, c in sums.T]
            else:
                _split(tree, sums, cuts, bins, penalty)
            level += 1
        trees.append(tree)
        pending.append(tree)


def _sum(trees: list[Tree], binned: np.ndarray) -> np.ndarray:
    out = np.zeros(binned.shape[1])
    for t in trees:
        out += np.array(t.leaf)[t.nodes(binned, t.bin)]
    return out


def _merge(a, b):
    return a[0] + b[0], a[1] + b[1]


def _work(pending: list[Tree], tree: Tree, level: int, n_features: int, bins: int):
    """A block's sums of gradients and counts: per node, feature and bin; at the last level per leaf."""

    def run(block):
        binned, y, valid, before = block
        gap = before + _sum(pending, binned) - y
        loss = float((gap[valid] ** 2).sum()) if level == 0 else 0.0
        x, g = binned[:, ~valid], gap[~valid]
        at = tree.nodes(x, tree.bin, level)
        width = 1 << level
        if level == tree.depth:
            return np.array([np.bincount(at, g, width), np.bincount(at, minlength=width)]), loss
        sums = np.zeros((2, n_features, width * bins))
        for f in range(n_features):
            key = at * bins + x[f]
            sums[0, f], sums[1, f] = np.bincount(key, g, width * bins), np.bincount(key, minlength=width * bins)
        return sums, loss

    return run


def _split(tree: Tree, sums: np.ndarray, cuts: list[np.ndarray], bins: int, penalty: float) -> None:
    """Add the best split of every node of the next level: the first best by feature, then by cut."""
    g, n = (s.reshape(s.shape[0], -1, bins) for s in sums)
    left_g, left_n = g.cumsum(2), n.cumsum(2)
    all_g, all_n = left_g[:, :, -1:], left_n[:, :, -1:]
    right_g, right_n = all_g - left_g, all_n - left_n
    gain = left_g**2 / (left_n + penalty) + right_g**2 / (right_n + penalty) - all_g**2 / (all_n + penalty)
    gain[(left_n < 1) | (right_n < 1)] = -np.inf
    for node in range(gain.shape[1]):
        f, b = divmod(int(np.argmax(gain[:, node])), bins)
        good = gain[f, node, b] > 1e-12 and b < len(cuts[f])
        tree.feature.append(f if good else -1)
        tree.bin.append(b if good else 0)
        tree.cut.append(float(cuts[f][b]) if good else 0.0)
