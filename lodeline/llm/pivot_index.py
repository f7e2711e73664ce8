"""Embedding near-dedup by a pivot-permutation index.

A bounded sample of the vectors gives reference points (pivots). Every vector is described by its
``NEAREST`` pivots in order of cosine. An inverted list for each two pivots holds the vectors that
have both among theirs, so two vectors of one list share at least two pivots; a vector is in one
list per two of its pivots. Vectors that share a list are verified by their cosine in double
precision; a pair that shares several lists counts in the first of them only.

Copies are indexed once, with their number. Vectors within half the link angle of one pivot all
link with each other by the triangle inequality of angles, so such a cell, however large, is
counted and never compared within itself. Other long lists are cut into blocks and pairs of
blocks are compared in tasks of bounded size. No list is cut short.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeline.llm.components import components
from lodeline.session import stored

PIVOTS = 256
SAMPLE_PER_PIVOT = 8
NEAREST = 5
BLOCK = 1024
MARGIN = 1e-9
"""Cells keep this distance from the limit of the triangle inequality, far above rounding."""


def _usable() -> Column:
    """Whether an embedding has a direction."""
    e = F.col("embedding")
    bad = F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~bad & F.exists(e, lambda x: x != 0), F.lit(False))


def _units(rows) -> np.ndarray:
    x = np.stack([np.asarray(v, np.float64) for v in rows])
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def choose_pivots(classes: DataFrame, threshold: float, pivots: int = PIVOTS) -> dict[int, np.ndarray]:
    """For each vector length, at most ``pivots`` unit vectors, no two within the link angle of each other.

    They come from the classes with the smallest hashes, ``SAMPLE_PER_PIVOT`` times as many as wanted.
    """
    first = Window.partitionBy("dim").orderBy(F.xxhash64("rep"), "rep")
    few = classes.select("dim", "rep").withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= pivots * SAMPLE_PER_PIVOT)
    few = stored(few.select(F.col("rep").alias("_rep"), "rank"), "pivot-ids")
    rows = classes.join(few, classes["rep"] == few["_rep"]).select("dim", "rank", "embedding").collect()
    out: dict[int, np.ndarray] = {}
    for dim in sorted({r["dim"] for r in rows}):
        units = _units([r["embedding"] for r in sorted((r for r in rows if r["dim"] == dim), key=lambda r: r["rank"])])
        picked: list[np.ndarray] = []
        for u in units:
            if len(picked) == pivots:
                break
            if not picked or (np.stack(picked) @ u).max() < threshold:
                picked.append(u)
        out[dim] = np.stack(picked)
    return out


def describe(classes: DataFrame, pivots: dict[int, np.ndarray], threshold: float, nearest: int = NEAREST) -> DataFrame:
    """``classes`` (dim, rep, copies, embedding) with ``near``, their nearest pivots in order, and ``cell``.

    ``cell`` is the nearest pivot if it lies within half the link angle, else -1.
    """
    sent = classes.sparkSession.sparkContext.broadcast(pivots)
    half = float(np.cos(np.arccos(threshold) / 2)) + MARGIN

    def run(parts):
        for pdf in parts:
            near, cell = [None] * len(pdf), np.full(len(pdf), -1)
            dims = pdf["dim"].to_numpy()
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                points = sent.value[int(dim)]
                cos = _units(pdf["embedding"].iloc[at]) @ points.T
                order = np.argsort(-cos, axis=1, kind="stable")[:, :nearest]
                best = cos[np.arange(len(at)), order[:, 0]]
                cell[at] = np.where(best >= half, order[:, 0], -1)
                for i, o in zip(at, order):
                    near[i] = o.astype(np.int32)
            yield pdf.assign(near=near, cell=cell.astype(np.int32))

    ddl = "dim int, rep long, copies long, embedding array<float>, near array<int>, cell int"
    return classes.select("dim", "rep", "copies", "embedding").mapInPandas(run, ddl)


def _lists(described: DataFrame, n_pivots: int) -> DataFrame:
    """A row for each vector and each list it is in; ``list`` is unique over vector lengths."""
    s = F.array_sort("near")
    two = F.flatten(
        F.transform(s, lambda a: F.transform(F.filter(s, lambda b: b > a), lambda b: a.cast("long") * n_pivots + b))
    )
    # With a single pivot there is one list of all.
    two = F.when(F.size("near") < 2, F.array(F.lit(-1).cast("long"))).otherwise(two)
    return described.withColumn("list", F.explode(two)).withColumn("list", F.col("list") * 100_000 + F.col("dim"))


def _shared_first(a: np.ndarray, b: np.ndarray, n_pivots: int) -> np.ndarray:
    """For rows of sorted pivots of two sides: the first list that both are in, -1 with a single pivot."""
    if a.shape[1] < 2:
        return np.full(len(a), -1)
    same = (a[:, :, None] == b[:, None, :]).any(axis=2)
    order = np.cumsum(same, axis=1)
    first = np.take_along_axis(a, np.argmax(same & (order == 1), axis=1)[:, None], 1)[:, 0]
    second = np.take_along_axis(a, np.argmax(same & (order == 2), axis=1)[:, None], 1)[:, 0]
    return first.astype(np.int64) * n_pivots + second


def _local_roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest position that links of positions reach, for each position."""
    root = np.arange(n)
    while True:
        low = root.copy()
        np.minimum.at(low, i, root[j])
        np.minimum.at(low, j, root[i])
        low = low[low]
        if (low == root).all():
            return root
        root = low


def _compare(threshold: float, n_pivots: int):
    """The links within one block or between two blocks of one list."""

    def run(key, rows: pd.DataFrame) -> pd.DataFrame:
        list_id = int(key[0]) // 100_000 if key[0] >= 0 else -1
        rows = rows.sort_values(["side", "rep"], kind="stable").reset_index(drop=True)
        x, reps = _units(rows["embedding"]), rows["rep"].to_numpy()
        near = np.sort(np.stack(list(rows["near"])), axis=1)
        cell, copies, side = rows["cell"].to_numpy(), rows["copies"].to_numpy(), rows["side"].to_numpy()
        left = np.flatnonzero(side == 0)
        right = np.flatnonzero(side == 1) if key[1] != key[2] else left
        found_i, found_j = [], []
        for lo in range(0, len(left), 256):
            own = left[lo : lo + 256]
            hit = x[own] @ x[right].T >= threshold
            hit &= (cell[own][:, None] != cell[right]) | (cell[own] < 0)[:, None]
            if key[1] == key[2]:
                hit &= own[:, None] < right
            a, b = np.nonzero(hit)
            a, b = own[a], right[b]
            mine = _shared_first(near[a], near[b], n_pivots) == list_id
            found_i.append(a[mine])
            found_j.append(b[mine])
        i, j = np.concatenate(found_i or [left[:0]]), np.concatenate(found_j or [left[:0]])
        links = np.zeros(len(rows), np.int64)
        np.add.at(links, i, copies[j])
        np.add.at(links, j, copies[i])
        root = _local_roots(len(rows), i, j)
        any_link = links > 0
        return pd.DataFrame({"rep": reps[any_link], "links": links[any_link], "root": reps[root[any_link]]})

    return run


def _block_pairs(entries: DataFrame, block: int) -> DataFrame:
    """``entries`` once for each pair of blocks that they are compared in: columns list, b1, b2, side and their own.

    A list of at most ``block`` rows is one block. A longer one is cut by hash; the rows of a cell
    that fills a block alone get blocks of their own, and two blocks of one such cell never meet.
    """
    sizes = stored(entries.groupBy("list", "cell").agg(F.count("*").alias("n")), "list-sizes")
    total = sizes.groupBy("list").agg(F.sum("n").alias("all"), F.sum(F.when((F.col("cell") < 0) | (F.col("n") <= block), F.col("n"))).alias("mixed"))
    long_lists = total.where(F.col("all") > block)
    alone = (F.col("cell") >= 0) & (F.col("n") > block)
    parts = sizes.where(alone).select("list", F.col("cell").alias("own"), F.ceil(F.col("n") / block).cast("int").alias("k"))
    mixed = long_lists.where("mixed > 0").select("list", F.lit(-1).alias("own"), F.ceil(F.col("mixed") / block).cast("int").alias("k"))
    parts = stored(parts.join(long_lists.select("list"), "list", "left_semi").unionByName(mixed), "list-parts")

    # Short lists, which are nearly all, need nothing but their own rows.
    short = entries.join(long_lists.select("list"), "list", "left_anti")
    short = short.select("list", F.lit("").alias("b1"), F.lit("").alias("b2"), F.lit(0).alias("side"), "rep", "copies", "embedding", "near", "cell")

    own = parts.select(F.col("list").alias("l1"), F.col("own").alias("own1"), F.col("k").alias("k1"))
    other = parts.select(F.col("list").alias("l2"), F.col("own").alias("own2"), F.col("k").alias("k2"))
    # For a row in block j of part own1: the blocks of the other parts, and of its own if that is mixed.
    rows = entries.join(sizes.where(alone).select("list", "cell", F.lit(True).alias("solo")), ["list", "cell"], "left")
    rows = rows.withColumn("own", F.when(F.col("solo"), F.col("cell")).otherwise(-1))
    meets = own.join(other, (F.col("l1") == F.col("l2")) & ((F.col("own1") != F.col("own2")) | (F.col("own1") == -1)))
    placed = rows.join(meets, (F.col("list") == F.col("l1")) & (F.col("own") == F.col("own1")))
    here = F.pmod(F.xxhash64("rep"), F.col("k1"))
    name = lambda part, i: F.concat_ws(":", F.lpad(part.cast("string"), 6, "0"), F.lpad(i.cast("string"), 9, "0"))
    placed = placed.withColumn("a", name(F.col("own1"), here)).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("k2") - 1)))
    placed = placed.withColumn("c", name(F.col("own2"), F.col("o")))
    placed = placed.select(
        "list", F.least("a", "c").alias("b1"), F.greatest("a", "c").alias("b2"),
        F.when(F.col("a") <= F.col("c"), 0).otherwise(1).alias("side"), "rep", "copies", "embedding", "near", "cell",
    )
    return short.unionByName(placed)


def near_vectors(
    vectors: DataFrame, threshold: float = 0.95, pivots: int = PIVOTS, nearest: int = NEAREST, block: int = BLOCK
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row of ``vectors`` (vec_id, embedding).

    Vectors link at a cosine of at least ``threshold``; every link is verified, and equal vectors
    always link. Null and zero vectors, those with null or non-finite components, and vectors of
    different lengths link with nothing. ``n_links`` counts other vec_ids; rows that repeat a vec_id
    with the same vector are one vector, repeated in the result.
    """
    vectors = vectors.select("vec_id", F.col("embedding").cast("array<float>").alias("embedding"))
    good = vectors.where(_usable())
    classes = good.where("vec_id is not null").groupBy("embedding").agg(
        F.min("vec_id").alias("rep"), F.countDistinct("vec_id").alias("copies")
    )
    classes = stored(classes.select(F.size("embedding").alias("dim"), "rep", "copies", "embedding"), "classes")
    points = choose_pivots(classes, threshold, pivots)
    described = stored(describe(classes, points, threshold, nearest), "described")
    entries = _lists(described, pivots)
    pairs = _block_pairs(entries, block)
    found = stored(
        pairs.groupBy("list", "b1", "b2").applyInPandas(_compare(threshold, pivots), "rep long, links long, root long"), "links"
    )
    cells = described.where("cell >= 0").groupBy("dim", "cell").agg(F.sum("copies").alias("in_cell"), F.min("rep").alias("lowest"))
    cells = stored(cells, "cells")
    inside = stored(described.join(cells, ["dim", "cell"]).select("rep", (F.col("in_cell") - F.col("copies")).alias("links"), F.col("lowest").alias("root")), "inside")
    both = found.unionByName(inside)
    joined = components(both.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    counts = both.groupBy("rep").agg(F.sum("links").alias("links"))
    per = (
        described.select("rep", "copies", "embedding")
        .join(counts, "rep", "left")
        .join(joined.withColumnRenamed("node", "rep"), "rep", "left")
        .select(
            F.col("embedding").alias("_same"),
            (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
            F.coalesce("component", "rep").alias("component_id"),
        )
    )
    per = stored(per, "per-class")
    linked = good.join(per, good["embedding"] == per["_same"], "left").select("vec_id", "n_links", "component_id")
    rest = vectors.where(~_usable()).select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")
    )
    out = linked.unionByName(rest)
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))
