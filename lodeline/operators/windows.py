"""Rolling, lagged and running features, holdouts and folds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeline.plans.hot_groups import row_frames, row_positions, running


def rolling_stats(
    df: DataFrame,
    *,
    keys: Sequence[str],
    order: Sequence[str],
    cols: Sequence[str],
    rows: int = 10,
    min_periods: int = 10,
) -> DataFrame:
    """Sample stddev and mean of each column over the last ``rows`` rows, and their mean stddev.

    One window specification, so one shuffle and one sort. Rows with fewer than
    ``min_periods`` rows in their frame are left out.
    """

    def build(w):
        frame = w.rowsBetween(1 - rows, 0)
        made = {"_filled": F.count(F.lit(1)).over(frame)}
        for c in cols:
            made[f"{c}_std"] = F.stddev_samp(c).over(frame)
            made[f"{c}_mean"] = F.avg(c).over(frame)
        return made

    made = row_frames(df, keys, order, rows - 1, build).filter(F.col("_filled") >= min_periods)
    texture = sum((F.col(f"{c}_std") for c in cols[1:]), F.col(f"{cols[0]}_std")) / F.lit(float(len(cols)))
    return made.drop("_filled").withColumn("texture_score", texture)


def buffered_only(df: DataFrame, *, keys: Sequence[str], order: Sequence[str], size: int = 10) -> DataFrame:
    """Rows from the ``size``-th of their group on."""
    return row_positions(df, keys, order).filter(F.col("pos") >= size)


def lag_features(
    df: DataFrame, *, keys: Sequence[str], order: Sequence[str], value: str, lags: Sequence[int] = (1, 24)
) -> DataFrame:
    return row_frames(
        df, keys, order, max(lags), lambda w: {f"lag_{n}": F.lag(value, n).over(w) for n in lags}
    )


def rolling_mean(
    df: DataFrame, *, keys: Sequence[str], order: Sequence[str], value: str, rows: int = 7, out: str = "rolling_mean"
) -> DataFrame:
    """Mean of the last ``rows`` rows, NULL until so many non-null values exist."""

    def build(w):
        frame = w.rowsBetween(1 - rows, 0)
        return {out: F.when(F.count(value).over(frame) == rows, F.avg(value).over(frame))}

    return row_frames(df, keys, order, rows - 1, build)


def expanding_mean(
    df: DataFrame, *, keys: Sequence[str] = (), order: Sequence[str], values: dict[str, str | Column]
) -> DataFrame:
    """Running mean of each value: output name -> column."""
    aggs = {}
    for out, v in values.items():
        aggs[f"_s_{out}"], aggs[f"_n_{out}"] = ("sum", v), ("count", v)
    made = running(df, keys, order, aggs)
    made = made.withColumns({out: F.col(f"_s_{out}") / F.nullif(F.col(f"_n_{out}"), F.lit(0)) for out in values})
    return made.drop(*aggs)


def cumulative_events(df: DataFrame, *, order: Sequence[str], event: Column, out: str = "events_so_far") -> DataFrame:
    return running(df, [], order, {out: ("sum", event.cast("long"))})


# ---- holdouts and folds --------------------------------------------------------------


def nth_per_user_split(
    df: DataFrame, *, user: str, order: Sequence[str], start: int, stop: int, max_test: int | None = None
) -> DataFrame:
    """``split``: test for the start-th to stop-th row of each user by arrival, else base.

    With ``max_test`` only the first so many test rows by arrival stay in the test part.
    """
    placed = row_positions(df, [user], order)
    in_test = F.col("pos").between(start, stop)
    if max_test:
        placed = running(placed, [], order, {"_tests": ("sum", in_test.cast("long"))})
        in_test = in_test & (F.col("_tests") <= max_test)
    return placed.withColumn("split", F.when(in_test, "test").otherwise("base")).drop("_tests")


def last_n_holdout(df: DataFrame, *, user: str, order: Sequence[str], n: int) -> DataFrame:
    """``held``: the last ``n`` rows of each user that has more than ``n`` rows."""
    placed = row_positions(df, [user], order, total="_size")
    held = (F.col("_size") > n) & (F.col("pos") > F.col("_size") - n)
    return placed.withColumn("held", held).drop("pos", "_size")


def kfold(df: DataFrame, *, order: Sequence[str], k: int = 5) -> DataFrame:
    """``fold`` 1..k: contiguous blocks of the given order, sizes differing by at most one."""
    placed = row_positions(df, [], order, name="_pos", total="_size")
    size, extra = F.floor(F.col("_size") / k), F.col("_size") % k
    cut = extra * (size + 1)
    first = F.floor((F.col("_pos") - 1) / (size + 1))
    later = extra + F.floor((F.col("_pos") - 1 - cut) / F.nullif(size, F.lit(0)))
    fold = F.when(F.col("_pos") <= cut, first).otherwise(later) + 1
    return placed.withColumn("fold", fold.cast("int")).drop("_pos", "_size")


def chronological_split(df: DataFrame, *, order: Sequence[str], test_size: float = 0.2) -> DataFrame:
    """``split``: train for the first int(n*(1-test_size)) rows, then test."""
    placed = row_positions(df, [], order, name="_pos", total="_size")
    cut = F.floor(F.round(F.col("_size") * (1 - test_size), 6))
    return placed.withColumn("split", F.when(F.col("_pos") <= cut, "train").otherwise("test")).drop("_pos", "_size")


def walk_forward(df: DataFrame, *, order: Sequence[str], n_splits: int = 5) -> DataFrame:
    """``block`` 0..n_splits: block ``j+1`` is the test part of fold ``j``, all lower blocks its train part.

    A row is written once; no copy per fold is made.
    """
    placed = row_positions(df, [], order, name="_pos", total="_size")
    step = F.floor(F.col("_size") / (n_splits + 1))
    first_test = F.col("_size") - n_splits * step
    after = F.floor((F.col("_pos") - 1 - first_test) / F.nullif(step, F.lit(0))) + 1
    block = F.when(F.col("_pos") <= first_test, 0).otherwise(after)
    return placed.withColumn("block", block.cast("int")).drop("_pos", "_size")


def walk_forward_folds(df: DataFrame, *, order: Sequence[str], label: str, n_splits: int = 5) -> DataFrame:
    """Per fold: train and test sizes and positives; ``usable`` is False for one-class parts."""
    blocks = walk_forward(df, order=order, n_splits=n_splits).groupBy("block").agg(
        F.count(F.lit(1)).alias("n"), F.sum(label).alias("p")
    )
    from pyspark.sql import Window

    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    made = blocks.select(
        (F.col("block") - 1).alias("fold"),
        F.sum("n").over(before).alias("train_rows"),
        F.sum("p").over(before).alias("train_positive"),
        F.col("n").alias("test_rows"),
        F.col("p").alias("test_positive"),
    ).filter(F.col("fold") >= 0)
    two = lambda n, p: (p > 0) & (p < n)
    usable = two(F.col("train_rows"), F.col("train_positive")) & two(F.col("test_rows"), F.col("test_positive"))
    return made.withColumn("usable", usable)


def stratified_split(df: DataFrame, *, key: str, label: str, test_size: float = 0.2, seed: int = 42) -> DataFrame:
    """``split`` per class: the first ceil(test_size*n) rows of a seeded hash order are the test part."""
    shuffled = df.withColumn("_h", F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))))
    placed = row_positions(shuffled, [label], ["_h", key], name="_pos", total="_size")
    cut = F.ceil(F.round(F.col("_size") * test_size, 6))
    return placed.withColumn("split", F.when(F.col("_pos") <= cut, "test").otherwise("train")).drop("_pos", "_size", "_h")
