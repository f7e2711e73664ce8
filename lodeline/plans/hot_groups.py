"""Order-dependent computations on groups of any size.

A window function sends each group to one task. That is the right plan while groups
are small, and it stops working when one key holds a large share of the table. Every
function here therefore looks at the group sizes first. Groups that fit one task
(``max_group_rows``) get a plain window: one shuffle, one sort. Longer groups are cut
into blocks along their order, every block is handled by its own task, and what a row
needs from earlier blocks comes from a table with one row per block.

``order`` is a list of ascending columns that together identify a row within its
group; sort numbers downwards by negating them.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeline.plans.layout import dealt
from lodeline.session import max_group_rows

# Upper bound on the blocks of one table, hence on the rows of every block table that
# is broadcast. If more groups are too long, the longest ones are split.
MAX_BLOCKS = 20_000
SAMPLE_PER_BLOCK = 16
# Rows that one task of a running aggregate sorts, on average.
WINDOW_ROWS = 500_000
_ALL = "_all"
_BLK = "_blk"


def _as_column(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


class Split:
    """``cold``: rows of groups that fit a task; ``hot``: rows of the others, or None.

    Both carry the order columns ``ord``; ``hot`` also carries a block number that
    grows with the order.
    """

    def __init__(self, cold: DataFrame, hot: DataFrame | None, keys: list[str], ord_: list[str], limit: int):
        self.cold, self.hot, self.keys, self.ord, self.limit = cold, hot, keys, ord_, limit

    def finish(self, cold: DataFrame, hot: DataFrame | None) -> DataFrame:
        out = cold if hot is None else cold.unionByName(hot.select(*[F.col(f"`{c}`") for c in cold.columns]))
        drop = [*self.ord, _BLK]
        if self.keys == [_ALL]:
            drop.append(_ALL)
        return out.drop(*drop)


def split_groups(
    df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], limit: int | None = None
) -> Split:
    """Separate over-long groups and number the blocks of their rows."""
    spark = df.sparkSession
    limit = limit or max_group_rows(spark)
    keys = list(keys)
    if not keys:
        df, keys = df.withColumn(_ALL, F.lit(0)), [_ALL]
    names = [f"_ord{i}" for i in range(len(order))]
    df = df.withColumns({n: _as_column(c) for n, c in zip(names, order)})

    # At most rows/limit groups are longer than limit, and never more than MAX_BLOCKS.
    sizes = df.groupBy(*keys).count().filter(F.col("count") > limit)
    long_groups = sizes.orderBy(F.desc("count")).limit(MAX_BLOCKS).collect()
    if not long_groups:
        return Split(df, None, keys, names, limit)

    total = sum(r["count"] for r in long_groups)
    block_rows = max(limit, math.ceil(total / MAX_BLOCKS))
    if keys == [_ALL]:
        return Split(df.filter(F.lit(False)), _with_blocks(df, keys, names, block_rows), keys, names, limit)
    key_schema = T.StructType([T.StructField(k, df.schema[k].dataType) for k in keys])
    hot_keys = spark.createDataFrame([tuple(r[k] for k in keys) for r in long_groups], key_schema)
    same = _same_key(df, hot_keys, keys)
    hot = df.join(F.broadcast(hot_keys), same, "left_semi")
    cold = df.join(F.broadcast(hot_keys), same, "left_anti")
    return Split(cold, _with_blocks(hot, keys, names, block_rows), keys, names, limit)


def _same_key(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    cond = F.lit(True)
    for k in keys:
        cond = cond & left[k].eqNullSafe(right[k])
    return cond


def _with_blocks(hot: DataFrame, keys: list[str], ord_: list[str], block_rows: int) -> DataFrame:
    """Number the blocks by cut points taken from a sample of each long group.

    The sample only chooses where to cut; every row lands in exactly one block. The cut
    points are collected (at most MAX_BLOCKS) so that all uses of the plan see the same.
    """
    spark = hot.sparkSession
    point = F.struct(*ord_).alias("_p")
    fraction = min(1.0, SAMPLE_PER_BLOCK / block_rows)
    ranked = hot.select(*keys, point).sample(fraction=fraction, seed=7).withColumn(
        "_r", F.row_number().over(Window.partitionBy(*keys).orderBy("_p"))
    )
    step = max(1, round(fraction * block_rows))
    cuts = ranked.filter(F.col("_r") % step == 0).select(*keys, "_p").collect()
    by_key: dict[tuple, list] = {}
    for r in cuts:
        by_key.setdefault(tuple(r[k] for k in keys), []).append(r["_p"])

    # Two levels of cut points keep the lookup at about 2*sqrt(blocks) comparisons.
    rows = []
    width = 1
    for points in by_key.values():
        width = max(width, math.isqrt(len(points)) + 1)
    for key, points in by_key.items():
        points.sort(key=lambda p: tuple((v is not None, v) for v in p))
        groups = [points[i : i + width] for i in range(0, len(points), width)]
        rows.append((*key, [g[0] for g in groups], groups))
    point_type = hot.select(point).schema["_p"].dataType
    schema = T.StructType(
        [T.StructField(k, hot.schema[k].dataType) for k in keys]
        + [
            T.StructField("_top", T.ArrayType(point_type)),
            T.StructField("_cuts", T.ArrayType(T.ArrayType(point_type))),
        ]
    )
    cut_table = spark.createDataFrame(rows, schema)
    cut_table = cut_table.select(*[F.col(k).alias(f"_c_{k}") for k in keys], "_top", "_cuts")
    cond = F.lit(True)
    for k in keys:
        cond = cond & hot[k].eqNullSafe(cut_table[f"_c_{k}"])
    here = F.struct(*ord_)
    top = F.size(F.filter("_top", lambda p: p <= here))
    fine = F.size(F.filter(F.get(F.col("_cuts"), F.col("_t") - 1), lambda p: p <= here))
    return (
        hot.join(F.broadcast(cut_table), cond, "left")
        .withColumn("_t", F.when(F.col("_top").isNull(), 0).otherwise(top))
        .withColumn(_BLK, F.when(F.col("_t") == 0, 0).otherwise((F.col("_t") - 1) * (width + 1) + fine))
        .drop("_top", "_cuts", "_t", *[f"_c_{k}" for k in keys])
    )


def join_blocks(hot: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """Attach the block table (at most MAX_BLOCKS rows plus one per group) by broadcast."""
    renamed = table.select(
        *[F.col(k).alias(f"_b_{k}") for k in keys],
        F.col(_BLK).alias("_b_blk"),
        *[c for c in table.columns if c not in (*keys, _BLK)],
    )
    cond = hot[_BLK] == renamed["_b_blk"]
    for k in keys:
        cond = cond & hot[k].eqNullSafe(renamed[f"_b_{k}"])
    return hot.join(F.broadcast(renamed), cond, "inner").drop("_b_blk", *[f"_b_{k}" for k in keys])


def row_positions(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    name: str = "pos",
    total: str | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Add the 1-based position of each row in its group, and the group size if asked."""
    s = split_groups(df, keys, order, limit)
    cold = s.cold.withColumn(name, F.row_number().over(Window.partitionBy(*s.keys).orderBy(*s.ord)).cast("long"))
    if total:
        cold = cold.withColumn(total, F.count(F.lit(1)).over(Window.partitionBy(*s.keys)))
    return s.finish(cold, _hot_positions(s, name, total))


def _hot_positions(s: Split, name: str, total: str | None) -> DataFrame | None:
    if s.hot is None:
        return None
    by_block = Window.partitionBy(*s.keys).orderBy(_BLK)
    sizes = s.hot.groupBy(*s.keys, _BLK).agg(F.count(F.lit(1)).alias("_n"))
    table = sizes.select(
        *s.keys,
        _BLK,
        F.coalesce(F.sum("_n").over(by_block.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
        *([F.sum("_n").over(Window.partitionBy(*s.keys)).alias(total)] if total else []),
    )
    local = F.row_number().over(Window.partitionBy(*s.keys, _BLK).orderBy(*s.ord))
    hot = s.hot.withColumn(name, local.cast("long"))
    return join_blocks(hot, table, s.keys).withColumn(name, F.col(name) + F.col("_before")).drop("_before")


def _plus(a: Column, b: Column) -> Column:
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b)


_MERGE: dict[str, Callable[[Column, Column], Column]] = {
    "sum": _plus,
    "count": _plus,
    "min": lambda a, b: F.least(a, b),
    "max": lambda a, b: F.greatest(a, b),
    "last": lambda earlier, here: F.coalesce(here, earlier),
}


def _aggregate(fn: str, value: Column) -> Column:
    if fn == "last":
        return F.last(value, ignorenulls=True)
    return {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max}[fn](value)


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    aggs: dict[str, tuple[str, str | Column]],
    strict: bool = False,
    limit: int | None = None,
    rows: int = 0,
) -> DataFrame:
    """Aggregates over all rows up to the current one (``strict``: before it).

    ``aggs`` maps an output name to ``(function, column)`` with the functions sum,
    count, min, max and last (the last non-null value). With ``rows``, the rows of ``df``,
    the tasks grow in number with the table, not in size.
    """
    values = {f"_v{i}": _as_column(c) for i, (_, c) in enumerate(aggs.values())}
    s = split_groups(df.withColumns(values), keys, order, limit)
    end = -1 if strict else Window.currentRow
    spec = [(out, fn, f"_v{i}") for i, (out, (fn, _)) in enumerate(aggs.items())]

    def over(w: Window) -> dict[str, Column]:
        frame = w.rowsBetween(Window.unboundedPreceding, end)
        return {out: _aggregate(fn, F.col(v)).over(frame) for out, fn, v in spec}

    cold = dealt(s.cold, rows, *s.keys, task_rows=WINDOW_ROWS).withColumns(over(Window.partitionBy(*s.keys).orderBy(*s.ord)))
    hot = None
    if s.hot is not None:
        per_block = []
        for out, fn, v in spec:
            if fn == "last":
                at = F.when(F.col(v).isNotNull(), F.struct(*s.ord))
                per_block.append(F.max_by(v, at).alias(f"_blk_{out}"))
            else:
                per_block.append(_aggregate(fn, F.col(v)).alias(f"_blk_{out}"))
        before = Window.partitionBy(*s.keys).orderBy(_BLK).rowsBetween(Window.unboundedPreceding, -1)
        table = s.hot.groupBy(*s.keys, _BLK).agg(*per_block)
        table = table.select(
            *s.keys,
            _BLK,
            *[
                _aggregate("sum" if fn == "count" else fn, F.col(f"_blk_{out}")).over(before).alias(f"_pre_{out}")
                for out, fn, _ in spec
            ],
        )
        hot = dealt(s.hot, rows, *s.keys, _BLK, task_rows=WINDOW_ROWS)
        hot = hot.withColumns(over(Window.partitionBy(*s.keys, _BLK).orderBy(*s.ord)))
        hot = join_blocks(hot, table, s.keys)
        hot = hot.withColumns({out: _MERGE[fn](F.col(f"_pre_{out}"), F.col(out)) for out, fn, _ in spec})
    return s.finish(cold, hot).drop(*values)


def row_frames(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    lookback: int,
    build: Callable[[Window], dict[str, Column]],
    limit: int | None = None,
) -> DataFrame:
    """Columns that look at up to ``lookback`` earlier rows of the group.

    ``build`` receives the ordered window and returns the columns. Long groups are cut
    into stretches of equal row counts; the last ``lookback`` rows of a stretch are
    copied to the next one and dropped again afterwards.
    """
    s = split_groups(df, keys, order, limit)
    cold = s.cold.withColumns(build(Window.partitionBy(*s.keys).orderBy(*s.ord)))
    hot = None
    if s.hot is not None:
        length = max(s.limit, lookback + 1)
        placed = _hot_positions(s, "_pos", None)
        at, inside = F.floor((F.col("_pos") - 1) / length), (F.col("_pos") - 1) % length
        to = F.when(inside >= length - lookback, F.array(at, at + 1)).otherwise(F.array(at))
        placed = placed.withColumn("_home", at).withColumn("_stretch", F.explode(to))
        w = Window.partitionBy(*s.keys, "_stretch").orderBy("_pos")
        hot = placed.withColumns(build(w)).filter(F.col("_home") == F.col("_stretch"))
        hot = hot.drop("_pos", "_home", "_stretch")
    return s.finish(cold, hot)
