"""Exact selection within a budget for groups of any size: knapsack tables of blocks, merged as a tree.

A group that fits whole is taken whole. Of the others most items are settled by a price per token: an item
that is worth more, or less, than its tokens cost at that price by more than all choices can differ from the
best is in, or out of, every best choice. Only the items between are searched, for what they leave of the
budget. Any price and any choice within the budget give such a bound, so the result stays exact; where worth
and tokens go closely together many items stay in between.

Of the items with the same cost only as many can be taken as fit, the highest-ranked first, so a group
shrinks to about budget times its logarithm. The rest is cut into blocks by rank:

    up      from the last block to the first: what a block and all behind it can be worth, per tokens left
    down    from the first block to the last: an item is taken if the best choice behind it loses nothing by it

A block works on all numbers of tokens in ranges, a small task each, which need the numbers of the blocks behind
down to their own range less the tokens of the block. So the work is items times budget, whatever the group, no
task or row holds a whole table, and one step of all groups is one job. Only numbers that can occur are kept:
not more tokens than all items behind need, nor fewer than all items before leave.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodeline.operators.aggregates import topk_per_group
from lodeline.operators.keys import free_name, group_name
from lodeline.plans.hot_groups import row_positions, running
from lodeline.session import stored

BLOCK_ITEMS = 1_024
# Numbers of a table that one task works out, and that one row holds.
RANGE = 524_288
ROW = 65_536
# Items around the price that a first choice is made of, and numbers of its table.
TRIED_ITEMS = 256
TRIED_TABLE = 4_000_000
SCALE = 1e9
_KEY = ["g", "node"]


def exact_budget_select(
    df: DataFrame, *, group: Sequence[str], score: str, id: str, tokens: str, budget: str, block_items: int = BLOCK_ITEMS
) -> DataFrame:
    """Rows of the best total score within each group's budget, with their ``rank``; scores count to nine decimals.

    Of equally good choices the one that takes the higher-ranked items wins (rank: score from the highest,
    then id). Items with a negative or no score are never taken; null or negative tokens count as none, and a
    null budget as zero. ``budget`` is the same in all rows of a group.
    """
    ranked = row_positions(df.where(F.col(score).isNotNull()), group, [-F.col(score), id], "rank")
    ranked = stored(ranked.withColumn("rank", F.col("rank").cast("int")), "ranked")
    name = group_name(group)
    items = ranked.select(
        name.alias("g"),
        "rank",
        F.round(F.col(score) * SCALE).cast("long").alias("worth"),
        F.greatest(F.coalesce(F.col(tokens).cast("long"), F.lit(0)), F.lit(0)).alias("need"),
        F.greatest(F.coalesce(F.col(budget).cast("long"), F.lit(0)), F.lit(0)).alias("limit"),
    ).where("worth >= 0 and need <= limit")
    free = items.where("need = 0").select("g", "rank")
    sure, open_ = _settled(items.where("need > 0"))
    free = free.unionByName(sure)
    able = row_positions(open_, ["g", "need"], ["rank"], "nth").where("nth <= limit div need")
    able = row_positions(able, ["g"], ["rank"], "at").withColumn("node", F.floor((F.col("at") - 1) / block_items))
    each = F.array_sort(F.collect_list(F.struct("rank", "worth", "need")))
    blocks = able.groupBy(*_KEY).agg(F.max("limit").alias("limit"), F.sum("need").alias("own"), each.alias("e"))
    blocks = stored(
        blocks.select(*_KEY, "limit", "own", *[F.col(f"e.{c}").alias(f"{c}s") for c in ("rank", "worth", "need")]), "blocks"
    )
    chosen = free.unionByName(_solve(blocks)) if blocks.head(1) else free
    own = free_name(df, "g")
    chosen = chosen.withColumnRenamed("g", own)
    return ranked.withColumn(own, name).join(chosen, [own, "rank"]).select(*[F.col(f"`{c}`") for c in [*df.columns, "rank"]])


def _settled(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(g, rank) of items in every best choice, and the open items with what the others leave as their ``limit``.

    The price of a group is the worth per token of the first item that no longer fits, by falling worth per
    token, rounded up: the items above it fit together. ``over`` is what an item is worth above the price. The
    whole budget at the price and all positive ``over`` is a bound that no choice exceeds, less ``over`` of each
    item that it leaves out, or plus the negative ``over`` of each that it takes.
    """
    ratio = F.col("worth") / F.col("need")
    summed = stored(running(items, ["g"], [-ratio, "rank"], {"used": ("sum", "need")}), "summed")
    tight = summed.where("used > limit")
    price = stored(tight.groupBy("g").agg(F.max(F.expr("(worth + need - 1) div need")).alias("price")), "prices")
    whole = summed.join(price, "g", "left_anti").select("g", "rank")
    wide = "decimal(38,0)"
    over = F.col("worth").cast(wide) - F.col("price").cast(wide) * F.col("need").cast(wide)
    priced = stored(summed.drop("used").join(price, "g").withColumn("over", over), "priced")
    tried = topk_per_group(priced, group=["g"], order=[F.abs("over"), F.asc("rank")], k=TRIED_ITEMS, rank="nth").drop("nth")
    above = priced.where("over > 0").groupBy("g").agg(F.sum("need").alias("above"))
    first = tried.join(above, "g", "left").withColumn("above", F.coalesce("above", F.lit(0)))
    room = first.withColumn("over", F.col("over").cast("string")).groupBy("g").applyInPandas(_room, "g string, room string")
    room = stored(room.select("g", F.col("room").cast(wide).alias("room")), "room")
    priced = priced.join(room, "g")
    sure = priced.where("over > room")
    spent = sure.groupBy("g").agg(F.sum("need").alias("spent"))
    rest = priced.where("abs(over) <= room").select("g", "rank", "worth", "need", "limit").join(spent, "g", "left")
    rest = stored(rest.withColumn("limit", F.col("limit") - F.coalesce("spent", F.lit(0))).drop("spent"), "open")
    # More budget than all open items need makes no difference.
    needs = rest.groupBy("g").agg(F.sum("need").alias("needs"))
    rest = rest.join(needs, "g").withColumn("limit", F.least("limit", "needs")).drop("needs").where("need <= limit")
    return whole.unionByName(sure.select("g", "rank")), rest


def _room(pdf: pd.DataFrame) -> pd.DataFrame:
    """How far the bound of a group lies above a good choice: all items above the price, but the best of those near it.

    Python's integers hold the sums.
    """
    pdf = pdf.sort_values("rank")
    worth, need, over = pdf["worth"].to_numpy(), pdf["need"].to_numpy(), [int(x) for x in pdf["over"]]
    near = np.argsort(np.array([abs(x) for x in over], dtype=object), kind="stable")
    limit, price, above = (int(pdf[c].iloc[0]) for c in ("limit", "price", "above"))
    is_above = np.array([x > 0 for x in over])
    n = len(near)
    while True:
        mine = np.sort(near[:n])
        # What the items above the price that are not searched leave of the budget.
        left = limit - above + int(need[mine][is_above[mine]].sum())
        size = min(left, int(need[mine].sum()))
        if size <= TRIED_TABLE or n == 0:
            break
        n //= 2
    best = int(_best(worth[mine], need[mine], np.zeros(size + 1, np.int64))[-1]) if n else 0
    # The items above the price that are not searched are in the bound and in the choice alike.
    room = price * left + sum(over[i] for i in mine if over[i] > 0) - best
    return pd.DataFrame({"g": [pdf["g"].iloc[0]], "room": [str(room)]})


def _solve(blocks: DataFrame) -> DataFrame:
    """(g, rank) of the items taken; ``blocks`` (g, node, limit, own, ranks, worths, needs) are numbered by rank."""
    per_row = min(RANGE, ROW)
    span = per_row * (RANGE // per_row)
    down = Window.partitionBy("g").orderBy(F.desc("node"))
    behind = F.coalesce(F.sum("own").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = blocks.select(*_KEY, "own", "limit", (F.row_number().over(down) - 1).alias("step"), behind.alias("behind"),
                           F.sum("own").over(Window.partitionBy("g")).alias("all"))
    placed = placed.select(
        *_KEY, "step", F.least("limit", "behind").alias("last"), F.least("limit", F.col("behind") + F.col("own")).alias("top"),
        F.greatest(F.lit(0), F.col("limit") - (F.col("all") - F.col("behind") - F.col("own"))).alias("low"),
    )
    blocks = stored(blocks.join(placed, _KEY), "steps")
    steps = blocks.agg(F.max("step")).first()[0] + 1
    nothing = blocks.where("node = 0").select("g", F.lit(0).cast("long").alias("u"), F.array(F.lit(0).cast("long")).alias("t"))

    tasks = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tables: list[DataFrame] = []
    for s in range(steps - 1):
        here = blocks.where(F.col("step") == s).drop("node", "step", "ranks", "limit")
        pieces = (tables[-1] if tables else nothing).join(here, "g")
        first = F.expr(f"greatest(u * {per_row} div {span}, low div {span})")
        final = F.expr(f"least(top div {span}, (u * {per_row} + {per_row - 1} + own) div {span})")
        pieces = pieces.withColumn("r", F.explode(F.when(first <= final, F.sequence(first, final))))
        # Few bytes, but much work: they must not be put into few tasks.
        pieces = pieces.repartition(tasks, "g", "r")
        made = pieces.groupBy("g", "r").applyInArrow(lambda t: _range(t, span, per_row), "g string, u long, t array<long>")
        tables.append(stored(made, "tables"))

    starts = blocks.where("node = 0").select("g", "step", F.col("limit").alias("given"))
    given, picked = None, []
    for s in reversed(range(steps)):
        now = starts.where(F.col("step") == s).drop("step")
        now = now if given is None else now.unionByName(given)
        here = blocks.where(F.col("step") == s).join(now, "g").select("g", "given", "last", "own", "ranks", "worths", "needs")
        pieces = (tables[s - 1] if s else nothing).join(here, "g")
        pieces = pieces.where(f"u * {per_row} <= given and (u + 1) * {per_row} > least(given - own, last)")
        done = pieces.groupBy("g").applyInArrow(lambda t: _taken(t, per_row), "g string, given long, ranks array<int>")
        done = stored(done, "taken")
        given = done.select("g", "given")
        picked.append(done.select("g", F.explode("ranks").alias("rank")))
    return reduce(DataFrame.unionByName, picked)


def _numbers(table: pa.Table, column: str, row: int = 0) -> np.ndarray:
    return table[column][row].values.to_numpy(zero_copy_only=False)


def _behind(table: pa.Table, lo: int, hi: int, per_row: int) -> np.ndarray:
    """The numbers ``lo`` to ``hi`` (exclusive) of what is behind a block, whose table ends at ``last`` and goes on evenly."""
    x, last = np.zeros(hi - lo, np.int64), table["last"][0].as_py()
    for i, u in enumerate(table["u"].to_pylist()):
        t, at = _numbers(table, "t", i), u * per_row
        a, b = max(at, lo), min(at + len(t), hi)
        if a < b:
            x[a - lo : b - lo] = t[a - at : b - at]
        if at <= last < at + len(t):
            x[max(last + 1 - lo, 0) :] = t[last - at]
    return x


def _range(table: pa.Table, span: int, per_row: int) -> pa.Table:
    """One range of the table of a block and all behind it, in rows."""
    r, own, top, low = (table[c][0].as_py() for c in ("r", "own", "top", "low"))
    lo, hi = max(0, r * span - own), min((r + 1) * span, top + 1)
    x = _best(_numbers(table, "worths"), _numbers(table, "needs"), _behind(table, lo, hi, per_row))[r * span - lo :]
    us = [u for u in range(r * span // per_row, -(-hi // per_row)) if (u + 1) * per_row > low]
    parts = [x[u * per_row - r * span : (u + 1) * per_row - r * span] for u in us]
    return pa.table({"g": pa.array([table["g"][0].as_py()] * len(us), pa.string()), "u": pa.array(us, pa.int64()), "t": pa.array(parts, pa.list_(pa.int64()))})


def _taken(table: pa.Table, per_row: int) -> pa.Table:
    """The ranks that a block takes of the tokens it is given, and the tokens it leaves."""
    given, own = table["given"][0].as_py(), table["own"][0].as_py()
    lo, picks = max(0, given - own), []
    after = _behind(table, lo, given + 1, per_row)
    left = lo + int(_walk(_numbers(table, "worths"), _numbers(table, "needs"), after, np.array([given - lo]), picks)[0])
    ranks = pa.array([_numbers(table, "ranks")[picks].tolist()], pa.list_(pa.int32()))
    return pa.table({"g": pa.array([table["g"][0].as_py()], pa.string()), "given": pa.array([left], pa.int64()), "ranks": ranks})


def _best(worth: np.ndarray, need: np.ndarray, after: np.ndarray) -> np.ndarray:
    """The best worth of the items and what is behind them, by the tokens left."""
    after = after.copy()
    for v, w in zip(worth[::-1].tolist(), need[::-1].tolist()):
        if w < len(after):
            np.maximum(after[w:], after[: len(after) - w] + v, out=after[w:])
    return after


def _walk(worth: np.ndarray, need: np.ndarray, after: np.ndarray, left: np.ndarray, picks: list[int] | None, lo: int = 0) -> np.ndarray:
    """Take or leave the items in order, for every number of tokens in ``left``; the tokens left then.

    An item is taken where that loses nothing. By halves, so that few tables stand at a time.
    """
    if len(left) == 1 and left[0] > need.sum():
        # Less than what is left beside all items plays no part.
        cut = int(left[0] - need.sum())
        return cut + _walk(worth, need, after[cut : int(left[0]) + 1], left - cut, picks, lo)
    if len(worth) > 1:
        mid = len(worth) // 2
        left = _walk(worth[:mid], need[:mid], _best(worth[mid:], need[mid:], after), left, picks, lo)
        return _walk(worth[mid:], need[mid:], after, left, picks, lo + mid)
    w = int(need[0])
    less = np.maximum(left - w, 0)
    takes = (left >= w) & (after[less] + worth[0] >= after[left])
    if picks is not None and takes[0]:
        picks.append(lo)
    return np.where(takes, less, left)
