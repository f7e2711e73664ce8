"""Greedy selection within a token budget, for groups of any size.

What is left of a budget never grows. So once an item of some cost did not fit, none of its cost fits any
more: of each cost only the first items, as many as the budget holds, can be taken. That leaves about the
budget times its logarithm of a group. A group that is still long is filled in rounds: of the items that
fit alone into what is left, the longest prefix that fits together is taken, by running sums over split
groups; the first item beyond it is skipped, and what is left is smaller.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeline.operators.aggregates import topk_per_group
from lodeline.operators.keys import free_name, group_name
from lodeline.plans.hot_groups import row_positions, running
from lodeline.session import max_group_rows as session_rows
from lodeline.session import stored


def greedy_fill(
    df: DataFrame, *, group: Sequence[str], score: str, id: str, tokens: str, budget: str, k_max: int | None = None,
    max_group_rows: int | None = None,
) -> DataFrame:
    """Rows chosen per group, with their ``rank`` by score from the highest, then id.

    Items are walked in rank order, and one that does not fit is skipped. Negative tokens count as none; an
    item without tokens given never fits, and a group without a budget takes nothing. ``k_max`` looks at the
    best of each group only. A group with more than ``max_group_rows`` candidates is filled in rounds.
    """
    limit = max_group_rows or session_rows(df.sparkSession)
    if k_max is None:
        ranked = row_positions(df, group, [F.coalesce(-F.col(score), F.lit(float("inf"))), id], "rank", limit=limit)
        ranked = ranked.withColumn("rank", F.col("rank").cast("int"))
    else:
        ranked = topk_per_group(df, group=group, order=[F.desc(score), F.asc(id)], k=k_max)
    ranked = stored(ranked, "ranked")
    own = free_name(df, "g")
    name = group_name(group)
    need = F.when(F.col(tokens).isNotNull(), F.greatest(F.col(tokens).cast("long"), F.lit(0)))
    able = ranked.select(name.alias("g"), "rank", need.alias("need"), F.col(budget).cast("long").alias("left"))
    able = able.where("need <= left")  # a null on either side fits nothing
    if k_max is None:
        spending = row_positions(able.where("need > 0"), ["g", "need"], ["rank"], "nth", limit=limit)
        able = able.where("need = 0").unionByName(spending.where("nth <= left div need").drop("nth"))
    able = stored(able, "able")
    free = able.where("need = 0").select("g", "rank")
    chosen = free.unionByName(_fill(able.where("need > 0"), limit)).withColumnRenamed("g", own)
    return ranked.withColumn(own, name).join(chosen, [own, "rank"]).select(*[F.col(f"`{c}`") for c in [*df.columns, "rank"]])


def _fill(able: DataFrame, limit: int) -> DataFrame:
    """(g, rank) of the chosen among (g, rank, need, left), all of which fit alone."""
    done = []
    while True:
        sizes = able.groupBy("g").agg(F.count("*").alias("n"))
        long_groups = stored(sizes.where(F.col("n") > limit).select("g"), "long")
        done.append(able.join(F.broadcast(long_groups), "g", "left_anti").groupBy("g").applyInPandas(_walk, "g string, rank int"))
        if long_groups.isEmpty():
            break
        rest = able.join(F.broadcast(long_groups), "g", "left_semi")
        summed = stored(running(rest, ["g"], ["rank"], {"used": ("sum", "need")}, limit=limit), "filled")
        fits = summed.where("used <= left")
        done.append(fits.select("g", "rank"))
        now = fits.groupBy("g").agg(F.max("used").alias("gone"), F.max("rank").alias("to"))
        able = summed.join(now, "g").where("rank > to").withColumn("left", F.col("left") - F.col("gone"))
        able = stored(able.where("need <= left").select("g", "rank", "need", "left"), "able")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def _walk(pdf: pd.DataFrame) -> pd.DataFrame:
    """The same rounds within one task, by running sums."""
    pdf = pdf.sort_values("rank")
    rank, need, left = pdf["rank"].to_numpy(), pdf["need"].to_numpy(), int(pdf["left"].iloc[0])
    taken = []
    while len(need):
        used = np.cumsum(need)
        k = int(np.searchsorted(used, left, "right"))
        taken.append(rank[:k])
        left -= int(used[k - 1])
        rank, need = rank[k:], need[k:]
        fits = need <= left
        rank, need = rank[fits], need[fits]
    return pd.DataFrame({"g": pdf["g"].iloc[0], "rank": np.concatenate(taken)})
