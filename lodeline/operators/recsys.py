"""Neighborhood recommendation for all users in one job."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeline.operators.aggregates import topk_per_group
from lodeline.operators.windows import last_n_holdout
from lodeline.plans.hot_groups import row_positions
from lodeline.session import stored

# Raters per list of the index. An item with more has further lists, by falling weight.
LIST_ROWS = 2_000
# Products that one task of the search adds up, on average.
TASK_PAIRS = 2_000_000
TASK_BLOCKS = 4
# Users who ask for an item are sent one by one if there are so many times more blocks than of them.
FEW = 4
# A user with more items is searched by joins.
LONG_USER = 5_000
# Products that are added up at a time, and those of one round of the search, whose shuffle is removed before the next.
CHUNK_PAIRS = 250_000
ROUND_PAIRS = 1_500_000_000
SIM_DIGITS = 9
# Rounding and the order of sums stay within this; bounds are compared with it in hand.
SLACK = 1e-8
EXACT, PARTIAL, OPEN = 0, 1, 2


def user_item(ratings: DataFrame) -> DataFrame:
    """One row per user and item; repeated pairs are summed."""
    return ratings.groupBy("user", "item").agg(F.sum("rating").alias("rating"))


def _squares(ratings: DataFrame) -> DataFrame:
    squares = ratings.groupBy("user").agg(F.sum(F.col("rating") * F.col("rating")).alias("sq"))
    return ratings.join(squares, "user").select("user", "item", "rating", "sq")


INTEGERS = {"tinyint": 7, "smallint": 15, "int": 31, "bigint": 63}


def _narrowed(df: DataFrame, *cols: str) -> DataFrame:
    """The columns in the smallest numeric type that holds all their values exactly, else as they are.

    Bounds and comparisons find it: a cast that fails costs more than all the rest of a row.
    """
    types = {c: df.schema[c].dataType.simpleString() for c in cols}
    checks = [F.count("*").alias("rows")]
    for c in cols:
        x = F.col(c)
        checks += [F.count(x).alias(f"{c}:n"), F.min(x).alias(f"{c}:min"), F.max(x).alias(f"{c}:max")]
        if types[c] not in INTEGERS:
            checks.append(F.bool_and((F.rint(x) if types[c] in ("double", "float") else F.floor(x)) == x).alias(f"{c}:whole"))
        if types[c] == "double":
            checks.append(F.bool_and(x.cast("float").cast("double") == x).alias(f"{c}:float"))
    found = df.agg(*checks).first().asDict()

    def best(c: str) -> str | None:
        if not found["rows"] or found[f"{c}:n"] < found["rows"]:
            return None
        if found.get(f"{c}:whole", True):
            for t in ("tinyint", "smallint", "int"):
                if -(2 ** INTEGERS[t]) <= found[f"{c}:min"] and found[f"{c}:max"] < 2 ** INTEGERS[t]:
                    return t
        return "float" if found.get(f"{c}:float") else None

    chosen = {c: best(c) for c in cols}
    return df.withColumns({c: F.col(c).cast(t) for c, t in chosen.items() if t})


def user_neighbors(
    ratings: DataFrame,
    *,
    k: int = 20,
    list_rows: int = LIST_ROWS,
    task_pairs: int = TASK_PAIRS,
    long_user: int = LONG_USER,
) -> DataFrame:
    """The ``k`` most similar other users of each user by cosine; ties go to the smaller id.

    An inverted index holds each item's raters in lists of ``list_rows`` by falling weight. Every
    user is searched in the first list of each of its items, a block of users per task, which writes
    only what can be among the best. What further lists of popular items could add is bounded by the
    user's weight times the largest weight left. While that is below the user's k-th similarity so
    far, nobody new can come in, and only the pairs near the limit get their missing products. Other
    users are searched in all lists. The result is exact.
    """
    squares = stored(_squares(stored(ratings, "ratings")), "squares")
    weight = (F.col("rating") / F.sqrt("sq")).alias("w")
    weights = squares.select("user", "item", weight)
    raters = squares.groupBy("item").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    popular = raters > list_rows
    if popular:
        placed = row_positions(squares, ["item"], [-weight, "user"], "pos", "n").withColumn("w", weight)
        placed = stored(placed.withColumn("slice", F.floor((F.col("pos") - 1) / list_rows)), "placed")
    else:
        # Every item has one list.
        placed = squares.select("*", weight, F.lit(0).cast("long").alias("slice"))
    # Lists are what is sent most: a rating and the user's sum of squares take less room than a weight, and equal
    # ratings side by side next to nothing.
    small = _narrowed(placed.select("item", "slice", "w", "rating", "sq", "user"), "rating", "sq", "user")
    entry = F.array_sort(F.collect_list(F.struct("rating", "sq", "user"))).alias("e")
    entries = small.groupBy("item", "slice").agg(entry, F.max("w").alias("top"))
    columns = [F.col(f"e.{c}").alias(n) for c, n in (("user", "users"), ("rating", "ratings"), ("sq", "squares"))]
    lists = stored(entries.select("item", "slice", "top", *columns), "lists")
    first = lists.where("slice = 0").drop("slice", "top")
    if popular:
        first = first.join(lists.where("slice = 1").select("item", F.col("top").alias("rest")), "item", "left")
    else:
        first = first.withColumn("rest", F.lit(None).cast("double"))
    long_ids = weights.groupBy("user").agg(F.count("*").alias("n")).where(F.col("n") > long_user).select("user")
    any_long = bool(long_ids.head(1))
    usual = weights.join(long_ids, "user", "left_anti") if any_long else weights

    found = _search(usual, first, k, task_pairs)
    pairs = [found.where(F.col("state") == EXACT).drop("state")]
    if popular:
        pairs.append(_completed(found.where(F.col("state") == PARTIAL).drop("state"), placed, list_rows))
        unsure = found.where(F.col("state") == OPEN).select("user")
        again = weights.join(unsure, "user", "left_semi")
        every = lists.select("item", "users", "ratings", "squares", F.lit(None).cast("double").alias("rest"))
        pairs.append(_search(again, every, k, task_pairs).drop("state"))
    if any_long:
        pairs.append(_by_joins(weights.join(long_ids, "user", "left_semi"), weights))
    both = pairs[0]
    for more in pairs[1:]:
        both = both.unionByName(more)
    ranked = both.withColumn("sim", F.round("sim", SIM_DIGITS)).filter(F.col("sim") > 0)
    return topk_per_group(ranked, group=["user"], order=[F.desc("sim"), F.asc("neighbor")], k=k)


def _search(queries: DataFrame, lists: DataFrame, k: int, task_pairs: int) -> DataFrame:
    """(user, neighbor, sim, state) of ``queries`` (user, item, w) in ``lists`` (item, users, ratings, squares, rest).

    ``rest`` is the largest weight of the item that is in no list. EXACT: the ``k`` best, and ties, of a user
    without such items. PARTIAL: sums that may still be among the best when what is missing is added. OPEN: one row
    for a user who may have others.
    """
    asked = queries.groupBy("item").agg(F.count("*").alias("n"))
    sizes = lists.groupBy("item").agg(F.sum(F.size("users")).alias("m"))
    total, most = asked.join(sizes, "item").agg(F.sum(F.col("n") * F.col("m")), F.max("n")).first()
    total, most = total or 0, most or 0
    blocks = max(1, -(-total // task_pairs))
    rounds = min(blocks, max(1, -(-total // ROUND_PAIRS)))
    block = F.pmod(F.xxhash64("user"), F.lit(blocks)).cast("int")
    queries = queries.withColumn("block", block)
    # Tasks of a few blocks sort what they get in memory, however many blocks there are.
    tasks = -(-blocks // (TASK_BLOCKS * rounds))

    def run(table: pa.Table) -> pa.Table:
        return _block_best(table, k)

    found = []
    for i in range(rounds):
        mine = queries.where(F.col("block") % rounds == i)
        if most * FEW <= blocks:
            # Hardly two users of a block share an item.
            grouped = mine.select("item", "block", F.array("user").alias("q_users"), F.array("w").alias("q_ws"))
        else:
            grouped = mine.groupBy("item", "block").agg(F.collect_list(F.struct("user", "w")).alias("q"))
            grouped = grouped.select("item", "block", F.col("q.user").alias("q_users"), F.col("q.w").alias("q_ws"))
        met = grouped.join(lists, "item").select("block", "q_users", "q_ws", "users", "ratings", "squares", "rest")
        if tasks > int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions")):
            met = met.repartition(tasks, "block")
        best = met.groupBy("block").applyInArrow(run, "user long, neighbor long, sim double, state int")
        found.append(stored(best, "found"))
    return reduce(DataFrame.unionByName, found)


def _ragged(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(lengths, values) of a list column."""
    flat = column.combine_chunks()
    return np.diff(flat.offsets.to_numpy()), flat.flatten().to_numpy(zero_copy_only=False)


def _block_best(table: pa.Table, k: int) -> pa.Table:
    n_q, q_user = _ragged(table["q_users"])
    _, q_w = _ragged(table["q_ws"])
    n_e, e_user = _ragged(table["users"])
    e_w = _ragged(table["ratings"])[1] / np.sqrt(_ragged(table["squares"])[1].astype(float))
    rest = np.nan_to_num(table["rest"].to_numpy())
    row = np.repeat(np.arange(len(n_q)), n_q)
    first = np.concatenate([[0], np.cumsum(n_e)[:-1]])
    by_user = np.argsort(q_user, kind="stable")
    row, q_user, q_w = row[by_user], q_user[by_user], q_w[by_user]
    width = n_e[row]
    # Stretches of whole users with about as many products as fit.
    starts = np.flatnonzero(np.concatenate([[True], q_user[1:] != q_user[:-1]]))
    done = np.concatenate([[0], np.cumsum(width)])
    out, lo = [], 0
    while lo < len(starts):
        hi = lo + max(1, int(np.searchsorted(done[starts[lo:]], done[starts[lo]] + CHUNK_PAIRS, "right")) - 1)
        a, b = starts[lo], starts[hi] if hi < len(starts) else len(q_user)
        w, r = width[a:b], row[a:b]
        of = np.repeat(np.arange(a, b), w)
        at = np.arange(len(of)) - np.repeat(np.cumsum(w) - w, w) + np.repeat(first[r], w)
        users, left = np.unique(q_user[a:b], return_inverse=True)
        missing = np.bincount(left, q_w[a:b] * rest[r])
        out.append(_best(users, left[of - a], e_user[at], q_w[of] * e_w[at], missing, k))
        lo = hi
    parts = [np.concatenate(c) for c in zip(*out)] if out else [np.array([])] * 4
    types = {"user": pa.int64(), "neighbor": pa.int64(), "sim": pa.float64(), "state": pa.int32()}
    return pa.table({n: pa.array(p.astype(t.to_pandas_dtype())) for p, (n, t) in zip(parts, types.items())})


def _best(users, u, other, product, missing, k):
    """Sums of ``product`` per user (index ``u``) and other user, and what of them has to be kept."""
    low = int(other.min()) if len(other) else 0
    width = (int(other.max()) - low if len(other) else 0) + 1
    names = None
    if width * max(1, len(users)) < 2**62:
        v = other.astype(np.int64) - low
    else:
        names, v = np.unique(other, return_inverse=True)
        width = len(names)
    key = u * width + v
    order = np.argsort(key, kind="stable")
    key = key[order]
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.array([], int)
    sim = np.add.reduceat(product[order], new) if len(key) else product
    u, v = np.divmod(key[new], width)
    other = v + low if names is None else names[v]
    real = (users[u] != other) & (sim > 0)
    u, other, sim = u[real], other[real], sim[real]
    bounds = np.searchsorted(u, np.arange(len(users) + 1))
    # The k-th best of each user; below it, less what may be missing, nothing has to be kept.
    limit = np.zeros(len(users))
    for i in np.flatnonzero(np.diff(bounds) >= k):
        mine = sim[bounds[i] : bounds[i + 1]]
        limit[i] = np.partition(mine, len(mine) - k)[len(mine) - k] - SLACK
    settled = missing == 0
    closed = missing < limit
    keep = (settled | closed)[u] & (sim + missing[u] >= limit[u])
    u, other, sim = u[keep], other[keep], sim[keep]
    unsure = users[~settled & ~closed]
    return (
        np.concatenate([users[u], unsure]),
        np.concatenate([other, unsure]),
        np.concatenate([sim, np.zeros(len(unsure))]),
        np.concatenate([np.where(settled, EXACT, PARTIAL)[u], np.full(len(unsure), OPEN)]),
    )


def _completed(partial: DataFrame, placed: DataFrame, list_rows: int) -> DataFrame:
    """``partial`` sums with the products of popular items where the neighbor is in no first list."""
    mine = placed.where(F.col("n") > list_rows).select("user", "item", F.col("w").alias("wu"))
    theirs = placed.where("slice > 0").select(F.col("user").alias("neighbor"), "item", F.col("w").alias("wv"))
    added = partial.select("user", "neighbor").join(mine, "user").join(theirs, ["neighbor", "item"])
    added = added.select("user", "neighbor", (F.col("wu") * F.col("wv")).alias("sim"))
    return partial.unionByName(added).groupBy("user", "neighbor").agg(F.sum("sim").alias("sim"))


def _by_joins(queries: DataFrame, weights: DataFrame) -> DataFrame:
    """All similarities of a few users with very many items, summed over tasks."""
    mine = queries.select("item", "user", F.col("w").alias("wu"))
    theirs = weights.select("item", F.col("user").alias("neighbor"), F.col("w").alias("wv"))
    crossed = mine.join(theirs, "item").filter(F.col("user") != F.col("neighbor"))
    return crossed.groupBy("user", "neighbor").agg(F.sum(F.col("wu") * F.col("wv")).alias("sim"))


# Items of one list that a neighbor hands to a user.
VOTE_ROWS = 1_000
# Votes that one task adds up, on average.
TASK_VOTES = 10_000_000


def _item_lists(ratings: DataFrame, owner: str) -> DataFrame:
    """The items and ratings of each user (as ``owner``) in lists of at most ``VOTE_ROWS``, equal ratings side by side."""
    rows = _narrowed(ratings.select(F.col("user").alias(owner), "item", "rating"), "item", "rating")
    placed = row_positions(rows, [owner], ["rating", "item"])
    listed = placed.groupBy(owner, F.floor((F.col("pos") - 1) / VOTE_ROWS)).agg(F.array_sort(F.collect_list(F.struct("rating", "item"))).alias("e"))
    return listed.select(owner, F.col("e.item").alias("items"), F.col("e.rating").alias("ratings"))


def candidate_items(neighbors: DataFrame, ratings: DataFrame, *, min_rating: float = 4.0, unseen: bool = False) -> DataFrame:
    """Items the neighbors rated at least ``min_rating``, with the summed sim*rating per user and item.

    A neighbor's items go to the user as lists and are taken apart there, so that one shuffle by user serves the
    sums and whatever follows per user. ``unseen`` leaves out what the user has rated, in the same shuffle.
    """
    kinds = {c: ratings.schema[c].dataType for c in ("item", "rating")}
    liked = stored(_item_lists(ratings.filter(F.col("rating") >= min_rating), "neighbor"), "liked")
    votes = neighbors.select("user", "neighbor", "sim").join(liked, "neighbor").select("user", "sim", "items", "ratings")
    amount = liked.agg(F.sum(F.size("items")), F.count_distinct("neighbor")).first()
    if unseen:
        # A user's own items come without a similarity.
        own = _item_lists(ratings.join(neighbors.select("user").distinct(), "user", "left_semi"), "user")
        votes = votes.unionByName(own.select("user", F.lit(None).cast("double").alias("sim"), "items", "ratings"))
    tasks = -(-(neighbors.count() * (amount[0] or 0) // max(1, amount[1])) // TASK_VOTES)
    tasks = max(tasks, int(neighbors.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    each = votes.repartition(tasks, "user").select("user", "sim", F.explode(F.arrays_zip("items", "ratings")).alias("e"))
    each = each.select("user", F.col("e.items").cast(kinds["item"]).alias("item"), "sim", F.col("e.ratings").cast(kinds["rating"]).alias("rating"))
    score = F.round(F.sum(F.col("sim") * F.col("rating")), SIM_DIGITS).alias("score")
    if not unseen:
        return each.groupBy("user", "item").agg(score)
    summed = each.groupBy("user", "item").agg(score, F.bool_or(F.col("sim").isNull()).alias("_seen"))
    return summed.filter(~F.col("_seen")).drop("_seen")


def unseen_items(candidates: DataFrame, ratings: DataFrame) -> DataFrame:
    return candidates.join(ratings.select("user", "item"), ["user", "item"], "left_anti")


def recommend(
    ratings: DataFrame,
    *,
    k_neighbors: int = 20,
    topn: int = 10,
    min_neighbor_rating: float = 4.0,
    users: DataFrame | None = None,
) -> DataFrame:
    """The ``topn`` best unseen items per user; ties go to the smaller item id.

    ``ratings`` has one row per user and item (see ``user_item``).
    """
    ratings = stored(ratings, "ratings")
    neighbors = stored(user_neighbors(ratings, k=k_neighbors), "neighbors")
    if users is not None:
        neighbors = neighbors.join(users.select("user"), "user", "left_semi")
    open_items = candidate_items(neighbors, ratings, min_rating=min_neighbor_rating, unseen=True)
    return topk_per_group(open_items, group=["user"], order=[F.desc("score"), F.asc("item")], k=topn)


def enrich_title(df: DataFrame, titles: DataFrame, *, item: str = "item", title: str = "title") -> DataFrame:
    """Item titles, ``Movie <id>`` where there is none. Spark broadcasts the titles if they are small."""
    joined = df.join(titles.select(F.col(item), F.col(title).alias("_t")), item, "left")
    return joined.withColumn(title, F.coalesce("_t", F.format_string("Movie %d", F.col(item)))).drop("_t")


def relevant_hits(recommended: DataFrame, held: DataFrame, *, min_relevant: float = 4) -> DataFrame:
    liked = held.filter(F.col("rating") >= min_relevant).select("user", "item")
    return recommended.join(liked, ["user", "item"], "left_semi")


def holdout_complement(df: DataFrame, held: DataFrame, *, key: list[str]) -> DataFrame:
    return df.join(held.select(*key), key, "left_anti")


def precision_at_k(
    ratings: DataFrame,
    *,
    order: list[str],
    holdout: int = 5,
    topn: int = 5,
    min_relevant: float = 4,
    k_neighbors: int = 20,
) -> DataFrame:
    """Per user: recommendations, hits among the liked held-out items, precision.

    The last ``holdout`` ratings of each user are held out and the neighbors are found
    from the others.
    """
    marked = stored(last_n_holdout(ratings, user="user", order=order, n=holdout).select("user", "item", "rating", "held"), "marked")
    train = user_item(marked.filter(~F.col("held")))
    held = marked.filter("held").groupBy("user", "item").agg(F.max("rating").alias("rating"))
    recs = stored(recommend(train, k_neighbors=k_neighbors, topn=topn), "recommended")
    hits = relevant_hits(recs, held, min_relevant=min_relevant).groupBy("user").agg(F.count(F.lit(1)).alias("h"))
    evaluated = recs.groupBy("user").agg(F.count(F.lit(1)).alias("recs"))
    evaluated = evaluated.join(held.select("user").distinct(), "user", "left_semi").join(hits, "user", "left")
    counted = evaluated.select("user", "recs", F.coalesce("h", F.lit(0)).alias("hits"))
    return counted.withColumn("precision", F.col("hits") / F.col("recs"))
