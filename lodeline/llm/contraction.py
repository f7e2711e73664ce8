"""Subtree totals of a forest by parallel tree contraction, all as joins and sums.

A round rakes all leaves (their totals go to the parents) and then compresses unary chains: a node
with one child is taken out where its hash exceeds those of its parent and its child, so no two
neighbours go at once and a third of every chain goes per round. What is left shrinks by a constant
factor, so rounds grow with the logarithm of the tree however deep it is. Nodes taken out of chains
get their totals afterwards, last round first, from the child they had when they went.

A node keeps the number of its children and the exclusive or of their ids; with one child left that
is the child's id, so children are never gathered, and a node with very many costs a partial sum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeline.session import stored

MAX_ROUNDS = 200


def with_children(tree: DataFrame, kids: DataFrame | None = None) -> DataFrame:
    """``tree`` with ``n_children`` and ``only``, the exclusive or of the children's ids.

    ``kids`` may hold sums of them already: (parent, n, x), several rows per parent allowed.
    """
    if kids is None:
        kids = tree.where("parent is not null").select("parent", F.lit(1).cast("long").alias("n"), F.col("id").alias("x"))
    sums = kids.groupBy(F.col("parent").alias("id")).agg(F.sum("n").alias("n_children"), F.bit_xor("x").alias("only"))
    none = F.lit(0).cast("long")
    return tree.join(sums, "id", "left").withColumns(
        {"n_children": F.coalesce("n_children", none), "only": F.coalesce("only", none)}
    )


def subtree_totals(tree: DataFrame, values: list[str]) -> DataFrame:
    """(id, n_leaves, *values): sums over each node's subtree, itself included.

    ``tree`` is stored and has ``id``, ``parent`` (null for a root; else the id of a row), the columns
    of ``with_children`` and ``values``, all long and, ids apart, small enough that their sums are long.
    An empty tree gives no rows. Rows that hang on a cycle or on a missing parent raise an error.
    """
    names = ["n_leaves", *values]
    start = {"n_leaves": (F.col("n_children") == 0).cast("long"), **{v: F.col(v).cast("long") for v in values}}
    live = tree.select(
        "id",
        "parent",
        F.col("n_children").alias("kids"),
        "only",
        *[c.alias(f"v{i}") for i, c in enumerate(start.values())],
        *[F.lit(0).cast("long").alias(f"up{i}") for i in range(len(names))],
    )
    total = [f"v{i}" for i in range(len(names))]
    rounds: list[tuple[DataFrame, DataFrame | None]] = []
    n_live, n_roots = live.agg(F.count("*"), F.count_if(F.col("parent").isNull())).first()
    while n_live > n_roots:
        if len(rounds) == MAX_ROUNDS:
            raise RuntimeError("the tree did not contract: a cycle or a missing parent")
        leaves = live.where("kids = 0 and parent is not null").select("id", "parent", *total, *_ups(names))
        live = stored(_compress(_rake(live, leaves, total), total, len(rounds)), "contracted")
        n_live, n_roots, gone = live.agg(F.count("*"), F.count_if(F.col("parent").isNull()), F.count("gone")).first()
        rounds.append((leaves.select("id", *total), live.where("gone is not null") if gone else None))
        live = live.drop("gone", *[f"gone{i}" for i in range(len(names))])
    known = live.select("id", *total)
    for k, (leaves, chained) in reversed(list(enumerate(rounds))):
        if chained is not None:
            below = chained.select("id", "gone", *[f"gone{i}" for i in range(len(names))]).join(known, "id")
            opened = [(F.col(f"v{i}") + F.col(f"gone{i}")).alias(f"v{i}") for i in range(len(names))]
            known = known.unionByName(below.select(F.col("gone").alias("id"), *opened))
        known = known.unionByName(leaves)
        known = stored(known, "known") if k else known
    return known.select("id", *[F.col(f"v{i}").alias(n) for i, n in enumerate(names)])


def _ups(names: list[str]) -> list[str]:
    return [f"up{i}" for i in range(len(names))]


def _plus(a: str, b: str) -> Column:
    return F.col(a) + F.coalesce(F.col(b), F.lit(0))


def _rake(live: DataFrame, leaves: DataFrame, total: list[str]) -> DataFrame:
    """What stays when the leaves go: a parent takes their totals and what chains above them held."""
    lost = leaves.groupBy(F.col("parent").alias("id")).agg(
        F.count("*").alias("n"),
        F.bit_xor("id").alias("x"),
        *[F.sum(F.col(v) + F.col(v.replace("v", "up"))).alias(f"a_{v}") for v in total],
    )
    rest = live.where("kids > 0 or parent is null").join(lost, "id", "left")
    return rest.select(
        "id",
        "parent",
        (F.col("kids") - F.coalesce("n", F.lit(0))).alias("kids"),
        F.col("only").bitwiseXOR(F.coalesce("x", F.lit(0))).alias("only"),
        *[_plus(v, f"a_{v}").alias(v) for v in total],
        *[v.replace("v", "up") for v in total],
    )


def _compress(kept: DataFrame, total: list[str], salt: int) -> DataFrame:
    """What stays when local maxima of a hash leave their chains.

    The child of a node that goes hangs on the node's parent and carries the node's own values upwards
    (``up``). Its row names the node (``gone``) and what the node's total is above the child's.
    """
    rank = lambda c: F.xxhash64(F.lit(salt), F.col(c))
    above = (rank("id") > rank("parent")) & (rank("id") > rank("only"))
    goes = F.coalesce((F.col("kids") == 1) & F.col("parent").isNotNull() & above, F.lit(False))
    out = kept.where(goes)
    zero = F.lit(0).cast("long")
    to_child = {
        "id": F.col("only"),
        "to": F.col("parent"),
        "gone": F.col("id"),
        "x": zero,
        **{f"own_{v}": F.col(v) for v in total},
        **{f"a_{v}": F.col(v) + F.col(v.replace("v", "up")) for v in total},
    }
    to_parent = {n: zero for n in to_child} | {
        "id": F.col("parent"),
        "to": F.lit(None).cast("long"),
        "gone": F.lit(None).cast("long"),
        "x": F.col("id").bitwiseXOR(F.col("only")),
    }
    both = [F.struct(*[c.alias(n) for n, c in news.items()]) for news in (to_child, to_parent)]
    news = kept.where(goes).select(F.inline(F.array(*both))).groupBy("id").agg(
        F.max("to").alias("to"),
        F.max("gone").alias("gone"),
        F.bit_xor("x").alias("x"),
        *[F.sum(c).alias(c) for v in total for c in (f"own_{v}", f"a_{v}")],
    )
    rest = kept.where(~goes).join(news, "id", "left")
    up = [v.replace("v", "up") for v in total]
    return rest.select(
        "id",
        F.coalesce("to", "parent").alias("parent"),
        "kids",
        F.col("only").bitwiseXOR(F.coalesce("x", zero)).alias("only"),
        *total,
        *[_plus(u, f"a_{v}").alias(u) for u, v in zip(up, total)],
        "gone",
        *[_plus(u, f"own_{v}").alias(u.replace("up", "gone")) for u, v in zip(up, total)],
    )

