"""Test-then-train naive Bayes over an ordered message table, and its comparison with a batch model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeline.functions.text import words
from lodeline.plans.hot_groups import WINDOW_ROWS, running
from lodeline.plans.layout import dealt, dealt_texts
from lodeline.session import stored


def token_counts(df: DataFrame, *, order: str, text: str, label: str) -> DataFrame:
    """Occurrences of each lowercased word per message; a task counts a bounded amount of text."""
    texts = dealt_texts(df.select(order, label, text), text, order)
    tokens = texts.select(order, label, F.explode(words(F.lower(text))).alias("w"))
    return tokens.groupBy(order, label, "w").agg(F.count(F.lit(1)).alias("tf"))


def log_score(own: Column, total: Column, vocabulary: Column, smoothing: float) -> Column:
    """Smoothed log probability of a word in a class with ``own`` of ``total`` word counts."""
    return F.log((own + smoothing) / F.greatest(total + smoothing * vocabulary, F.lit(1.0)))


def decide(s0: Column, s1: Column) -> Column:
    """The class with the higher score; a class never seen has no score."""
    return F.when(s1.isNotNull() & (s0.isNull() | (s1 > s0)), 1).otherwise(0)


NOTHING = {"d0": 0, "d1": 0, "t0": 0, "t1": 0, "v": 0}


def prequential_nb(
    df: DataFrame, *, order: str, text: str, label: str, smoothing: float = 1.0, known: DataFrame | None = None,
    totals: dict[str, int] | None = None, tokens: DataFrame | None = None,
) -> DataFrame:
    """For each message the scores and predictions before and after learning it.

    A message is scored with the counts of all earlier ones. These counts are running sums:
    per word for the word counts, over all messages for the totals and the vocabulary size
    (a word counts as new where its running count is still zero). A word that occurs in most
    messages is split into blocks like any long group. Nothing is iterated.

    ``known`` (w, n0, n1) and ``totals`` (messages d0 d1, words t0 t1, vocabulary v) are what was
    learned before the first message. ``tokens`` are the stored ``token_counts``, if they are at hand.
    """
    start = {**NOTHING, **(totals or {})}
    own = lambda c: F.when(F.col(label) == c, F.col("tf")).otherwise(0)
    if tokens is None:
        tokens = stored(token_counts(df, order=order, text=text, label=label), "message-words")
    n = tokens.count()
    tokens = running(
        tokens, ["w"], [order], {"n0": ("sum", own(0)), "n1": ("sum", own(1))}, strict=True, rows=n
    ).fillna(0, ["n0", "n1"])
    if known is not None:
        before = known.select("w", *[F.col(f"n{c}").alias(f"_k{c}") for c in (0, 1)])
        tokens = tokens.join(before, "w", "left").fillna(0, ["_k0", "_k1"])
        tokens = tokens.withColumns({f"n{c}": F.col(f"n{c}") + F.col(f"_k{c}") for c in (0, 1)}).drop("_k0", "_k1")
    tokens = stored(tokens, "token-counts")

    sums = tokens.groupBy(order).agg(
        F.sum("tf").alias("t"), F.count_if((F.col("n0") + F.col("n1")) == 0).alias("fresh")
    )
    rows = df.select(order, label).join(sums, order, "left").fillna(0, ["t", "fresh"])
    of = lambda c, x: F.when(F.col(label) == c, x).otherwise(0)
    sums = running(
        rows,
        [],
        [order],
        {
            "T0": ("sum", of(0, F.col("t"))),
            "T1": ("sum", of(1, F.col("t"))),
            "D0": ("sum", of(0, F.lit(1))),
            "D1": ("sum", of(1, F.lit(1))),
            "V": ("sum", "fresh"),
        },
        strict=True,
    ).fillna(0, ["T0", "T1", "D0", "D1", "V"])
    sums = sums.withColumns({n: F.col(n) + F.lit(start[n.lower()]) for n in ("T0", "T1", "D0", "D1", "V")})
    totals = stored(sums, "message-totals")

    by_message = lambda x: dealt(x, n, order, task_rows=WINDOW_ROWS)
    joined = by_message(tokens.drop(label)).join(by_message(totals), order)
    parts = []
    for c in (0, 1):
        mine = F.when(F.col(label) == c, 1).otherwise(0)
        before = log_score(F.col(f"n{c}"), F.col(f"T{c}"), F.col("V"), smoothing)
        after = log_score(
            F.col(f"n{c}") + mine * F.col("tf"), F.col(f"T{c}") + mine * F.col("t"), F.col("V") + F.col("fresh"), smoothing
        )
        parts += [F.sum(F.col("tf") * before).alias(f"_pre{c}"), F.sum(F.col("tf") * after).alias(f"_post{c}")]
    likelihood = joined.groupBy(order).agg(*parts)

    scored = totals.join(likelihood, order, "left").fillna(0.0, ["_pre0", "_pre1", "_post0", "_post1"])
    seen = F.col("D0") + F.col("D1")
    made = {}
    for c in (0, 1):
        mine = F.when(F.col(label) == c, 1).otherwise(0)
        prior = F.when(F.col(f"D{c}") > 0, F.log(F.col(f"D{c}") / seen))
        prior_after = F.when(F.col(f"D{c}") + mine > 0, F.log((F.col(f"D{c}") + mine) / (seen + 1)))
        made[f"pre_score{c}"] = F.col(f"_pre{c}") + prior
        made[f"post_score{c}"] = F.col(f"_post{c}") + prior_after
    scored = scored.withColumns(made)
    scored = scored.withColumns(
        {
            "pre_pred": decide(F.col("pre_score0"), F.col("pre_score1")),
            "post_pred": decide(F.col("post_score0"), F.col("post_score1")),
        }
    )
    return scored.withColumn("changed", F.col("pre_pred") != F.col("post_pred")).select(
        order, label, "pre_score0", "pre_score1", "post_score0", "post_score1", "pre_pred", "post_pred", "changed"
    )


def fit_batch_nb(train: DataFrame, *, text: str, label: str) -> tuple[DataFrame, dict[str, int]]:
    """Word counts per class as a table of all words (w, n0, n1), and the totals: words, vocabulary and messages."""
    of = lambda c, x: F.coalesce(F.sum(F.when(F.col(label) == c, x).otherwise(0)), F.lit(0)).cast("long")
    tokens = dealt_texts(train.select(label, text), text).select(label, F.explode(words(F.lower(text))).alias("w"))
    counts = stored(tokens.groupBy("w").agg(*[of(c, F.lit(1)).alias(f"n{c}") for c in (0, 1)]), "word-counts")
    sums = counts.agg(F.count("w").alias("v"), *[F.coalesce(F.sum(f"n{c}"), F.lit(0)).alias(f"t{c}") for c in (0, 1)]).first()
    seen = train.agg(*[of(c, F.lit(1)).alias(f"d{c}") for c in (0, 1)]).first()
    return counts, {**sums.asDict(), **seen.asDict()}


def batch_naive_bayes(
    train: DataFrame, stream: DataFrame, *, order: str, text: str, label: str, keep: list[str], smoothing: float = 1.0
) -> DataFrame:
    """The stream scored by a model fixed on the training part: prediction and confidence.

    Multinomial naive Bayes with all training words; words that training never saw are left
    out. ``order`` is the unique id of a message. A class without training messages is never
    predicted.
    """
    counts, t = fit_batch_nb(train, text=text, label=label)
    tokens = token_counts(stream, order=order, text=text, label=label).join(counts, "w")
    parts = [
        F.sum(F.col("tf") * log_score(F.col(f"n{c}"), F.lit(t[f"t{c}"]), F.lit(t["v"]), smoothing)).alias(f"_s{c}") for c in (0, 1)
    ]
    sums = tokens.groupBy(order).agg(*parts)
    seen = t["d0"] + t["d1"]
    prior = [F.log(F.lit(t[f"d{c}"] / seen)) if t[f"d{c}"] else F.lit(None).cast("double") for c in (0, 1)]
    rows = stream.select(*dict.fromkeys([order, *keep])).join(sums, order, "left").fillna(0.0, ["_s0", "_s1"])
    s0, s1 = F.col("_s0") + prior[0], F.col("_s1") + prior[1]
    sure = 1 / (1 + F.exp(-F.abs(s1 - s0)))
    return rows.select(*keep, decide(s0, s1).alias("batch_pred"), F.coalesce(sure, F.lit(1.0)).alias("batch_confidence"))


def drift_scoreboard(online: DataFrame, batch: DataFrame, *, order: str, label: str, phase: str) -> DataFrame:
    """Per phase: accuracy of the batch model and of the online one before and after learning."""
    joined = online.join(batch.select(order, phase, "batch_pred"), order)
    right = lambda c: (F.col(c) == F.col(label)).cast("int")
    return joined.groupBy(phase).agg(
        F.count(F.lit(1)).alias("messages"),
        F.avg(right("batch_pred")).alias("batch_accuracy"),
        F.avg(right("pre_pred")).alias("online_accuracy"),
        F.avg(right("post_pred")).alias("online_accuracy_after_learning"),
        F.sum(1 - right("batch_pred")).alias("batch_missed"),
        F.sum(right("post_pred")).alias("correct_after_learning"),
        F.count_if("changed").alias("updates"),
    )
