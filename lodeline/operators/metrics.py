"""Evaluation of scores and predictions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeline.plans.hot_groups import running


def roc_auc(df: DataFrame, *, score: str, label: str, keys: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve from tie-averaged rank sums; NULL where only one class occurs.

    Rows are counted per distinct score first, so ranks come from running counts.
    """
    keys = list(keys)
    counts = df.groupBy(*keys, score).agg(F.sum(label).alias("_p"), F.count(F.lit(1)).alias("_n"))
    placed = running(counts, keys, [score], {"_before": ("sum", "_n")}, strict=True)
    rank = F.coalesce(F.col("_before"), F.lit(0)) + (F.col("_n") + 1) / 2
    made = placed.groupBy(*keys).agg(
        F.sum("_n").alias("rows"), F.sum("_p").alias("positive"), F.sum(F.col("_p") * rank).alias("_ranks")
    )
    p = F.col("positive")
    auc = F.try_divide(F.col("_ranks") - p * (p + 1) / 2, p * (F.col("rows") - p))
    return made.withColumn("auc", auc).drop("_ranks")


def confusion(df: DataFrame, *, label: str, prediction: str) -> DataFrame:
    return df.groupBy(F.col(label).alias("label"), F.col(prediction).alias("prediction")).agg(F.count(F.lit(1)).alias("n"))


def classification_report(df: DataFrame, *, label: str, prediction: str) -> DataFrame:
    """Precision, recall, F1, support per class and the overall accuracy, from the confusion counts."""
    cells = confusion(df, label=label, prediction=prediction)
    hit = F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0)
    by_label = cells.groupBy(F.col("label").alias("class")).agg(F.sum("n").alias("support"), F.sum(hit).alias("tp"))
    by_pred = cells.groupBy(F.col("prediction").alias("class")).agg(F.sum("n").alias("predicted"))
    joined = by_label.join(by_pred, "class", "left")
    accuracy = cells.agg(F.sum(hit) / F.sum("n")).scalar()
    precision = F.coalesce(F.try_divide("tp", "predicted"), F.lit(0.0))
    recall = F.col("tp") / F.col("support")
    joined = joined.withColumns({"precision": precision, "recall": recall})
    f1 = F.coalesce(
        F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)
    )
    return joined.withColumns({"f1": f1, "accuracy": accuracy}).select(
        "class", "precision", "recall", "f1", "support", "accuracy"
    )


def regression_metrics(df: DataFrame, *, actual: str, predicted: str) -> DataFrame:
    error = F.col(predicted) - F.col(actual)
    return df.agg(
        F.count(error).alias("rows"),
        F.avg(F.abs(error)).alias("mae"),
        F.avg(error * error).alias("mse"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
    )


def retrain_gate(runs: DataFrame, data: DataFrame, *, min_new: int = 1500) -> DataFrame:
    """One row: rows now, rows at the last run, new rows, and whether to train.

    The run log stores the row total of each run; the first run always trains.
    """
    now = data.agg(F.count(F.lit(1)).alias("rows_now"))
    last = runs.agg(F.max_by("total_rows", "started").alias("t")).scalar()
    new = F.col("rows_now") - F.coalesce(F.col("rows_last"), F.lit(0))
    made = now.withColumn("rows_last", last).withColumn("rows_new", new)
    return made.withColumn("train", F.col("rows_last").isNull() | (F.col("rows_new") >= min_new))
