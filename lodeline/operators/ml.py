"""Training, scoring and comparing models with Spark ML."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodeline.operators import boosting
from lodeline.operators.metrics import roc_auc
from lodeline.operators.windows import stratified_split, walk_forward
from lodeline.plans.layout import spread, waves
from lodeline.session import stored

# Forests trained at once.
FITS_AT_ONCE = 4
# Rows of one task that trains or scores.
FIT_ROWS, SCORE_ROWS = 1_000_000, 100_000


def rf_classifier(
    train: DataFrame, *, features: Sequence[str], label: str, trees: int = 100, depth: int = 10, min_leaf: int = 5, seed: int = 42
):
    """A forest pipeline that indexes labels in sorted order and returns label names."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import IndexToString, StringIndexer, VectorAssembler

    indexer = StringIndexer(inputCol=label, outputCol="_label", stringOrderType="alphabetAsc", handleInvalid="keep").fit(train)
    stages = [
        indexer,
        VectorAssembler(inputCols=list(features), outputCol="_features", handleInvalid="keep"),
        RandomForestClassifier(
            featuresCol="_features", labelCol="_label", numTrees=trees, maxDepth=depth, minInstancesPerNode=min_leaf, seed=seed
        ),
        IndexToString(inputCol="prediction", outputCol="predicted", labels=indexer.labels),
    ]
    return Pipeline(stages=stages).fit(waves(train.select(label, *features), FIT_ROWS))


def feature_importance(model, features: Sequence[str], spark) -> DataFrame:
    """Ranked importances; one row per feature, so bounded by the feature list."""
    forest = next(s for s in model.stages if hasattr(s, "featureImportances"))
    rows = [(n, float(v)) for n, v in zip(features, forest.featureImportances.toArray())]
    df = spark.createDataFrame(rows, "feature_name string, importance double")
    return df.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("importance"), "feature_name")))


def save_model(model, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str):
    from pyspark.ml import PipelineModel

    return PipelineModel.load(path)


def batch_score(model, df: DataFrame, *, keep: Sequence[str]) -> DataFrame:
    """Predicted label and the highest class probability; all cores score."""
    from pyspark.ml.functions import vector_to_array

    scored = model.transform(waves(df, SCORE_ROWS))
    return scored.select(*keep, "predicted", F.array_max(vector_to_array("probability")).alias("confidence"))


def _binary_auc(train: DataFrame, test: DataFrame, features: Sequence[str], label: str, trees: int, seed: int):
    """AUC of a forest on the test rows, or None for a one-class test part."""
    from pyspark.ml import Pipeline

    from lodeline.operators.forest import BinaryForest

    forest = BinaryForest(features=features, label=label, trees=trees, seed=seed)
    model = Pipeline(stages=[forest]).fit(spread(train.select(label, *features)))
    # Rows of one part may lie in few files. Scores are read more than once.
    scored = model.transform(waves(test.select(label, *features), SCORE_ROWS)).select(label, "score")
    return roc_auc(stored(scored, "scored"), score="score", label=label).first()["auc"]


def leakage_gap_report(
    honest: DataFrame,
    shortcut: DataFrame,
    *,
    honest_features: Sequence[str],
    shortcut_features: Sequence[str],
    key: str,
    order: Sequence[str],
    label: str,
    n_splits: int = 5,
    repeats: int = 3,
    trees: int = 300,
) -> DataFrame:
    """Mean AUC of as-of features under walk-forward evaluation, against global features under shuffled splits.

    One row per setting and fold, plus the two means and their gap (shortcut minus honest).
    """
    spark = honest.sparkSession
    cols = lambda df, fs: df.select(key, *order, label, *fs).fillna(0, list(fs))
    # The split reads its rows more than once.
    h = stored(cols(honest, honest_features), "features")
    h = stored(walk_forward(h, order=[*order, key], n_splits=n_splits), "honest")
    s = stored(cols(shortcut, shortcut_features), "shortcut")
    jobs = []
    for fold in range(n_splits):
        train, test = h.filter(F.col("block") <= fold), h.filter(F.col("block") == fold + 1)
        if train.select(label).distinct().count() < 2:
            continue
        jobs.append(("honest", fold, train, test, honest_features))
    for i in range(repeats):
        split = stored(stratified_split(s, key=key, label=label, test_size=0.25, seed=i), "shuffled")
        train, test = split.filter(F.col("split") == "train"), split.filter(F.col("split") == "test")
        jobs.append(("shortcut", i, train, test, shortcut_features))

    def one(job):
        setting, i, train, test, features = job
        return setting, i, _binary_auc(train, test, features, label, trees, 42)

    with ThreadPoolExecutor(FITS_AT_ONCE) as pool:
        rows = [f.result() for f in [pool.submit(inheritable_thread_target(one), j) for j in jobs]]
    per = spark.createDataFrame([r for r in rows if r[2] is not None], "setting string, fold int, auc double")
    fold = F.lit(None).cast("int").alias("fold")
    means = per.groupBy("setting").agg(F.avg("auc").alias("auc")).select("setting", fold, "auc")
    of = lambda name: F.avg(F.when(F.col("setting") == name, F.col("auc")))
    gap = per.agg((of("shortcut") - of("honest")).alias("auc")).select(F.lit("gap").alias("setting"), fold, "auc")
    return per.unionByName(means).unionByName(gap)


# The inputs of the load forecast.
FORECAST_FEATURES = (
    "hour", "dayofweek", "quarter", "month", "year", "dayofyear", "dayofmonth", "weekofyear", "lag_1", "lag_24", "rolling_mean",
)


def gbt_forecast(
    df: DataFrame, *, target: str, split: str = "split", features: Sequence[str] = FORECAST_FEATURES,
    rounds: int = 1000, rate: float = 0.01, depth: int = 3, patience: int = 50,
) -> boosting.BoostedTrees:
    """Boosted trees that stop ``patience`` rounds after their best on a validation slice and are cut there.

    The test slice is not looked at. ``split`` holds train, validation or test.
    """
    used = df.filter(F.col(split) != "test").withColumn("_valid", F.col(split) == "validation")
    return boosting.fit(
        used, target=target, features=features, valid="_valid", rounds=rounds, rate=rate, depth=depth, patience=patience
    )


def linear_regression(df: DataFrame, *, features: Sequence[str], target: str):
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    return Pipeline(
        stages=[
            VectorAssembler(inputCols=list(features), outputCol="_features"),
            LinearRegression(featuresCol="_features", labelCol=target, regParam=0.0, solver="normal"),
        ]
    ).fit(df)
