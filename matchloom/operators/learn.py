"""Boosted trees over pair features: grouped out-of-fold scores, a second stage, a stacker."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scores import fold
from .context import score_context

#: Settings of the classifier: trees of depth 7 have as many leaves as leaf-wise trees of 127 leaves.
SETTINGS = {"maxIter": 50, "stepSize": 0.1, "maxDepth": 7, "subsamplingRate": 0.8, "minInstancesPerNode": 50, "seed": 42}
#: Gain that a second stage must bring to be used.
GATE = 0.0005


def assembled(df: DataFrame, columns: list[str]) -> DataFrame:
    """Features as a vector; what is missing counts as -1."""
    return VectorAssembler(inputCols=columns, outputCol="_x").transform(df.fillna(-1.0, columns))


def fit(df: DataFrame, columns: list[str], label: str = "label", validation: str | None = None, **settings):
    """A model; validation names a boolean column whose rows stop the boosting early."""
    gbt = GBTClassifier(featuresCol="_x", labelCol=label, **{**SETTINGS, **settings})
    if validation:
        gbt = gbt.setValidationIndicatorCol(validation)
    return gbt.fit(assembled(df, columns).withColumn(label, F.col(label).cast("double")))


def predict(model, df: DataFrame, columns: list[str], out: str = "prob") -> DataFrame:
    done = model.transform(assembled(df, columns))
    return done.withColumn(out, vector_to_array("probability")[1]).drop("_x", "rawPrediction", "probability", "prediction")


def out_of_fold(df: DataFrame, columns: list[str], folds: int = 5, key: str = "s1_id", out: str = "prob", early_stopping: bool = True, **settings) -> tuple[DataFrame, list]:
    """Each row scored by the model of the other folds, and the models; folds keep a primary record's pairs together.

    With early stopping a fold's own rows end the boosting of the model that scores them.
    """
    df = df.withColumn("_fold", fold(F.col(key), folds))
    models, parts = [], None
    for k in range(folds):
        held_out = F.col("_fold") == k
        if early_stopping:
            model = fit(df.withColumn("_stop", held_out), columns, validation="_stop", **settings)
        else:
            model = fit(df.where(~held_out), columns, **settings)
        part = predict(model, df.where(held_out), columns, out)
        models.append(model)
        parts = part if parts is None else parts.unionByName(part)
    return parts.drop("_fold"), models


def fit_and_refit(df: DataFrame, columns: list[str], key: str = "s1_id", **settings):
    """A stacker: boosting is stopped by fold 15 of 20, then all rows are fitted with as many trees."""
    marked = df.withColumn("_stop", fold(F.col(key), 20) == 15)
    trees = fit(marked, columns, validation="_stop", **settings).getNumTrees
    return fit(df, columns, **{**settings, "maxIter": trees})


def predict_mean(models: list, df: DataFrame, columns: list[str], out: str = "prob") -> DataFrame:
    """Mean of the fold models."""
    for i, m in enumerate(models):
        df = predict(m, df, columns, f"_p{i}")
    mean = sum(F.col(f"_p{i}") for i in range(len(models))) / len(models)
    return df.withColumn(out, mean).drop(*[f"_p{i}" for i in range(len(models))])


def second_stage(df: DataFrame, score: str = "prob") -> tuple[DataFrame, list[str]]:
    """df with the first stage's score and its context, and their names."""
    out = score_context(df.withColumn("p1", F.col(score)), "p1", "p1")
    return out, ["p1", "p1_rank", "p1_max", "p1_gap", "p1_sum", "p1_n50", "p1_second"]


def accepted(first: float, second: float) -> bool:
    return second > first + GATE


def importance(models: list, columns: list[str], top: int = 15) -> list[tuple[str, float]]:
    """Mean gain of the features over the fold models, the best first."""
    mean = [sum(float(m.featureImportances[i]) for m in models) / len(models) for i in range(len(columns))]
    return sorted(zip(columns, mean), key=lambda x: (-x[1], x[0]))[:top]


def save(models: list, path: str, stage: int = 1) -> None:
    for i, m in enumerate(models):
        m.write().overwrite().save(f"{path}/stage{stage}_model_{i}")


def load(path: str, n: int, stage: int = 1) -> list:
    from pyspark.ml.classification import GBTClassificationModel

    return [GBTClassificationModel.load(f"{path}/stage{stage}_model_{i}") for i in range(n)]


def quarter_stack(df: DataFrame, columns: list[str], key: str = "s1_id", **settings) -> DataFrame:
    """Out-of-fold scores over the four quarters of fold 0: one quarter is scored, one stops the boosting, two are fitted."""
    quarters, parts = [0, 5, 10, 15], None
    df = df.withColumn("_q", fold(F.col(key), 20)).where(F.col("_q").isin(*quarters))
    for q in quarters:
        stop = 5 if q == 0 else 0
        model = fit(df.where(F.col("_q") != q).withColumn("_stop", F.col("_q") == stop), columns, validation="_stop", **settings)
        part = predict(model, df.where(F.col("_q") == q), columns, "stack_prob")
        parts = part if parts is None else parts.unionByName(part)
    return parts.drop("_q")
