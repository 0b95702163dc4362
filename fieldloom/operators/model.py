"""Block classification with pyspark.ml."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import IndexToString, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.fields import label_block
from .blocks import CARD
from .features import FEATURES


def labeled_blocks(features: DataFrame, expected: DataFrame, as_of_year: int | None = None) -> DataFrame:
    """features with the weak label of each block. expected: filename and the three fields."""
    e = expected.select("filename", *[F.col(f).alias(f"__{f}") for f in ("name", "birth_date", "address")])
    out = features.join(e, "filename").withColumn("label", label_block("text", "__name", "__birth_date", "__address", as_of_year=as_of_year))
    return out.drop("__name", "__birth_date", "__address")


def balanced_weights(rows: DataFrame, label: str = "label") -> DataFrame:
    """weight: n / (classes * n of the class), so that each class weighs the same. The class table has a row per class."""
    counts = rows.groupBy(label).agg(F.count(F.lit(1)).alias("__n"))
    totals = counts.agg(F.sum("__n").alias("__all"), F.count(F.lit(1)).alias("__k"))
    return rows.join(F.broadcast(counts.crossJoin(totals)), label).withColumn("weight", F.col("__all") / (F.col("__k") * F.col("__n"))).drop("__n", "__all", "__k")


def fit(rows: DataFrame, classifier: str = "logreg", features: tuple[str, ...] = FEATURES, max_iter: int = 2000) -> PipelineModel:
    """A pipeline from feature columns to probabilities. logreg: multinomial, unscaled, L2 of strength 1 over the weighted sum; forest and
    hgb (one-vs-rest boosting) stand in for histogram boosting."""
    weighted = balanced_weights(rows)
    stages = [StringIndexer(inputCol="label", outputCol="__label", stringOrderType="alphabetAsc"), VectorAssembler(inputCols=list(features), outputCol="__x")]
    if classifier == "logreg":
        n = max(1, weighted.count())
        learner = LogisticRegression(featuresCol="__x", labelCol="__label", weightCol="weight", family="multinomial", standardization=False, regParam=1.0 / n, maxIter=max_iter, tol=1e-6, probabilityCol="__p", predictionCol="__y", rawPredictionCol="__raw")
    elif classifier == "forest":
        learner = RandomForestClassifier(featuresCol="__x", labelCol="__label", weightCol="weight", numTrees=100, seed=42, probabilityCol="__p", predictionCol="__y", rawPredictionCol="__raw")
    elif classifier == "hgb":
        learner = OneVsRest(featuresCol="__x", labelCol="__label", weightCol="weight", predictionCol="__y", rawPredictionCol="__raw", classifier=GBTClassifier(maxIter=30, seed=42))
    else:
        raise ValueError(f"{classifier} is not available: logreg, forest, hgb")
    indexer = stages[0].fit(weighted)
    decode = IndexToString(inputCol="__y", outputCol="predicted_label", labels=indexer.labels)
    return Pipeline(stages=[indexer, stages[1], learner, decode]).fit(weighted)


def classes(model: PipelineModel) -> list[str]:
    return list(model.stages[0].labels)


def score(model: PipelineModel, features: DataFrame) -> DataFrame:
    """features with p_name, p_birth_date, p_address and predicted_label; a class that training never saw has probability 0."""
    own = "label" in features.columns
    rows = features.withColumnRenamed("label", "__own") if own else features
    out = model.transform(rows.withColumn("label", F.lit(classes(model)[0])))
    if "__p" in out.columns:
        p = vector_to_array("__p")
    else:  # one-vs-rest gives a score per class
        raw = F.transform(vector_to_array("__raw"), lambda s: 1 / (1 + F.exp(-2 * s)))
        p = F.transform(raw, lambda s: s / F.aggregate(raw, F.lit(0.0), lambda a, b: a + b))
    at = {c: i for i, c in enumerate(classes(model))}
    probs = {f"p_{f}": p[at[f]] if f in at else F.lit(0.0) for f in ("name", "birth_date", "address")}
    out = out.withColumns(probs).drop("__x", "__label", "__p", "__y", "__raw", "label")
    return out.withColumnRenamed("__own", "label") if own else out


def top_coefficients(model: PipelineModel, k: int = 4, features: tuple[str, ...] = FEATURES) -> dict[str, list[tuple[str, float]]]:
    """The k largest coefficients of each class; the matrix is classes x features, so this is driver work."""
    matrix = model.stages[2].coefficientMatrix.toArray()
    return {c: sorted(zip(features, map(float, row), strict=True), key=lambda t: (-t[1], t[0]))[:k] for c, row in zip(classes(model), matrix, strict=True)}


KEYS = (*CARD, "block_idx")
