"""Whole workflows: training tables, fitting, evaluation, splits, rescoring."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.fields import parse_fields
from ..operators import blocks as B
from ..operators import corpus, images, model, rules, score
from ..operators.features import block_features


def expected_of(reports: DataFrame) -> DataFrame:
    return reports.select("filename", "expected.name", "expected.birth_date", "expected.address").dropDuplicates(["filename"])


def build_table(reports: DataFrame, sizes: DataFrame, boilerplate: DataFrame | None = None, ngrams: DataFrame | None = None, use_face: bool = False, as_of_year: int | None = None) -> DataFrame:
    """Features and weak label of every block of a report."""
    feats = block_features(B.report_blocks(reports), sizes, boilerplate, ngrams, use_face, as_of_year)
    return model.labeled_blocks(feats, expected_of(reports), as_of_year)


def boilerplate_of(reports: DataFrame) -> DataFrame:
    """Frequency over identities of the expected fields."""
    ids = reports.select("filename", F.col("expected.name").alias("id_name"), F.col("expected.birth_date").alias("id_date"))
    blocks = B.report_blocks(reports).join(ids.dropDuplicates(["filename"]), "filename")
    return corpus.boilerplate_frequency(blocks, ids, ["id_name", "id_date"])


def ngrams_of(reports: DataFrame, sizes: DataFrame, as_of_year: int | None = None) -> DataFrame:
    return corpus.ngram_model(build_table(reports, sizes, as_of_year=as_of_year))


def fit(reports: DataFrame, sizes: DataFrame, classifier: str = "logreg", max_iter: int = 2000, **statistics) -> PipelineModel:
    table = build_table(reports, sizes, **statistics).cache()
    try:
        return model.fit(table, classifier, max_iter=max_iter)
    finally:
        table.unpersist()


def cards_of(reports: DataFrame) -> DataFrame:
    return reports.select("engine", "split", "filename").distinct()


def predict(reports: DataFrame, sizes: DataFrame, fitted: PipelineModel, method: str = "geo", boilerplate: DataFrame | None = None, as_of_year: int | None = None, frequency: DataFrame | None = None, ngrams: DataFrame | None = None, use_face: bool = False) -> DataFrame:
    """engine, split, filename, name, birth_date, address. method: plain or geo.

    boilerplate: the frequencies that bar blocks in the rule layer; frequency: those that the model was fitted with, as its feature.
    """
    return _predict(B.report_blocks(reports), cards_of(reports), sizes, fitted, method, boilerplate, as_of_year, boilerplate_feature=frequency, ngrams=ngrams, use_face=use_face)


def _predict(blocks: DataFrame, cards: DataFrame, sizes: DataFrame, fitted: PipelineModel, method: str, boilerplate: DataFrame | None, as_of_year: int | None, boilerplate_feature: DataFrame | None, ngrams: DataFrame | None, use_face: bool) -> DataFrame:
    scored = model.score(fitted, block_features(blocks, sizes, boilerplate_feature, ngrams, use_face, as_of_year))
    if method == "plain":
        return rules.predict_plain(scored, cards, as_of_year=as_of_year)
    return rules.predict_geometric(scored, cards, boilerplate, as_of_year=as_of_year)


def predict_two_engines(primary: DataFrame, secondary: DataFrame, sizes: DataFrame, fitted: PipelineModel, boilerplate: DataFrame | None = None, as_of_year: int | None = None, frequency: DataFrame | None = None, ngrams: DataFrame | None = None, use_face: bool = False) -> DataFrame:
    """Name and address from the primary engine; the date from both engines' blocks together. Both passes have all statistics."""
    statistics = {"boilerplate_feature": frequency, "ngrams": ngrams, "use_face": use_face}
    first = _predict(B.report_blocks(primary), cards_of(primary), sizes, fitted, "geo", boilerplate, as_of_year, **statistics)
    merged = B.merge_engines(B.report_blocks(primary), B.report_blocks(secondary))
    cards = cards_of(primary).withColumn("engine", F.lit("merged"))
    return rules.predict_multi_engine(first, _predict(merged, cards, sizes, fitted, "geo", boilerplate, as_of_year, **statistics))


def predict_images(files: DataFrame, engine: str, preprocessing: str = "none", as_of_year: int | None = None) -> DataFrame:
    """files (binaryFile rows, such as those without a record): filename, status, reason, name, birth_date, address by the text rules."""
    read = images.recognize(files, engine, transform=images.preprocessing(preprocessing))
    return read.select("filename", "status", "reason", parse_fields("raw.full", as_of_year).alias("f")).select("filename", "status", "reason", "f.*")


def coverage(predictions: DataFrame) -> DataFrame:
    """One row: files, and for each field those for which something was read; for files without a record, which can't be scored."""
    return predictions.agg(F.count(F.lit(1)).alias("files"), *[F.count_if(F.coalesce(F.col(c), F.lit("")) != "").alias(f"with_{c}") for c in ("name", "birth_date", "address")])


def evaluate(reports: DataFrame, predictions: DataFrame) -> DataFrame:
    """Metrics of predictions against the report's expected fields."""
    got = predictions.select("filename", F.struct("name", "birth_date", "address").alias("predicted"))
    return score.score_predictions(reports.select("filename", "expected").join(got, "filename"))


def rescore(reports: DataFrame, as_of_year: int | None = None) -> DataFrame:
    """Metrics of the text rules alone, from saved OCR text: no image is read."""
    return score.score_predictions(reports.withColumn("predicted", parse_fields("raw.full", as_of_year)))
