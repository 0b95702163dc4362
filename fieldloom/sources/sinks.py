"""Sinks: split manifests, summaries, reports, experiment log, logs, models."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vocabulary import FIELDS
from ..shared import put_joined, remove, replace_folder
from .ingest import REPORT_BY_LINE, REPORT_HEAD_END


def write_splits(splits: DataFrame, path: str) -> None:
    """A folder for each split, rows sorted by file name within and over its files. Ranges of split and name, so that no split is one task."""
    rows = splits.repartitionByRange("split", "filename").sortWithinPartitions("split", "filename")
    rows.write.mode("overwrite").partitionBy("split").csv(path, header=True, escape='"', emptyValue="")


def write_manifest(files: DataFrame, path: str) -> None:
    files.select("filename").orderBy("filename").coalesce(1).write.mode("overwrite").csv(path, header=True)


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").csv(path, header=True, escape='"', emptyValue="")


def reloads_equal(rows: DataFrame, again: DataFrame) -> bool:
    """Same columns and the same rows, however ordered: counts and two sums of hashes over all cells as text."""
    if rows.columns != again.columns:
        return False
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in rows.columns]
    sums = [F.count(F.lit(1)), *[F.sum(F.xxhash64(F.lit(k), *cells).cast("decimal(38,0)")) for k in range(2)]]
    return tuple(rows.agg(*sums).first()) == tuple(again.agg(*sums).first())


def split_summary(splits: DataFrame) -> DataFrame:
    """Per split: rows, identities, rows of the largest identity, rows with an address. Two levels, so identities combine before the shuffle."""
    by_identity = splits.groupBy("split", "name", "birth_date").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("address") != "").alias("with_address"))
    return by_identity.groupBy("split").agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("identities"), F.coalesce(F.max("n"), F.lit(0)).alias("max_rows"), F.sum("with_address").alias("address_rows"))


def report(predictions: DataFrame, engine: str, metrics: DataFrame) -> DataFrame:
    """One document as a row: engine, metrics, predictions in file-name order. It has to fit a task; write_report writes it at any size."""
    preds = predictions.agg(F.array_sort(F.collect_list(F.struct("filename", "expected", "predicted", "raw"))).alias("predictions"))
    return metrics.crossJoin(preds).select(F.lit(engine).alias("engine"), "metrics", "predictions")


def write_report(predictions: DataFrame, engine: str, metrics: DataFrame, path: str) -> None:
    """The document of report() as the one file of a folder, at any size.

    It has a prediction a line, so read_reports reads it in parts. Tasks write sorted lines, and the driver's JVM copies them into the file: no task or driver
    holds more than a prediction. A report that was there stays until the new one is whole.
    """
    spark = predictions.sparkSession
    order = ["filename", "expected", "predicted", "raw"]
    heads = metrics.select(F.to_json(F.struct(F.lit(engine).alias("engine"), "metrics"), {"ignoreNullFields": "false"})).limit(2).collect()
    if len(heads) != 1:
        raise ValueError("a report has one row of metrics")
    rows = predictions.select(*order).repartitionByRange(*order[:3]).sortWithinPartitions(*order)
    above, _, name = path.rstrip("/").rpartition("/")
    parts = f"{above}/_{name}-{uuid.uuid4().hex}" if above else f"_{name}-{uuid.uuid4().hex}"
    try:
        rows.select(F.concat(F.lit(","), F.to_json(F.struct(*order))).alias("value")).write.text(parts, compression="none", lineSep="\n")
        put_joined(spark, f"{parts}/_whole", f"{heads[0][0][:-1]},{REPORT_HEAD_END}\n".encode(), parts, b"]}\n", 1)
        replace_folder(spark, path, REPORT_BY_LINE, f"{parts}/_whole")
    finally:
        remove(spark, parts)


def write_predictions(predictions: DataFrame, path: str, engine: str) -> None:
    """The predictions as JSON lines, one a prediction: for sets of any size; aggregates go to the experiment log."""
    predictions.select(F.lit(engine).alias("engine"), "filename", "expected", "predicted", "raw").write.mode("overwrite").json(path)


def write_files(files: DataFrame, folder: str) -> DataFrame:
    """files (filename, content): each as a file of its own in a folder that all executors share; filename and its bytes come back.

    A file is written under another name and moved, so a task that is tried again leaves whole files only.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.makedirs(folder, exist_ok=True)
        for batch in batches:
            names, sizes = batch.column(0).to_pylist(), []
            for name, content in zip(names, batch.column(1).to_pylist(), strict=True):
                path = os.path.join(folder, os.path.basename(name))
                part = f"{path}.{uuid.uuid4().hex}.part"
                with open(part, "wb") as f:
                    f.write(content)
                os.replace(part, path)
                sizes.append(len(content))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(sizes, pa.int64())], names=["filename", "bytes"])

    return files.select("filename", "content").mapInArrow(write, "filename string, bytes long")


def write_json(doc: DataFrame, path: str) -> None:
    doc.coalesce(1).write.mode("overwrite").json(path)


def log_experiment(metrics: DataFrame, path: str, engine: str, split: str, method: str) -> None:
    """Appends one line with aggregates only."""
    row = metrics.select(F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX").alias("timestamp"), F.lit(engine).alias("engine"), F.lit(split).alias("split"), F.lit(method).alias("method"), "metrics")
    row.coalesce(1).write.mode("append").json(path)


def save_model(model: PipelineModel, boilerplate: DataFrame, path: str) -> None:
    model.write().overwrite().save(f"{path}/model")
    boilerplate.write.mode("overwrite").parquet(f"{path}/boilerplate")


def load_model(spark, path: str) -> tuple[PipelineModel, DataFrame]:
    return PipelineModel.load(f"{path}/model"), spark.read.parquet(f"{path}/boilerplate")


__all__ = ["FIELDS", "write_splits", "write_manifest", "write_csv", "write_predictions", "write_files", "reloads_equal", "split_summary", "report", "write_report", "write_json", "log_experiment", "save_model", "load_model"]
