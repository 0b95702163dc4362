"""Extension: saved reports as a file stream, flattened to blocks and rule-based fields as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..functions.fields import parse_fields
from ..sources.ingest import REPORT


def stream_reports(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    docs = spark.readStream.schema(REPORT).option("multiLine", True).option("maxFilesPerTrigger", files_per_trigger).json(path)
    return docs.select("engine", F.explode("predictions").alias("p")).select("engine", "p.*")


def stream_blocks(reports: DataFrame) -> DataFrame:
    return reports.select("engine", "filename", F.posexplode(F.coalesce("raw.blocks", F.expr("array()"))).alias("block_idx", "b")).select("engine", "filename", "block_idx", "b.*")


def stream_predictions(reports: DataFrame, as_of_year: int | None = None) -> DataFrame:
    return reports.select("engine", "filename", parse_fields("raw.full", as_of_year).alias("p")).select("engine", "filename", "p.*")


def write_stream(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Everything there is now, exactly once, then the query ends."""
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
