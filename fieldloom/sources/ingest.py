"""Sources: labelled CSV exports with repair, split manifests, OCR reports, experiment logs, image folders.

Schemas are declared, never inferred. Blank CSV cells are '' in the core tables, not null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.vocabulary import FIELDS, IMAGE_SUFFIXES

S, D = T.StringType(), T.DoubleType()


def _struct(names: tuple[str, ...] | list[str], kind: T.DataType = S) -> T.StructType:
    return T.StructType([T.StructField(n, kind) for n in names])


# Names and types of the files' columns.
COLUMNS = ("filename", *FIELDS)
RECORD = _struct(COLUMNS)
BLOCK = T.StructType([T.StructField("text", S), T.StructField("bbox", T.ArrayType(T.ArrayType(D))), T.StructField("confidence", D)])
RAW = T.StructType([T.StructField("full", S), T.StructField("blocks", T.ArrayType(BLOCK))])
PREDICTION = T.StructType([T.StructField("filename", S), T.StructField("expected", _struct(FIELDS)), T.StructField("predicted", _struct(FIELDS)), T.StructField("raw", RAW)])
FIELD_METRICS = T.StructType(
    [T.StructField(n, D) for n in ("exact_accuracy", "nonempty_expected_exact_accuracy", "empty_expected_exact_accuracy")]
    + [T.StructField("n_nonempty_expected", T.LongType())]
    + [T.StructField(n, D) for n in ("mean_normalized_edit_distance", "character_error_rate", "word_error_rate")]
    + [T.StructField("n", T.LongType())]
)
METRICS = T.StructType([T.StructField("n", T.LongType()), T.StructField("all_fields_exact_accuracy", D), T.StructField("fields", T.MapType(S, FIELD_METRICS))])
REPORT = T.StructType([T.StructField("engine", S), T.StructField("metrics", METRICS), T.StructField("predictions", T.ArrayType(PREDICTION))])
#: The file's name and the end of its first line where sinks.write_report wrote a report with a prediction a line.
REPORT_BY_LINE, REPORT_HEAD_END = "report-by-line.json", '"predictions":['
EXPERIMENT = T.StructType([T.StructField("timestamp", S), *[T.StructField(n, S) for n in ("engine", "split", "method")], T.StructField("metrics", METRICS)])
LOAD_LOG = T.StructType([T.StructField(n, S) for n in ("filename", "status", "reason")] + [T.StructField(n, T.IntegerType()) for n in ("height", "width", "channels")])
RESIZE_LOG = T.StructType(
    [T.StructField(n, S) for n in ("filename", "status", "reason")]
    + [T.StructField(n, T.IntegerType()) for n in ("original_width", "original_height", "original_long_side", "final_width", "final_height", "final_long_side")]
    + [T.StructField(n, T.BooleanType()) for n in ("downscaled", "very_low_res")]
)
CONTRAST_LOG = T.StructType(
    [T.StructField(n, S) for n in ("filename", "status", "reason", "method")]
    + [T.StructField(n, D) for n in ("low_percentile", "high_percentile", "stretch_low", "stretch_high", "original_brightness_mean", "final_brightness_mean", "final_l_clip_low_ratio", "final_l_clip_high_ratio")]
)


OPTIONS = {"quote": '"', "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "bad"}
ROW = T.StructType([*RECORD.fields, T.StructField("bad", S)])


def parse_rows(spark: SparkSession, path: str) -> DataFrame:
    """filename, name, birth_date, address, row (the text of an odd row), n_cells. Cells may hold line feeds.

    A row wrapped in one more pair of quotes has one cell, which is parsed a second time. Cells are counted where a row has
    not just the four.
    """
    rows = spark.read.schema(ROW).options(**OPTIONS, header=True, enforceSchema=False, multiLine=True).csv(path)
    odd = F.col("bad").isNotNull()
    wrapped = odd & F.col("name").isNull() & F.col("filename").contains(",") & F.col("bad").rlike(r'^[\x{feff}\s]*"')
    again = F.from_csv("filename", ", ".join(f"{c} STRING" for c in (*COLUMNS, "bad")), OPTIONS)
    whole = F.struct(*[F.col(c) for c in (*COLUMNS, "bad")])
    out = rows.select(F.when(wrapped, again).otherwise(whole).alias("r")).select("r.*")
    bare = F.regexp_replace("bad", '"(?:[^"]|"")*"', "")
    n = F.when(F.col("bad").isNull(), len(COLUMNS)).otherwise(F.length(bare) - F.length(F.replace(bare, F.lit(","), F.lit(""))) + 1)
    return out.select(*COLUMNS, F.regexp_replace("bad", r"[\r\n]+$", "").alias("row"), n.alias("n_cells"))


def check_header(spark: SparkSession, path: str) -> None:
    """Raises unless the first line that has anything names the four columns. The CSV reader's own check names columns only where it reads."""
    head = spark.read.options(header=True, multiLine=True, quote='"', escape='"').csv(path).columns
    if [c.lstrip("\ufeff") for c in head] != list(COLUMNS):
        raise ValueError(f"{path} does not begin with {','.join(COLUMNS)}")


def read_ground_truth(spark: SparkSession, path: str, overrides: dict[str, str] | None = None, strict: bool = True) -> DataFrame:
    """filename, name, birth_date, address: repaired, trimmed, blanks as ''. A wrong header or too short a row raises where strict.

    overrides: birth dates by file name that replace what the export has.
    """
    check_header(spark, path)
    body = parse_rows(spark, path)
    short = F.col("n_cells") < len(COLUMNS)
    if strict:
        body = body.filter(F.when(short, F.raise_error(F.concat(F.lit("too few cells: "), F.col("row"))).cast("boolean")).otherwise(True))
    else:
        body = body.filter(~short)
    clean = body.select(*[F.regexp_replace(F.coalesce(c, F.lit("")), r"^[\s\p{Z}]+|[\s\p{Z}]+$", "").alias(c) for c in COLUMNS])
    return override_dates(clean, overrides or {})


def failed_rows(spark: SparkSession, path: str) -> DataFrame:
    """Rows of an export that do not have exactly four cells after repair."""
    return parse_rows(spark, path).filter(F.col("n_cells") != len(COLUMNS)).select("row", "n_cells")


def override_dates(records: DataFrame, overrides: dict[str, str]) -> DataFrame:
    """A few literals: a map in the expression, so no join."""
    if not overrides:
        return records
    table = F.create_map(*[F.lit(x) for kv in sorted(overrides.items()) for x in kv])
    return records.withColumn("birth_date", F.coalesce(F.try_element_at(table, F.col("filename")), F.col("birth_date")))


def read_split(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RECORD).csv(path, header=True, escape='"').na.fill("")


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """engine and one row per prediction: filename, expected, predicted, raw.

    Files that write_report left are read by lines, in parts; any other document is read whole by one task.
    """
    docs = spark.read.schema(REPORT).json(path, multiLine=True).filter(F.col("_metadata.file_name") != REPORT_BY_LINE)
    whole = docs.select("engine", F.explode("predictions").alias("p"))
    lines = spark.read.text(path, lineSep="\n", pathGlobFilter=REPORT_BY_LINE).select("value", F.col("_metadata.file_path").alias("file"))
    is_head = F.col("value").endswith(REPORT_HEAD_END)  # a prediction's line ends with a brace
    heads = lines.filter(is_head).select("file", F.from_json(F.concat("value", F.lit("]}")), "engine string", {"mode": "FAILFAST"})["engine"].alias("engine"))
    body = lines.filter(~is_head & (F.col("value") != "]}")).withColumn("p", F.from_json(F.ltrim("value", F.lit(",")), PREDICTION, {"mode": "FAILFAST"}))
    return whole.unionByName(body.join(F.broadcast(heads), "file").select("engine", "p")).select("engine", "p.*")


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """The rows that write_predictions left: engine and one row per prediction."""
    return spark.read.schema(T.StructType([T.StructField("engine", S), *PREDICTION.fields])).json(path)


def read_experiments(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EXPERIMENT).json(path).withColumn("ts", F.to_timestamp("timestamp"))


def read_log(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A stage log written as CSV with a header; its types are declared."""
    return spark.read.schema(schema).csv(path, header=True, escape='"')


def read_json_document(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).json(path, multiLine=True)


def list_files(spark: SparkSession, root: str, images_only: bool = False) -> DataFrame:
    """filename, path, length; contents are never read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length")
    found = found.select(F.element_at(F.split("path", "/"), -1).alias("filename"), "path", "length")
    if images_only:
        found = found.filter(F.lower(F.regexp_extract("filename", r"\.([^.]+)$", 1)).isin(*IMAGE_SUFFIXES))
    return found


def unlabeled(files: DataFrame, records: DataFrame) -> DataFrame:
    """Files without a record, sorted by name."""
    return files.join(records.select("filename"), "filename", "left_anti").orderBy("filename")


def with_ground_truth_flag(files: DataFrame, records: DataFrame) -> DataFrame:
    marks = records.select("filename").distinct().withColumn("has_ground_truth", F.lit(True))
    return files.join(marks, "filename", "left").na.fill(False, ["has_ground_truth"])


def audit(records: DataFrame) -> DataFrame:
    """One row: rows, duplicate file names, empties per field, dates not in ISO form."""
    return records.agg(
        F.count(F.lit(1)).alias("rows"),
        (F.count("filename") - F.count_distinct("filename")).alias("duplicate_filenames"),
        *[F.count_if(F.col(c) == "").alias(f"empty_{c}") for c in FIELDS],
        F.count_if((F.col("birth_date") != "") & ~F.col("birth_date").rlike(r"^\d{4}-\d{2}-\d{2}$")).alias("odd_dates"),
    )


def odd_dates(records: DataFrame) -> DataFrame:
    return records.filter((F.col("birth_date") != "") & ~F.col("birth_date").rlike(r"^\d{4}-\d{2}-\d{2}$"))
