"""Sources, sinks, image stages and log analytics: what is written is read back, each beside SQL over the tables it was made from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import images, pixels, score, stagelog
from ..shared import put
from ..sources import ingest, sinks
from . import pipelines
from .card_queries import CARDS, HEUR, LETTERS, YEAR, reports
from .queries import RECORDS, _records
from .registry import query

# Labelled exports: cells with quotes, commas and line feeds, every third row wrapped in one more pair of quotes


def _quoted(c: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))


def _export(t) -> str:
    """customer as a labelled export of few files' size, written as text."""
    k = F.col("c_custkey")
    address = F.when(k % 4 == 0, "").when(k % 4 == 1, F.concat(F.lit('No "'), k.cast("string"), F.lit('", Road'))).otherwise(F.concat(F.lit("Road, line"), F.lit("\n"), k.cast("string")))
    row = F.concat_ws(",", F.concat(k.cast("string"), F.lit(".jpg")), F.concat(F.lit("  "), "c_name", F.lit(" ")), F.lit("1990-01-02"), _quoted(address))
    line = F.when(k % 3 == 0, _quoted(row)).otherwise(row)
    path = t.folder("export")
    body = t("customer").coalesce(1).select(line.alias("value"))
    whole = body.agg(F.concat(F.lit("filename,name,birth_date,address\n"), F.array_join(F.array_sort(F.collect_list("value")), "\n"), F.lit("\n\n")).alias("value"))
    whole.write.text(path)  # an export is one file by its nature
    return path


_ADDRESS = """CASE c_custkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'No "' || c_custkey || '", Road' ELSE 'Road, line' || chr(10) || c_custkey END"""


@query(f"SELECT c_custkey || '.jpg' AS filename, trim(c_name) AS name, CASE WHEN c_custkey = 7 THEN '1977-07-07' ELSE '1990-01-02' END AS birth_date, {_ADDRESS} AS address FROM customer")
def ground_truth_scan(t):
    """Header, repair of wrapped rows, line feeds within cells, trimmed cells, a literal override by file name."""
    return ingest.read_ground_truth(t.spark, _export(t), {"7.jpg": "1977-07-07", "none.jpg": "x"})


@query("SELECT 'short ' || n_name || ',x' AS row, 2 AS n_cells FROM nation WHERE n_nationkey % 2 = 0 UNION ALL SELECT n_name || ',b,c,d,e', 5 FROM nation WHERE n_nationkey % 2 = 1")
def failed_export_rows(t):
    path = t.folder("failed")
    name = F.col("n_name")
    rows = t("nation").orderBy("n_nationkey").select(F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("short "), name, F.lit(",x"))).otherwise(F.concat(name, F.lit(",b,c,d,e"))).alias("v")).collect()  # 25 rows
    put(t.spark, f"{path}/a.csv", "\n".join(["filename,name,birth_date,address", "fine,a,b,c", *[r["v"] for r in rows], '"wrapped,a,b,""c, d"""']).encode())
    return ingest.failed_rows(t.spark, path)


@query(f"WITH {RECORDS} SELECT filename, name, birth_date, address, CASE WHEN address <> '' THEN 'train' WHEN birth_date <> '' THEN 'val' ELSE 'test' END AS split FROM records")
def split_manifests(t):
    """Manifests per split, written and read back."""
    path = t.folder("splits")
    made = _records(t).withColumn("split", F.when(F.col("address") != "", "train").when(F.col("birth_date") != "", "val").otherwise("test"))
    sinks.write_splits(made, path)
    out = [ingest.read_split(t.spark, f"{path}/split={s}").withColumn("split", F.lit(s)) for s in ("train", "val", "test")]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("SELECT d.doc_id::VARCHAR AS filename FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def held_out_manifest(t):
    """Files without a record, as a manifest of one column."""
    path = t.folder("manifest")
    files = t("documents").select(F.col("doc_id").cast("string").alias("filename"))
    sinks.write_manifest(ingest.unlabeled(files, t("labels").select(F.col("doc_id").cast("string").alias("filename"))), path)
    return t.spark.read.schema("filename string").csv(path, header=True)


@query("SELECT l.doc_id FROM labels l WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = l.doc_id AND d.source = 'src0')")
def labels_without_files(t):
    """Records whose file is missing: the same operator, the other way round."""
    named = lambda df: df.select(F.col("doc_id").alias("filename"))
    return ingest.unlabeled(named(t("labels")), named(t("documents").filter("source = 'src0'"))).withColumnRenamed("filename", "doc_id")


@query(f"WITH {RECORDS} SELECT count(*) AS n, true AS equal, false AS changed FROM records")
def cleaned_reload(t):
    """A cleaned table written and read again has the same rows; one changed cell shows."""
    path = t.folder("cleaned")
    rows = _records(t)
    sinks.write_csv(rows, path)
    again = ingest.read_split(t.spark, path)
    other = again.withColumn("name", F.when(F.col("filename") == "1", "changed").otherwise(F.col("name")))
    equal, changed = sinks.reloads_equal(rows, again), sinks.reloads_equal(rows, other)
    return again.agg(F.count(F.lit(1)).alias("n")).select("n", F.lit(equal).alias("equal"), F.lit(changed).alias("changed"))


# Reports, logs, documents


@query(f"WITH {CARDS} SELECT 'main' AS engine, o.filename, e.name, e.birth_date, e.address, array_to_string(a, chr(10)) AS full, 7 AS blocks FROM o JOIN ts USING (filename) JOIN e USING (filename) WHERE o.split = 'val'")
def report_round_trip(t):
    """A report as one JSON document, written and read back."""
    path = t.folder("report")
    preds = reports(t).filter("split = 'val'").withColumn("predicted", F.col("expected"))
    sinks.write_report(preds, "main", score.score_predictions(preds), path)
    return ingest.read_reports(t.spark, path).select("engine", "filename", "expected.*", "raw.full", F.size("raw.blocks").alias("blocks"))


@query(f"WITH {CARDS} SELECT 'main' AS engine, e.filename, e.name, array_to_string(a, chr(10)) AS full FROM e JOIN ts USING (filename)")
def prediction_lines(t):
    """Predictions as JSON lines, for sets of any size."""
    path = t.folder("predictions")
    sinks.write_predictions(reports(t).withColumn("predicted", F.col("expected")), path, "main")
    return ingest.read_predictions(t.spark, path).select("engine", "filename", "predicted.name", "raw.full")


@query(f"""WITH {CARDS}, {HEUR}, m AS (SELECT unnest(['one', 'two']) AS method) SELECT 'main' AS engine, 'test' AS split, method, field, n, round(x, 6) AS exact_accuracy FROM m, (SELECT field, count(*) AS n, avg((regexp_replace(upper(expected), '[^A-Z0-9]', '', 'g') = regexp_replace(upper(predicted), '[^A-Z0-9]', '', 'g'))::INTEGER) AS x
FROM (SELECT unnest(['name', 'birth_date', 'address']) AS field, unnest([e.name, e.birth_date, e.address]) AS expected, unnest([p.name, p.birth_date, p.address]) AS predicted FROM e JOIN parsed p ON e.filename = p.filename WHERE e.split = 'test') l GROUP BY field) z""")
def experiment_log(t):
    """Aggregates appended to the log line by line and read back."""
    path = t.folder("log")
    metrics = pipelines.rescore(reports(t).filter("split = 'test'"), YEAR).cache()
    for method in ("one", "two"):
        sinks.log_experiment(metrics, path, "main", "test", method)
    metrics.unpersist()
    rows = score.explode_metrics(ingest.read_experiments(t.spark, path).filter("ts is not null"))
    return rows.select("engine", "split", "method", "field", "n", F.round("exact_accuracy", 6).alias("exact_accuracy"))


@query("SELECT event_id, event_type FROM events WHERE user_id = 7 ORDER BY ts")
def method_history(t):
    e = t("events").filter("user_id = 7").select("event_id", "event_type", "ts", F.lit("m").alias("method"))
    return score.history(e, "m").select("event_id", "event_type")


@query("SELECT p_partkey, p_name, 'second' AS place FROM part WHERE p_partkey = 12")
def first_match_of_tables(t):
    p = t("part").select("p_partkey", "p_name")
    tables = [p.filter("p_partkey > 100").withColumn("place", F.lit("first")), p.withColumn("place", F.lit("second")), p.withColumn("place", F.lit("third"))]
    return score.first_match(tables, "p_partkey", 12)


@query("SELECT c_custkey, c_name FROM customer ORDER BY md5(c_custkey || ':42'), c_custkey LIMIT 50")
def seeded_sample(t):
    return stagelog.sample(t("customer").select("c_custkey", "c_name"), "c_custkey", 50)


@query("SELECT 'nations' AS kind, count(*) AS n, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation")
def json_document(t):
    path = t.folder("document")
    sinks.write_json(t("nation").agg(F.lit("nations").alias("kind"), F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("n_name")).alias("names")), path)
    return ingest.read_json_document(t.spark, path, "kind string, n long, names array<string>").withColumn("names", F.array_join("names", ","))


CONTRAST = """cl AS (SELECT p_partkey || '.jpg' AS filename, CASE WHEN p_partkey % 7 = 0 THEN 'failed' ELSE 'ok' END AS status, CASE WHEN p_partkey % 7 = 0 THEN 'bad, "file"' END AS reason, p_size::DOUBLE AS before, p_size + 0.5::DOUBLE AS after, (p_partkey % 20) / 100.0::DOUBLE AS low, (p_partkey % 13) / 100.0::DOUBLE AS high FROM part)"""


def _contrast_log(t) -> DataFrame:
    """A contrast log of parts, written as CSV and read back with its declared types."""
    k = F.col("p_partkey")
    value = {
        "filename": F.concat(k.cast("string"), F.lit(".jpg")), "status": F.when(k % 7 == 0, "failed").otherwise("ok"), "reason": F.when(k % 7 == 0, 'bad, "file"'), "method": F.lit("stretch"),
        "original_brightness_mean": F.col("p_size").cast("double"), "final_brightness_mean": F.col("p_size") + 0.5, "final_l_clip_low_ratio": (k % 20) / 100, "final_l_clip_high_ratio": (k % 13) / 100,
    }
    path = t.folder("contrast")
    sinks.write_csv(t("part").select(*[value.get(f.name, F.lit(None).cast(f.dataType)).alias(f.name) for f in ingest.CONTRAST_LOG.fields]), path)
    return ingest.read_log(t.spark, path, ingest.CONTRAST_LOG)


@query(f"WITH {CONTRAST} SELECT filename, status, reason, before AS original_brightness_mean, after AS final_brightness_mean, low AS final_l_clip_low_ratio FROM cl")
def log_reload(t):
    return _contrast_log(t).select("filename", "status", "reason", "original_brightness_mean", "final_brightness_mean", "final_l_clip_low_ratio")


@query(f"WITH {CONTRAST} SELECT filename FROM cl WHERE low >= 0.1 OR high >= 0.1")
def clip_risk(t):
    return stagelog.clip_risk(_contrast_log(t)).select("filename")


@query(f"""WITH {CONTRAST}, r AS (SELECT p_partkey || '.jpg' AS filename, p_size > 25 AS down, p_size < 5 AS tiny FROM part WHERE p_partkey % 3 <> 0), l AS (SELECT p_partkey || '.jpg' AS filename FROM part WHERE p_partkey % 5 <> 0)
SELECT count(*) AS files, count_if(cl.status = 'ok' AND r.filename IS NOT NULL AND l.filename IS NOT NULL)::BIGINT AS ok, count_if(coalesce(down, false))::BIGINT AS downscaled, count_if(coalesce(tiny, false))::BIGINT AS very_low_res, round(avg(before), 6) AS brightness_before, round(avg(after), 6) AS brightness_after FROM cl LEFT JOIN r USING (filename) LEFT JOIN l USING (filename)""")
def review_summary(t):
    """One row of counts and means over the merged logs; flags of files that a stage never saw count as false."""
    name = F.concat(F.col("p_partkey").cast("string"), F.lit(".jpg")).alias("filename")
    log = lambda cond, *cols: t("part").filter(cond).select(name, F.lit("ok").alias("status"), F.lit("").alias("reason"), *cols)
    resize = log("p_partkey % 3 <> 0", (F.col("p_size") > 25).alias("downscaled"), (F.col("p_size") < 5).alias("very_low_res"))
    merged = stagelog.consolidate(log("p_partkey % 5 <> 0"), resize, _contrast_log(t).select("filename", "status", "reason", "original_brightness_mean", "final_brightness_mean"))
    out = stagelog.review(merged)
    return out.select("files", "ok", "downscaled", "very_low_res", F.round("brightness_before", 6).alias("brightness_before"), F.round("brightness_after", 6).alias("brightness_after"))


@query("SELECT p_partkey, p_size, p_partkey % 10 <> 0 AS matches FROM part")
def spot_checks(t):
    """Logged values against actual ones."""
    p = t("part").select("p_partkey", "p_size", "p_brand")
    actual = p.withColumn("p_size", F.when(F.col("p_partkey") % 10 == 0, F.col("p_size") + 1).otherwise(F.col("p_size")))
    return stagelog.spot_check(p, actual, "p_partkey", ["p_size", "p_brand"]).select("p_partkey", "p_size", "matches")


@query("SELECT p_partkey FROM part WHERE p_size >= 0")
def held_invariants(t):
    """Rows under a condition that holds for all; one that doesn't would raise."""
    return stagelog.hold(t("part"), F.col("p_size") >= 0, "a size below zero").select("p_partkey")


# Images and files: one of each nation


def _picture(k: int) -> bytes:
    """A flat grey image of 40 + 4k by 30 + 3k pixels; every fifth is broken, every fourth has one channel."""
    width, height, grey = 40 + 4 * k, 30 + 3 * k, 10 + 9 * k
    if k % 5 == 4:
        return b"no image"
    if k % 4 == 0:
        return b"P5 %d %d 255\n" % (width, height) + bytes([grey]) * (width * height)
    return b"P6 %d %d 255\n" % (width, height) + bytes([grey]) * (3 * width * height)


def _pictures(t) -> tuple[DataFrame, str]:
    path = t.folder("pictures")
    for r in t("nation").select("n_nationkey").collect():  # 25 rows
        k = r["n_nationkey"]
        put(t.spark, f"{path}/{k % 3}/{k}.{('PNG', 'txt', 'jpg')[k % 3]}", _picture(k))
    return t.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path), path


PICTURES = "p AS (SELECT n_nationkey AS k, n_nationkey || '.' || ['PNG', 'txt', 'jpg'][n_nationkey % 3 + 1] AS filename, n_nationkey % 5 <> 4 AS good, n_nationkey % 4 = 0 AS grey, 40 + 4 * n_nationkey AS w, 30 + 3 * n_nationkey AS h FROM nation), s AS (SELECT *, least(1.0::DOUBLE, 100.0::DOUBLE / greatest(w, h)) AS f FROM p)"
_BYTES = "CASE WHEN NOT good THEN 8 ELSE 11 + length(w::VARCHAR) - 2 + length(h::VARCHAR) - 2 + w * h * CASE WHEN grey THEN 1 ELSE 3 END + 2 END"


@query(f"WITH {PICTURES} SELECT filename, ({_BYTES})::BIGINT AS length, k % 3 <> 1 AS image FROM p")
def directory_scan(t):
    """All files below a folder, and those with an image's suffix in either case."""
    _, path = _pictures(t)
    some = ingest.list_files(t.spark, path, images_only=True).select("filename", F.lit(True).alias("image"))
    return ingest.list_files(t.spark, path).select("filename", "length").join(some, "filename", "left").na.fill(False, ["image"])


@query(f"WITH {PICTURES} SELECT filename, ({_BYTES})::BIGINT AS bytes, CASE WHEN good THEN 'PPM' END AS format, CASE WHEN good THEN CASE WHEN grey THEN 'L' ELSE 'RGB' END END AS mode, CASE WHEN good THEN w ELSE 0 END AS width, CASE WHEN good THEN h ELSE 0 END AS height, good AS is_valid FROM p")
def image_inventory(t):
    return images.inventory(_pictures(t)[0]).select("filename", "bytes", "format", "mode", "width", "height", "is_valid").na.fill(0, ["width", "height"])


@query(f"WITH {PICTURES} SELECT filename, CASE WHEN good THEN 'ok' ELSE 'failed' END AS status, CASE WHEN good THEN h ELSE 0 END AS height, CASE WHEN good THEN w ELSE 0 END AS width, CASE WHEN good THEN 3 ELSE 0 END AS channels FROM p")
def image_load_log(t):
    """A row for each file; one that can't be decoded fails alone."""
    return images.load_images(_pictures(t)[0]).select("filename", "status", "height", "width", "channels").na.fill(0)


@query(f"WITH {PICTURES} SELECT filename, w AS original_width, greatest(round_even(w * f, 0), 1)::INTEGER AS final_width, greatest(round_even(h * f, 0), 1)::INTEGER AS final_height, w > 100 AS downscaled, w < 60 AS very_low_res FROM s WHERE good")
def image_resize_log(t):
    out = images.resize_images(_pictures(t)[0], cap=100, low=60).filter("status = 'ok'")
    return out.select("filename", "original_width", "final_width", "final_height", "downscaled", "very_low_res")


@query(f"WITH {PICTURES} SELECT k || '.ppm' AS filename, (9 + length(round_even(w * f, 0)::INTEGER::VARCHAR) + length(round_even(h * f, 0)::INTEGER::VARCHAR) + 3 * round_even(w * f, 0)::INTEGER * round_even(h * f, 0)::INTEGER)::BIGINT AS length, round_even(w * f, 0)::INTEGER AS width, 10 + 9 * k AS grey FROM s WHERE good")
def image_sink(t):
    """Resized pictures written as files of their own and read back: their sizes and the grey of their first pixel."""
    path = t.folder("resized").removeprefix("file:")
    files, _ = _pictures(t)
    sinks.write_files(images.changed(files, lambda rgb: images.resized(rgb, 100)), path).agg(F.sum("bytes")).collect()
    back = t.spark.read.format("binaryFile").load(path)
    read = images.load_images(back).select("filename", "width")
    first = back.select(F.element_at(F.split("path", "/"), -1).alias("filename"), "length", F.conv(F.hex(F.substring("content", -1, 1)), 16, 10).cast("int").alias("grey"))
    return first.join(read, "filename")


_LIGHT = "CASE WHEN y > 216 / 24389.0::DOUBLE THEN 116 * cbrt(y) - 16 ELSE y * 24389 / 27.0::DOUBLE END"


@query(f"WITH {PICTURES}, c AS (SELECT *, (10 + 9 * k) / 255.0::DOUBLE AS v FROM p WHERE good), l AS (SELECT *, CASE WHEN v <= 0.04045 THEN v / 12.92 ELSE ((v + 0.055) / 1.055) ** 2.4 END AS y FROM c) SELECT filename, 'ok' AS status, round({_LIGHT}, 3) AS lightness, round({_LIGHT}, 3) AS stretch_low, 0.0::DOUBLE AS clipped FROM l")
def image_contrast_log(t):
    """Lightness figures of flat pictures: percentiles equal the one value there is, and nothing is stretched or clipped."""
    out = images.normalize_contrast(_pictures(t)[0]).filter("status = 'ok'")
    return out.select("filename", "status", F.round(F.col("original_brightness_mean") / 2.55, 3).alias("lightness"), F.round(F.col("stretch_low") / 2.55, 3).alias("stretch_low"), (F.col("final_l_clip_low_ratio") + F.col("final_l_clip_high_ratio")).alias("clipped"))


@query(f"WITH {PICTURES}, z AS (SELECT unnest(['grayscale', 'perspective', 'full', 'no such step']) AS step) SELECT step, filename, CASE WHEN k < 3 THEN w ELSE 200 END AS width, CASE WHEN k < 3 THEN h ELSE 300 END AS height FROM (SELECT * FROM p WHERE good AND k < 3 UNION ALL SELECT 90, 'card.ppm', true, false, 200, 300) q, z WHERE q.k < 3 OR step = 'grayscale' UNION ALL SELECT step, 'card.ppm', 159, 99 FROM z WHERE step <> 'grayscale'")
def preprocessing_steps(t):
    """Pictures through each named step; an unknown name means all steps. Flat ones keep their size, a card on a dark ground is cut out upright."""
    import numpy as np

    ground = np.full((300, 200, 3), 20, np.uint8)
    ground[60:160, 20:180] = 220
    path = t.folder("card")
    put(t.spark, f"{path}/card.ppm", pixels.encode(ground))
    files = _pictures(t)[0].filter(F.col("path").rlike(r"/[0-2]\.[A-Za-z]+$")).unionByName(t.spark.read.format("binaryFile").load(path))
    out = None
    for step in ("grayscale", "perspective", "full", "no such step"):
        run = images.preprocessing(step)
        one = images.load_images(images.changed(files, lambda rgb, run=run: pixels.decode(run(pixels.encode(rgb)))).withColumnRenamed("filename", "path"))
        one = one.select(F.lit(step).alias("step"), F.regexp_replace("filename", r"\.ppm$", "").alias("stem"), "width", "height")
        out = one if out is None else out.unionByName(one)
    names = files.select(F.element_at(F.split("path", "/"), -1).alias("filename")).withColumn("stem", F.regexp_replace("filename", r"\.[^.]*$", ""))
    return out.join(names, "stem").select("step", "filename", "width", "height")


def _transcripts(t) -> tuple[DataFrame, DataFrame]:
    """A text file for each nation, every third of which has a record."""
    path = t.folder("transcripts")
    rows = t("nation").select("n_nationkey", "n_name", F.translate("n_name", "0123456789", LETTERS[1]).alias("name")).collect()  # 25 rows
    for r in rows:
        k = r["n_nationkey"]
        body = "\n" if k % 7 == 6 else f"IDENTITY CARD\nOMAR {r['name']}\nBorn {k % 28 + 1}.03.1990\nJalan {r['name']} 3"
        put(t.spark, f"{path}/{k}.txt", body.encode() if k % 9 != 8 else b"\xff\xfe")
    records = t("nation").filter("n_nationkey % 3 = 0").select(F.concat(F.col("n_nationkey").cast("string"), F.lit(".txt")).alias("filename"))
    return t.spark.read.format("binaryFile").load(path), records


HELD_OUT = f"""h AS (SELECT n_nationkey AS k, n_nationkey || '.txt' AS filename, {"upper(translate(n_name, '0123456789', 'ABCDEFGHIJ'))"} AS nm, n_nationkey % 9 <> 8 AS good, n_nationkey % 7 <> 6 AND n_nationkey % 9 <> 8 AS has FROM nation WHERE n_nationkey % 3 <> 0),
hp AS (SELECT filename, CASE WHEN good THEN 'ok' ELSE 'failed' END AS status, CASE WHEN has THEN 'OMAR ' || nm ELSE '' END AS name, CASE WHEN has THEN '1990-03-' || lpad((k % 28 + 1)::VARCHAR, 2, '0') ELSE '' END AS birth_date, CASE WHEN has THEN 'JALAN ' || nm || ' 3' ELSE '' END AS address FROM h)"""


@query(f"WITH {HELD_OUT} SELECT * FROM hp")
def held_out_predictions(t):
    """Files without a record, read by an engine and parsed: a file that can't be read has its status and empty fields."""
    files, records = _transcripts(t)
    listed = ingest.unlabeled(files.select(F.element_at(F.split("path", "/"), -1).alias("filename"), "path", "content"), records)
    return pipelines.predict_images(listed, "text", as_of_year=YEAR).drop("reason")


@query(f"WITH {HELD_OUT} SELECT count(*) AS files, count_if(name <> '')::BIGINT AS with_name, count_if(birth_date <> '')::BIGINT AS with_birth_date, count_if(address <> '')::BIGINT AS with_address FROM hp")
def held_out_coverage(t):
    """What can be said of files without a record: how many had which field."""
    return pipelines.coverage(held_out_predictions(t))
